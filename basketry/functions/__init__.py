from basketry.functions.expressions import (  # noqa: F401
    WS,
    basket_canonical,
    drop_last,
    itemset_key,
    itemset_last,
    itemset_prefix,
    report_line,
    split_lines,
    tokens_single_space,
    tokens_whitespace,
)
