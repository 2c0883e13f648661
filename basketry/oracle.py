"""DuckDB SQL for every registered query (the correctness oracle).

Built from one levelwise template: ``b(bid, item)`` distinct occurrences,
``n`` the number of baskets, then per level k: extend the occurrences of
L_{k-1} by a larger item of the same basket, count, keep ``count >= s * n``
in DOUBLE.  ``K`` levels are spelled out; K is above the longest itemset of
every fixture, and levels past the longest are empty.
"""

from __future__ import annotations

from basketry import catalog as C

K = 8
WS = r"'[ \t\n\r\f]+'"
LINE_BREAK = r"'\r\n|\r|\n'"


def _s(s: float) -> str:
    return f"cast({s!r} as double)"


def _tokens(expr: str) -> str:
    return f"list_filter(regexp_split_to_array({expr}, {WS}), lambda x: x <> '')"


# -- fixtures: b(bid, item) and n ----------------------------------------------------

LINES = ("lines as (select doc_id, cast(unnest(generate_series(0, len(arr) - 1)) as bigint)"
         " as line_no, unnest(arr) as line from (select doc_id, string_split(text, chr(10))"
         " as arr from documents))")

FIXTURES = {
    "order_brand": [
        "b as (select distinct l_orderkey as bid, p_brand as item"
        " from lineitem join part on l_partkey = p_partkey)",
        "n as (select count(distinct bid) as n from b)"],
    "user_day_event": [
        "b as (select distinct {'user_id': user_id, 'day': cast(ts as date)} as bid,"
        " event_type as item from events where event_type is not null)",
        "n as (select count(distinct bid) as n from b)"],
    "doc_tokens": [
        "b as (select distinct bid, item from (select doc_id as bid,"
        f" unnest({_tokens('text')}) as item from documents))",
        "n as (select count(*) as n from documents)"],
    "doc_lines": [
        LINES,
        "b as (select distinct bid, item from (select {'doc_id': doc_id, 'line_no': line_no}"
        f" as bid, unnest({_tokens('line')}) as item from lines))",
        "n as (select count(*) as n from lines)"],
}


def levels(s: float, chunked: bool = False, src: str = "b", kmax: int = K) -> list[str]:
    """l1..lK (counts), fb (frequent occurrences), o1..oK (occurrences of
    L_k), x2..xK (extensions before the support filter)."""
    c = "c, " if chunked else ""
    on_c = lambda a, b: f"{a}.c = {b}.c and " if chunked else ""
    if chunked:
        thr = f"join nc on g.c = nc.c where g.freq >= {_s(s)} * nc.n - greatest(1e-6, 1e-9 * {_s(s)} * nc.n)"
    else:
        thr = f"where g.freq >= {_s(s)} * (select n from n)"
    out = [
        f"l1 as (select g.* from (select {c}[item] as items, count(*) as freq from {src}"
        f" group by {c}item) g {thr})",
        f"fb as (select x.* from {src} x semi join l1 on {on_c('x', 'l1')}[x.item] = l1.items)",
        f"o1 as (select {c}bid, [item] as items, item as last from fb)",
    ]
    for k in range(2, kmax + 1):
        out += [
            f"x{k} as (select {'o.c, ' if chunked else ''}o.bid, list_append(o.items, f.item)"
            f" as items, f.item as last from o{k - 1} o join fb f"
            f" on {on_c('o', 'f')}o.bid = f.bid and f.item > o.last)",
            f"l{k} as (select g.* from (select {c}items, count(*) as freq from x{k}"
            f" group by {c}items) g {thr})",
            f"o{k} as (select x.* from x{k} x semi join l{k} l"
            f" on {on_c('x', 'l')}x.items = l.items)",
        ]
    return out


def union(prefix: str, cols: str, kmin: int = 1, kmax: int = K) -> str:
    return " union all ".join(f"select {cols} from {prefix}{k}" for k in range(kmin, kmax + 1))


def result(fixture: str, s: float) -> list[str]:
    """CTEs ending in ``res(itemset, size, freq)``."""
    return FIXTURES[fixture] + levels(s) + [
        "res as (select array_to_string(items, ' ') as itemset, cast(len(items) as integer)"
        f" as size, cast(freq as bigint) as freq from ({union('l', 'items, freq')}))"]


def sql(ctes: list[str], select: str) -> str:
    return "with " + ",\n".join(ctes) + "\n" + select


RES_COLS = "select itemset, size, freq from res"

# contiguous chunks of user_day_event in (user_id, day) order
CHUNKS = [
    "keys as (select distinct bid from b)",
    "pos as (select bid, row_number() over (order by bid.user_id, bid.day) - 1 as p from keys)",
    f"ck as (select bid, p, p // (select cast(ceil(n / {float(C.P_UDC)}) as bigint) from n)"
    " as c from pos)",
    "bc as (select ck.c, b.bid, b.item from b join ck on b.bid = ck.bid)",
    "nc as (select c, count(*) as n from ck group by c)",
]
UDC = FIXTURES["user_day_event"] + CHUNKS
UDC_LOCAL = UDC + levels(C.S_UDC, chunked=True, src="bc")
UDC_ARR = ("arr as (select bid, array_to_string(list_sort(list(item)), ' ') as value"
           " from b group by bid)")


def containment(kmax: int = K) -> list[str]:
    """SON candidates (distinct local itemsets) and their occurrences in
    every basket, level by level (q1, r2..rK)."""
    out = [f"cand as (select distinct items from ({union('l', 'items')}))",
           "fq as (select b.* from b semi join cand on [b.item] = cand.items)",
           "q1 as (select bid, [item] as items, item as last from fq)",
           "r1 as (select * from q1)"]
    for k in range(2, kmax + 1):
        out += [f"q{k} as (select o.bid, list_append(o.items, f.item) as items, f.item as last"
                f" from r{k - 1} o join fq f on o.bid = f.bid and f.item > o.last)",
                f"r{k} as (select x.* from q{k} x semi join cand on x.items = cand.items)"]
    out.append(f"allq as ({union('r', 'bid, items')})")
    return out


UDE_OUT = "bid.user_id as user_id, bid.day as day"


def _c3() -> str:
    return ("c3 as (select list_append(a.items, b2.items[2]) as items from l2 a join l2 b2"
            " on a.items[1] = b2.items[1] and a.items[2] < b2.items[2])")


def build() -> dict[str, str]:
    ob, ude = result("order_brand", C.S_OB), result("user_day_event", C.S_UDE)
    q = {}
    # 2.1 sources and sinks
    doc_lines = (f"dl as (select unnest(regexp_split_to_array(text, {LINE_BREAK})) as value"
                 " from documents)")
    canon = f"list_sort(list_distinct({_tokens('value')}))"
    q["scan_text_baskets"] = sql([doc_lines], (
        f"select value, array_to_string({canon}, ' ') as items,"
        f" cast(len({canon}) as integer) as n_items from dl"))
    q["scan_first_file"] = sql(UDC + [UDC_ARR],
                               "select arr.value from arr join ck on arr.bid = ck.bid"
                               " where ck.c = 0")
    q["scan_whole_files"] = sql(UDC + [UDC_ARR], (
        "select ck.c as chunk_id, count(*) as n_lines,"
        " cast(sum(length(arr.value)) + count(*) as bigint) as n_chars"
        " from arr join ck on arr.bid = ck.bid group by ck.c"))
    q["read_candidates"] = sql(ob, "select itemset, size from res")
    q["read_counts"] = sql(ob, "select itemset, freq from res")
    q["read_report"] = sql(ob, "select itemset, freq from res")
    q["ingest_roundtrip"] = sql([doc_lines], "select value from dl")
    q["write_chunks_roundtrip"] = sql(UDC + [UDC_ARR], (
        "select ck.c as chunk_id, arr.value from arr join ck on arr.bid = ck.bid"))
    q["text_chunks"] = (
        "with tl as (select doc_id, unnest(a) as value, generate_subscripts(a, 1) as i from"
        f" (select doc_id, regexp_split_to_array(text, {LINE_BREAK}) as a from documents)),"
        " tp as (select value, row_number() over (order by doc_id, i) - 1 as pos from tl)"
        " select pos, pos // (select cast(ceil(count(*) / "
        f"{float(C.P_UDC)}) as bigint) from tl) as chunk_id, value from tp")
    q["write_counts_roundtrip"] = sql(ude, "select itemset, freq from res")
    q["report_lines"] = sql(ob, (
        "select cast(0 as bigint) as line_no, cast(count(*) as varchar) as value from res"
        " union all select row_number() over (order by freq desc, itemset asc) as line_no,"
        " itemset || ' (' || cast(freq as varchar) || ')' as value from res"))
    # 2.2 projections
    lines_cut = ("lc as (select doc_id, cast(unnest(generate_series(0, len(arr) - 1)) as bigint)"
                 " as line_no, unnest(arr) as line from (select doc_id,"
                 " string_split(regexp_replace(text, '\\n+$', ''), chr(10)) as arr"
                 " from documents))")
    q["split_lines"] = sql([lines_cut], "select doc_id, line_no, line from lc")
    q["tokens_single_space"] = sql([LINES], (
        "select doc_id, line_no, array_to_string(t, '|') as tokens,"
        " cast(len(t) as integer) as n_tokens from (select doc_id, line_no,"
        " string_split(regexp_replace(line, ' +$', ''), ' ') as t from lines)"))
    q["tokens_whitespace"] = sql([LINES], (
        "select doc_id, line_no, array_to_string(t, '|') as tokens,"
        " cast(len(t) as integer) as n_tokens from (select doc_id, line_no,"
        f" {_tokens('line')} as t from lines)"))
    q["basket_canonical"] = (
        "select doc_id, array_to_string(c, ' ') as items, cast(len(c) as integer) as size"
        f" from (select doc_id, list_sort(list_distinct({_tokens('text')})) as c"
        " from documents)")
    q["itemset_key"] = sql(ude, (
        "select array_to_string(list_reverse(string_split(itemset, ' ')), ' ') as reversed,"
        " itemset from res"))
    q["itemset_prefix_last"] = sql(ude, (
        "select itemset, array_to_string(t[1:len(t) - 1], ' ') as prefix, t[len(t)] as last"
        " from (select itemset, string_split(itemset, ' ') as t from res where size >= 2)"))
    ob_l = FIXTURES["order_brand"] + levels(C.S_OB)
    dic = ("dic as (select items[1] as item, row_number() over (order by items[1]) - 1"
           " as code from l1)")
    q["item_dictionary"] = sql(ob_l + [dic], "select item, code from dic")
    q["itemset_decode"] = sql(ob_l + [dic], (
        "select cast(d1.code as varchar) || ' ' || cast(d2.code as varchar) as codes,"
        " array_to_string(l2.items, ' ') as itemset from l2"
        " join dic d1 on d1.item = l2.items[1] join dic d2 on d2.item = l2.items[2]"))
    q["itemsets_by_size"] = sql(ude, "select size, count(*) as n_itemsets from res group by size")
    # 2.3 filters
    q["local_frequent_items"] = sql(UDC_LOCAL, (
        "select c as chunk_id, array_to_string(items, ' ') as itemset, freq from l1"))
    q["local_frequent_pairs"] = sql(UDC_LOCAL, (
        "select c as chunk_id, array_to_string(items, ' ') as itemset, freq from l2"))
    q["local_frequent_itemsets"] = sql(UDC_LOCAL, (
        "select c as chunk_id, array_to_string(items, ' ') as itemset,"
        f" cast(len(items) as integer) as size, freq from ({union('l', 'c, items, freq', 3)})"))
    q["son_frequent_itemsets"] = sql(result("user_day_event", C.S_UDC), RES_COLS)
    q["prune_baskets"] = sql(ob_l, "select bid as basket_id, item from fb")
    # 2.4 joins
    q["candidate_gen"] = sql(ob_l + [_c3()], (
        "select array_to_string(items, ' ') as itemset, cast(3 as integer) as size from c3"))
    q["basket_pairs"] = sql(ob_l, (
        "select bid as basket_id, array_to_string(items, ' ') as itemset from x2"))
    ude_l = FIXTURES["user_day_event"] + levels(C.S_UDE)
    q["basket_k_combinations"] = sql(ude_l, (
        f"select {UDE_OUT}, array_to_string(items, ' ') as itemset from x3"))
    q["basket_frequent_itemsets"] = sql(ude_l, (
        f"select {UDE_OUT}, array_to_string(items, ' ') as itemset"
        f" from ({union('o', 'bid, items')})"))
    cont = UDC_LOCAL + containment()
    q["basket_candidates"] = sql(cont, (
        f"select {UDE_OUT}, array_to_string(items, ' ') as itemset from allq"))
    q["basket_candidate_items"] = sql(cont, f"select {UDE_OUT}, item from fq")
    q["support_lookup"] = sql(ob_l + [_c3(), "t3 as (select items, count(*) as freq from x3"
                                      " group by items)"], (
        "select array_to_string(c3.items, ' ') as itemset,"
        " cast(coalesce(t3.freq, 0) as bigint) as freq from c3 left join t3"
        " on c3.items = t3.items"))
    # 2.5 aggregations
    q["item_support"] = sql(FIXTURES["order_brand"],
                            "select item, count(*) as freq from b group by item")
    q["pair_support"] = sql(ob_l, (
        "select array_to_string(items, ' ') as itemset, count(*) as freq from x2"
        " group by items"))
    q["triple_support"] = sql(ude_l, (
        "select array_to_string(items, ' ') as itemset, count(*) as freq from x3"
        " group by items"))
    q["prefix_groups"] = sql(ob_l, (
        "select items[1] as prefix, array_to_string(list_sort(list(items[2])), ' ') as lasts"
        " from l2 group by items[1]"))
    q["chunk_sizes"] = sql(UDC, "select c as chunk_id, n from nc")
    q["basket_count"] = (
        "select 'order_brand' as fixture, count(distinct l_orderkey) as n"
        " from lineitem join part on l_partkey = p_partkey"
        " union all select 'user_day_event', count(distinct {'user_id': user_id,"
        " 'day': cast(ts as date)}) from events where event_type is not null"
        " union all select 'doc_tokens', count(*) from documents"
        " union all select 'doc_lines', cast(sum(len(string_split(text, chr(10)))) as bigint)"
        " from documents")
    q["son_candidates"] = sql(cont, (
        "select array_to_string(items, ' ') as itemset, cast(len(items) as integer) as size"
        " from cand"))
    q["partial_candidate_counts"] = sql(cont, (
        "select ck.c as chunk_id, array_to_string(allq.items, ' ') as itemset,"
        " count(*) as freq from allq join ck on allq.bid = ck.bid group by ck.c, allq.items"))
    q["candidate_support"] = sql(cont, (
        "select array_to_string(items, ' ') as itemset, cast(len(items) as integer) as size,"
        " count(*) as freq from allq group by items"))
    q["itemset_count"] = sql(ob, "select count(*) as n_itemsets from res")
    # 2.6 windows and sorts
    q["assign_chunks"] = sql(UDC, f"select {UDE_OUT}, p as pos, c as chunk_id from ck")
    q["report_ranked"] = sql(ob, (
        "select row_number() over (order by freq desc, itemset asc) as rank, itemset, size,"
        " freq from res"))
    q["local_itemsets"] = sql(UDC_LOCAL, (
        "select c as chunk_id, array_to_string(items, ' ') as itemset,"
        f" cast(len(items) as integer) as size, freq from ({union('l', 'c, items, freq')})"))
    # 2.7 strategies
    q["order_brand_itemsets"] = sql(ob, RES_COLS)
    q["apriori_itemsets"] = sql(ude, RES_COLS)
    dt = sql(result("doc_tokens", C.S_DT), RES_COLS)
    q["fpgrowth_itemsets"] = dt
    q["doc_tokens_itemsets"] = dt
    q["doc_tokens_son"] = dt
    q["doc_lines_itemsets"] = sql(result("doc_lines", C.S_DL), RES_COLS)
    return q


ORACLE = build()
