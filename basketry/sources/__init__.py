from basketry.sources.baskets import BasketData, from_arrays, from_table  # noqa: F401
