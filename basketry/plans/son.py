"""SON: two passes over P chunks (M-1..M-3).

Pass 1 mines every chunk at its own threshold ``s * n_c`` (minus a tiny
slack, Q6) -- all chunks in the same Spark jobs, the chunk id being one more
key column.  The distinct union of the local results is the candidate set
(A-7).  Pass 2 counts every candidate in every basket (JN-5: one walk of
the candidates' prefix tree per distinct basket) and keeps those reaching
``s * N``.  Chunking cannot change the result: every globally frequent
itemset is locally frequent in at least one chunk.  Its items are globally
frequent too, so the full query mines occurrences of those items only, which
keeps small chunks from making candidates of rare items.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.operators.dictionary import decode_itemsets
from basketry.operators.levels import basket_rows, only
from basketry.operators.positions import chunk_starts, hash_chunks, in_chunks, with_positions
from basketry.operators.support import item_support, support_filter
from basketry.operators.tree import contained_sets, contained_support
from basketry.plans.apriori import Levels, mine_levels
from basketry.session import write_counted, write_table
from basketry.sources.baskets import BasketData


@dataclass
class Chunked:
    occ: DataFrame      # (chunk_id, basket, item)
    keys: DataFrame     # (basket, chunk_id)
    sizes: DataFrame    # (chunk_id, n)   A-5, one row per non-empty chunk


def chunk_baskets(data: BasketData, chunks: int, chunking: str = "hash",
                  order_cols=None, occ: DataFrame | None = None) -> Chunked:
    """WIN-1 (contiguous, in ascending ``order_cols`` order) or hash chunks,
    of all occurrences or of ``occ``, a part of them.

    Contiguous: the baskets are sorted once to find the first key of every
    chunk; an occurrence finds its chunk by binary search of those keys, so it
    is not joined with its basket.  ``order_cols`` are columns or fields of
    ``basket``; baskets equal in all of them go by ``basket`` itself.
    """
    occ = data.occ if occ is None else occ
    if chunking == "hash":
        keys = hash_chunks(data.keys, "basket", chunks).select("basket", "chunk_id")
        occ = hash_chunks(occ, "basket", chunks)
    elif chunking == "contiguous":
        order = F.struct(*[F.col(c).alias(f"k{i}") for i, c in
                           enumerate([*(order_cols or []), "basket"])])
        first = write_table(chunk_starts(data.keys.select(order.alias("key")), "key", chunks,
                                         data.n), "starts")
        keys = in_chunks(data.keys, order, first, chunks)
        occ = in_chunks(occ, order, first, chunks)
    else:
        raise ValueError(f"unknown chunking {chunking!r}")
    sizes = write_table(keys.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n")), "sizes")
    return Chunked(occ=write_table(occ.select("chunk_id", "basket", "item"), "chunked"),
                   keys=keys, sizes=sizes)


def local_levels(ch: Chunked, min_support: float, max_len=None) -> Levels:
    """M-1: locally frequent itemsets of every chunk (coded)."""
    return mine_levels(ch.occ, min_support, sizes=ch.sizes, part_cols=["chunk_id"],
                       max_len=max_len)


def candidates(local: Levels) -> tuple[DataFrame, int]:
    """A-7 / U-2: distinct union of the local itemsets -> ``(items, size,
    id)``, numbered in lexicographic order, and how many there are."""
    union = local.coded().select("items").distinct().withColumn("size", F.size("items"))
    return write_counted(with_positions(union, ["items"], "id"), "candidates")


def candidate_items(occ: DataFrame, local: Levels, cand: DataFrame) -> DataFrame:
    """JN-6: the occurrences ``(basket, item)`` of candidate items."""
    c1 = cand.where(F.col("size") == 1).select(F.col("items")[0].alias("code"))
    items = local.dictionary.join(c1, "code", "left_semi")
    return only(occ, items, key="item")


def candidate_rows(occ: DataFrame, local: Levels, cand: DataFrame, part_cols=(),
                   basket: str | None = None) -> DataFrame:
    """Baskets as rows of their candidate items (see ``basket_rows``)."""
    c1 = cand.where(F.col("size") == 1).select(F.col("items")[0].alias("code"))
    coded = local.dictionary.join(c1, "code", "left_semi")
    occ1 = occ.join(coded, "item").select(*part_cols, "basket", "code")
    return write_table(basket_rows(occ1, part_cols, basket, least=1), "rows")


def contained_candidates(occ: DataFrame, local: Levels, cand: DataFrame, n: int) -> DataFrame:
    """JN-5: the candidates contained in each basket, ``(basket, items)``, of
    all sizes in one pass."""
    return contained_sets(candidate_rows(occ, local, cand, basket="basket"), cand, n)


def count_candidates(occ: DataFrame, local: Levels, cand: DataFrame, n: int,
                     part_cols=()) -> DataFrame:
    """M-2 / JN-5 + A-8: the candidates' counts ``(*part, items, freq)``."""
    return contained_support(candidate_rows(occ, local, cand, part_cols), cand, n, part_cols)


def son_levels(data: BasketData, min_support: float, chunks: int, max_len=None,
               chunking: str = "hash", order_cols=None):
    """Both passes over ``chunks`` chunks; returns (local Levels, candidate
    table, global counts)."""
    items = write_table(support_filter(item_support(data.occ), min_support, n=data.n), "items")
    ch = chunk_baskets(data, chunks, chunking, order_cols, only(data.occ, items, key="item"))
    local = local_levels(ch, min_support, max_len)
    cand, n = candidates(local)
    return ch, local, cand, count_candidates(ch.occ, local, cand, n)


def son_itemsets(data: BasketData, min_support: float, chunks: int, max_len=None,
                 chunking: str = "hash", order_cols=None) -> DataFrame:
    """M-3: ``(itemset, size, freq)``, the same result as Apriori."""
    ch, local, cand, totals = son_levels(data, min_support, chunks, max_len,
                                         chunking, order_cols)
    return decode_itemsets(support_filter(totals, min_support, n=data.n), local.dictionary)
