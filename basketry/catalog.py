"""Registered queries: one per operator of SURVEY §2, each on the whole
test tables (``sf_dir``).  ``oracle.py`` holds the matching DuckDB SQL.

Fixtures and parameters (FIXTURES §3):
  OB  order_brand     s = 0.02
  UDE user_day_event  s = 0.005 (levels >= 3, containment, full miner)
  UDC user_day_event  s = 0.05, P = 4 contiguous chunks by (user_id, day)
  DT  doc_tokens      s = 0.4
  DL  doc_lines       s = 0.05
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry import frequent_itemsets
from basketry.functions import expressions as X
from basketry.operators import bitmaps as BM
from basketry.operators import levels as LV
from basketry.operators.dictionary import codes_key, decode_itemsets, item_dictionary
from basketry.operators.pairs import pair_support
from basketry.operators.positions import assign_chunks, with_positions
from basketry.operators.support import (item_support, itemset_support, support_filter,
                                         support_lookup)
from basketry.plans import apriori, son
from basketry.session import scratch_path, write_table
from basketry.sources import fixtures as FX
from basketry.sources import text as TX

# The fixture parameters the oracle SQL uses as well.
S_OB = 0.02
S_UDE = 0.005
S_UDC = 0.05
P_UDC = 4
S_DT = 0.4
S_DL = 0.05
UDC_ORDER = ["basket.user_id", "basket.day"]


# -- shared pieces ------------------------------------------------------------

def _ob(spark, d):
    return FX.order_brand(spark, d)


def _ude(spark, d):
    return FX.user_day_event(spark, d)


def _ude_out(df: DataFrame, *cols) -> DataFrame:
    """Spell the struct basket key of user_day_event as two columns."""
    return df.select(F.col("basket.user_id").alias("user_id"),
                     F.col("basket.day").alias("day"), *cols)


def _ob_result(spark, d) -> DataFrame:
    return frequent_itemsets(_ob(spark, d), S_OB)


def _udc(spark, d):
    data = _ude(spark, d)
    return data, son.chunk_baskets(data, P_UDC, "contiguous", UDC_ORDER)


def _decoded(res: apriori.Levels, coded: DataFrame, part_cols=()) -> DataFrame:
    return decode_itemsets(coded, res.dictionary, list(part_cols))


def _occ_itemsets(res: apriori.Levels, occ: DataFrame) -> DataFrame:
    """Occurrence rows ``(basket, items)`` -> ``(basket, itemset)``: decode
    each distinct itemset once, then join back on the coded itemset."""
    names = write_table(decode_itemsets(
        occ.select("items").distinct().withColumn("freq", F.lit(0)),
        res.dictionary, keep_items=True), "names")
    return occ.select("basket", "items").join(names.select("items", "itemset"), "items").select(
        "basket", "itemset")


# -- 2.1 sources and sinks ---------------------------------------------------

def _doc_text_dir(spark, d) -> str:
    """Every document's text written as lines of a text dataset."""
    path = scratch_path(spark, "docs-text")
    FX.table(spark, d, "documents").select("text").write.text(path)
    return path


def q_scan_text_baskets(spark, d):
    lines = TX.scan_text(spark, _doc_text_dir(spark, d))
    canon = X.basket_canonical(X.tokens_whitespace("value"))
    return lines.select("value", F.concat_ws(" ", canon).alias("items"),
                        F.size(canon).cast("int").alias("n_items"))


def _udc_lines(spark, d):
    """UDC baskets as text lines with their chunk and position."""
    data, ch = _udc(spark, d)
    # event types: a basket holds a handful at most
    arr = data.occ.groupBy("basket").agg(F.sort_array(F.collect_list("item")).alias("items"))
    pos = assign_chunks(data.keys, UDC_ORDER, P_UDC, n=data.n)
    return pos.join(arr, "basket", "left").select(
        "basket", "pos", "chunk_id", F.concat_ws(" ", "items").alias("value"))


def _udc_chunk_dir(spark, d) -> str:
    path = scratch_path(spark, "chunks")
    TX.write_chunks(_udc_lines(spark, d), path)
    return path


def q_scan_first_file(spark, d):
    """One file per chunk here, so the first file is the first chunk."""
    path = scratch_path(spark, "first")
    TX.write_chunks(_udc_lines(spark, d), path, split=False)
    return TX.scan_first_file(spark, path).select("value")


def q_text_chunks(spark, d):
    """Documents as a text dataset in doc_id order, in contiguous chunks."""
    path = scratch_path(spark, "docs-text")
    FX.table(spark, d, "documents").orderBy("doc_id").select("text").write.text(path)
    return TX.text_chunks(spark, path, P_UDC)


def q_scan_whole_files(spark, d):
    whole = TX.scan_whole_files(spark, _udc_chunk_dir(spark, d))
    return whole.groupBy(F.col("chunk_id").cast("bigint").alias("chunk_id")).agg(
        F.sum(F.size(F.split("value", "\n")) - 1).cast("bigint").alias("n_lines"),
        F.sum(F.length("value")).cast("bigint").alias("n_chars"))


def _ob_counts_dir(spark, d, count_col="freq") -> str:
    path = scratch_path(spark, "counts")
    res = _ob_result(spark, d)
    if count_col == "one":
        res = res.withColumn("one", F.lit(1))
    TX.write_counts(res, path, count_col)
    return path


def q_read_candidates(spark, d):
    items = TX.read_candidates(spark, _ob_counts_dir(spark, d, "one"))
    return items.select(F.concat_ws(" ", "items").alias("itemset"),
                        F.size("items").cast("int").alias("size"))


def q_read_counts(spark, d):
    return TX.read_counts(spark, _ob_counts_dir(spark, d))


def q_read_report(spark, d):
    path = scratch_path(spark, "report")
    TX.write_report(_ob_result(spark, d), path)
    return TX.read_report(spark, path)


def q_ingest_roundtrip(spark, d):
    dst = scratch_path(spark, "ingest")
    TX.ingest(spark, _doc_text_dir(spark, d), dst)
    return TX.scan_text(spark, dst)


def q_write_chunks_roundtrip(spark, d):
    back = spark.read.text(_udc_chunk_dir(spark, d))
    return back.select(F.col("chunk_id").cast("bigint").alias("chunk_id"), "value")


def q_write_counts_roundtrip(spark, d):
    path = scratch_path(spark, "counts")
    TX.write_counts(frequent_itemsets(_ude(spark, d), S_UDE), path)
    return TX.read_counts(spark, path)


def q_report_lines(spark, d):
    return TX.report_lines(_ob_result(spark, d))


# -- 2.2 projections and scalar functions --------------------------------------

def _lines(spark, d, keep_trailing=False):
    docs = FX.table(spark, d, "documents").select("doc_id", "text")
    return docs.select("doc_id", F.posexplode(X.split_lines("text", keep_trailing))
                       .alias("line_no", "line")).withColumn(
        "line_no", F.col("line_no").cast("bigint"))


def q_split_lines(spark, d):
    return _lines(spark, d)


def q_tokens_single_space(spark, d):
    t = X.tokens_single_space("line")
    return _lines(spark, d, True).select("doc_id", "line_no",
                                         F.concat_ws("|", t).alias("tokens"),
                                         F.size(t).cast("int").alias("n_tokens"))


def q_tokens_whitespace(spark, d):
    t = X.tokens_whitespace("line")
    return _lines(spark, d, True).select("doc_id", "line_no",
                                         F.concat_ws("|", t).alias("tokens"),
                                         F.size(t).cast("int").alias("n_tokens"))


def q_basket_canonical(spark, d):
    c = X.basket_canonical(X.tokens_whitespace("text"))
    return FX.table(spark, d, "documents").select(
        "doc_id", F.concat_ws(" ", c).alias("items"), F.size(c).cast("int").alias("size"))


def q_itemset_key(spark, d):
    """P-5 on itemsets (k items each): the found itemsets with their items
    reversed, keyed again -- the key restores the sorted form."""
    res = frequent_itemsets(_ude(spark, d), S_UDE)
    rev = F.reverse(F.split("itemset", " "))
    return res.select(F.concat_ws(" ", rev).alias("reversed"),
                      X.itemset_key(rev).alias("itemset"))


def q_itemset_prefix_last(spark, d):
    res = frequent_itemsets(_ude(spark, d), S_UDE).where(F.col("size") >= 2)
    items = F.split("itemset", " ")
    return res.select("itemset",
                      F.concat_ws(" ", X.itemset_prefix(items)).alias("prefix"),
                      X.itemset_last(items).alias("last"))


def _ob_l1(spark, d):
    data = _ob(spark, d)
    return data, support_filter(item_support(data.occ), S_OB, n=data.n)


def q_item_dictionary(spark, d):
    _, l1 = _ob_l1(spark, d)
    return item_dictionary(l1.select("item"))


def q_itemset_decode(spark, d):
    """Pairs of OB coded with the dense dictionary, then decoded."""
    data, l1 = _ob_l1(spark, d)
    dic = write_table(item_dictionary(l1.select("item")), "dictionary")
    occ1 = apriori.encode(data.occ, dic)
    pairs = support_filter(itemset_support(LV.extend(LV.first_level(occ1), occ1)), S_OB, n=data.n)
    named = decode_itemsets(pairs, dic, keep_items=True)
    return named.select(codes_key("items").alias("codes"), "itemset")


def q_itemsets_by_size(spark, d):
    res = frequent_itemsets(_ude(spark, d), S_UDE)
    return res.groupBy("size").agg(F.count(F.lit(1)).alias("n_itemsets"))


# -- 2.3 filters ---------------------------------------------------------------

def _udc_local(spark, d):
    data, ch = _udc(spark, d)
    return son.local_levels(ch, S_UDC).itemsets()


def q_local_frequent_items(spark, d):
    return _udc_local(spark, d).where(F.col("size") == 1).select("chunk_id", "itemset", "freq")


def q_local_frequent_pairs(spark, d):
    return _udc_local(spark, d).where(F.col("size") == 2).select("chunk_id", "itemset", "freq")


def q_local_frequent_itemsets(spark, d):
    return _udc_local(spark, d).where(F.col("size") >= 3).select(
        "chunk_id", "itemset", "size", "freq")


def q_son_frequent_itemsets(spark, d):
    return frequent_itemsets(_ude(spark, d), S_UDC, strategy="son", chunks=P_UDC,
                             chunking="contiguous", order_cols=UDC_ORDER)


def q_prune_baskets(spark, d):
    data, l1 = _ob_l1(spark, d)
    kept = LV.only(data.occ, write_table(l1, "items"), key="item")
    return kept.select(F.col("basket").alias("basket_id"), "item")


# -- 2.4 joins -------------------------------------------------------------------

def _levels(spark, data, s, keep_occurrences=False, max_len=None):
    return apriori.mine_levels(data.occ, s, n=data.n, keep_occurrences=keep_occurrences,
                               max_len=max_len)


def q_candidate_gen(spark, d):
    res = _levels(spark, _ob(spark, d), S_OB)
    cand = LV.candidate_gen(res.levels[1]).withColumn("freq", F.lit(0).cast("bigint"))
    return _decoded(res, cand).select("itemset", "size")


def _ob_pairs(spark, d):
    """Every pair of frequent items of each OB basket (JN-2), unfiltered."""
    data = _ob(spark, d)
    res = _levels(spark, data, S_OB, max_len=1)
    return res, LV.extend(LV.first_level(res.occ1), res.occ1)


def q_basket_pairs(spark, d):
    res, pairs = _ob_pairs(spark, d)
    return _occ_itemsets(res, pairs).select(F.col("basket").alias("basket_id"), "itemset")


def _ude_x3(spark, d):
    """Every extension of an L_2 occurrence by a larger frequent item of the
    same basket (JN-3, k = 3), before any candidate or support filter."""
    data = _ude(spark, d)
    res = _levels(spark, data, S_UDE, keep_occurrences=True, max_len=2)
    return res, LV.extend(res.occurrences[1], res.occ1)


def q_basket_k_combinations(spark, d):
    res, x3 = _ude_x3(spark, d)
    return _ude_out(_occ_itemsets(res, x3), "itemset")


def q_basket_frequent_itemsets(spark, d):
    res = _levels(spark, _ude(spark, d), S_UDE, keep_occurrences=True)
    occ = res.occurrences[0].select("basket", "items")
    for o in res.occurrences[1:]:
        occ = occ.unionByName(o.select("basket", "items"))
    return _ude_out(_occ_itemsets(res, occ), "itemset")


def _udc_containment(spark, d):
    data, ch = _udc(spark, d)
    local = son.local_levels(ch, S_UDC)
    cand, n = son.candidates(local)
    return data, ch, local, cand, n


def q_basket_candidates(spark, d):
    data, ch, local, cand, n = _udc_containment(spark, d)
    return _ude_out(_occ_itemsets(local, son.contained_candidates(data.occ, local, cand, n)), "itemset")


def q_basket_candidate_items(spark, d):
    data, ch, local, cand, n = _udc_containment(spark, d)
    return _ude_out(son.candidate_items(data.occ, local, cand), "item")


def q_support_lookup(spark, d):
    data = _ob(spark, d)
    res = _levels(spark, data, S_OB, keep_occurrences=True, max_len=2)
    cand = write_table(LV.candidate_gen(res.levels[1]), "candidates")
    counts = itemset_support(LV.extend(res.occurrences[1], res.occ1))
    return _decoded(res, support_lookup(cand, counts)).select("itemset", "freq")


# -- 2.5 aggregations -------------------------------------------------------------

def q_item_support(spark, d):
    return item_support(_ob(spark, d).occ).select("item", F.col("freq").cast("bigint"))


def q_pair_support(spark, d):
    res = _levels(spark, _ob(spark, d), S_OB, max_len=1)
    counts = pair_support(write_table(LV.basket_rows(res.occ1), "rows"))
    return _decoded(res, counts).select("itemset", "freq")


def q_triple_support(spark, d):
    """Triples that extend an L_2 pair, counted on the items' bitmaps."""
    data = _ude(spark, d)
    res = _levels(spark, data, S_UDE, max_len=2)
    pairs = write_table(pair_support(LV.basket_rows(res.occ1)), "pairs")
    triples = BM.extensions(support_filter(pairs, S_UDE, n=data.n), pairs)
    return _decoded(res, BM.bitmap_support(write_table(BM.item_bitmaps(res.occ1), "bitmaps"),
                                           triples)).select("itemset", "freq")


def q_prefix_groups(spark, d):
    """A-4 on the found pairs; items decode by their place in the rows."""
    res = _levels(spark, _ob(spark, d), S_OB, max_len=2)
    groups = LV.prefix_groups(res.levels[1])
    named = {}
    for c in ("prefix", "lasts"):  # a group has at most F items
        rows = groups.select(F.col("prefix").alias("_k"), F.posexplode(c).alias("pos", "code"))
        named[c] = rows.join(res.dictionary, "code").groupBy("_k").agg(
            F.concat_ws(" ", F.transform(F.sort_array(F.collect_list(F.struct("pos", "item"))),
                                         lambda x: x["item"])).alias(c))
    return named["prefix"].join(named["lasts"], "_k").select("prefix", "lasts")


def q_chunk_sizes(spark, d):
    data, ch = _udc(spark, d)
    return ch.sizes.select("chunk_id", F.col("n").cast("bigint").alias("n"))


def q_basket_count(spark, d):
    rows = []
    for name in ("order_brand", "user_day_event", "doc_tokens", "doc_lines"):
        data = getattr(FX, name)(spark, d)
        rows.append(data.keys.agg(F.count(F.lit(1)).alias("n"))
                    .select(F.lit(name).alias("fixture"), "n"))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def q_son_candidates(spark, d):
    data, ch, local, cand, n = _udc_containment(spark, d)
    return _decoded(local, cand.select("items", F.lit(0).cast("bigint").alias("freq"))
                    ).select("itemset", "size")


def q_partial_candidate_counts(spark, d):
    data, ch, local, cand, n = _udc_containment(spark, d)
    counts = son.count_candidates(ch.occ, local, cand, n, part_cols=["chunk_id"])
    return _decoded(local, counts, ["chunk_id"]).select("chunk_id", "itemset", "freq")


def q_candidate_support(spark, d):
    data, ch, local, cand, n = _udc_containment(spark, d)
    counts = son.count_candidates(data.occ, local, cand, n)
    return _decoded(local, counts).select("itemset", "size", "freq")


def q_itemset_count(spark, d):
    return _ob_result(spark, d).agg(F.count(F.lit(1)).alias("n_itemsets"))


# -- 2.6 windows, sorts, set operations ------------------------------------------

def q_assign_chunks(spark, d):
    data = _ude(spark, d)
    out = assign_chunks(data.keys, UDC_ORDER, P_UDC, n=data.n)
    return _ude_out(out, "pos", "chunk_id")


def q_report_ranked(spark, d):
    res = _ob_result(spark, d)
    ranked = with_positions(res, [F.col("freq").desc(), F.col("itemset").asc()], "pos")
    return ranked.select((F.col("pos") + 1).alias("rank"), "itemset", "size", "freq")


def q_local_itemsets(spark, d):
    return _udc_local(spark, d).select("chunk_id", "itemset", "size", "freq")


# -- 2.7 strategies -----------------------------------------------------------------

def q_order_brand_itemsets(spark, d):
    return _ob_result(spark, d)


def q_apriori_itemsets(spark, d):
    return frequent_itemsets(_ude(spark, d), S_UDE)


def q_fpgrowth_itemsets(spark, d):
    return frequent_itemsets(FX.doc_tokens(spark, d), S_DT, strategy="fpgrowth")


def q_doc_tokens_itemsets(spark, d):
    return frequent_itemsets(FX.doc_tokens(spark, d), S_DT)


def q_doc_lines_itemsets(spark, d):
    return frequent_itemsets(FX.doc_lines(spark, d), S_DL)


def q_doc_tokens_son(spark, d):
    return frequent_itemsets(FX.doc_tokens(spark, d), S_DT, strategy="son", chunks=4)


QUERIES = {name[2:]: fn for name, fn in sorted(globals().items())
           if name.startswith("q_") and callable(fn)}
