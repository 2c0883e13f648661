"""Connected components by alternating large-star and small-star steps.

Each step is a partial aggregate (least neighbour) and a join; components and
edges stay in Spark, written to the shared folder after every round.  A hub
with many edges is one aggregate row per map task and a join key that AQE may
split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from basketry import session


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"),
                                                           F.col("a").alias("b")))


def _least(near: DataFrame) -> DataFrame:
    """``(a, m)``: the least of each node and its neighbours."""
    return near.groupBy("a").agg(F.min("b").alias("m")).select(
        "a", F.least("a", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    near = _both(edges)
    return (near.where("b > a").join(_least(near), "a")
            .where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    near = _least(down)
    links = down.join(near, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return links.unionByName(near.select("a", F.col("m").alias("b"))).where("a <> b")


def _labels(edges: DataFrame) -> tuple[DataFrame, bool]:
    """``(node, label)`` of distinct edges that lead to a lesser node, and
    whether they are stars: no node has two labels, no label one of its own."""
    ends = edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
        edges.select(F.col("b").alias("node"), F.lit(None).alias("label")))
    found = ends.groupBy("node").agg(
        F.min("label").alias("label"), F.max("label").alias("last"),
        F.count("label").alias("up"), F.count(F.lit(1)).alias("n"))
    obs = Observation()
    out = session.write_table(found.observe(obs, F.count(F.when(
        (F.col("label") != F.col("last")) | (F.col("up") > 0) & (F.col("up") < F.col("n")),
        1)).alias("open")).select("node", F.coalesce("label", "node").alias("label")), "labels")
    return out, not obs.get["open"]


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` -> ``(node, label)``, label the least node of its
    component; nodes without an edge are absent.  Edges may repeat and lead
    either way.  Rounds grow with the logarithm of the longest path; the labels
    tell whether another is due."""
    now = edges.where("a <> b")
    while True:
        now = session.write_table(_small_star(_large_star(now)).distinct(), "edges")
        labels, stars = _labels(now)
        if stars:
            return labels
