"""Connected components over links, by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnweave.llm.skew import join_groups
from tarnweave.storage import materialise


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def _hook(arcs: DataFrame, keep) -> DataFrame:
    """Arcs (u, v): every v that ``keep`` selects becomes linked to the smallest of u and its neighbours."""
    least = arcs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("degree"))
    hot, rest = join_groups(arcs, least, ["u"], "degree", arcs.count())
    return hot.unionByName(rest).where(keep).select(F.col("v").alias("a"), F.col("m").alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of undirected ``edges`` (a, b); component: the smallest node reachable.

    Each round writes its links as a table; rounds grow as the logarithm of the longest chain. A node with very many
    links gets its smallest neighbour by a combining aggregate and a broadcast of under a thousand such nodes.
    """
    now = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = _mark(now)
    while mark[0]:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = materialise(_hook(materialise(both, "arcs"), F.col("v") > F.col("u")).where("a <> b").distinct(), "large")
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        small = _hook(down, F.lit(True)).unionByName(down.groupBy("u").agg(F.min("v").alias("b")).select(F.col("u").alias("a"), "b"))
        now = materialise(small.where("a <> b").distinct(), "small")
        before, mark = mark, _mark(now)
        if before == mark:
            break
    return now.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node").unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
