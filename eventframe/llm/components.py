"""Connected components of an undirected graph by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventframe.llm.common import cut


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    across = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return across.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _signature(edges: DataFrame) -> tuple:
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))), F.bit_xor(h)).first())


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` -> ``(node, component)`` with the smallest reachable node, for nodes other than it.

    Every step is an aggregate with map-side combine and an equi-join whose large keys adaptive execution
    splits; each round is cut by a written table. Nodes on their own and loops give no row.
    """
    now = cut(edges.where("a <> b").select("a", "b").distinct(), "edges")
    seen = _signature(now)
    while seen[0]:
        now = cut(_small_star(_large_star(now)), "edges")
        last, seen = seen, _signature(now)
        if last == seen:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
