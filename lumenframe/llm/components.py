"""Connected components by alternating large-star and small-star.

Each pass is a grouped minimum and a join on it; a hub's neighbours are split by adaptive skew handling, its minimum by partial
aggregation. Links and labels stay in tables; the driver sees a count and a checksum a pass.

Defined results: links from a node to itself don't count, repeated ones and both directions are one; null ends are linked with
nothing; ties can't be, as nodes are distinct numbers; an empty table gives none; further columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import cut, drop


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, passes: int = 200) -> DataFrame:
    """(node, component): the smallest node that each node of edges (u, v) reaches; the smallest ones themselves are left out."""
    state, seen = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links"), None
    n = state.count()
    for _ in range(passes):
        # a pass never has more links than the one before, so few links are written to few files
        new = cut(_small_star(_large_star(state)).coalesce(n // 20_000 + 4), "links")
        sums = new.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("x")).first()
        drop(state)
        state = new
        if (sums["n"], sums["x"]) == seen:
            return state.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = (sums["n"], sums["x"])
    raise RuntimeError(f"no stable components after {passes} passes")
