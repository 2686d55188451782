"""Integrals, roots, splines, distances of all pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe.operators import graph as G
from lumenframe.operators import numerics as N
from lumenframe.plans.registry import Registry
from lumenframe.plans.statistics import rounded
from lumenframe.sources.tables import table

query = Registry()
QUERIES, SQL = query.queries, query.sql

_STEPS = "SELECT range AS i, range * 0.002 AS x FROM range(1001)"


@query("integrate_trapezoid", f"WITH s AS ({_STEPS}) SELECT round(sum(CASE WHEN i IN (0, 1000) THEN 0.5 ELSE 1 END * exp(-x::DOUBLE * x::DOUBLE)) * 0.002, 9) AS integral FROM s")
def _(spark, d):
    return rounded(N.integrate_trapezoid(spark, lambda x: F.exp(-x * x), 0, 2, 1000), 9)


@query("integrate_simpson", f"WITH s AS ({_STEPS}) SELECT round(sum(CASE WHEN i IN (0, 1000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-x::DOUBLE * x::DOUBLE)) * 0.002 / 3, 9) AS integral FROM s")
def _(spark, d):
    return rounded(N.integrate_simpson(spark, lambda x: F.exp(-x * x), 0, 2, 1000), 9)


@query("bisection_roots", "SELECT p_partkey, round(cbrt(p_retailprice), 6) AS root FROM part")
def _(spark, d):
    rows = table(spark, d, "part").select("p_partkey", "p_retailprice", F.lit(0.0).alias("low"), (F.col("p_retailprice") + 1).alias("high"))
    return N.roots(rows, lambda x, v: x**3 - v, ["p_retailprice"], "low", "high").select("p_partkey", F.round("root", 6).alias("root"))


@query("cubic_spline")
def _(spark, d):
    sold = table(spark, d, "lineitem").groupBy("l_returnflag", F.col("l_quantity").cast("double").alias("q")).agg(F.avg("l_extendedprice").alias("price"))
    return rounded(N.cubic_spline(sold, sold.select("l_returnflag", (F.col("q") + 0.5).alias("q")), "q", "price", ["l_returnflag"]), 6)


_NATIONS = """SELECT c_nationkey AS src, s_nationkey AS dst, min(l_extendedprice)::DOUBLE AS distance FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2"""


def _doubled(rounds: int) -> str:
    out = [f"WITH e AS ({_NATIONS}), d0 AS (SELECT src, dst, min(distance) AS distance FROM (FROM e UNION ALL SELECT src, src, 0 FROM e UNION ALL SELECT dst, dst, 0 FROM e) GROUP BY 1, 2)"]
    out += [f"d{k + 1} AS (SELECT a.src, b.dst, min(a.distance + b.distance) AS distance FROM d{k} a JOIN d{k} b ON a.dst = b.src GROUP BY 1, 2)" for k in range(rounds)]
    return ", ".join(out) + f" SELECT src, dst, round(distance, 4) AS distance FROM d{rounds}"


@query("all_pairs_paths", _doubled(5))
def _(spark, d):
    t = lambda name: table(spark, d, name)
    joined = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    edges = joined.groupBy(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).agg(F.min("l_extendedprice").cast("double").alias("weight"))
    return rounded(G.all_pairs_paths(edges, directed=True), 4)
