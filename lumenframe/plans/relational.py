"""Projection, joins, grouping, reshaping, windows, sorting and SQL over the star schema and the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe.functions import scalar as S
from lumenframe.operators import frame as O
from lumenframe.operators import series as R
from lumenframe.operators.validate import Rule, validate
from lumenframe.plans.registry import Registry
from lumenframe.sources.tables import table

query = Registry()
QUERIES, SQL = query.queries, query.sql


@query(
    "flagship_revenue_by_region",
    """SELECT r_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
       WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1998-01-01'
       GROUP BY r_name ORDER BY revenue DESC LIMIT 5""",
)
def flagship(spark, d):
    orders = table(spark, d, "orders").filter("o_orderdate >= '1996-01-01' AND o_orderdate < '1998-01-01'")
    joined = table(spark, d, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    joined = joined.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue")).orderBy(F.desc("revenue")).limit(5)


# projection and filter


@query("select_drop_rename", "SELECT o_orderkey AS id, o_custkey, o_totalprice, o_orderstatus FROM orders")
def _(spark, d):
    kept = O.drop_columns(table(spark, d, "orders"), ["o_orderdate", "o_orderpriority"])
    return O.select(O.rename(kept, "o_orderkey", "id"), ["id", "o_custkey", "o_totalprice", "o_orderstatus"])


@query("computed_column", "SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice * (1 - l_discount) + l_tax, 4) AS charge, l_quantity / 2 AS half FROM lineitem")
def _(spark, d):
    line = O.add_column(table(spark, d, "lineitem"), "charge", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) + F.col("l_tax"), 4))
    return line.select("l_orderkey", "l_linenumber", "l_partkey", "charge", (F.col("l_quantity") / 2).alias("half"))


@query("filter_compound", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE (l_quantity > 45 AND l_discount < 0.03) OR NOT (l_returnflag <> 'R' OR l_linestatus = 'O')")
def _(spark, d):
    keep = ((F.col("l_quantity") > 45) & (F.col("l_discount") < 0.03)) | ~((F.col("l_returnflag") != "R") | (F.col("l_linestatus") == "O"))
    return table(spark, d, "lineitem").filter(keep).select("l_orderkey", "l_linenumber", "l_quantity")


@query("head", "SELECT event_id, user_id, value FROM events ORDER BY event_id LIMIT 10")
def _(spark, d):
    return O.head(table(spark, d, "events").select("event_id", "user_id", "value"), 10, ["event_id"])


@query("tail", "SELECT * FROM (SELECT event_id, user_id, value FROM events ORDER BY event_id DESC LIMIT 10) ORDER BY event_id")
def _(spark, d):
    return O.tail(table(spark, d, "events").select("event_id", "user_id", "value"), 10, ["event_id"])


@query("slice_rows", "SELECT event_id, value FROM events ORDER BY event_id LIMIT 25 OFFSET 100")
def _(spark, d):
    return O.slice_rows(table(spark, d, "events").select("event_id", "value"), 100, 25, ["event_id"])


@query("lazy_filter_sort_limit", "SELECT event_id, value * 2 AS twice FROM events WHERE value > 50 ORDER BY value, event_id LIMIT 20")
def _(spark, d):
    return table(spark, d, "events").filter("value > 50").orderBy("value", "event_id").limit(20).select("event_id", (F.col("value") * 2).alias("twice"))


@query("row_numbers", "SELECT event_id, row_number() OVER (ORDER BY value, event_id) - 1 AS position FROM events")
def _(spark, d):
    return O.argsort(table(spark, d, "events").select("event_id", "value"), "value", "event_id").select("event_id", "position")


@query("divide_by_zero", "SELECT l_returnflag, count(*) FILTER (l_discount = 0) AS infinite, round(max(CASE WHEN l_discount <> 0 THEN l_quantity / l_discount END), 4) AS top FROM lineitem GROUP BY 1")
def _(spark, d):
    line = table(spark, d, "lineitem").withColumn("x", S.divide(F.col("l_quantity"), F.col("l_discount")))
    infinite = F.col("x") == float("inf")
    return line.groupBy("l_returnflag").agg(F.count_if(infinite).alias("infinite"), F.round(F.max(F.when(~infinite, F.col("x"))), 4).alias("top"))


# sort, top-k, sets


@query("sort_nulls", "SELECT event_id, CASE WHEN event_type <> 'error' THEN value END AS v FROM events ORDER BY v ASC NULLS LAST, event_id")
def _(spark, d):
    rows = table(spark, d, "events").select("event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("v"))
    return O.sort_by(rows, ["v", "event_id"])


@query("sort_descending_nulls_first", "SELECT event_id, CASE WHEN event_id % 900 <> 0 THEN value END AS v FROM events ORDER BY v DESC NULLS FIRST, event_id DESC")
def _(spark, d):
    rows = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 900 != 0, F.col("value")).alias("v"))
    return O.sort_by(rows, ["v", "event_id"], ascending=False)


@query("topk_per_group", "SELECT l_returnflag, l_orderkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_partkey) AS n FROM lineitem) WHERE n <= 5")
def _(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("l_returnflag").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_partkey")
    return table(spark, d, "lineitem").withColumn("n", F.row_number().over(w)).filter("n <= 5").select("l_returnflag", "l_orderkey", "l_extendedprice")


@query("unique_first_seen", "SELECT event_type, min(event_id) AS first FROM events GROUP BY event_type ORDER BY first")
def _(spark, d):
    return O.unique(table(spark, d, "events"), "event_type", "event_id")


@query("set_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def _(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, d, "supplier").select("s_nationkey")).distinct()


@query("set_intersect", "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier")
def _(spark, d):
    return table(spark, d, "customer").filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("k")).intersect(table(spark, d, "supplier").select("s_nationkey"))


@query("set_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def _(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k")).exceptAll(table(spark, d, "orders").select("o_custkey").distinct())


@query("concat_by_name", "SELECT c_name AS name, c_acctbal AS bal FROM customer UNION ALL SELECT s_name, s_acctbal FROM supplier")
def _(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_acctbal").alias("bal"), F.col("s_name").alias("name"))
    return O.union_all(table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal")), s)


# joins

_CO = "(SELECT * FROM customer WHERE c_acctbal > 0) c {how} JOIN (SELECT * FROM orders WHERE o_totalprice > 400000) o ON c_custkey = o_custkey"


def _sides(spark, d):
    return table(spark, d, "customer").filter("c_acctbal > 0").select("c_custkey", "c_name"), table(spark, d, "orders").filter("o_totalprice > 400000").select("o_custkey", "o_orderkey")


for _how, _sql in (("inner", "INNER"), ("left", "LEFT"), ("right", "RIGHT"), ("outer", "FULL OUTER")):

    @query(f"join_{_how}", f"SELECT coalesce(c_custkey, o_custkey) AS c_custkey, c_name, o_orderkey FROM {_CO.format(how=_sql)}" if _how in ("right", "outer") else f"SELECT c_custkey, c_name, o_orderkey FROM {_CO.format(how=_sql)}")
    def _(spark, d, how=_how):
        a, b = _sides(spark, d)
        return O.join(a, b, ["c_custkey"], ["o_custkey"], how)


@query("join_semi", "SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 0 AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def _(spark, d):
    a, b = _sides(spark, d)
    return O.join(a, b, ["c_custkey"], ["o_custkey"], "left_semi")


@query("join_anti", "SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 0 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def _(spark, d):
    a, b = _sides(spark, d)
    return O.join(a, b, ["c_custkey"], ["o_custkey"], "left_anti")


@query("join_cross", "SELECT r_name, n_name FROM region, nation")
def _(spark, d):
    return table(spark, d, "region").select("r_name").crossJoin(table(spark, d, "nation").select("n_name"))


@query("join_suffixes", "SELECT a.k, a.v AS v_left, b.v AS v_right FROM (SELECT c_nationkey AS k, c_acctbal AS v FROM customer) a JOIN (SELECT s_nationkey AS k, s_acctbal AS v FROM supplier) b USING (k)")
def _(spark, d):
    a = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("v"))
    return O.join(a, table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_acctbal").alias("v")), ["k"])


@query(
    "join_two_keys",
    """WITH a AS (SELECT l_partkey, l_suppkey, sum(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2), b AS (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2)
       SELECT a.l_partkey, a.l_suppkey, q, n FROM a JOIN b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey""",
)
def _(spark, d):
    line = table(spark, d, "lineitem")
    a = line.filter("l_returnflag = 'R'").groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("q"))
    b = line.filter("l_returnflag = 'A'").groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    return O.join(a, b, ["l_partkey", "l_suppkey"])


@query("join_null_safe", "WITH a AS (SELECT nullif(n_regionkey, 0) AS k, n_name FROM nation), b AS (SELECT nullif(r_regionkey, 0) AS k, r_name FROM region) SELECT a.k, n_name, r_name FROM a JOIN b ON a.k IS NOT DISTINCT FROM b.k")
def _(spark, d):
    a = table(spark, d, "nation").select(F.nullif("n_regionkey", F.lit(0)).alias("k"), "n_name")
    return O.join(a, table(spark, d, "region").select(F.nullif("r_regionkey", F.lit(0)).alias("k"), "r_name"), ["k"], null_safe=True)


@query(
    "join_asof",
    """SELECT a.event_id, a.user_id, a.ts, b.price FROM (SELECT event_id, user_id, ts FROM events WHERE event_type = 'view') a
       ASOF LEFT JOIN (SELECT user_id, ts, value AS price FROM events WHERE event_type = 'purchase') b ON a.user_id = b.user_id AND a.ts >= b.ts""",
)
def _(spark, d):
    ev = table(spark, d, "events")
    return O.asof_join(ev.filter("event_type = 'view'").select("event_id", "user_id", "ts"), ev.filter("event_type = 'purchase'").select("user_id", "ts", F.col("value").alias("price")), "ts", ["user_id"], ["price"])


@query("join_range", "SELECT p_partkey, low FROM part JOIN (SELECT s_suppkey * 40.0 AS low, s_suppkey * 40.0 + 30 AS high FROM supplier) ON p_retailprice >= low AND p_retailprice < high")
def _(spark, d):
    ranges = table(spark, d, "supplier").select((F.col("s_suppkey") * 40.0).alias("low"), (F.col("s_suppkey") * 40.0 + 30).alias("high"))
    return O.range_join(table(spark, d, "part").select("p_partkey", "p_retailprice"), ranges, "p_retailprice", "low", "high", 40.0).select("p_partkey", "low")


# grouping

for _how, _fn in (("sum", "round(sum({c}), 2)"), ("mean", "round(avg({c}), 6)"), ("min", "min({c})"), ("max", "max({c})")):

    @query(f"groupby_{_how}", f"SELECT l_returnflag, l_linestatus, {_fn.format(c='l_quantity')} AS l_quantity, {_fn.format(c='l_extendedprice')} AS l_extendedprice FROM lineitem GROUP BY 1, 2")
    def _(spark, d, how=_how):
        got = O.aggregate(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], how, ["l_quantity", "l_extendedprice"])
        digits = {"sum": 2, "mean": 6}.get(how)
        return got if digits is None else got.withColumns({c: F.round(c, digits) for c in ("l_quantity", "l_extendedprice")})


@query("groupby_count", "SELECT l_returnflag, count(*) AS l_quantity_count, count(*) AS l_tax_count FROM lineitem GROUP BY 1")
def _(spark, d):
    return O.aggregate(table(spark, d, "lineitem"), ["l_returnflag"], "count", ["l_quantity", "l_tax"])


for _how, _fn in (("first", "arg_min"), ("last", "arg_max")):

    @query(f"groupby_{_how}", f"SELECT user_id, {_fn}(value, event_id) AS value, {_fn}(event_type, event_id) AS event_type FROM events GROUP BY user_id")
    def _(spark, d, how=_how):
        return O.aggregate(table(spark, d, "events"), ["user_id"], how, ["value", "event_type"], "event_id")


@query("groupby_null_key", "SELECT nullif(event_type, 'click') AS k, count(*) AS n, count(nullif(value, 0)) AS present FROM events GROUP BY 1")
def _(spark, d):
    return table(spark, d, "events").groupBy(F.nullif("event_type", F.lit("click")).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.count(F.nullif("value", F.lit(0))).alias("present"))


@query(
    "agg_product_var_std_median",
    """SELECT user_id % 7 AS g, round(product(1 + value / 1e6), 6) AS p, round(var_pop(value), 5) AS v, round(stddev_pop(value), 6) AS s, round(quantile_cont(value, 0.5), 6) AS m, count(DISTINCT event_type) AS kinds FROM events GROUP BY 1""",
)
def _(spark, d):
    v = F.col("value")
    return table(spark, d, "events").groupBy((F.col("user_id") % 7).alias("g")).agg(F.round(F.product(1 + v / 1e6), 6).alias("p"), F.round(F.var_pop(v), 5).alias("v"), F.round(F.stddev_pop(v), 6).alias("s"), F.round(F.median(v), 6).alias("m"), F.count_distinct("event_type").alias("kinds"))


@query("rollup", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS q, grouping(l_returnflag, l_linestatus) AS level FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def _(spark, d):
    return table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("q"), F.grouping_id().alias("level"))


@query("cube", "SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_returnflag, l_linestatus) AS level FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def _(spark, d):
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))


@query("null_counts", "SELECT 'event_id' AS \"column\", count(*) FILTER (event_id IS NULL) AS nulls FROM events UNION ALL SELECT 'v', count(*) FILTER (value <= 50) FROM events")
def _(spark, d):
    return O.null_counts(table(spark, d, "events").select("event_id", F.when(F.col("value") > 50, F.col("value")).alias("v")))


# reshaping


@query("pivot_sum", "SELECT l_returnflag, round(sum(l_quantity) FILTER (l_linestatus = 'F'), 2) AS \"l_quantity_F\", round(sum(l_quantity) FILTER (l_linestatus = 'O'), 2) AS \"l_quantity_O\" FROM lineitem GROUP BY 1")
def _(spark, d):
    got = O.pivot(table(spark, d, "lineitem"), ["l_returnflag"], "l_linestatus", "l_quantity")
    return got.select("l_returnflag", *[F.round(c, 2).alias(c) for c in got.columns[1:]])


@query("crosstab", "SELECT event_type, count(*) FILTER (user_id % 3 = 0) AS event_type_0, count(*) FILTER (user_id % 3 = 1) AS event_type_1, count(*) FILTER (user_id % 3 = 2) AS event_type_2 FROM events GROUP BY 1")
def _(spark, d):
    return O.crosstab(table(spark, d, "events").withColumn("g", F.col("user_id") % 3), "event_type", "g", [0, 1, 2])


@query("melt", "SELECT s_suppkey, variable, value FROM (SELECT s_suppkey, s_name, CAST(s_nationkey AS VARCHAR) AS s_nationkey FROM supplier) UNPIVOT (value FOR variable IN (s_name, s_nationkey))")
def _(spark, d):
    return O.melt(table(spark, d, "supplier"), ["s_suppkey"], ["s_name", "s_nationkey"])


@query("categorical_codes", "SELECT o_orderkey, o_orderpriority, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS code FROM orders")
def _(spark, d):
    return O.categorical(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority")


@query("categorical_order", "SELECT l_orderkey, l_linenumber, l_partkey, CAST(CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 END AS INTEGER) AS code FROM lineitem")
def _(spark, d):
    return O.categorical(table(spark, d, "lineitem"), "l_returnflag", categories=["R", "A"]).select("l_orderkey", "l_linenumber", "l_partkey", "code")


@query("multi_index", "SELECT n_regionkey, n_nationkey, concat_ws('_', n_regionkey, n_name) AS label FROM nation WHERE n_regionkey = 1 ORDER BY 1, 2")
def _(spark, d):
    return O.flat_index(O.index_select(table(spark, d, "nation"), n_regionkey=1), ["n_regionkey", "n_name"]).select("n_regionkey", "n_nationkey", "label").orderBy("n_regionkey", "n_nationkey")


# series windows

_HOLES = "(SELECT event_id, user_id, CASE WHEN event_id % 4 <> 0 THEN value END AS v FROM events)"
_W = "PARTITION BY user_id ORDER BY event_id"


def _holes(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", F.when(F.col("event_id") % 4 != 0, F.col("value")).alias("v"))


def _spec():
    return R.spec(["user_id"], ["event_id"])


for _how, _fn in (("mean", "avg"), ("sum", "sum"), ("min", "min"), ("max", "max"), ("std", "stddev_pop")):

    @query(f"rolling_{_how}", f"SELECT event_id, round(CASE WHEN count(v) OVER w >= 2 THEN {_fn}(v) OVER w END, 6) AS r FROM {_HOLES} WINDOW w AS ({_W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
    def _(spark, d, how=_how):
        return _holes(spark, d).select("event_id", F.round(R.rolling("v", how, 5, _spec(), 2), 6).alias("r"))


for _how, _fn in (("sum", "sum"), ("mean", "avg"), ("min", "min"), ("max", "max")):

    @query(f"expanding_{_how}", f"SELECT event_id, round(CASE WHEN v IS NOT NULL THEN {_fn}(v) OVER w END, 10) AS r FROM {_HOLES} WINDOW w AS ({_W} ROWS UNBOUNDED PRECEDING)")
    def _(spark, d, how=_how):
        return _holes(spark, d).select("event_id", F.round(R.expanding("v", how, _spec()), 10).alias("r"))


@query("rolling_mean_centered", f"SELECT event_id, round(CASE WHEN count(v) OVER w >= 3 THEN avg(v) OVER w END, 6) AS r FROM {_HOLES} WINDOW w AS ({_W} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)")
def _(spark, d):
    return _holes(spark, d).select("event_id", F.round(R.rolling("v", "mean", 5, _spec(), 3, center=True), 6).alias("r"))


@query("fill_null", f"SELECT event_id, coalesce(v, -1) AS v FROM {_HOLES}")
def _(spark, d):
    return _holes(spark, d).select("event_id", F.coalesce("v", F.lit(-1.0)).alias("v"))


@query("fill_forward_backward", f"SELECT event_id, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS f, first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM {_HOLES}")
def _(spark, d):
    return _holes(spark, d).select("event_id", R.fill_forward("v", _spec()).alias("f"), R.fill_backward("v", _spec()).alias("b"))


@query(
    "interpolate_linear",
    f"""WITH p AS (SELECT *, row_number() OVER ({_W}) AS n FROM {_HOLES}), q AS (SELECT *, CASE WHEN v IS NOT NULL THEN n END AS h FROM p),
        r AS (SELECT *, last_value(v IGNORE NULLS) OVER b AS a0, last_value(h IGNORE NULLS) OVER b AS i0, first_value(v IGNORE NULLS) OVER f AS a1, first_value(h IGNORE NULLS) OVER f AS i1 FROM q
              WINDOW b AS ({_W} ROWS UNBOUNDED PRECEDING), f AS ({_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
        SELECT event_id, round(CASE WHEN v IS NOT NULL THEN v WHEN i0 IS NOT NULL AND i1 IS NOT NULL THEN a0 + (a1 - a0) * (n - i0) / (i1 - i0) END, 6) AS x FROM r""",
)
def _(spark, d):
    return R.interpolate(_holes(spark, d), "v", ["user_id"], ["event_id"], "x").select("event_id", F.round("x", 6).alias("x"))


@query(
    "ewm_mean",
    f"""WITH RECURSIVE p AS (SELECT *, row_number() OVER ({_W}) AS n FROM {_HOLES}),
        e AS (SELECT event_id, user_id, n, coalesce(v, 0) AS t, CASE WHEN v IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS b FROM p WHERE n = 1
              UNION ALL SELECT p.event_id, p.user_id, p.n, e.t * 0.7 + coalesce(p.v, 0), e.b * 0.7 + CASE WHEN p.v IS NULL THEN 0 ELSE 1 END FROM e JOIN p ON p.user_id = e.user_id AND p.n = e.n + 1)
        SELECT event_id, round(CASE WHEN b > 0 THEN t / b END, 6) AS x FROM e""",
)
def _(spark, d):
    got = R.ewm_mean(_holes(spark, d), "v", 0.3, ["user_id"], ["event_id"], "x")
    return got.select("event_id", F.when(F.isnan("x"), None).otherwise(F.round("x", 6)).alias("x"))


@query("drop_nulls", f"SELECT event_id, v FROM {_HOLES} WHERE v IS NOT NULL")
def _(spark, d):
    return O.drop_nulls(_holes(spark, d)).select("event_id", "v")


# scalar functions


@query(
    "string_functions",
    """SELECT p_partkey, upper(p_name) AS up, lower(p_type) AS low, contains(p_type, 'E') AS has, starts_with(p_type, 'S') AS starts, ends_with(p_type, 'L') AS ends, length(p_name) AS n, replace(p_brand, 'Brand', 'B') AS rep, trim(concat('  ', p_name, ' ')) AS stripped FROM part""",
)
def _(spark, d):
    c = F.col
    return table(spark, d, "part").select("p_partkey", F.upper("p_name").alias("up"), F.lower("p_type").alias("low"), S.false_if_null(c("p_type").contains("E")).alias("has"), S.false_if_null(c("p_type").startswith("S")).alias("starts"), S.false_if_null(c("p_type").endswith("L")).alias("ends"), F.char_length("p_name").cast("long").alias("n"), F.replace(c("p_brand"), F.lit("Brand"), F.lit("B")).alias("rep"), S.strip(F.concat(F.lit("\t "), c("p_name"), F.lit(" \n"))).alias("stripped"))


@query(
    "regex_functions",
    r"""SELECT c_custkey, regexp_matches(c_name, '[0-9]*7') AS m, regexp_extract(c_name, '([0-9]+)', 1) AS x, regexp_replace(c_name, '([0-9])', '<\1>', 'g') AS r, len(regexp_extract_all(c_name, '[0-4]')) AS n FROM customer""",
)
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.col("c_name").rlike("[0-9]*7").alias("m"), F.regexp_extract("c_name", "([0-9]+)", 1).alias("x"), F.regexp_replace("c_name", "([0-9])", "<$1>").alias("r"), F.regexp_count("c_name", F.lit("[0-4]")).cast("long").alias("n"))


@query(
    "date_parts",
    """SELECT event_id, year(ts) AS y, month(ts) AS mo, day(ts) AS d, hour(ts) AS h, minute(ts) AS mi, second(ts) AS s, isodow(ts) - 1 AS weekday, dayofyear(ts) AS doy FROM events""",
)
def _(spark, d):
    parts = {"y": F.year, "mo": F.month, "d": F.dayofmonth, "h": F.hour, "mi": F.minute, "s": F.second, "weekday": F.weekday, "doy": F.dayofyear}
    return table(spark, d, "events").select("event_id", *[f("ts").cast("long").alias(n) for n, f in parts.items()])


@query("date_shift_diff", "SELECT event_id, ts + INTERVAL 36 HOUR AS later, ts - INTERVAL 2 DAY AS earlier, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY event_id)) AS gap FROM events")
def _(spark, d):
    from pyspark.sql import Window

    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, d, "events").select("event_id", (F.col("ts") + F.expr("INTERVAL 36 HOURS")).alias("later"), (F.col("ts") - F.expr("INTERVAL 2 DAYS")).alias("earlier"), (us - F.lag(us).over(Window.partitionBy("user_id").orderBy("event_id"))).alias("gap"))


@query("date_range", "SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-03', INTERVAL 7 HOUR)) AS t")
def _(spark, d):
    return spark.sql("SELECT explode(sequence(TIMESTAMP_NTZ '2024-01-01 00:00:00', TIMESTAMP_NTZ '2024-01-03 00:00:00', INTERVAL 7 HOURS)) AS t")


@query("parse_datetime", "SELECT o_orderkey, o_orderdate AS a, date_trunc('day', o_orderdate) AS b FROM orders")
def _(spark, d):
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    return table(spark, d, "orders").select("o_orderkey", S.parse_datetime(stamp).cast("timestamp_ntz").alias("a"), S.parse_datetime(F.date_format("o_orderdate", "yyyy-MM-dd")).cast("timestamp_ntz").alias("b"))


@query(
    "math_functions",
    """SELECT event_id, round(abs(value - 50), 6) AS a, round(sqrt(value), 6) AS sq, round(sin(value), 6) AS si, round(cos(value), 6) AS co, round(exp(value / 100), 6) AS e, round(ln(value + 1), 6) AS l, round(log2(value + 1), 6) AS l2, round(log10(value + 1), 6) AS l10,
       floor(value)::BIGINT AS f, ceil(value)::BIGINT AS c, round(pow(value, 1.5), 4) AS p, least(greatest(value, 10), 60) AS cl FROM events WHERE value >= 0""",
)
def _(spark, d):
    v = F.col("value")
    r = lambda x, n=6: F.round(x, n)
    return table(spark, d, "events").filter("value >= 0").select("event_id", r(F.abs(v - 50)).alias("a"), r(F.sqrt(v)).alias("sq"), r(F.sin(v)).alias("si"), r(F.cos(v)).alias("co"), r(F.exp(v / 100)).alias("e"), r(F.ln(v + 1)).alias("l"), r(F.log2(v + 1)).alias("l2"), r(F.log10(v + 1)).alias("l10"), F.floor(v).alias("f"), F.ceil(v).alias("c"), r(F.pow(v, F.lit(1.5)), 4).alias("p"), S.clamp(v, 10.0, 60.0).alias("cl"))


# SQL and schema rules


@query("sql_group_having_order", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS m FROM events WHERE value > 10 GROUP BY event_type HAVING count(*) > 5 ORDER BY n DESC, event_type LIMIT 3")
def _(spark, d):
    return spark.sql("SELECT event_type, count(*) AS n, round(avg(value), 6) AS m FROM {t} WHERE value > 10 GROUP BY event_type HAVING count(*) > 5 ORDER BY n DESC, event_type LIMIT 3", t=table(spark, d, "events"))


@query("sql_join_is_null", "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_orderkey IS NULL OR o.o_totalprice > 400000")
def _(spark, d):
    return spark.sql("SELECT c.c_custkey, o.o_orderkey FROM {c} c LEFT JOIN {o} o ON c.c_custkey = o.o_custkey WHERE o.o_orderkey IS NULL OR o.o_totalprice > 400000", c=table(spark, d, "customer"), o=table(spark, d, "orders"))


@query(
    "validate_schema",
    """SELECT 'p_size' AS "column", 'range' AS rule, count(*) FILTER (p_size < 2 OR p_size > 40) AS violations FROM part UNION ALL SELECT 'p_type', 'one_of', count(*) FILTER (p_type NOT IN ('SMALL', 'LARGE')) FROM part
       UNION ALL SELECT 'p_brand', 'unique', count(p_brand) - count(DISTINCT p_brand) FROM part UNION ALL SELECT 'p_name', 'max_length', count(*) FILTER (strlen(p_name) > 6) FROM part UNION ALL SELECT 'p_partkey', 'not_null', count(*) FILTER (p_partkey IS NULL) FROM part""",
)
def _(spark, d):
    rules = [Rule("p_size", "range", (2, 40)), Rule("p_type", "one_of", ("SMALL", "LARGE")), Rule("p_brand", "unique"), Rule("p_name", "max_length", 6), Rule("p_partkey", "not_null")]
    return validate(table(spark, d, "part"), rules)


# event time


@query("tumbling_window", "SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY 1, 2")
def _(spark, d):
    return table(spark, d, "events").groupBy(F.window("ts", "6 hours"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("v")).select(F.col("window.start").alias("start"), "event_type", "n", "v")


@query("sliding_window", "SELECT time_bucket(INTERVAL 3 HOUR, ts) - h * INTERVAL 3 HOUR AS start, count(*) AS n FROM events, range(0, 2) t(h) GROUP BY 1")
def _(spark, d):
    return table(spark, d, "events").groupBy(F.window("ts", "6 hours", "3 hours")).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "n")


@query(
    "session_window",
    """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 4 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
       SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 4 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, k""",
)
def _(spark, d):
    got = table(spark, d, "events").groupBy("user_id", F.session_window("ts", "4 hours")).agg(F.count(F.lit(1)).alias("n"))
    return got.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
