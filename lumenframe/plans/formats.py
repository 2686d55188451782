"""Round trips through formats, shapes and types, label indexes and dates from parts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lumenframe.operators import labels as L
from lumenframe.operators.lineage import shared_folder
from lumenframe.plans.registry import Registry
from lumenframe.sources import files as X
from lumenframe.sources.tables import table

query = Registry()
QUERIES, SQL = query.queries, query.sql


def _place(spark) -> str:
    return f"{shared_folder(spark)}/formats/{uuid.uuid4().hex}"


for _codec in ("zstd", "gzip"):

    @query(f"parquet_{_codec}", "SELECT o_orderkey, o_totalprice, o_orderdate FROM orders")
    def _(spark, d, codec=_codec):
        path = _place(spark)
        X.write_parquet(table(spark, d, "orders"), path, codec)
        return X.read_parquet(spark, path, ["o_orderkey", "o_totalprice", "o_orderdate"])


@query("orc_round_trip", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def _(spark, d):
    path = _place(spark)
    X.write_orc(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_comment") if "o_comment" in table(spark, d, "orders").columns else table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), path, "zlib", 1 << 20)
    return X.read_orc(spark, path, ["o_orderkey", "o_orderstatus", "o_totalprice"])


@query("avro_round_trip", "SELECT event_id, user_id, event_type, value, ts FROM events")
def _(spark, d):
    path = _place(spark)
    X.write_avro(table(spark, d, "events").select("event_id", "user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts")), path)
    return X.read_avro(spark, path).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("excel_round_trip", "SELECT CAST(n_nationkey AS DOUBLE) AS n_nationkey, n_name, CAST(n_regionkey AS DOUBLE) AS n_regionkey FROM nation")
def _(spark, d):
    path = _place(spark) + "/nation.xlsx"
    X.write_excel(table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), path, "nations")
    return X.read_excel(spark, path, "nations")


@query("frame_shape", "SELECT (SELECT count(*) FROM nation) AS n_rows, (SELECT count(*) FROM duckdb_columns() WHERE table_name = 'nation') AS n_columns, true AS typed, true AS names_found")
def _(spark, d):
    nation = table(spark, d, "nation")
    rows, columns = L.shape(nation)
    typed = nation.select(L.column_typed(nation, "n_name", L.dtypes(nation)["n_name"])).columns == ["n_name"]
    return L.FrameBuilder(spark).add_column("n_rows", [rows]).add_column("n_columns", [columns]).add_column("typed", [typed]).add_column("names_found", [L.column_names(nation) == nation.columns]).build()


@query("group_count", "SELECT count(*) AS n_groups FROM (SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem)")
def _(spark, d):
    return L.n_groups(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"])


@query("string_n_unique", "SELECT event_type, count(DISTINCT CASE WHEN event_id % 3 <> 0 THEN CAST(user_id AS VARCHAR) END) AS n_unique FROM events GROUP BY 1")
def _(spark, d):
    return L.n_unique(table(spark, d, "events").withColumn("u", F.when(F.col("event_id") % 3 != 0, F.col("user_id").cast("string"))), "u", ["event_type"])


@query("date_min_max", "SELECT event_type, min(ts) AS first, max(ts) AS last FROM events GROUP BY 1")
def _(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))


@query("add_category", "SELECT o_orderkey, CAST(CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'F' THEN 1 WHEN 'P' THEN 2 END AS INTEGER) AS code FROM orders")
def _(spark, d):
    coded, _ = L.add_category(table(spark, d, "orders"), ["O", "F"], "P", "o_orderstatus")
    return coded.select("o_orderkey", "code")


@query("series_apply_map", "SELECT p_partkey, CASE WHEN p_size % 5 <> 0 THEN p_size * 2 + 1 END AS applied, CASE WHEN p_size % 5 <> 0 THEN 's' || p_size END AS mapped FROM part")
def _(spark, d):
    part = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 5 != 0, F.col("p_size")).alias("x"))
    out = L.map_values(L.apply(part, "x", lambda c: c * 2 + 1, "applied"), "x", lambda v: f"s{int(v)}", "string", "mapped")
    return out.select("p_partkey", "applied", "mapped")


@query("multi_index_levels", "SELECT 'level' AS what, n_regionkey::VARCHAR AS label, NULL AS row FROM (SELECT DISTINCT n_regionkey FROM nation) UNION ALL SELECT 'tuple', n_name, NULL FROM nation WHERE n_regionkey = 2 AND n_name = (SELECT min(n_name) FROM nation WHERE n_regionkey = 2) UNION ALL SELECT 'swapped', n_name || '_' || n_regionkey, NULL FROM nation UNION ALL SELECT 'dropped', n_name, NULL FROM nation")
def _(spark, d):
    nation = table(spark, d, "nation")
    index = L.MultiIndex.of(nation, ["n_regionkey", "n_name"])
    least = nation.filter("n_regionkey = 2").agg(F.min("n_name")).first()[0]
    row = lambda df, what, c: df.select(F.lit(what).alias("what"), c.cast("string").alias("label"), F.lit(None).cast("int").alias("row"))
    swapped = index.swap_levels(0, 1)
    parts = [row(index.get_level(0), "level", F.col("n_regionkey")), row(index.select_tuple([2, least]), "tuple", F.col("n_name")), row(swapped.df, "swapped", swapped.to_flat_index()), row(index.droplevel(0).df, "dropped", F.col("n_name"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


@query("multi_index_tuples", "SELECT 2::BIGINT AS row, 'a' AS x, 'p' AS y UNION ALL SELECT 0, 'b', 'q' UNION ALL SELECT 1, 'b', 'r'")
def _(spark, d):
    return L.MultiIndex.from_arrays(spark, ["x", "y"], [["b", "b", "a"], ["q", "r", "p"]]).sort()


@query("dates_from_parts", "SELECT event_id, make_timestamp(2000 + event_id % 30, 1 + event_id % 12, 1 + event_id % 28, event_id % 24, event_id % 60, 7.0) AS made, make_timestamp(2000 + event_id % 30, 1 + event_id % 12, 1 + event_id % 28, 0, 0, 0.0) AS day, make_timestamp(event_id * 7919000000) AS secs, make_timestamp(event_id * 7919000) AS millis, make_timestamp(event_id * 7919) AS nanos FROM events")
def _(spark, d):
    i = F.col("event_id")
    y, mo, day = ((2000 + i % 30), (1 + i % 12), (1 + i % 28))
    ints = [x.cast("int") for x in (y, mo, day, i % 24, i % 60)]
    return table(spark, d, "events").select("event_id", L.from_ymd_hms(*ints, F.lit(7)).alias("made"), L.from_ymd(*ints[:3]).alias("day"), L.from_secs(i * 7919).alias("secs"), L.from_millis(i * 7919).alias("millis"), L.from_nanos(i * 7919000).alias("nanos"))


@query("timestamps_of_dates", "SELECT event_id, epoch_us(ts) // 1000000 AS secs, epoch_us(ts) // 1000 AS millis, epoch_us(ts) * 1000 AS nanos, (epoch_us(ts) % 1000000) * 1000 AS nanosecond, ts + INTERVAL 3 DAY AS later FROM events")
def _(spark, d):
    ts = F.col("ts")
    return table(spark, d, "events").select("event_id", L.timestamp(ts).alias("secs"), L.timestamp_millis(ts).alias("millis"), L.timestamp_nanos(ts).alias("nanos"), L.nanosecond(ts).alias("nanosecond"), (ts + L.duration("days", 3)).alias("later"))
