"""Projection, slices, joins, grouping and reshaping.

A DataFrame has no row order, so whatever depends on one takes `order_by`; ties are the caller's to break. Names that are
missing or clash raise ValueError before anything runs. Nulls follow SQL unless a docstring says otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.operators.lineage import cut


def _need(df: DataFrame, names: Sequence[str]) -> None:
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"no such column: {', '.join(missing)}")


def select(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The named columns; a name given twice is an error."""
    _need(df, names)
    if len(set(names)) < len(names):
        raise ValueError("a column is named twice")
    return df.select(*names)


def drop_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """df without the named columns, all of which must be there."""
    _need(df, names)
    return df.drop(*names)


def rename(df: DataFrame, old: str, new: str) -> DataFrame:
    """df with a column renamed; the new name must be free."""
    _need(df, [old])
    if new != old and new in df.columns:
        raise ValueError(f"{new} is there already")
    return df.withColumnRenamed(old, new)


def add_column(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with one more column; its name must be free."""
    if name in df.columns:
        raise ValueError(f"{name} is there already")
    return df.withColumn(name, value)


def head(df: DataFrame, n: int, order_by: Sequence[str]) -> DataFrame:
    """The first n rows; planned as a top-n without a full sort."""
    return df.orderBy(*order_by).limit(n)


def tail(df: DataFrame, n: int, order_by: Sequence[str]) -> DataFrame:
    """The last n rows, in order."""
    last = df.orderBy(*[F.col(c).desc_nulls_last() for c in order_by]).limit(n)
    return last.orderBy(*order_by)


def slice_rows(df: DataFrame, offset: int, length: int, order_by: Sequence[str]) -> DataFrame:
    """`length` rows from `offset` on."""
    return df.orderBy(*order_by).offset(offset).limit(length)


def sort_by(df: DataFrame, keys: Sequence[str], ascending: bool = True) -> DataFrame:
    """Nulls come last ascending and first descending."""
    return df.orderBy(*[F.col(k).asc_nulls_last() if ascending else F.col(k).desc_nulls_first() for k in keys])


def unique(df: DataFrame, column: str, order_by: str) -> DataFrame:
    """Distinct values in the order they are first seen: (column, first)."""
    return df.groupBy(column).agg(F.min(order_by).alias("first")).orderBy("first")


def argsort(df: DataFrame, column: str, order_by: str, ascending: bool = True) -> DataFrame:
    """df with `position`, the 0-based place of each row when sorted by column; ties keep their order.

    One global ranking: rows are range-partitioned and ranked per partition, partition sizes being added up.
    """
    key = F.col(column).asc_nulls_last() if ascending else F.col(column).desc_nulls_first()
    return with_row_number(df, [key, F.col(order_by).asc()], "position")


def with_row_number(df: DataFrame, keys: Sequence[Column], name: str = "row_idx") -> DataFrame:
    """Contiguous 0-based numbers in the order of keys, without bringing all rows to one task.

    Rows are sorted by range partitions and numbered within them; the partitions' sizes, a row each, are added up.
    """
    rows = cut(df.orderBy(*keys).withColumn("_m", F.monotonically_increasing_id()))
    rows = rows.select("*", F.shiftrightunsigned("_m", 33).alias("_p"), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)).alias("_i"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).withColumn("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return rows.join(F.broadcast(sizes), "_p").select(*df.columns, (F.col("_b") + F.col("_i")).alias(name))


def running_sums(df: DataFrame, keys: Sequence[Column], sums: dict[str, str]) -> DataFrame:
    """Inclusive running sums of columns in the order of keys, which are to be distinct; `sums` maps a column to its sum's name.

    As with_row_number: a window within each range partition, plus what the partitions before it add up to, a row each.
    """
    rows = cut(df.orderBy(*keys).withColumn("_m", F.monotonically_increasing_id())).withColumn("_p", F.shiftrightunsigned("_m", 33))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("_p").orderBy("_m").rowsBetween(Window.unboundedPreceding, 0)
    totals = rows.groupBy("_p").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    bases = totals.select("_p", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_b_{c}") for c in sums])
    inside = rows.select("*", *[F.sum(c).over(within).alias(f"_w_{c}") for c in sums])
    return inside.join(F.broadcast(bases), "_p").select(*df.columns, *[(F.col(f"_w_{c}") + F.col(f"_b_{c}")).alias(name) for c, name in sums.items()])


def join(left: DataFrame, right: DataFrame, left_on: Sequence[str], right_on: Sequence[str] | None = None, how: str = "inner", null_safe: bool = False) -> DataFrame:
    """Equi-join. Columns: all of the left, then the right ones that are not keys; names on both sides get _left and _right.

    null_safe: null keys match null keys. Keys of rows that only the right side has are taken from there.
    """
    right_on = right_on or left_on
    _need(left, left_on), _need(right, right_on)
    a, b = left.alias("a"), right.alias("b")
    on = reduce(lambda x, y: x & y, [F.col(f"a.`{x}`").eqNullSafe(F.col(f"b.`{y}`")) if null_safe else F.col(f"a.`{x}`") == F.col(f"b.`{y}`") for x, y in zip(left_on, right_on, strict=True)])
    joined = a.join(b, on, how)
    if how.replace("_", "") in ("leftsemi", "leftanti", "semi", "anti"):
        return joined
    rest = [c for c in right.columns if c not in right_on]
    both = set(left.columns) & set(rest)
    keys = dict(zip(left_on, right_on, strict=True))
    outer = how.replace("_", "") in ("right", "rightouter", "outer", "full", "fullouter")
    out = [(F.coalesce(F.col(f"a.`{c}`"), F.col(f"b.`{keys[c]}`")) if outer and c in keys else F.col(f"a.`{c}`")).alias(f"{c}_left" if c in both else c) for c in left.columns]
    return joined.select(*out, *[F.col(f"b.`{c}`").alias(f"{c}_right" if c in both else c) for c in rest])


def asof_join(left: DataFrame, right: DataFrame, on: str, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Each left row with `values` of the last right row of its key at or before it.

    One sort of both sides together by key and time, no join: the last right values are carried along a window.
    """
    side = lambda df, n, own: df.select(*[F.col(c) for c in [*by, on]], F.lit(n).alias("_side"), (F.struct(*left.columns) if own else F.lit(None).cast(T.StructType(left.schema.fields))).alias("_row"), (F.lit(None).cast(T.StructType([right.schema[c] for c in values])) if own else F.struct(*values)).alias("_value"))
    both = side(right, 0, False).unionAll(side(left, 1, True))
    w = Window.partitionBy(*by).orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("_value", F.last("_value", ignorenulls=True).over(w)).filter("_side = 1").select("_row.*", "_value.*")


def range_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """Pairs with low <= point < high, by an equi-join on bins of `width`, each range standing in the bins it reaches into."""
    bins = ranges.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return points.withColumn("_bin", F.floor(F.col(point) / width)).join(bins, "_bin").filter((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))).drop("_bin")


AGGREGATES = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max}


def aggregate(df: DataFrame, by: Sequence[str], how: str, columns: Sequence[str] | None = None, order_by: str | None = None) -> DataFrame:
    """sum, mean, min, max, count, first or last of every numeric (or named) column by group; first and last need order_by.

    count is the number of rows, as `<column>_count`.
    """
    _need(df, by)
    columns = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in by]
    if how in AGGREGATES:
        out = [AGGREGATES[how](c).alias(c) for c in columns]
    elif how == "count":
        out = [F.count(F.lit(1)).alias(f"{c}_count") for c in columns]
    elif how in ("first", "last"):
        if not order_by:
            raise ValueError("first and last depend on order_by")
        out = [(F.min_by if how == "first" else F.max_by)(c, order_by).alias(c) for c in columns]
    else:
        raise ValueError(f"unknown aggregate: {how}")
    return df.groupBy(*by).agg(*out)


def pivot(df: DataFrame, index: Sequence[str], column: str, value: str, how: str = "sum", values: Sequence | None = None) -> DataFrame:
    """One column `<value>_<v>` for each v of column; cells without rows are null. Without `values` the distinct ones are read
    first, which is one more pass; more than spark.sql.pivotMaxValues of them are an error."""
    if values is None:
        most = int(df.sparkSession.conf.get("spark.sql.pivotMaxValues", "10000"))
        values = [r[0] for r in df.select(column).distinct().orderBy(column).limit(most + 1).collect()]
        if len(values) > most:
            raise ValueError(f"{column} has more than {most} values")
    agg = AGGREGATES.get(how) or {"count": F.count}[how]
    out = df.groupBy(*index).pivot(column, values).agg(agg(value))
    return out.toDF(*index, *[f"{value}_{v}" for v in values])


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str] | None = None, variable: str = "variable", value: str = "value") -> DataFrame:
    """Wide to long; values become strings, so that columns of different types can stand in one."""
    values = values or [c for c in df.columns if c not in ids]
    return df.select(*ids, *[F.col(c).cast("string").alias(c) for c in values]).unpivot(list(ids), list(values), variable, value)


def crosstab(df: DataFrame, index: str, column: str, values: Sequence | None = None) -> DataFrame:
    """Row counts of index by column, as `<index>_<v>`."""
    values = values if values is not None else [r[0] for r in df.select(column).distinct().orderBy(column).collect()]
    out = df.groupBy(index).pivot(column, values).agg(F.count(F.lit(1)))
    return out.toDF(index, *[f"{index}_{v}" for v in values])


def categorical(df: DataFrame, column: str, code: str = "code", categories: Sequence[str] | None = None) -> DataFrame:
    """df with the 0-based code of each value: its place in `categories`, or in the sorted distinct values (null: null)."""
    if categories is not None:
        at = F.array_position(F.array(*[F.lit(c) for c in categories]), F.col(column)) - 1
        return df.withColumn(code, F.when(at >= 0, at).cast("int"))
    known = df.select(column).dropna().distinct()
    ranked = known.withColumn(code, (F.row_number().over(Window.orderBy(column)) - 1).cast("int"))  # over distinct values only
    return df.join(ranked, column, "left")


def rename_category(df: DataFrame, column: str, old: str, new: str) -> DataFrame:
    return df.withColumn(column, F.when(F.col(column) == old, F.lit(new)).otherwise(F.col(column)))


def index_from_product(spark: SparkSession, levels: dict[str, Sequence[str]]) -> DataFrame:
    """All combinations of the levels' labels."""
    return reduce(lambda a, b: a.crossJoin(b), [spark.createDataFrame([(v,) for v in values], f"`{name}` string") for name, values in levels.items()])


def index_select(df: DataFrame, **labels: str) -> DataFrame:
    """Rows whose levels have the given labels."""
    return df.filter(reduce(lambda a, b: a & b, [F.col(k) == v for k, v in labels.items()]))


def flat_index(df: DataFrame, levels: Sequence[str], name: str = "label") -> DataFrame:
    return df.withColumn(name, F.concat_ws("_", *levels))


def union_all(*frames: DataFrame) -> DataFrame:
    """Rows of all frames, matched by column name."""
    return reduce(lambda a, b: a.unionByName(b), frames)


def null_counts(df: DataFrame) -> DataFrame:
    """(column, nulls), in one pass."""
    one = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    return one.unpivot([], list(df.columns), "column", "nulls")


def drop_nulls(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Rows without a null (NaN is a value here)."""
    return df.filter(reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNotNull() for c in subset or df.columns]))
