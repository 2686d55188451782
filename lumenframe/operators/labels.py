"""Frames' shapes and types, label indexes of several levels, categories, and dates from parts."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def from_series(spark: SparkSession, **columns: Sequence) -> DataFrame:
    """Equally long sequences as columns."""
    if len({len(c) for c in columns.values()}) > 1:
        raise ValueError("columns differ in length")
    return spark.createDataFrame(pd.DataFrame(columns))


class FrameBuilder:
    """Columns one by one, then build()."""

    def __init__(self, spark: SparkSession):
        self.spark, self.columns = spark, {}

    def add_column(self, name: str, values: Sequence) -> FrameBuilder:
        self.columns[name] = values
        return self

    def build(self) -> DataFrame:
        return from_series(self.spark, **self.columns)


def shape(df: DataFrame) -> tuple[int, int]:
    return df.count(), len(df.columns)


def column_names(df: DataFrame) -> list[str]:
    return list(df.columns)


def dtypes(df: DataFrame) -> dict[str, str]:
    return dict(df.dtypes)


def column_typed(df: DataFrame, name: str, kind: str) -> Column:
    """The column, if it is of that type."""
    if name not in df.columns:
        raise KeyError(name)
    if dict(df.dtypes)[name] != kind:
        raise TypeError(f"{name} is {dict(df.dtypes)[name]}, not {kind}")
    return df[name]


def n_groups(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: how many groups there are; a null is a key like any other."""
    return df.groupBy(*keys).agg(F.lit(1).alias("_")).agg(F.count(F.lit(1)).alias("n_groups"))


def n_unique(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Distinct values that aren't null."""
    return df.groupBy(*by).agg(F.count_distinct(column).alias("n_unique"))


def apply(df: DataFrame, column: str, f: Callable[[Column], Column], name: str | None = None) -> DataFrame:
    """f of each value that isn't null, f being an expression."""
    return df.withColumn(name or column, F.when(F.col(column).isNotNull(), f(F.col(column))))


def map_values(df: DataFrame, column: str, f: Callable, returns: str, name: str | None = None) -> DataFrame:
    """f of each value that isn't null, f being a Python function, in Arrow batches."""
    @F.pandas_udf(returns)
    def run(values: pd.Series) -> pd.Series:
        return values.map(f, na_action="ignore")

    return df.withColumn(name or column, run(column))


def add_category(df: DataFrame, categories: Sequence[str], new: str, column: str, code: str = "code") -> tuple[DataFrame, list[str]]:
    """df coded by the dictionary with one more category, and the dictionary."""
    longer = [*categories, *([] if new in categories else [new])]
    place = F.array_position(F.array(*[F.lit(c) for c in longer]), F.col(column)) - 1
    return df.withColumn(code, F.when(place >= 0, place).cast("int")), longer


@dataclass(frozen=True)
class MultiIndex:
    """Rows of labels, a column per level; a row's number is in `row` if it has one."""

    df: DataFrame
    levels: tuple[str, ...]

    @classmethod
    def from_tuples(cls, spark: SparkSession, names: Sequence[str], tuples: Sequence[Sequence[str]]) -> MultiIndex:
        if any(len(t) != len(names) for t in tuples):
            raise ValueError("a tuple has another number of levels")
        ddl = "row long, " + ", ".join(f"`{n}` string" for n in names)
        return cls(spark.createDataFrame([(k, *t) for k, t in enumerate(tuples)], ddl), tuple(names))

    @classmethod
    def from_arrays(cls, spark: SparkSession, names: Sequence[str], arrays: Sequence[Sequence[str]]) -> MultiIndex:
        if len({len(a) for a in arrays}) > 1:
            raise ValueError("arrays differ in length")
        return cls.from_tuples(spark, names, list(zip(*arrays, strict=True)))

    @classmethod
    def of(cls, df: DataFrame, levels: Sequence[str]) -> MultiIndex:
        """Levels of a table, which keeps its other columns."""
        return cls(df, tuple(levels))

    def _name(self, level: int | str) -> str:
        return self.levels[level] if isinstance(level, int) else level

    def get_level(self, level: int | str) -> DataFrame:
        """The distinct labels of a level."""
        return self.df.select(self._name(level)).distinct()

    def get_label(self, row: int) -> DataFrame:
        return self.df.filter(F.col("row") == row).select(*self.levels)

    def select(self, level: int | str, label) -> DataFrame:
        return self.df.filter(F.col(self._name(level)) == F.lit(label))

    def select_tuple(self, labels: Sequence) -> DataFrame:
        out = self.df
        for level, label in zip(self.levels, labels, strict=True):
            out = out.filter(F.col(level) == F.lit(label))
        return out

    def swap_levels(self, i: int, j: int) -> MultiIndex:
        order = list(self.levels)
        order[i], order[j] = order[j], order[i]
        return MultiIndex(self.df, tuple(order))

    def droplevel(self, level: int | str) -> MultiIndex:
        name = self._name(level)
        if len(self.levels) == 1:
            raise ValueError("the last level stays")
        return MultiIndex(self.df.drop(name), tuple(x for x in self.levels if x != name))

    def sort(self) -> DataFrame:
        """In the order of the labels; `row` then is the permutation."""
        return self.df.orderBy(*self.levels)

    def to_flat_index(self, sep: str = "_") -> Column:
        return F.concat_ws(sep, *self.levels)


# dates


def from_ymd_hms(y, mo, d, h=0, mi=0, s=0) -> Column:
    lift = lambda x: F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)
    return F.try_make_timestamp_ntz(*[lift(x) for x in (y, mo, d, h, mi, s)])


def from_ymd(y, mo, d) -> Column:
    return from_ymd_hms(y, mo, d)


def _ntz(micros: Column) -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), micros.cast("decimal(20,0)") / 1_000_000)


def from_secs(c: Column) -> Column:
    return _ntz(c * 1_000_000)


def from_millis(c: Column) -> Column:
    return _ntz(c * 1000)


def from_nanos(c: Column) -> Column:
    """To the microsecond below, which is what Spark keeps."""
    return _ntz(F.floor(c / 1000))


def micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def timestamp(c: Column) -> Column:
    """Whole seconds since 1970, towards zero."""
    m = micros(c)
    return (m / 1_000_000).cast("long")


def timestamp_millis(c: Column) -> Column:
    return F.floor(micros(c) / 1000)


def timestamp_nanos(c: Column) -> Column:
    return micros(c) * 1000


def nanosecond(c: Column) -> Column:
    """Nanoseconds within the second."""
    return F.pmod(micros(c), F.lit(1_000_000)) * 1000


#: Microseconds of each unit.
UNITS = {"nanos": 0.001, "micros": 1, "millis": 1000, "seconds": 1_000_000, "minutes": 60_000_000, "hours": 3_600_000_000, "days": 86_400_000_000}


def duration(unit: str, n) -> Column:
    """A length of time as an interval, to the microsecond."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (n * UNITS[unit]).cast("decimal(20,0)") / 1_000_000)
