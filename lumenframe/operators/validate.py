"""Schema rules, checked in one pass."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """kind: not_null, unique, range (low, high), one_of (values), min_length or max_length (bytes)."""

    column: str
    kind: str
    value: Any = None

    def violations(self) -> Column:
        c = F.col(f"`{self.column}`")
        if self.kind == "not_null":
            return F.count_if(c.isNull())
        if self.kind == "unique":
            return F.count(c) - F.count_distinct(c)
        if self.kind == "range":
            low, high = self.value
            return F.count_if((c < low) | (c > high))
        if self.kind == "one_of":
            return F.count_if(~c.isin(*self.value))
        if self.kind in ("min_length", "max_length"):
            n = F.octet_length(c)
            return F.count_if(n < self.value if self.kind == "min_length" else n > self.value)
        raise ValueError(f"unknown rule: {self.kind}")


def validate(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(column, rule, violations). A null violates not_null only."""
    one = df.agg(*[r.violations().cast("long").alias(str(k)) for k, r in enumerate(rules)])
    rows = F.array(*[F.struct(F.lit(r.column).alias("column"), F.lit(r.kind).alias("rule"), F.col(str(k)).alias("violations")) for k, r in enumerate(rules)])
    return one.select(F.inline(rows))
