"""Lazy projections, filters, time ranges, orders and counts over one table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helioframe.plans.text import ordering


def equalities(where: Mapping[str, Any]) -> Column:
    """All of the columns equal their values; a None value matches no row."""
    return reduce(lambda a, b: a & b, [F.col(c) == F.lit(v) for c, v in where.items()])


def select(df: DataFrame, columns: Sequence[str] | None = None, where: Mapping[str, Any] | None = None, order_by: str | None = None, limit: int | None = None) -> DataFrame:
    """Columns or expressions of the rows where all of `where` holds. Falsy columns, where, order_by and limit mean none."""
    out = df.where(equalities(where)) if where else df
    out = out.selectExpr(*columns) if columns else out
    out = out.orderBy(*ordering(order_by)) if order_by else out
    return out.limit(limit) if limit else out


def select_date_range(
    df: DataFrame, date_column: str, start_date: Any, end_date: Any, columns: Sequence[str] | None = None, where: Mapping[str, Any] | None = None,
    order_by: str | None = None, limit: int | None = None, inclusive_end: bool = False,
) -> DataFrame:
    """Rows from start_date to before end_date (or to it). Bounds are cast to the column's type, so that they reach the scan."""
    kind = df.schema[date_column].dataType
    low, high = F.lit(start_date).cast(kind), F.lit(end_date).cast(kind)
    c = F.col(date_column)
    return select(df.where((c >= low) & ((c <= high) if inclusive_end else (c < high))), columns, where, order_by, limit)


def count(df: DataFrame, where: Mapping[str, Any] | None = None) -> DataFrame:
    """One row with `n`, the number of rows where all of `where` holds."""
    return select(df, where=where).agg(F.count("*").alias("n"))


def exists(df: DataFrame, where: Mapping[str, Any] | None = None) -> DataFrame:
    """One row with `found`: whether any row matches; reads one row at most."""
    return select(df, where=where).limit(1).agg((F.count("*") > 0).alias("found"))


def parse_dates(df: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    """The named columns, where they exist, as timestamps without a zone."""
    return df.withColumns({c: F.to_timestamp_ntz(F.col(c)) for c in columns if c in df.columns})


def updated(df: DataFrame, changes: Mapping[str, Column], condition: Column) -> DataFrame:
    """The rows of df with the changes where the condition holds."""
    hit = F.coalesce(condition, F.lit(False))
    return df.select(*[F.when(hit, changes[c].cast(df.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in df.columns])


def deleted(df: DataFrame, condition: Column) -> DataFrame:
    """The rows of df for which the condition does not hold."""
    return df.where(~F.coalesce(condition, F.lit(False)))
