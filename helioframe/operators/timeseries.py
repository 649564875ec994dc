"""Gap-filled resampling, time chunks and summary statistics."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _start(ts: str, step: str) -> Column:
    return F.window(F.col(ts), step)["start"].cast("timestamp_ntz")


def _grid(binned: DataFrame, step: str) -> DataFrame:
    """Every bin from the first to the last; two values decide it, so one small task makes it."""
    ends = binned.agg(F.min("bin").alias("a"), F.max("bin").alias("b"))
    return ends.where("a IS NOT NULL").select(F.explode(F.sequence("a", "b", F.expr(f"INTERVAL '{step}'"))).alias("bin"))


def resample_mean(df: DataFrame, ts: str, columns: Sequence[str], step: str = "1 day") -> DataFrame:
    """(bin, columns...): the mean of each column over each bin; bins without rows are null. Null times are left out."""
    sums = df.where(F.col(ts).isNotNull()).groupBy(_start(ts, step).alias("bin")).agg(*[F.avg(c).alias(c) for c in columns])
    return _grid(sums, step).join(sums, "bin", "left")


def resample_size(df: DataFrame, ts: str, step: str = "1 hour") -> DataFrame:
    """(bin, n): the rows of each bin, 0 for bins without rows."""
    counts = df.where(F.col(ts).isNotNull()).groupBy(_start(ts, step).alias("bin")).agg(F.count("*").alias("n"))
    return _grid(counts, step).join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def time_chunks(df: DataFrame, ts: str, start: datetime | str, end: datetime | str, days: int = 7) -> DataFrame:
    """The rows of [start, end) with `chunk`: the number of the half-open chunk of so many days, from start, that holds the row."""
    low, high = F.lit(str(start)).cast("timestamp_ntz"), F.lit(str(end)).cast("timestamp_ntz")
    inside = df.where((F.col(ts) >= low) & (F.col(ts) < high))
    return inside.withColumn("chunk", F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ '{start}', {ts}) DIV {days * 86400}").cast("long"))


def describe(df: DataFrame, column: str, approximate: int = 0) -> DataFrame:
    """One row: count, mean, sample deviation, minimum, quartiles and maximum of a column's values.

    The quartiles are exact and linear between neighbours, for which one task gathers the distinct values. For columns
    with too many of them, `approximate` (say 10,000) gives values whose ranks are off by a share of 1 / approximate at
    most, from sketches of bounded size.
    """
    at = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    q = F.percentile_approx(column, at, approximate).cast("array<double>") if approximate else F.percentile(column, at)
    out = df.agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.min(column).alias("low"), q.alias("q"), F.max(column).alias("high"))
    return out.select("n", "mean", "std", "low", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"), "high")
