"""The resampling of operators.timeseries over a stream: counts and means of each bin, final once the watermark has passed it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_resample(df: DataFrame, ts: str, columns: Sequence[str], step: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(bin, n, columns...) of a streaming frame; rows later than `late` are dropped. Empty bins do not appear: a stream has no last bin."""
    bins = df.withWatermark(ts, late).groupBy(F.window(ts, step))
    return bins.agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in columns]).select(F.col("window.start").alias("bin"), "n", *columns)
