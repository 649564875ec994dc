"""Tables of an external database over JDBC, for sessions that have its driver; settings as load_config gives them."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def options(settings: Mapping[str, Any], table: str, column: str | None = None, low: Any = None, high: Any = None, parts: int = 1) -> dict[str, str]:
    """Options of Spark's JDBC source. With a column and its bounds the table is read by `parts` tasks, each a range of it."""
    out = {"url": f"jdbc:postgresql://{settings['host']}:{settings.get('port', 5432)}/{settings['database']}", "dbtable": table, "user": settings["user"], "password": settings["password"], "driver": "org.postgresql.Driver", "fetchsize": "10000"}
    if column is not None:
        if low is None or high is None:
            raise ValueError("a column needs its bounds")
        out |= {"partitionColumn": column, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(parts)}
    return out


def read(spark: SparkSession, settings: Mapping[str, Any], table: str, **ranges: Any) -> DataFrame:
    """The table as a lazy frame; filters and columns are pushed to the database."""
    return spark.read.format("jdbc").options(**options(settings, table, **ranges)).load()


def write(df: DataFrame, settings: Mapping[str, Any], table: str, mode: str = "append") -> None:
    """Appends the frame's rows to the table, batch by batch, one connection for each partition."""
    df.write.format("jdbc").options(**options(settings, table), batchsize="5000").mode(mode).save()
