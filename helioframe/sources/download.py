"""Files fetched by the executors, with retries; each is written beside its place and then moved there."""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helioframe.plans.workers import ship


def download_single_file(source_url: str, destination: str, overwrite: bool = False, max_retries: int = 3, timeout: float = 30, verify: bool = True, wait: float = 1.0) -> bool:
    """Whether the file is there: it was before (and is not to be overwritten), or one of max_retries + 1 tries, ever further apart, fetched it."""
    import requests

    if os.path.exists(destination) and not overwrite:
        return True
    os.makedirs(os.path.dirname(os.path.abspath(destination)), exist_ok=True)
    beside = f"{destination}.{uuid.uuid4().hex[:8]}.part"
    for attempt in range(max_retries + 1):
        try:
            with requests.get(source_url, timeout=timeout, verify=verify, stream=True) as got, open(beside, "wb") as out:
                got.raise_for_status()
                for block in got.iter_content(1 << 20):
                    out.write(block)
            os.replace(beside, destination)
            return True
        except Exception:
            if os.path.exists(beside):
                os.remove(beside)
            if attempt < max_retries:
                time.sleep(wait * 2**attempt)
    return False


def downloads(tasks: DataFrame, overwrite: bool = False, max_retries: int = 3, parallel: int = 1, **options) -> DataFrame:
    """(url, dest, ok) of each task (url, dest), fetched by `parallel` tasks. dest must be on storage that all executors share."""

    ship(tasks.sparkSession)

    def run(frames):
        for pdf in frames:
            yield pdf.assign(ok=[download_single_file(u, d, overwrite, max_retries, **options) for u, d in zip(pdf["url"], pdf["dest"])])

    return tasks.select("url", "dest").repartition(max(1, parallel)).mapInPandas(run, "url string, dest string, ok boolean")


def tally(done: DataFrame) -> DataFrame:
    """One row: how many were downloaded (or already there) and how many failed."""
    return done.agg(F.count_if("ok").alias("downloaded"), F.count_if(~F.col("ok")).alias("failed"))


def download_parallel(spark: SparkSession, download_tasks: Iterable[tuple[str, str]], overwrite: bool = False, max_retries: int = 3, parallel: int = 1, **options) -> dict[str, int]:
    tasks = list(download_tasks)
    if not tasks:
        return {"downloaded": 0, "failed": 0}
    return tally(downloads(spark.createDataFrame(tasks, "url string, dest string"), overwrite, max_retries, parallel, **options)).first().asDict()
