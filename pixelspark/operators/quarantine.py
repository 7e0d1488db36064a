"""Jobs whose pictures may kill a Python worker: the killing rows are found and answered, the others finish.

A row that raises is answered where it is. A row that ends its worker (a crash of a library, the kernel's memory killer)
fails the whole Spark job. `fenced` runs the jobs; where a run fails so, the rows are dealt to LOTS lots by a number stored
with them, each lot is run by itself, and so on: a lot that holds no killer is done once, and a lot of one row that fails is
that row, which gets error code 9. Other failures are passed on. With k killers among n rows that is about k * log(n) further passes
over ever smaller lots, each written before the next begins.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.native import error_message
from ..schema import RESULT
from .reencode import _detail, _none, optimize_jobs

LOTS = 8
# What Spark says when a worker or its executor has died.
DEATHS = ("Python worker exited unexpectedly", "Python worker failed to connect back", "ExecutorLostFailure", "Connection reset", "Broken pipe", "EOFException")


def killed(e: Exception) -> bool:
    return any(d in str(e) for d in DEATHS)


def answered(jobs: DataFrame) -> DataFrame:
    """Result rows of code 9 for jobs that no worker survives."""
    sizes = F.coalesce(F.octet_length("content"), F.lit(0)).cast("long")
    known = {"path": F.col("path"), "mode": F.col("mode"), "state": F.lit("failed"), "original_bytes": sizes, "hdr": F.lit("absent"), "error_code": F.lit(9), "error_detail": _detail(F.lit("the worker died")), "metadata_removed": F.lit(False)}
    rows = jobs.select(*[known.get(k, F.col(k) if k == "modificationTime" and k in jobs.columns else _none(kind)).cast(kind).alias(k) for k, kind in RESULT.items()])
    return rows.withColumn("error_message", error_message(F.col("error_code")))


def fenced(jobs: DataFrame, folder: str, work: Callable[[DataFrame], DataFrame] = optimize_jobs, lots: int = LOTS) -> DataFrame:
    """Result rows of all jobs, written under folder (shared by driver and executors), killers among them as code 9."""
    spark, place = jobs.sparkSession, f"{folder.rstrip('/')}/jobs-{uuid.uuid4().hex}"
    jobs.withColumn("__row", F.monotonically_increasing_id()).write.parquet(place)  # so that a row has the same number in every pass
    rows, done = spark.read.parquet(place), []

    def run(part: DataFrame, depth: int) -> None:
        out = f"{folder.rstrip('/')}/results-{uuid.uuid4().hex}"
        try:
            work(part.drop("__row")).write.parquet(out)
        except Exception as e:  # noqa: BLE001  what is no death is passed on
            if not killed(e):
                raise
            if part.count() > 1:
                for k in range(lots):
                    lot = part.where(F.pmod(F.xxhash64("__row", F.lit(depth)), F.lit(lots)) == k)
                    if not lot.isEmpty():
                        run(lot, depth + 1)
                return
            out = f"{folder.rstrip('/')}/results-{uuid.uuid4().hex}"
            answered(part.drop("__row")).write.parquet(out)
        done.append(out)

    run(rows, 0)
    return spark.read.parquet(*done)

