"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What `[^\x20\x09-\x0D]+` calls a word is what lies between runs of these.
SPACE_CLASS = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, a temporary one in local mode, else one in the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.pixelspark.checkpoint.dir", None)
    if not found:
        local = spark.sparkContext.master.split("[")[0] == "local"
        found = "file://" + tempfile.mkdtemp(prefix="pixelspark-") if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/pixelspark-{uuid.uuid4().hex}"
        spark.conf.set("spark.pixelspark.checkpoint.dir", found)
    return found.rstrip("/")


def stash(df: DataFrame, name: str, **options: object) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut, and a lost executor costs no recomputation. options: of the writer."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000, size: str = "4m") -> Iterator[None]:
    """While this is open, what is run hands at most so many rows and bytes at a time to Python workers, which bounds what a
    worker and the buffers between it and the JVM hold. For code that runs its jobs itself (`stash`)."""
    names = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {name: spark.conf.get(name, None) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once per row even when body mentions it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Cells of the presence table that `likely` broadcasts: its size bound, whatever the number of keys.
PRESENCE_CELLS = 1 << 20


def cells(keys: DataFrame, *columns: str) -> DataFrame:
    """The cells of a presence table that the keys fall into: at most PRESENCE_CELLS rows, so it may be broadcast."""
    return F.broadcast(stash(keys.select(_cell(*[F.col(c) for c in columns])).distinct(), "cells"))


def _cell(*columns: Column) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(PRESENCE_CELLS)).alias("__cell")


def likely(rows: DataFrame, presence: DataFrame, *columns: str, there: bool = True) -> DataFrame:
    """rows whose key may be among those of `cells` (there), or is certainly not; without a shuffle."""
    return rows.withColumn("__cell", _cell(*[F.col(c) for c in columns])).join(presence, "__cell", "left_semi" if there else "left_anti").drop("__cell")
