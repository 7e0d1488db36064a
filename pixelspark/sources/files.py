"""Image files as rows, and results written back beside or over them."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.native import extension_ok


def read_files(spark: SparkSession, path: str, only_images: bool = False) -> DataFrame:
    """path, modificationTime, length, content; content is not read where it is not selected."""
    files = spark.read.format("binaryFile").load(path)
    return files.where(extension_ok(F.col("path"))) if only_images else files


def _local(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


def _put(data: bytes, place: str, like: str) -> None:
    """Write data to place in one step, with the mode, dates and extended attributes (tags) of the file `like`."""
    beside = os.path.join(os.path.dirname(place), f".pixelspark-{uuid.uuid4().hex}.tmp")
    try:
        with open(beside, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        shutil.copystat(like, beside)  # extended attributes too, where the system has them
        os.utime(beside)
        os.replace(beside, place)
    finally:
        if os.path.exists(beside):
            os.remove(beside)


def _written(results: DataFrame, one: Callable[[str, bytes, int, object], bool]) -> DataFrame:
    seen = F.col("modificationTime") if "modificationTime" in results.columns else F.lit(None).cast("timestamp")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done, problem = [], []
            for path, data, size, at in zip(batch["path"], batch["data"], batch["original_bytes"], batch["at"], strict=True):
                try:
                    done.append(one(_local(path), bytes(data), size, at))
                    problem.append(None)
                except OSError as e:  # a file that has gone or may not be written is its own row's matter
                    done.append(False)
                    problem.append(str(e))
            yield pd.DataFrame({"path": batch["path"], "written": done, "problem": problem}).astype(object)

    finished = results.where("state = 'done' AND path IS NOT NULL").select("path", "data", "original_bytes", F.unix_micros(seen).alias("at"))
    return finished.mapInPandas(run, "path string, written boolean, problem string")


def replace_in_place(results: DataFrame) -> DataFrame:
    """Write data over each local path of finished rows: to a temporary file beside it first, then in one step.

    Returns path, written and problem. A file whose size is no longer original_bytes, or whose time is no longer
    modificationTime (where results have it), is left alone, so a repeated or speculative task does not replace twice.
    Store results before calling this: the inputs change under a plan that reads them.
    """

    def one(path: str, data: bytes, size: int, at: object) -> bool:
        now = os.stat(path)
        if now.st_size != size or (at is not None and at == at and abs(now.st_mtime_ns // 1000 - int(at)) >= 1000):
            return False
        _put(data, path, path)
        return True

    return _written(results, one)


def write_beside(results: DataFrame, suffix: str = "-small") -> DataFrame:
    """Write data of finished rows beside the originals, with `suffix` before the extension; the originals stay."""

    def one(path: str, data: bytes, size: int, at: object) -> bool:
        stem, extension = os.path.splitext(path)
        _put(data, f"{stem}{suffix}{extension}", path)
        return True

    return _written(results, one)


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a temporary folder in local mode, else one in the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.pixelspark.shared", None)
    if not found:
        local = spark.sparkContext.master.split("[")[0] == "local"
        found = "file://" + tempfile.mkdtemp(prefix="pixelspark-") if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/pixelspark-{uuid.uuid4().hex}"
        spark.conf.set("spark.pixelspark.shared", found)
    return found.rstrip("/")


def written(rows: DataFrame, name: str) -> DataFrame:
    """rows written to the shared folder and read back: lineage is cut, and a lost executor costs no recomputation."""
    place = f"{shared_folder(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(place)
    return rows.sparkSession.read.schema(rows.schema).parquet(place)


def stored(results: DataFrame, table: str | None = None, beside: str | None = None) -> DataFrame:
    """results written as Parquet and read back: to `table`, or to a folder under spark.checkpoint.dir, or else to one named after `beside`.

    A sink may replace the files that results were made from, so they must not be computed again, whatever is lost: a cache
    is not enough. Without any place this is an error.
    """
    spark = results.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if table is None and not shared and not beside:
        raise ValueError("no place to store results: name a table, or set spark.checkpoint.dir")
    place = table or (f"{shared.rstrip('/')}/results-{uuid.uuid4().hex}" if shared else f"{beside.rstrip('/')}-results-{uuid.uuid4().hex}")
    results.write.parquet(place)
    return spark.read.schema(results.schema).parquet(place)


def require_some(files: DataFrame) -> DataFrame:
    """files; ValueError where there are none."""
    if files.isEmpty():
        raise ValueError("No JPEG or PNG images were selected.")
    return files
