"""Results written over or beside their files in two phases, as a data source with a commit protocol.

    results.write.format("pixelspark_files").option("journal", folder).mode("append").save()
    finish(spark, folder)

`write` runs in the tasks: each stages its rows as temporary files beside their targets and lists them in a part of the
journal; a task that fails removes what it staged. `commit` runs once all tasks are through: it names the parts of those tasks
in one step, which is the decision; a second commit of one journal changes nothing. `abort` removes what was staged.
Until the decision no original has been touched. `finish` then puts staged files in place, as a Spark job over the parts;
a file that has changed since it was read is left alone, and what an interrupted run has placed already is skipped, so it
may be run again. Only one name for each task passes through the driver.

The journal is a folder that driver and executors reach by the same path, as they do the pictures. Options: journal; suffix,
to write beside the originals with it before the extension instead of over them.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

NAME, DECISION = "pixelspark_files", "COMMITTED"


def local(path: str) -> str:
    return "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path


@dataclass
class Part(WriterCommitMessage):
    name: str | None


def _remove(path: str) -> None:
    if os.path.exists(path):
        os.remove(path)


def _entries(journal: str, part: str) -> Iterator[dict]:
    with open(os.path.join(journal, part)) as f:
        for line in f:
            yield json.loads(line)


class _Writer(DataSourceWriter):
    def __init__(self, options: dict) -> None:
        if not options.get("journal"):
            raise ValueError("the option journal is missing: a folder that driver and executors share")
        self.journal, self.suffix = local(options["journal"]), options.get("suffix", "")

    def write(self, iterator: Iterator) -> Part:
        os.makedirs(self.journal, exist_ok=True)
        part, staged = f"{uuid.uuid4().hex}.part", []
        try:
            with open(os.path.join(self.journal, part), "w") as listed:
                for row in iterator:
                    if row["data"] is None or row["path"] is None:
                        continue
                    path = local(row["path"])
                    stem, extension = os.path.splitext(path)
                    target = f"{stem}{self.suffix}{extension}" if self.suffix else path
                    beside = os.path.join(os.path.dirname(target), f".pixelspark-{uuid.uuid4().hex}.tmp")
                    staged.append(beside)
                    with open(beside, "wb") as f:
                        f.write(row["data"])
                        f.flush()
                        os.fsync(f.fileno())
                    listed.write(json.dumps({"path": path, "target": target, "staged": beside, "size": row["original_bytes"], "at": row["at"]}) + "\n")
                listed.flush()
                os.fsync(listed.fileno())
        except BaseException:
            for beside in [*staged, os.path.join(self.journal, part)]:
                _remove(beside)
            raise
        return Part(part)

    def commit(self, messages: list) -> None:
        decision = os.path.join(self.journal, DECISION)
        if os.path.exists(decision):
            return
        os.makedirs(self.journal, exist_ok=True)
        draft = f"{decision}-{uuid.uuid4().hex}"
        with open(draft, "w") as f:
            json.dump([m.name for m in messages if m is not None and m.name], f)
            f.flush()
            os.fsync(f.fileno())
        os.replace(draft, decision)

    def abort(self, messages: list) -> None:
        for m in messages:
            if m is not None and m.name and os.path.exists(os.path.join(self.journal, m.name)):
                for entry in _entries(self.journal, m.name):
                    _remove(entry["staged"])
                _remove(os.path.join(self.journal, m.name))


class PictureFiles(DataSource):
    """See the module."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:  # noqa: ANN001
        return _Writer(self.options)


def stage(results: DataFrame, journal: str, suffix: str = "") -> None:
    """Stage the data of finished rows (path, data, original_bytes, modificationTime if known) and decide; nothing is in place yet."""
    spark = results.sparkSession
    spark.dataSource.register(PictureFiles)
    seen = F.unix_micros("modificationTime") if "modificationTime" in results.columns else F.lit(None).cast("long")
    rows = results.where("state = 'done' AND path IS NOT NULL").select("path", "data", "original_bytes", seen.alias("at"))
    rows.write.format(NAME).option("journal", journal).option("suffix", suffix).mode("append").save()


def _place(entry: dict) -> tuple[str, bool, str | None]:
    """Put one staged file in place, with the mode, dates and extended attributes (tags) of its original."""
    try:
        if not os.path.exists(entry["staged"]):
            return entry["path"], False, None  # placed by an earlier run
        now = os.stat(entry["path"])
        if now.st_size != entry["size"] or (entry["at"] is not None and abs(now.st_mtime_ns // 1000 - entry["at"]) >= 1000):
            _remove(entry["staged"])
            return entry["path"], False, "the file has changed"
        shutil.copystat(entry["path"], entry["staged"])
        os.utime(entry["staged"])
        os.replace(entry["staged"], entry["target"])
        return entry["path"], True, None
    except OSError as e:  # a file that has gone or may not be written is its own row's matter
        _remove(entry["staged"])
        return entry["path"], False, str(e)


def finish(spark: SparkSession, journal: str) -> DataFrame:
    """path, written, problem: what a decided journal lists, put in place; nothing for a journal that was not decided."""
    decision = os.path.join(local(journal), DECISION)
    parts = json.load(open(decision)) if os.path.exists(decision) else []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in batch["part"]:
                yield pd.DataFrame([_place(entry) for entry in _entries(local(journal), part)], columns=["path", "written", "problem"]).astype(object)

    named = spark.createDataFrame([(p,) for p in parts], "part string").repartition(max(1, len(parts)))
    return named.mapInPandas(run, "path string, written boolean, problem string")


def replace(results: DataFrame, journal: str, suffix: str = "") -> DataFrame:
    """stage and finish: path, written and problem of each finished row, the files being in place."""
    stage(results, journal, suffix)
    done = finish(results.sparkSession, journal).toLocalIterator()
    kept = os.path.join(local(journal), "placed.json")
    with open(kept, "w") as f:
        for row in done:
            f.write(json.dumps(row.asDict()) + "\n")
    return results.sparkSession.read.schema("path string, written boolean, problem string").json(f"file://{kept}")


def tags(path: str) -> dict[str, bytes]:
    """The extended attributes (such as Finder's tags) of a file, as they are after a replacement; none where the system has none."""
    if not hasattr(os, "listxattr"):
        return {}
    return {name: os.getxattr(local(path), name) for name in os.listxattr(local(path))}
