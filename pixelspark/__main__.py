"""Command line: optimize the pictures of a folder and report on each.

    python -m pixelspark FOLDER --mode strip|fast|quality [--target 80] [--quality 75] [--png-floor N]
                         [--against FOLDER] [--in-place | --beside SUFFIX | --out TABLE] [--summary]

Exit codes: 0, 1 where a file failed, 2 for wrong arguments.
"""

from __future__ import annotations

import argparse
import sys
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import native as N
from .functions import report as rollup
from .operators.reencode import optimize, score_pairs, with_rasters
from .schema import MODES, QUALITY, TARGET
from .sources import files as sources
from .sources import sink


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pixelspark", description="Optimize the JPEG and PNG files of a folder.")
    p.add_argument("folder")
    p.add_argument("--mode", choices=MODES, default="fast")
    p.add_argument("--target", type=float, default=TARGET, help="score that quality mode must reach")
    p.add_argument("--quality", type=float, default=QUALITY, help="encoder quality of fast mode")
    p.add_argument("--png-floor", type=int, default=None, help="reduce colours, unless their quality is under this")
    p.add_argument("--against", help="compare the files of this folder, by name, with those of the first")
    p.add_argument("--summary", action="store_true", help="report a line for each mode, state and code instead of each file")
    where = p.add_mutually_exclusive_group()
    where.add_argument("--in-place", action="store_true", help="replace the files")
    where.add_argument("--beside", metavar="SUFFIX", help="write beside the files, with this before the extension")
    where.add_argument("--out", metavar="TABLE", help="write the results as Parquet")
    return p


def report(results: DataFrame) -> DataFrame:
    """name, line: what happened to each file."""
    done = F.concat(N.detail(F.col("original_bytes"), F.col("bytes"), F.col("score"), F.lit(None).cast("string"), F.col("quantized")), N.hdr_note(F.col("hdr")))
    return results.select(N.file_name(F.col("path")).alias("name"), "state", F.when(F.col("state") == "done", done).otherwise(F.col("error_message")).alias("line"))


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    given = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("pixelspark").config("spark.speculation", "false").getOrCreate()
    read = lambda folder: sources.require_some(with_rasters(spark, folder).where(N.extension_ok(F.col("path"))))
    try:
        if given.against:
            named = [read(f).withColumn("path", N.file_name(F.col("path"))) for f in (given.folder, given.against)]
            for row in score_pairs(*named).orderBy("path").toLocalIterator():
                print(f"{row['path']}  score {row['score']:.2f}" if row["score"] is not None else f"{row['path']}  not compared ({row['error_code']})")
            return 0
        files = sources.require_some(sources.read_files(spark, given.folder, only_images=True)) if given.mode == "strip" else read(given.folder)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    results = optimize(files, given.mode, given.target, given.quality, given.png_floor)
    # stored before anything is replaced: a plan that reads its inputs again would work on them twice
    results = sources.stored(results, given.out, given.folder)
    if given.in_place or given.beside:
        written = sink.replace(results, f"{given.folder.rstrip('/')}-journal-{uuid.uuid4().hex}", given.beside or "")
        for row in written.where("NOT written").toLocalIterator():
            print(f"{row['path']}  not written: {row['problem']}", file=sys.stderr)
    if given.summary:
        for row in rollup.report(rollup.partial_report(results)).orderBy(*rollup.GROUP).collect():  # a row for each group
            print(f"{row['mode']} {row['state']} ({row['error_code']}): {row['files']} files, {row['old_bytes']} to {row['new_bytes']} bytes, half of them up to {row['p50']}")
    else:
        for row in report(results).orderBy("name").toLocalIterator():
            print(f"{row['name']}  {row['line']}")
    return 1 if not results.where("state = 'failed'").isEmpty() else 0


if __name__ == "__main__":
    sys.exit(main())
