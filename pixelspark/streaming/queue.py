"""The job queue: new files of a folder are admitted as jobs with a frozen mode and target, one micro-batch is one pass.

States: a job is waiting when admitted, and done, already_optimal or failed when its pass has written its result. Results
and jobs are written by batch, over what an earlier attempt of the same batch wrote, so a replayed batch repeats no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.native import concurrency_limit, detail
from ..operators.reencode import optimize, rasters_of
from ..schema import MODES, TARGET

#: Jobs that a placement folds at a time. It does not change the result.
LOT = 64
FILES = "path string, modificationTime timestamp, length long, content binary"


def admit(files: DataFrame, mode: str, target: float = TARGET) -> DataFrame:
    """Jobs of files: mode and target are frozen; a path queued twice is one job, as two would write the same file."""
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    return files.dropDuplicates(["path"]).withColumns({"mode": F.lit(mode), "target": F.lit(target), "state": F.lit("waiting")})


def waiting(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """Jobs without a result."""
    return jobs.join(results.select("path", "mode").distinct(), ["path", "mode"], "left_anti")


def states(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """path, mode, state, detail of all jobs: waiting ones too."""
    told = detail(F.col("original_bytes"), F.col("bytes"), F.col("score"), F.col("hdr"), F.col("quantized"))
    done = results.select("path", "mode", F.col("state").alias("__state"), F.when(F.col("state") == "done", told).otherwise(F.col("error_message")).alias("detail"))
    return jobs.join(done, ["path", "mode"], "left").select("path", "mode", F.coalesce("__state", "state").alias("state"), "detail")


def bounded(jobs: DataFrame, mode: str, cores: int, ram: int, machines: int = 1) -> DataFrame:
    """jobs in as many partitions as may be worked on at a time: a pass runs one task, so one picture, in each."""
    limit = jobs.sparkSession.range(1).select(concurrency_limit(F.lit(mode == "quality"), F.lit(cores), F.lit(ram))).first()[0]
    return jobs.repartition(max(1, int(limit)) * machines)


def placement(jobs: DataFrame, capacity: int, group: str = "group", cost: str = "cost") -> DataFrame:
    """jobs with a place (group and number of a task) such that no task's jobs cost more together than capacity, and no two neighbouring
    tasks of a group could be one; a job that costs more by itself has a task of its own.

    Groups are dealt beforehand (by a hash, to some thousand jobs each), so that each is placed by one fold over its costs in the
    order of `ord`, in the JVM; equal costs are told apart by ord, and a null cost counts as 0.
    """
    row = F.struct(F.col("ord").alias("ord"), F.coalesce(F.col(cost), F.lit(0)).cast("long").alias("cost"))
    start = F.struct(F.lit(0).cast("long").alias("held"), F.lit(0).alias("task"), F.array().cast("array<struct<ord:bigint,task:int>>").alias("placed"))

    def put(s: Column, j: Column) -> Column:
        fits = (s["held"] + j["cost"] <= capacity) | (s["held"] == 0)
        task = F.when(fits, s["task"]).otherwise(s["task"] + 1)
        return F.struct(F.when(fits, s["held"] + j["cost"]).otherwise(j["cost"]).alias("held"), task.alias("task"), F.concat(s["placed"], F.array(F.struct(j["ord"].cast("long").alias("ord"), task.alias("task")))).alias("placed"))

    # the list of what is placed would be copied with every job, so a group is folded in lots of LOT jobs
    folded = lambda jobs_, s: F.aggregate(jobs_, s, put)
    lots = lambda a: F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / LOT).cast("int")), lambda k: F.slice(a, k * LOT + 1, F.lit(LOT)))
    listed = jobs.groupBy(group).agg(F.array_sort(F.collect_list(row)).alias("jobs"))
    one = lambda s, lot: F.get(F.transform(F.array(folded(lot, F.struct(s["held"].alias("held"), s["task"].alias("task"), F.array().cast("array<struct<ord:bigint,task:int>>").alias("placed")))), lambda t: F.struct(t["held"].alias("held"), t["task"].alias("task"), F.concat(s["placed"], F.array(t["placed"])).alias("placed"))), F.lit(0))
    whole = F.aggregate(lots(F.col("jobs")), F.struct(start["held"].alias("held"), start["task"].alias("task"), F.array().cast("array<array<struct<ord:bigint,task:int>>>").alias("placed")), one)
    return listed.select(group, F.explode(F.flatten(whole["placed"])).alias("p")).select(group, "p.ord", "p.task")


def stream(spark: SparkSession, folder: str, results: str, checkpoint: str, mode: str = "strip", target: float = TARGET, limit: tuple[int, int, int] | None = None) -> StreamingQuery:
    """Work on every file that is in folder or comes while the query runs; one pass over what is there, then it stops.

    limit: cores and bytes of memory of a machine, and machines; without it, tasks run as the cluster has room.
    """

    def one_pass(batch: DataFrame, number: int) -> None:
        jobs = admit(batch, mode, target)
        if mode != "strip":
            jobs = rasters_of(jobs)  # of this batch's files only
        placed = bounded(jobs, mode, *limit) if limit else jobs
        optimize(placed, mode, target).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(results)

    files = spark.readStream.format("binaryFile").schema(FILES).load(folder)
    return files.writeStream.foreachBatch(one_pass).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def strip_stream(spark: SparkSession, folder: str, results: str, checkpoint: str) -> StreamingQuery:
    return stream(spark, folder, results, checkpoint, "strip")


def clear(results: DataFrame, running: StreamingQuery | None = None) -> DataFrame:
    """The queue without its finished jobs; as it is while a pass is running."""
    if running is not None and running.isActive:
        return results
    return results.where(~F.col("state").isin("done", "already_optimal", "failed"))
