"""The search for the smallest encoding as rounds over all files at once.

A table has one row for each file: its bracket (lo, hi), the best probe so far, all probes, and the next quality to try. In
a round every file that is not settled is probed once, whatever a probe is: column expressions, a join with measured
curves, or an encoder in Python workers. What the probes gave and the new brackets are written, so that a lost executor costs
one round at most; settled files drop out. `search.search` is the same search for one file inside a task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.native import interpolated, predict_quality
from ..schema import HIGHEST, LOWEST, PROBES, STEP
from ..sources.files import written

PROBE = "struct<quality:double,score:double,bytes:bigint>"


def _whole(value: Column) -> Column:
    """The nearest whole quality inside the bracket, halves up."""
    return F.least(F.greatest(F.floor(value + F.lit(0.5)).cast("double"), F.col("lo")), F.col("hi"))


def _next(ended: Column) -> Column:
    """The quality to try: the wanted one, the middle of the bracket where that was tried, none where both were."""
    tried = F.transform("probes", lambda p: p["quality"])
    want, middle = _whole(F.col("want")), _whole((F.col("lo") + F.col("hi")) / 2)
    return F.when(~ended, F.when(~F.array_contains(tried, want), want).when(~F.array_contains(tried, middle), middle))


def search_rounds(files: DataFrame, probe: Callable[[DataFrame], DataFrame], budget: int = PROBES) -> tuple[DataFrame, DataFrame]:
    """(outcomes, trace) of files (key, target, original).

    probe takes (key, quality) rows and gives key, score and bytes for each. outcomes: key, code (0, 5: no probe reaches the target,
    6: the best is no smaller than the original), quality, score, bytes, best_score, probes; trace: key, probe (from 1), quality, score,
    bytes. A NaN score reaches nothing. Keys are unique; a null key is probed if probe answers it, and has code 5 otherwise, as has
    every file that probe leaves out. An empty table gives empty results.
    """
    lowest, highest = F.lit(float(LOWEST)), F.lit(float(HIGHEST))
    start = files.select("key", F.col("target").cast("double").alias("target"), F.col("original").cast("long").alias("original")).withColumns({"lo": lowest, "hi": highest, "want": predict_quality(F.col("target")), "best": F.lit(None).cast(PROBE), "probes": F.array().cast(f"array<{PROBE}>")})
    state, settled = start.withColumn("next", _next(F.lit(False))), []
    for number in range(budget):
        state = written(state, f"bracket-{number}")
        given = written(probe(state.select("key", F.col("next").alias("quality"))).select(F.col("key").alias("__key"), F.col("score").cast("double").alias("score"), F.col("bytes").cast("long").alias("bytes")), f"probes-{number}")
        met = state.join(given, F.col("key").eqNullSafe(F.col("__key")), "left").drop("__key").withColumn("score", F.when(~F.isnan("score"), F.col("score")))
        seen, ok = F.struct(F.col("next").alias("quality"), "score", "bytes"), F.coalesce(F.col("score") >= F.col("target"), F.lit(False))
        # a file that was not answered is not tried again
        met = met.withColumns({
            "best": F.when(ok & (F.col("best").isNull() | (F.col("bytes") < F.col("best.bytes"))), seen).otherwise(F.col("best")), "probes": F.when(F.col("bytes").isNotNull(), F.concat("probes", F.array(seen))).otherwise(F.col("probes")),
            "lo": F.when(ok, F.col("lo")).otherwise(F.col("next")), "hi": F.when(ok, F.col("next")).otherwise(F.col("hi")),
        })
        fallback = F.when(F.col("best").isNull(), F.col("hi")).otherwise(F.greatest(F.col("next") - STEP, F.col("lo")))
        met = met.withColumn("want", F.coalesce(interpolated(F.col("probes"), F.col("target")), fallback))
        over = (F.col("hi") - F.col("lo") <= 1) | F.col("bytes").isNull()
        state = met.withColumn("next", _next(over)).drop("score", "bytes")
        state = written(state, f"state-{number}")
        settled.append(state.where("next IS NULL"))
        state = state.where("next IS NOT NULL")
        if state.isEmpty():
            break
    every = state
    for part in settled:
        every = every.unionByName(part)
    code = F.when(F.col("best").isNull(), 5).when(F.col("best.bytes") >= F.col("original"), 6).otherwise(0)
    outcomes = every.select("key", code.alias("code"), "best.quality", "best.score", "best.bytes", F.when(F.col("best").isNull(), F.array_max(F.transform("probes", lambda p: p["score"]))).alias("best_score"), F.size("probes").cast("long").alias("probes"))
    trace = every.select("key", F.posexplode("probes").alias("probe", "p")).select("key", (F.col("probe") + 1).cast("long").alias("probe"), "p.*")
    return outcomes, trace
