"""A report over results of any number, as partial states that later passes merge.

A state is a table of counts: one row for each mode, state, code and cell of sizes, with the number of files and their bytes
before and after. A cell holds sizes that agree in their five highest bits, so a quantile read from it is at most a sixteenth
below the true one, whatever the number of files, and merging states is adding rows: merged and computed at once are equal.
No file has a line of its own, and what reaches a driver is a row for each group.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GROUP, BITS = ("mode", "state", "error_code"), 5


def cell(size: Column) -> Column:
    """The smallest size that agrees with this one in its BITS highest bits."""
    drop = F.greatest(F.length(F.bin(size)) - BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", size, drop), drop)


def partial_report(results: DataFrame) -> DataFrame:
    """The state of results: mode, state, error_code, original_bytes and bytes (null: as before)."""
    old = F.coalesce("original_bytes", F.lit(0)).cast("long")
    rows = results.select(*GROUP, old.alias("old"), F.coalesce(F.col("bytes").cast("long"), old).alias("new"))
    return rows.groupBy(*GROUP, cell(F.col("old")).alias("cell")).agg(F.count(F.lit(1)).alias("files"), F.sum("old").alias("old_bytes"), F.sum("new").alias("new_bytes"))


def merged_reports(states: Sequence[DataFrame]) -> DataFrame:
    """One state of several."""
    every = reduce(DataFrame.unionByName, states)
    return every.groupBy(*GROUP, "cell").agg(*[F.sum(c).alias(c) for c in ("files", "old_bytes", "new_bytes")])


def report(state: DataFrame, quantiles: Sequence[float] = (0.5, 0.9)) -> DataFrame:
    """A row for each mode, state and code: files, bytes before and after, and quantiles of the size before (p50, p90)."""
    group = Window.partitionBy(*GROUP)
    ranked = state.withColumns({"upto": F.sum("files").over(group.orderBy("cell")), "all": F.sum("files").over(group)})
    at = lambda q: F.min(F.when(F.col("upto") >= F.ceil(F.col("all") * F.lit(q)), F.col("cell"))).alias(f"p{round(q * 100)}")
    return ranked.groupBy(*GROUP).agg(F.sum("files").alias("files"), F.sum("old_bytes").alias("old_bytes"), F.sum("new_bytes").alias("new_bytes"), *map(at, quantiles))
