"""Exact deduplication with a heavy-hitter split.

Each row is reduced to the SHA-256 digest of its normalised text where it is read. A Misra-Gries pass with `counters`
counters per partition finds every digest that could be frequent; their true counts and winners are then computed over
all rows, and at most counters + 1 verified winners are broadcast to settle the frequent digests without a shuffle.
The remaining digests, none of which holds more than a small share of the rows, are shuffled and settled by a window.

Edge cases: a null text equals the empty text; a row whose key is null loses against any key; of repeated rows with the
same key and text one stays; a very long text is digested whole where it is read; an empty table gives an empty result; extra columns are ignored by `duplicate_groups` and
kept by `drop_duplicates`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash, table

COUNTERS = 255
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; texts of one byte per character take the fast way."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def text_digest(text: Column) -> Column:
    """SHA-256 of the normalised text, as 32 bytes."""
    return F.unhex(F.sha2(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))).cast("binary"), 256))


def misra_gries(rows: DataFrame, column: str, counters: int = COUNTERS) -> DataFrame:
    """Values of a binary column that may hold over 2 / (counters + 1) of all rows: a superset of at most counters + 1.

    Each partition keeps `counters` counters, decremented together when full. The summed counters of a value fall short
    of its true count by at most rows / (counters + 1).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = pd.Series(dtype="int64"), 0
        for batch in batches:
            total += batch.num_rows
            seen = batch.column(0).value_counts()
            more = pd.Series(seen.field("counts").to_numpy(zero_copy_only=False), index=seen.field("values").to_pylist())
            held = held.add(more, fill_value=0).astype("int64") if len(held) else more
            if len(held) > counters:
                held = held - held.nlargest(counters + 1).iloc[-1]
                held = held[held > 0]
        yield pa.RecordBatch.from_arrays([pa.array([*held.index, None], pa.binary()), pa.array([*held.tolist(), total], pa.int64())], [column, "n"])

    summary = stash(rows.select(column).mapInArrow(run, f"{column} binary, n long"), "heavy")
    total = summary.filter(F.col(column).isNull()).agg(F.sum("n")).first()[0] or 0
    least = total // (counters + 1) + 1
    return summary.filter(F.col(column).isNotNull()).groupBy(column).agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select(column)


def duplicate_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per document: doc_id, digest, keep_id, group_size, kept."""
    rows = stash(docs.select(F.col(key).cast("long").alias("doc_id"), text_digest(F.col(text)).alias("digest"), F.monotonically_increasing_id().alias("row_no")), "digests")
    heavy = F.broadcast(misra_gries(rows, "digest", counters))
    best = F.max(F.struct("doc_id", "row_no")).alias("best")
    winners = F.broadcast(stash(rows.join(heavy, "digest").groupBy("digest").agg(best, F.count(F.lit(1)).alias("group_size")), "winners"))
    settled = rows.join(winners, "digest").select("doc_id", "digest", "row_no", "best", "group_size")
    group = Window.partitionBy("digest")
    others = rows.join(winners.select("digest"), "digest", "left_anti").select("doc_id", "digest", "row_no", F.max(F.struct("doc_id", "row_no")).over(group).alias("best"), F.count(F.lit(1)).over(group).alias("group_size"))
    return settled.unionByName(others).select("doc_id", "digest", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row_no") == F.col("best.row_no")).alias("kept"))


def drop_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    mark, ident = "__dedup_digest", "__dedup_key"
    kept = stash(duplicate_groups(docs, key, text).filter("kept").select(F.col("digest").alias(mark), F.col("doc_id").alias(ident), (F.col("group_size") > 1).alias("__dedup_group")), "kept")
    marked = docs.withColumns({mark: text_digest(F.col(text)), ident: F.col(key).cast("long")})
    same = (marked[mark] == kept[mark]) & marked[ident].eqNullSafe(kept[ident])
    joined = marked.join(kept, same, "left_semi")
    repeats = duplicate_keys(docs, kept, key, text)
    if repeats.isEmpty():
        return joined.select(*[F.col(f"`{c}`") for c in docs.columns])
    # Repeated rows with one key and text: only these are brought together to choose one.
    both = (joined[mark] == repeats[mark]) & joined[ident].eqNullSafe(repeats[ident])
    single = joined.join(repeats, both, "left_anti")
    one = joined.join(repeats, both, "left_semi").withColumn("__dedup_no", F.row_number().over(Window.partitionBy(mark, ident).orderBy(*[F.col(f"`{c}`").cast("string") for c in docs.columns]))).filter("__dedup_no = 1").drop("__dedup_no")
    return single.unionByName(one).select(*[F.col(f"`{c}`") for c in docs.columns])


def duplicate_keys(docs: DataFrame, kept: DataFrame, key: str, text: str) -> DataFrame:
    """Digest and key of the kept rows that are there more than once."""
    groups = kept.filter("__dedup_group").select("__dedup_digest", "__dedup_key")
    rows = docs.select(text_digest(F.col(text)).alias("__dedup_digest"), F.col(key).cast("long").alias("__dedup_key"))
    same = (rows["__dedup_digest"] == groups["__dedup_digest"]) & rows["__dedup_key"].eqNullSafe(groups["__dedup_key"])
    return stash(rows.join(groups, same, "left_semi").groupBy("__dedup_digest", "__dedup_key").count().filter("count > 1").drop("count"), "repeats")


def op7_exact_dedup(spark, sf_dir: str) -> DataFrame:
    found = duplicate_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


QUERIES = {"op7_exact_dedup": op7_exact_dedup}
ORACLES = {
    "op7_exact_dedup": f"""
WITH n AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM n WINDOW g AS (PARTITION BY text_sha256)
"""
}
