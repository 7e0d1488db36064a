"""Balanced label propagation over documents linked by equal texts.

Every document starts in a shard drawn by its key. In each round one join brings every group's counts by shard to its
members (equal texts form stars around the group, so a document's neighbours are counted without listing pairs). A
member proposes to move to the shard that holds most of its neighbours, and proposals are accepted in proportion to the
quota left for each destination, whole groups at a time unless a group is larger than a small share of a shard. The
quota is of documents with neighbours, as the others can make room without a cut. Rounds go on until no proposal is
left or none has quota: each accepted one brings a document to its group's main shard, so they come to an end. A last
pass evens the shards out exactly, moving documents without neighbours first.

Law: `rows`; the shards' row counts differ by one at most. Slots are numbered without a gap from per-partition counts, so no
shard is ever sorted or gathered in one task.

Edge cases: a null text has size 1 and counts as the empty text; a group larger than a shard is split over shards;
a very long text counts by its size only; ties between
shards go to the one that a hash of group and shard puts last; repeated rows are placed once each; fewer documents than shards leave shards empty; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stash, table

SHARDS = 8
#: A group moves as a whole up to this share of a shard's rows.
WHOLE_SHARE = 0.01


def cut_share(placed: DataFrame) -> float:
    """Of all links between a document and its group's main shard, the share that is cut."""
    sizes = placed.groupBy("link", "shard").agg(F.count(F.lit(1)).alias("n")).groupBy("link").agg(F.sum("n").alias("n"), F.max("n").alias("top"))
    row = sizes.filter("n > 1").agg(F.sum("n"), F.sum("top")).first()
    return 0.0 if not row[0] else 1.0 - row[1] / row[0]


def propagate(rows: DataFrame, shards: int = SHARDS, rounds: int | None = None) -> DataFrame:
    """rows (doc_id, link, ...) with a shard each: equal links drawn together, no shard with more of them than its quota allows. rounds: a limit, if any."""
    total = rows.count()
    quota = -(-total // shards)
    counts = rows.groupBy("link").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    state = stash(rows.join(counts, "link", "left").withColumn("shard", F.pmod(F.xxhash64("doc_id", "row_no"), F.lit(shards)).cast("int")), "shards")
    for step in count() if rounds is None else range(rounds):
        # neighbours by group and shard; at most `shards` rows per group whatever its size
        near = state.filter("n > 1").groupBy("link", "shard").agg(F.count(F.lit(1)).alias("here"))
        # counts first; of equal counts the group's own lot decides, so that small groups spread evenly
        want = near.groupBy("link").agg(F.max(F.struct("here", F.xxhash64("link", "shard").alias("lot"), "shard")).alias("top")).select("link", F.col("top.shard").alias("want"))
        asked = state.join(want, "link", "left").withColumn("whole", F.coalesce(F.col("n"), F.lit(1)) <= WHOLE_SHARE * quota)
        asked = asked.withColumn("want", F.coalesce("want", "shard"))
        flow = {(r["shard"], r["want"]): r["c"] for r in asked.filter("n > 1").groupBy("shard", "want").agg(F.count(F.lit(1)).alias("c")).collect()}  # shards x shards rows
        size = {s: sum(c for (a, _), c in flow.items() if a == s) for s in range(shards)}
        leave = {s: sum(c for (a, b), c in flow.items() if a == s != b) for s in range(shards)}
        come = {s: sum(c for (a, b), c in flow.items() if b == s != a) for s in range(shards)}
        if not sum(come.values()):
            break
        share = [min(1.0, max(0.0, (quota - size[s] + leave[s]) / come[s])) if come[s] else 0.0 for s in range(shards)]
        if not any(share):
            break
        limit = F.element_at(F.array(*[F.lit(float(x)) for x in share]), F.col("want") + 1)
        lot = F.pmod(F.when(F.col("whole"), F.xxhash64("link", F.lit(step))).otherwise(F.xxhash64("doc_id", "row_no", F.lit(step))), F.lit(1 << 40)) / float(1 << 40)
        state = stash(asked.withColumn("shard", F.when(lot < limit, F.col("want")).otherwise(F.col("shard"))).drop("want", "whole"), "shards")
    return state


def number_slots(state: DataFrame, shards: int) -> tuple[DataFrame, dict[int, int]]:
    """state with a position in its shard (linked documents before others), and the shards' sizes.

    Each stored partition numbers its own rows; where its numbers begin follows from a table of partitions x shards x 2
    counts, which stays in Spark: one window for each shard over as many rows as there are partitions, twice.
    """

    schema = [f for f in state.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(2 * shards, np.int64)
        part = TaskContext.get().partitionId()
        for batch in batches:
            kind = np.asarray(batch.column(batch.schema.get_field_index("kind")))
            order = np.argsort(kind, kind="stable")
            many = np.bincount(kind, minlength=2 * shards)
            place = np.empty(len(kind), np.int64)
            place[order] = np.arange(len(kind)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(seen, many)
            seen += many
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(kind), part), pa.int32()), pa.array(place)], [*batch.schema.names, "part", "place"])

    kinds = state.withColumn("kind", (F.col("shard") + F.when(F.col("n") > 1, 0).otherwise(shards)).cast("int"))
    kind_schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema) + ", kind int, part int, place long"
    numbered = stash(kinds.mapInArrow(run, kind_schema), "slots")
    shard = F.pmod(F.col("kind"), F.lit(shards))
    counts = numbered.groupBy("part", "kind").agg(F.count(F.lit(1)).alias("c"))
    size = dict.fromkeys(range(shards), 0) | {r["s"]: r["c"] for r in counts.groupBy(shard.alias("s")).agg(F.sum("c").alias("c")).collect()}  # a row for each shard
    before = Window.partitionBy(shard).orderBy("kind", "part").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select("part", "kind", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("base"))
    return numbered.join(begins, ["part", "kind"]).withColumn("slot", F.col("base") + F.col("place")).drop("part", "kind", "base", "place"), size


def even_out(state: DataFrame, shards: int = SHARDS) -> DataFrame:
    """state with shards whose counts differ by one at most, and gapless slots from 0."""
    placed, size = number_slots(state, shards)
    total = sum(size.values())
    # the larger shards get the odd rows, so that fewest rows move
    order = sorted(range(shards), key=lambda s: -size[s])
    goal = {s: total // shards + (i < total % shards) for i, s in enumerate(order)}
    # the k-th surplus row takes the k-th free slot
    over, base = [], 0
    for s in range(shards):
        extra = max(0, size[s] - goal[s])
        over.append((goal[s], base))
        base += extra
    free, base = [], 0
    for s in range(shards):
        gap = max(0, goal[s] - size[s])
        if gap:
            free.append((base, gap, s, size[s]))
        base += gap
    at = lambda values: F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col("shard") + 1)
    moved = F.col("slot") >= at([x[0] for x in over])
    rank = F.col("slot") - at([x[0] for x in over]) + at([x[1] for x in over])
    shard, slot = F.col("shard"), F.col("slot")
    for first, gap, s, used in free:
        here = moved & (rank >= first) & (rank < first + gap)
        shard = F.when(here, F.lit(s)).otherwise(shard)
        slot = F.when(here, rank - first + used).otherwise(slot)
    return placed.withColumns({"shard": shard.cast("int"), "slot": slot.cast("long")})


def assign_shards(docs: DataFrame, shards: int = SHARDS, rounds: int | None = None) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, link, shard, slot."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"), F.unhex(F.md5(text.cast("binary"))).alias("link"), F.monotonically_increasing_id().alias("row_no")
    )
    return even_out(propagate(stash(rows, "rows"), shards, rounds), shards)


def op10_sharding(spark, sf_dir: str) -> DataFrame:
    placed = assign_shards(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op10_sharding": op10_sharding}
ORACLES: dict[str, str] = {}
