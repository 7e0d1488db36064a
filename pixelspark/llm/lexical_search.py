r"""Ranked lexical search over document-sharded postings.

1. One pass over all texts counts, for each term, the documents that hold it (summed in each task before the shuffle), the
   documents with terms (N) and all their terms (L).
2. A second pass makes the index: a shard is a run of documents of one partition with about SHARD_POSTINGS postings, stored as
   one row. Its terms are sorted; `indptr` tells where the postings of each begin (CSR), and each posting has the document's
   place in the shard and an integer impact, which holds all of the score that does not depend on the query's term.
3. A search takes a block of items at a time. Each task goes through its shards: term by term, weight times impact is added
   into a dense array of one number per document of the shard; argpartition finds the best of them, ties at the border are
   settled by doc_id. A task keeps the best of all its shards, so that items x top rows leave it at most, and a window with
   row numbers merges the tasks' rows.

A term's weight is computed where the block is put together, as it needs the item's terms only. Nothing else reaches the
driver: a block has about BLOCK_TERMS (item, term) rows at most, and the document frequencies of a block's terms are found
by a join.

Edge cases: a null text, or one without terms, has no score and is not counted in N; an item without terms, or whose terms
no document holds, has no rows; equal scores are ranked by ascending doc_id, a null doc_id last; repeated documents are
ranked one by one; of repeated items one is ranked, and texts with one item_id are one item; a very long text is split by
itself and may exceed a shard's size; an empty table of documents or items gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, stash, table
from .terms import ALNUM, SLICE_BYTES, Sums, slices, split

#: Postings of a shard, (item, term) rows of a block of items, rows of the result for each item.
SHARD_POSTINGS, BLOCK_TERMS, TOP = 1 << 20, 1 << 18, 20
#: A shard is a large row, so each has a row group of its own: readers and writers hold one at a time, whatever a file has. (A size
#: of row groups would not do: Parquet first looks at it after 100 rows.) Values in it do not repeat, so no dictionary is tried.
ROW_GROUPS = {"parquet.block.row.count.limit": 1, "parquet.enable.dictionary": False}
LAST = np.iinfo(np.int64).max


@dataclass
class Index:
    shards: DataFrame  # doc_ids, terms, indptr, docs, impacts
    vocabulary: DataFrame  # term, df
    n_docs: int
    n_terms: int


def _postings(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Row, term number and count of each posting, ordered by term and row; the terms in order; the number of terms of each row."""
    row, term, words = split(texts, ALNUM)
    order = pc.array_sort_indices(words).to_numpy()
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    key, tf = np.unique(rank[term] * len(texts) + row, return_counts=True)
    return key % len(texts), key // len(texts), tf, words.take(pa.array(order)), np.bincount(row, minlength=len(texts))


def count_terms(docs: DataFrame) -> DataFrame:
    """term, n, terms: partial document frequencies; without a term, documents with terms and all their terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n, total = Sums(["term"], ["n", "terms"]), 0, 0
        for batch in slices(batches, 0):
            row, term, words = split(batch.column(0), ALNUM)
            n, total = n + len(np.unique(row)), total + len(row)
            held = np.bincount(np.unique(term * batch.num_rows + row) // batch.num_rows, minlength=len(words))
            yield from sums.add(words, pa.array(held), pa.array(np.zeros(len(words), np.int64)))
        yield from sums.rest()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([n]), pa.array([total])], ["term", "n", "terms"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "term string, n long, terms long")


def build(docs: DataFrame, shard_postings: int = SHARD_POSTINGS) -> Index:
    """The index of docs (doc_id, text)."""
    with small_batches(docs.sparkSession):
        counted = stash(count_terms(docs), "terms")
    row = counted.filter("term IS NULL").agg(F.sum("n"), F.sum("terms")).first()
    n_docs, n_terms = row[0] or 0, row[1] or 0
    vocabulary = stash(counted.filter("term IS NOT NULL").groupBy("term").agg(F.sum("n").alias("df")), "vocabulary")

    def shard(held: list[tuple]) -> pa.RecordBatch:
        """One row of the parts that make a shard, whose terms are sorted each by itself."""
        base = np.cumsum([0, *[len(p[0]) for p in held]])
        every = pa.concat_arrays([p[4] for p in held]).dictionary_encode()
        place, words = every.indices.to_numpy(zero_copy_only=False).astype(np.int64), every.dictionary
        order = pc.array_sort_indices(words).to_numpy()
        rank = np.empty(len(words), np.int64)
        rank[order] = np.arange(len(words))
        starts = np.cumsum([0, *[len(p[4]) for p in held]])
        term = np.concatenate([rank[place[s + p[2]]] for s, p in zip(starts, held, strict=False)])
        docs = np.concatenate([b + p[1] for b, p in zip(base, held, strict=False)])
        by_term = np.argsort(term, kind="stable")  # rows stay in order: parts follow each other
        indptr = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(words)))])
        impacts = np.concatenate([p[3] for p in held])[by_term]
        binary = lambda x: pa.array([x.tobytes()], pa.binary())
        terms = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words.take(pa.array(order)))
        return pa.RecordBatch.from_arrays([binary(np.concatenate([p[0] for p in held])), terms, binary(indptr.astype(np.int64)), binary(docs[by_term].astype(np.int32)), binary(impacts.astype(np.int32))], ["doc_ids", "terms", "indptr", "docs", "impacts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in slices(batches, 1, min(SLICE_BYTES, 4 * shard_postings)):
            row, term, tf, words, n = _postings(batch.column(1))
            m = 75 + (25 * n * n_docs) // max(1, n_terms)
            impact = (1_000_000_000 * tf) // (1000 * tf + 12 * m[row])
            held.append((pc.fill_null(batch.column(0), LAST).to_numpy(zero_copy_only=False), row, term, impact, words))
            size += len(row)
            if size >= shard_postings:
                yield shard(held)
                held, size = [], 0
        if size:
            yield shard(held)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shards = rows.mapInArrow(run, "doc_ids binary, terms array<string>, indptr binary, docs binary, impacts binary")
    with small_batches(docs.sparkSession):
        return Index(stash(shards, "shards", **ROW_GROUPS), vocabulary, n_docs, n_terms)


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term, times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            row, term, words = split(batch.column(1), ALNUM)
            key, times = np.unique(row * max(1, len(words)) + term, return_counts=True)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(key // max(1, len(words)))), words.take(pa.array(key % max(1, len(words)))), pa.array(times)], ["item_id", "term", "times"])

    own = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    return own.mapInArrow(run, "item_id long, term string, times long").groupBy("item_id", "term").agg(F.sum("times").alias("times"))


def best(scores: np.ndarray, ids: np.ndarray, top: int) -> np.ndarray:
    """Places of the `top` highest scores above 0, equal ones by ascending id."""
    at = np.flatnonzero(scores > 0)
    if len(at) > top:
        border = scores[at[np.argpartition(-scores[at], top - 1)[top - 1]]]
        above, equal = at[scores[at] > border], at[scores[at] == border]
        at = np.concatenate([above, equal[np.argsort(ids[equal], kind="stable")[: top - len(above)]]])
    return at


def _search_block(index: Index, rows: list, top: int) -> DataFrame:
    """item_id, doc_id, score: of each task its best rows for the items of one block."""
    words = sorted({r["term"] for r in rows})
    number = {w: k for k, w in enumerate(words)}
    weight = np.zeros(len(words), np.int64)
    items: dict[int | None, list[tuple[int, int]]] = {}
    for r in rows:
        k = number[r["term"]]
        weight[k] = math.floor(1000 * math.log((2 * index.n_docs + 2) / (2 * r["df"] + 1)))
        items.setdefault(r["item_id"], []).append((k, r["times"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, kept = pa.array(words, pa.string()), {i: (np.empty(0, np.int64), np.empty(0, np.int64)) for i in items}
        for batch in batches:
            for k in range(batch.num_rows):
                ids, indptr, docs, impacts = (np.frombuffer(batch.column(c)[k].as_buffer(), kind) for c, kind in ((0, np.int64), (2, np.int64), (3, np.int32), (4, np.int32)))
                at = pc.index_in(asked, value_set=batch.column(1)[k].values).to_pylist()
                lists = [None if p is None else (docs[indptr[p] : indptr[p + 1]], weight[q] * impacts[indptr[p] : indptr[p + 1]].astype(np.int64)) for q, p in enumerate(at)]
                for item, terms in items.items():
                    total = np.zeros(len(ids), np.int64)
                    for q, times in terms:
                        if lists[q] is not None:
                            total[lists[q][0]] += times * lists[q][1]
                    s, d = kept[item]
                    new = best(total, ids, top)
                    s, d = np.concatenate([s, total[new]]), np.concatenate([d, ids[new]])
                    at_last = best(s, d, top)
                    kept[item] = s[at_last], d[at_last]
        for item, (s, d) in kept.items():
            if len(s):
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(s), pa.int64()), pa.array(d, mask=d == LAST), pa.array(s)], ["item_id", "doc_id", "score"])

    return index.shards.mapInArrow(run, "item_id long, doc_id long, score long")


def search(index: Index, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score of each item's `top` best documents."""
    found = None
    with small_batches(items.sparkSession):  # of large shards, one at a time
        pairs = stash(item_terms(items).join(index.vocabulary, "term"), "asked")
        blocks = max(1, -(-pairs.count() // BLOCK_TERMS))
        for k in range(blocks):
            rows = pairs.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect()  # about BLOCK_TERMS rows
            part = stash(_search_block(index, rows, top), "found")
            found = part if found is None else found.union(part)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def op11_lexical_search(spark, sf_dir: str) -> DataFrame:
    return search(build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


QUERIES = {"op11_lexical_search": op11_lexical_search}
TERM_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLES = {
    "op11_lexical_search": f"""
WITH t AS (SELECT doc_id, unnest({TERM_SQL}) AS term FROM documents
), p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL
), d AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM p GROUP BY doc_id
), g AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM d
), v AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, g GROUP BY term, n_docs
), q AS (SELECT item_id, unnest({TERM_SQL}) AS term FROM benchmark
), s AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM q JOIN v USING (term) JOIN p USING (term) JOIN d USING (doc_id), g GROUP BY item_id, doc_id
)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY rank <= {TOP}
"""
}
