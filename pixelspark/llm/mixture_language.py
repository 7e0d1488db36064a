r"""Language identification as inference of a mixture of languages.

1. Training counts the letter trigrams of the words of all labelled rows by language, in hashed buckets (summed in each task
   before the shuffle). How many buckets a language has depends on the number of languages only: the model has MODEL_CELLS
   cells at most, so it may be broadcast whatever the size of the corpus.
2. A word's likelihood in a language is the product of its letters' probabilities, each given the two letters before it.
3. A document is a bag of words, each drawn from one of the languages in the document's proportions. Expectation maximisation
   estimates these, for all documents of a slice at once, over their distinct words.
4. The language set: the first one, two, ... languages by proportion are fitted anew, and the set with the highest log
   likelihood less PENALTY * ln(words) for each language after the first is chosen. The language with the largest
   proportion in it is the prediction, the proportion its score. Where even all languages together gain no more than the
   price of one, no larger set can win and none is fitted.

Only text and label of the labelled rows are learned from, and only the text is used for a prediction.

Edge cases: a null text, or one without a letter, is `und` with a score of 0; so is every text if no row is labelled; rows with
a null label are not learned from; ties go to the label that sorts first; repeated rows are learned from each and predicted
alike; a very long text counts whole; an empty table gives an empty result; extra columns are kept by `identify`, and one of
the names `lang_pred`, `score` or `languages` is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash, table
from .terms import LETTERS, SLICE_BYTES, Sums, slices, split

#: Cells of the model at most, of which two tables of buckets for each language are made; buckets at most and at least.
MODEL_CELLS, MOST_BUCKETS, LEAST_BUCKETS = 1 << 22, 1 << 16, 1 << 8
#: Added to the count of each letter after two others, and how many letters are taken to be possible there.
ALPHA, POSSIBLE = 0.1, 40
#: Rounds of expectation maximisation at most, the change of a proportion that ends them, and the price of a further language.
ROUNDS, SETTLED, PENALTY = 60, 1e-3, 3.0
UNKNOWN = "und"
FOUND = "lang_pred string, score double, languages array<string>"


@dataclass
class Model:
    labels: list[str]
    grams: np.ndarray  # languages x buckets: ln(count of three letters)
    pairs: np.ndarray  # languages x buckets: ln(count of the first two of three letters)


def buckets_for(languages: int) -> int:
    """Buckets of each language, a power of two."""
    most = MODEL_CELLS // (2 * max(1, languages))
    if most < LEAST_BUCKETS:
        raise ValueError(f"{languages} labels: at most {MODEL_CELLS // (2 * LEAST_BUCKETS)} languages fit the model")
    return min(MOST_BUCKETS, 1 << (most.bit_length() - 1))


def trigrams(words: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each letter of the lower-cased words, and the end of each: word number, bucket of it and the two before, bucket of these two."""
    padded = pc.binary_join_element_wise(pa.scalar("  "), pc.utf8_lower(words), pa.scalar(" "), pa.scalar(""))
    codes = np.frombuffer("".join(padded.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(words)), pc.utf8_length(padded).to_numpy())
    pair = codes[:-2] * np.uint64(0x9E3779B97F4A7C15) + codes[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)
    inside = word[:-2] == word[2:]

    def bucket(key: np.ndarray) -> np.ndarray:
        key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((key >> np.uint64(32)) & np.uint64(buckets - 1)).astype(np.int64)[inside]

    return word[:-2][inside], bucket(pair + codes[2:] * np.uint64(0x165667B19E3779F9)), bucket(pair)


def train(rows: DataFrame) -> Model:
    """The model of rows (text, label): all of them are counted."""
    rows = rows.select(F.col("text").cast("string").alias("text"), F.col("label").cast("string").alias("label")).filter("text IS NOT NULL AND label IS NOT NULL")
    many = rows.select("label").distinct().count()
    buckets = buckets_for(many)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums(["label", "cell"], ["n"])
        for batch in slices(batches, 0):
            row, term, words = split(batch.column(0), LETTERS)
            if len(row):
                labels = batch.column(1).dictionary_encode()
                own = labels.indices.to_numpy(zero_copy_only=False)[row].astype(np.int64)
                held, n = np.unique(own * len(words) + term, return_counts=True)
                word, gram, pair = trigrams(words, buckets)
                begin = np.searchsorted(word, np.arange(len(words) + 1))
                size = np.diff(begin)[held % len(words)]
                at = np.repeat(begin[held % len(words)] - np.cumsum(size) + size, size) + np.arange(size.sum())
                cell = np.concatenate([gram[at], pair[at] + buckets]) + np.tile(np.repeat(held // len(words), size) * 2 * buckets, 2)
                total = np.bincount(cell, weights=np.tile(np.repeat(n, size), 2), minlength=len(labels.dictionary) * 2 * buckets).astype(np.int64)
                seen = np.flatnonzero(total)
                yield from sums.add(labels.dictionary.take(pa.array(seen // (2 * buckets))), pa.array(seen % (2 * buckets)), pa.array(total[seen]))
        yield from sums.rest()

    counted = stash(rows.mapInArrow(run, "label string, cell long, n long").groupBy("label", "cell").agg(F.sum("n").alias("n")), "trigrams")
    found = counted.toArrow()  # MODEL_CELLS rows at most
    labels = sorted(set(found.column("label").to_pylist()), key=str.encode)
    number = pc.index_in(found.column("label"), value_set=pa.array(labels, pa.string())).to_numpy()
    counts = np.zeros((max(1, len(labels)), 2 * buckets), np.float32)
    counts[number, found.column("cell").to_numpy()] = found.column("n").to_numpy()
    return Model(labels, np.log(counts[:, :buckets] + np.float32(ALPHA)), np.log(counts[:, buckets:] + np.float32(ALPHA * POSSIBLE)))


def word_logs(words: pa.Array, model: Model) -> np.ndarray:
    """words x languages: the log likelihood of each word."""
    word, gram, pair = trigrams(words, model.grams.shape[1])
    begin = np.searchsorted(word, np.arange(len(words)))
    return np.stack([np.add.reduceat((g[gram] - p[pair]).astype(np.float64), begin) for g, p in zip(model.grams, model.pairs, strict=True)], axis=1)


def mixture(likely: np.ndarray, n: np.ndarray, size: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's proportions of the languages that it is allowed, and their log likelihood.

    likely: words x languages; n: how often each word occurs; size: how many words each document has, one after the other.
    """
    start, total = np.cumsum(size) - size, np.add.reduceat(n, np.cumsum(size) - size)
    found = allowed / allowed.sum(axis=1, keepdims=True)
    live, rows, times, begin = np.arange(len(size)), likely, n, start
    for _ in range(ROUNDS):
        old = found[live]
        mixed = rows * np.repeat(old, size[live], axis=0)
        new = np.add.reduceat(mixed * (times / mixed.sum(axis=1))[:, None], begin, axis=0) / total[live][:, None]
        found[live] = new
        moved = np.abs(new - old).max(axis=1) >= SETTLED
        if not moved.any():
            break
        if not moved.all():  # the others are done
            keep = np.repeat(moved, size[live])
            live, rows, times = live[moved], rows[keep], times[keep]
            begin = np.cumsum(size[live]) - size[live]
    return found, np.add.reduceat(n * np.log((likely * np.repeat(found, size, axis=0)).sum(axis=1)), start)


def infer(texts: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Rows that have words, and the proportions of the chosen languages in each."""
    row, term, words = split(texts, LETTERS)
    if not len(row) or not model.labels:
        return np.empty(0, np.int64), np.empty((0, len(model.labels)))
    key, n = np.unique(row * len(words) + term, return_counts=True)
    docs, size = np.unique(key // len(words), return_counts=True)
    logs = word_logs(words, model)
    likely = np.maximum(np.exp(logs - logs.max(axis=1, keepdims=True)), 1e-200)[key % len(words)]  # of a word in its best language: 1
    n = n.astype(np.float64)
    price = PENALTY * np.log(np.add.reduceat(n, np.cumsum(size) - size))
    full, most = mixture(likely, n, size, np.ones((len(docs), len(model.labels))))
    order = np.argsort(-full, axis=1, kind="stable")
    chosen = np.zeros_like(full)
    chosen[np.arange(len(docs)), order[:, 0]] = 1
    best = np.add.reduceat(n * np.log(likely[np.arange(len(key)), np.repeat(order[:, 0], size)]), np.cumsum(size) - size)
    live = np.flatnonzero(most - best > price)
    for k in range(2, len(model.labels) + 1):
        if not len(live):
            break
        allowed = np.zeros((len(live), full.shape[1]))
        np.put_along_axis(allowed, order[live, :k], 1.0, axis=1)
        keep = np.isin(np.repeat(np.arange(len(docs)), size), live)
        found, gained = mixture(likely[keep], n[keep], size[live], allowed)
        better = gained - (k - 1) * price[live] > best[live]
        live = live[better]
        best[live], chosen[live] = gained[better] - (k - 1) * price[live], found[better]
    return docs, chosen


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred, score and languages, those of the chosen set, the largest proportion first."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    most = max(1 << 16, SLICE_BYTES * 8 // max(8, len(model.labels)))

    @F.arrow_udf(FOUND)
    def judge(texts: pa.Array, lettered: pa.Array) -> pa.Array:
        model, parts = shared.value, []
        names = pa.array(model.labels, pa.string())
        for batch in slices(iter([pa.RecordBatch.from_arrays([texts, lettered], ["t", "l"])]), 0, most):
            top, score = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            none = np.ones(batch.num_rows, bool)
            listed: list[list[str]] = [[] for _ in range(batch.num_rows)]
            rows, found = infer(batch.column(0), model)
            known = batch.column(1).to_numpy(zero_copy_only=False)[rows] if len(rows) else np.empty(0, bool)
            rows, found = rows[known], found[known]
            if len(rows):
                top[rows], score[rows], none[rows] = found.argmax(axis=1), found.max(axis=1), False
                order = np.argsort(-found, axis=1, kind="stable")
                for r, o, f in zip(rows.tolist(), order.tolist(), found, strict=True):
                    listed[r] = [model.labels[k] for k in o if f[k] > 0]
            pred = pc.fill_null(names.take(pa.array(top, mask=none)), UNKNOWN) if len(names) else pa.array([UNKNOWN] * batch.num_rows)
            parts.append(pa.StructArray.from_arrays([pred, pa.array(np.minimum(score, 1.0)), pa.array(listed, pa.list_(pa.string()))], ["lang_pred", "score", "languages"]))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("languages", pa.list_(pa.string()))]))

    value = F.col(text).cast("string")
    names = ("lang_pred", "score", "languages")
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    found = docs.select(*rest, judge(value, F.coalesce(value.rlike(r"\p{L}"), F.lit(False))).alias("__found"))
    return found.select(*rest, *[F.col("__found")[c].alias(c) for c in names])


def held_out(doc_id: Column) -> Column:
    """One document in five, by its key."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def op12_language_mixture(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(~held_out(F.col("doc_id"))).select("text", F.col("lang").alias("label")))
    found = identify(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), model)
    return found.select("doc_id", "held_out", "lang_pred", "score", "languages")


QUERIES = {"op12_language_mixture": op12_language_mixture}
ORACLES: dict[str, str] = {}
