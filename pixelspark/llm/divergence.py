r"""Source divergence audit: how far apart the sources of each language are in their use of words.

1. A pass over all texts counts the documents of each language that hold each term, exactly; terms with at least LEAST_DOCUMENTS are
   the language's kept terms.
2. A second pass recounts their occurrences with an Aho-Corasick automaton: the text has every delimiter replaced by one
   character and one put before and behind it, and each kept term is a pattern with a delimiter on both sides, so that
   every occurrence of a whole term is found once, also where two of them share a delimiter. A vocabulary larger than
   BLOCK_TERMS is taken in blocks, a pass each, so that no task holds more patterns than that.
3. Counts by (language, source, term) are sparse postings. The terms of a language are dealt to buckets of about
   BUCKET_CELLS (source, term) cells (more where a language has very many sources); a bucket is a dense array of the sources' shares, from which each task makes one
   partial sum for each pair of sources and its best rows for each source. Pairs are never rows for each term.

All shares are floor(SCALE * (count + 5) / (N + 5 * V)) + 1, by a long division that stays within 64 bits.

Edge cases: null texts, languages and sources are empty strings; a language without kept terms has a value of 0 for every
pair of its sources; a source without kept terms has the shares that no count gives; equal values are ranked by the
item's bytes; repeated rows count each; a very long text is searched whole; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stash, table
from .terms import LETTERS, Sums, flat, slices, split

LEAST_DOCUMENTS, TOP, SCALE = 30, 50, 1_000_000_000
#: Patterns of an automaton, and cells of a bucket: at least, and at most where the sources of a language are so many that
#: a bucket's partial sums of pairs would outnumber its cells. None changes the result.
BLOCK_TERMS, BUCKET_CELLS, MOST_CELLS = 1 << 18, 1 << 15, 1 << 22
#: Bytes with delimiters as one character; 0x20 is no byte of a term.
PADDED = np.where(LETTERS == 0, np.uint8(0x20), LETTERS).tobytes()
FINDINGS = "lang string, source string, part string, item string, value long"


def _labelled(docs: DataFrame) -> DataFrame:
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return docs.select(named("lang").alias("lang"), named("source").alias("source"), named("text").alias("text"))


def _codes(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    found = column.dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def count_documents(rows: DataFrame) -> DataFrame:
    """lang, term, df: documents of each language that hold each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums(["lang", "term"], ["df"])
        for batch in slices(batches, 1):
            row, term, words = split(batch.column(1), LETTERS)
            if len(row):
                lang, langs = _codes(batch.column(0))
                held = np.unique(row * len(words) + term)
                key, n = np.unique(lang[held // len(words)] * len(words) + held % len(words), return_counts=True)
                yield from sums.add(langs.take(pa.array(key // len(words))), words.take(pa.array(key % len(words))), pa.array(n))
        yield from sums.rest()

    return rows.select("lang", "text").mapInArrow(run, "lang string, term string, df long").groupBy("lang", "term").agg(F.sum("df").alias("df"))


_built: dict[str, tuple] = {}


def _automaton(name: str, terms: list[str]):
    """The automaton of a block, built once a worker; the worker forgets the block before."""
    import ahocorasick

    if name not in _built:
        _built.clear()
        found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, t in enumerate(terms):
            found.add_word(f" {t.encode().decode('latin-1')} ", k)
        found.make_automaton()
        _built[name] = found
    return _built[name]


def _count_block(rows: DataFrame, block: list) -> DataFrame:
    """lang, source, term, n of the kept terms of one block, partial sums."""
    kept: dict[str, list[str]] = {}
    for r in block:
        kept.setdefault(r["lang"], []).append(r["term"])
    terms = sorted({r["term"] for r in block})
    shared = rows.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, terms, kept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, terms, kept = shared.value
        automaton, words, number = _automaton(name, terms), pa.array(terms), {t: k for k, t in enumerate(terms)}
        own = {g: np.array(sorted(number[t] for t in ts), np.int64) for g, ts in kept.items()}
        sums = Sums(["lang", "source", "term"], ["n"])
        for batch in slices(batches, 2):
            data, at = flat(batch.column(2))
            raw, at = data.tobytes().translate(PADDED), at.astype(np.int64)
            # a row's text follows one delimiter, and the last row's has one behind it
            text = (b" " + b" ".join(raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)) + b" ").decode("latin-1")
            hits = np.fromiter(automaton.iter(text), np.dtype([("end", np.int64), ("term", np.int64)]))
            row = np.searchsorted(at[1:] + np.arange(1, len(at)), hits["end"], "left")  # the delimiter behind row k is at at[k + 1] + k + 1
            lang, langs = _codes(batch.column(0))
            source, sources = _codes(batch.column(1))
            group = lang * len(sources) + source
            key, n = np.unique(group[row] * len(terms) + hits["term"], return_counts=True)
            of, term = key // len(terms), key % len(terms)
            keep = np.zeros(len(key), bool)
            for k, g in enumerate(langs.to_pylist()):
                if g in own:
                    mine = of // len(sources) == k
                    keep[mine] = np.isin(term[mine], own[g], assume_unique=False)
            of, term = of[keep], term[keep]
            yield from sums.add(langs.take(pa.array(of // len(sources))), sources.take(pa.array(of % len(sources))), words.take(pa.array(term)), pa.array(n[keep]))
        yield from sums.rest()

    return rows.mapInArrow(run, "lang string, source string, term string, n long")


def count_occurrences(rows: DataFrame, kept: DataFrame, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """lang, source, term, n: occurrences of each language's kept terms in each of its sources, none of them 0."""
    blocks = -(-kept.count() // block_terms)
    found = rows.sparkSession.createDataFrame([], "lang string, source string, term string, n long")
    for k in range(blocks):
        block = kept.filter(F.pmod(F.xxhash64("term"), F.lit(blocks)) == k).select("lang", "term").collect()  # about block_terms rows
        if block:
            found = found.union(stash(_count_block(rows, block), "counted"))
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))


def shares(count: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 5) / (total + 5 * terms)): nine digits of a long division, three at a time."""
    below, rest, digits = total + 5 * terms, count + 5, 0
    for _ in range(3):
        rest = rest * 1000
        digits = digits * 1000 + rest // below
        rest = rest % below
    return 1 + digits


def compare(postings: pd.DataFrame, sources: pd.DataFrame, top: int) -> pd.DataFrame:
    """The findings of one bucket of terms of a language: partial values of its pairs, and each source's `top` terms."""
    sources = sources.sort_values("source", key=lambda s: s.map(str.encode)).reset_index(drop=True)
    names, total, lang = sources["source"].tolist(), sources["total"].to_numpy(np.int64), sources["lang"][0]
    v, whole = int(sources["terms"][0]), np.int64(sources["of_lang"][0])
    terms = sorted(set(postings["term"]), key=str.encode)
    count = np.zeros((len(names), len(terms)), np.int64)
    at = {s: k for k, s in enumerate(names)}, {t: k for k, t in enumerate(terms)}
    count[postings["source"].map(at[0]).to_numpy(int), postings["term"].map(at[1]).to_numpy(int)] = postings["n"].to_numpy(np.int64)
    p = shares(count, total[:, None], max(1, v))
    q = shares(count.sum(axis=0), whole, max(1, v))
    rows = []
    for k, name in enumerate(names):
        away = np.abs(p - p[k]).sum(axis=1)
        rows += [(lang, name, "pair", other, int(away[j])) for j, other in enumerate(names) if j != k]
        more = np.flatnonzero((count[k] > 0) & (p[k] > q))
        for j in more[np.argsort(-(p[k] - q)[more], kind="stable")[:top]].tolist():  # terms are in the order of their bytes
            rows.append((lang, name, "term", terms[j], int(p[k, j] - q[j])))
    return pd.DataFrame(rows, columns=["lang", "source", "part", "item", "value"])


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP, block_terms: int = BLOCK_TERMS, bucket_cells: int = BUCKET_CELLS) -> DataFrame:
    """lang, source, part, item, value, rank."""
    rows = _labelled(docs)
    kept = stash(count_documents(rows).filter(F.col("df") >= least), "kept")
    counted = stash(count_occurrences(rows, kept, block_terms), "postings")
    groups = rows.select("lang", "source").distinct()
    totals = counted.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    of_lang = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    sized = groups.join(totals, ["lang", "source"], "left").join(of_lang, "lang", "left").fillna(0, ["total", "terms"])
    every = Window.partitionBy("lang")
    many = F.count(F.lit(1)).over(every)
    cells = F.greatest(F.lit(bucket_cells), F.least(4 * many * many, F.lit(MOST_CELLS)))
    facts = stash(sized.withColumns({"of_lang": F.sum("total").over(every), "buckets": F.greatest(F.lit(1), F.ceil(F.col("terms") * many / cells))}), "facts")
    dealt = counted.join(facts.groupBy("lang").agg(F.first("buckets").alias("buckets")), "lang").withColumn("bucket", F.pmod(F.xxhash64("term"), F.col("buckets")))
    sides = facts.withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("buckets") - 1)))
    met = dealt.select("lang", "bucket", "source", "term", "n").groupBy("lang", "bucket").cogroup(sides.drop("buckets").groupBy("lang", "bucket"))
    partial = met.applyInPandas(lambda a, b: compare(a, b, top), FINDINGS)
    summed = partial.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    ranked = summed.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")))
    return ranked.filter((F.col("part") == "pair") | (F.col("rank") <= top))


def op13_source_divergence(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


QUERIES = {"op13_source_divergence": op13_source_divergence}
TERM_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLES = {
    "op13_source_divergence": f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {TERM_SQL} AS w FROM documents
), t AS (SELECT r, lang, source, unnest(w) AS term FROM d
), k AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT r) >= {LEAST_DOCUMENTS}
), c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL
), g AS (SELECT DISTINCT lang, source FROM d
), v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang
), e AS (SELECT lang, source, term, coalesce(n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)
), a AS (
  SELECT lang, source, term, n, sum(n) OVER (PARTITION BY lang, source) AS total, sum(n) OVER (PARTITION BY lang, term) AS n_lang, sum(n) OVER (PARTITION BY lang) AS total_lang FROM e
), p AS (
  SELECT lang, source, term, n, 1 + (({SCALE}::HUGEINT * (n + 5)) // (total + 5 * v))::BIGINT AS p, 1 + (({SCALE}::HUGEINT * (n_lang + 5)) // (total_lang + 5 * v))::BIGINT AS q FROM a JOIN v USING (lang)
), f AS (
  SELECT lang, x.source AS source, 'pair' AS part, y.source AS item, sum(abs(x.p - y.p))::BIGINT AS value FROM p x JOIN p y USING (lang, term) WHERE x.source <> y.source GROUP BY ALL
  UNION ALL SELECT x.lang, x.source, 'pair', y.source, 0 FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source WHERE x.lang NOT IN (SELECT lang FROM v)
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM f
QUALIFY part = 'pair' OR rank <= {TOP}
"""
}
