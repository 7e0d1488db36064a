"""The operators that count terms: ranked search, mixtures of languages, divergence of sources; against brute force."""

import math
import random
import re
from collections import Counter, defaultdict
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from pixelspark.llm import divergence, lexical_search, mixture_language, terms

ODD = ["", None, "  ", "12 34", "É é À-a_b", "A" * 70_000 + " b", "the The THE", "中 文 x", "x\0y", "😀 the end"]


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def prose(n, seed, words=40):
    draw = random.Random(seed)
    return [" ".join(f"w{min(draw.randrange(words), draw.randrange(words))}" for _ in range(draw.randrange(1, 60))) for _ in range(n)]


@pytest.mark.parametrize("table, pattern", [(terms.ALNUM, r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), (terms.LETTERS, r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")])
def test_split(table, pattern):
    draw = random.Random(0)
    texts = ODD + ["".join(draw.choice("aZ9 é中_-\n.\x7f") for _ in range(draw.randrange(40))) for _ in range(500)]
    for column in (pa.array(texts), pa.array(["skipped", *texts, None]).slice(1, len(texts)), pa.array([], pa.string()), pa.array([None], pa.string())):
        row, term, words = terms.split(column, table)
        words = words.to_pylist()
        assert [(r, words[k]) for r, k in zip(row.tolist(), term.tolist(), strict=True)] == [(k, w) for k, t in enumerate(column.to_pylist()) for w in re.findall(pattern, lower(t))]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["t"])
    for most in (1, 50, 1 << 20):
        assert [t for b in terms.slices(iter([batch]), 0, most) for t in b.column(0).to_pylist()] == texts


def test_sums_are_handed_on_whole(monkeypatch):
    monkeypatch.setattr(terms, "HELD_ROWS", 50)
    draw, sums, want, got = np.random.default_rng(0), terms.Sums(["k"], ["n"]), Counter(), Counter()
    for _ in range(40):
        k, n = draw.integers(0, 90, 20), draw.integers(0, 9, 20)
        for a, b in zip(k.tolist(), n.tolist(), strict=True):
            want[a] += b
        for batch in sums.add(pa.array(k), pa.array(n)):
            got.update(dict(zip(*[c.to_pylist() for c in batch.columns], strict=True)))
    for batch in sums.rest():
        got.update(dict(zip(*[c.to_pylist() for c in batch.columns], strict=True)))
    assert +got == +want


# --- ranked search ---


def ranked(docs, items, top):
    pattern = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    found = [(k, Counter(re.findall(pattern, lower(t)))) for k, t in docs]
    found = [(k, c) for k, c in found if c]
    n_docs, n_terms = len(found), sum(c.total() for _, c in found)
    df = Counter(t for _, c in found for t in c)
    for item, text in items:
        asked, rows = Counter(re.findall(pattern, lower(text))), []
        for k, c in found:
            m = 75 + (25 * c.total() * n_docs) // n_terms
            s = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, times in asked.items() if t in c)
            if s > 0:
                rows.append((-s, k is None, k or 0, k))
        yield from ((item, r + 1, k, -s) for r, (s, _, _, k) in enumerate(sorted(rows)[:top]))


@pytest.mark.parametrize("postings, block", [(1 << 20, 1 << 18), (300, 40)])
def test_lexical_search(spark, monkeypatch, postings, block):
    monkeypatch.setattr(lexical_search, "BLOCK_TERMS", block)
    texts = ODD + prose(300, 1) + ["same text here"] * 70  # more ties at the border than rows of a result
    docs = list(enumerate(texts)) + [(None, "same text here"), (5, "w1 w2 repeated key")]
    items = [(1, "w1 W2 w2, w39"), (2, "same"), (3, None), (4, "nothing like it"), (5, "the É x"), (6, ""), *enumerate(prose(12, 5), 10)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS term", "'x' AS score").repartition(5)
    asked = spark.createDataFrame([*items, items[0]], "item_id long, text string").selectExpr("*", "2 AS rank")
    index = lexical_search.build(frame, postings)
    got = lexical_search.search(index, asked, 20)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(ranked(docs, items, 20), key=str) and got.columns == ["item_id", "rank", "doc_id", "score"]
    assert postings > 300 or index.shards.count() > 5
    assert lexical_search.search(index, asked.limit(0)).count() == 0 and lexical_search.search(lexical_search.build(frame.limit(0)), asked).count() == 0


def test_one_shard_is_held_at_a_time(spark, monkeypatch):
    limits = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"]
    now = lambda: [spark.conf.get(name, None) for name in limits]
    before, during, plain = now(), {}, lexical_search.stash
    monkeypatch.setattr(lexical_search, "stash", lambda df, name, **options: (during.update({name: now()}), plain(df, name, **options))[1])
    docs, items = list(enumerate(prose(300, 1))), list(enumerate(prose(4, 5)))
    index = lexical_search.build(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), 300)
    groups = [f.metadata.row_group(k).num_rows for f in map(pq.ParquetFile, (urlparse(x).path for x in index.shards.inputFiles())) for k in range(f.metadata.num_row_groups)]
    assert len(groups) == index.shards.count() > 5 and set(groups) == {1}
    got = lexical_search.search(index, spark.createDataFrame(items, "item_id long, text string"), 20)
    assert sorted(map(tuple, got.collect())) == sorted(ranked(docs, items, 20))
    assert [during[name] for name in ("terms", "shards", "asked", "found")] == [["1000", "4m"]] * 4 and now() == before


def test_best_keeps_ties_by_id():
    draw = np.random.default_rng(3)
    for _ in range(300):
        scores, ids = draw.integers(0, 4, 30), draw.permutation(30)
        want = sorted((-s, d) for s, d in zip(scores.tolist(), ids.tolist(), strict=True) if s > 0)[:7]
        assert sorted((-scores[k], ids[k]) for k in lexical_search.best(scores, ids, 7)) == want


# --- mixtures of languages ---

EN, FR, DE = "the of and thing other then this with".split(), "le la des équerre où être avec que".split(), "der die und nicht über straße werden ein".split()


def spoken(words, n, draw):
    return " ".join(draw.choices(words, k=n))


@pytest.fixture(scope="module")
def model(spark):
    draw = random.Random(6)
    rows = [(spoken(w, 40, draw), name) for name, w in (("en", EN), ("fr", FR), ("de", DE)) for _ in range(40)] + [(None, "en"), ("ignored words", None), ("", "fr")]
    return mixture_language.train(spark.createDataFrame(rows, "text string, label string"))


def test_training_counts_every_trigram(spark):
    rows = [("ab Ab c", "x"), ("abc", "y"), ("ab", "x"), ("é", "y")]
    found = mixture_language.train(spark.createDataFrame(rows, "text string, label string"))
    assert found.labels == ["x", "y"]
    want = np.zeros_like(found.grams), np.zeros_like(found.pairs)
    for text, label in rows:
        for word in re.findall(r"[^\W\d_]+", text.lower()):
            _, gram, pair = mixture_language.trigrams(pa.array([word]), found.grams.shape[1])
            assert len(gram) == len(word) + 1
            for side, cells in zip(want, (gram, pair), strict=True):
                np.add.at(side[found.labels.index(label)], cells, 1)
    assert np.allclose(np.exp(found.grams), want[0] + mixture_language.ALPHA) and np.allclose(np.exp(found.pairs), want[1] + mixture_language.ALPHA * mixture_language.POSSIBLE, rtol=1e-4)


def test_mixture_equals_plain_expectation_maximisation():
    draw = np.random.default_rng(1)
    size = np.array([1, 5, 30, 80])
    likely, n = draw.random((size.sum(), 3)) ** 6 + 1e-9, draw.integers(1, 5, size.sum()).astype(float)
    allowed = np.array([[1, 1, 1], [1, 0, 1], [1, 1, 1], [0, 1, 1]], float)
    found, gained = mixture_language.mixture(likely, n, size, allowed)
    at = 0
    for k, s in enumerate(size):
        rows, times, p = likely[at : at + s], n[at : at + s], allowed[k] / allowed[k].sum()
        for _ in range(mixture_language.ROUNDS):
            old, p = p, sum(t * r * p / (r * p).sum() for r, t in zip(rows, times, strict=True)) / times.sum()
            if abs(p - old).max() < mixture_language.SETTLED:
                break
        assert np.allclose(found[k], p) and np.isclose(gained[k], sum(t * math.log((r * p).sum()) for r, t in zip(rows, times, strict=True)))
        assert np.isclose(found[k].sum(), 1) and not found[k][allowed[k] == 0].any()
        at += s


def test_languages(spark, model):
    draw = random.Random(9)
    rows = [(0, None), (1, ""), (2, "12 -- 34 …"), (3, spoken(EN, 30, draw)), (4, spoken(FR, 30, draw) + " " + spoken(EN, 12, draw)), (5, spoken(DE, 9000, draw)), (6, spoken(DE, 3, draw)), (3, "le")]
    rows += [(k, spoken((EN, FR, DE)[k % 3], draw.randrange(4, 50), draw)) for k in range(10, 200)]
    got = mixture_language.identify(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'clash' AS score", "1 AS lang", "2 AS label"), model)
    assert got.columns == ["doc_id", "text", "lang", "label", "lang_pred", "score", "languages"]
    by = {(r["doc_id"], r["text"]): r for r in got.collect()}
    assert [(by[k, t]["lang_pred"], by[k, t]["score"], by[k, t]["languages"]) for k, t in rows[:3]] == [("und", 0.0, [])] * 3
    assert [by[r]["lang_pred"] for r in rows[3:]] == ["en", "fr", "de", "de", "fr", *[("en", "fr", "de")[k % 3] for k in range(10, 200)]]
    assert by[rows[4]]["languages"] == ["fr", "en"] and abs(by[rows[4]]["score"] - 30 / 42) < 0.1 and by[rows[5]]["languages"] == ["de"]
    assert sum(len(by[r]["languages"]) == 1 for r in rows[8:]) > 180
    none = mixture_language.train(spark.createDataFrame([], "text string, label string"))
    assert {r["lang_pred"] for r in mixture_language.identify(spark.createDataFrame(rows, "doc_id long, text string"), none).collect()} == {"und"}
    assert mixture_language.identify(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0
    with pytest.raises(ValueError):
        mixture_language.buckets_for(10_000)


def test_language_accuracy_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = mixture_language.op12_language_mixture(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    right = [r["lang_pred"] == r["lang"] for r in got.filter("held_out").collect()]
    assert len(right) > 150 and sum(right) / len(right) >= 0.98


# --- divergence of sources ---


def diverged(rows, least, top):
    pattern, of, df = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        words = re.findall(pattern, lower(text))
        of[lang or "", source or ""].update(words)
        df[lang or ""].update(set(words))
    kept = {g: {t for t, n in c.items() if n >= least} for g, c in df.items()}
    share = lambda c, total, v: 1 + (10**9 * (c + 5)) // (total + 5 * v)
    for (lang, source), c in of.items():
        ks, out = kept[lang], {"pair": [], "term": []}
        whole = Counter()
        for (g, _), x in of.items():
            whole.update(x if g == lang else {})
        total, of_lang = sum(c[t] for t in ks), sum(whole[t] for t in ks)
        for (g, other), d in of.items():
            if g == lang and other != source:
                total_d = sum(d[t] for t in ks)
                out["pair"].append((-sum(abs(share(c[t], total, len(ks)) - share(d[t], total_d, len(ks))) for t in ks), other))
        for t in ks:
            p, q = share(c[t], total, len(ks)), share(whole[t], of_lang, len(ks))
            if c[t] and p > q:
                out["term"].append((q - p, t))
        for part, found in out.items():
            found.sort(key=lambda x: (x[0], x[1].encode()))
            yield from ((lang, source, part, item, -v, r + 1) for r, (v, item) in enumerate(found[: None if part == "pair" else top]))


@pytest.mark.parametrize("block, cells", [(1 << 18, 1 << 19), (7, 20)])
def test_divergence(spark, block, cells):
    draw = random.Random(2)
    rows = [(draw.choice(("en", "fr")), f"s{draw.randrange(6)}", t) for t in prose(200, 3) + ODD * 3]
    rows += [(None, None, "a b a b c"), (None, "s1", "a a\na"), ("", "s1", None), ("xx", "one", "rare"), ("xx", "two", None), ("en", "empty", "12"), ("en", None, "É é"), *[("en", "s0", "e e e")] * 6]
    frame = spark.createDataFrame(rows, "lang string, source string, text string").selectExpr("*", "1 AS term", "2 AS value").repartition(3)
    got = divergence.audit(frame, least=4, top=5, block_terms=block, bucket_cells=cells)
    want = [r for r in diverged([(a, b, re.sub(r"\d", lambda m: "abcdefghij"[int(m[0])], t) if t else t) for a, b, t in rows], 4, 5)]
    lettered = frame.selectExpr("lang", "source", "translate(text, '0123456789', 'abcdefghij') AS text", "term")
    again = divergence.audit(lettered, least=4, top=5, block_terms=block, bucket_cells=cells)
    assert sorted(map(tuple, got.collect())) == sorted(diverged(rows, 4, 5)) and got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, again.collect())) == sorted(want) and len({r[3] for r in want if r[2] == "term"}) > 10
    assert divergence.audit(frame.limit(0)).count() == 0


def test_shares_are_exact():
    draw = random.Random(4)
    for _ in range(2000):
        total, v = draw.randrange(10**15), draw.randrange(1, 10**6)
        count = draw.randrange(total + 1)
        assert divergence.shares(np.array([count]), np.array([total]), v)[0] == 1 + (10**9 * (count + 5)) // (total + 5 * v)
