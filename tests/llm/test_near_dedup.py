"""Near duplicates: recall against all pairs, boilerplate that many documents share, and how the rows made grow."""

import random
from collections import defaultdict

import pytest

from pixelspark.llm import near_dedup
from pixelspark.llm.common import stash


def shingles(text, size):
    w = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def links(rows, size):
    """All pairs of keys whose sets have a similarity of 0.8 or more."""
    sets, posted = {k: shingles(t, size) for k, t in rows}, defaultdict(list)
    for k, s in sets.items():
        for x in s:
            posted[x].append(k)
    shared = defaultdict(int)
    for ks in posted.values():
        for i, a in enumerate(ks):
            for b in ks[:i]:
                shared[b, a] += 1
    return {(a, b) for (a, b), n in shared.items() if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n)}


def labels(rows, pairs):
    label = {k: k for k, _ in rows}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return {k: find(k) for k in label}


def boilerplate(n, private, seed=0):
    """Documents of 225 words that share 225 - private(draw) of them, some in near copies."""
    draw, rows = random.Random(seed), []
    base = [f"b{k}" for k in range(225)]
    while len(rows) < n:
        words = list(base)
        for at in range(225 - private(draw), 225):
            words[at] = f"v{draw.randrange(100_000)}"
        rows.append((len(rows), " ".join(words)))
        if draw.random() < 0.1:
            words[draw.randrange(225)] = "edited"
            rows.append((len(rows), " ".join(words)))
    return rows[:n]


@pytest.mark.parametrize("long, block, family", [(64, 4096, 64), (5, 7, 8)])
def test_boilerplate_near_the_threshold(spark, monkeypatch, long, block, family):
    for name, value in (("LONG", long), ("LIST_BLOCK", block), ("FAMILY", family)):
        monkeypatch.setattr(near_dedup, name, value)
    rows = boilerplate(150, lambda d: d.randrange(10, 90), 1) + [(k + 1000, t.replace("b1", "c1")) for k, t in boilerplate(60, lambda d: 75, 2)]
    pairs = links(rows, 2)
    want = labels(rows, pairs)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.components(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    assert got == want and len(pairs) > 300 and 50 < len(set(want.values())) < len(rows)


@pytest.mark.parametrize("size", [2, 5])
def test_recall_against_all_pairs(spark, size):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    pairs = links(rows, size)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.components(docs, size).collect()}
    found = sum(got[a] == got[b] for a, b in pairs)
    assert len(pairs) > 50 and found == len(pairs) and got == labels(rows, pairs)


def test_rows_grow_in_proportion(spark, monkeypatch):
    """Postings, pairs, classes to compare and links of documents that share two thirds of their words, none of them linked."""
    made = defaultdict(int)

    def counted(name):
        f = getattr(near_dedup, name)

        def run(*args):
            out = stash(f(*args), "counted")
            made[name] += out.count()
            return out

        monkeypatch.setattr(near_dedup, name, run)

    for name in ("live_postings", "short_pairs", "agreeing_in_lists", "family_links"):
        counted(name)
    total = []
    for n in (500, 1500):
        made.clear()
        rows = boilerplate(n, lambda d: 75, n)
        near_dedup.components(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
        total.append(sum(made.values()))
        assert made["short_pairs"] <= n
    assert total[1] <= total[0] * 3**1.15


def test_forests_in_parts(spark, monkeypatch):
    draw = random.Random(3)
    edges = [(draw.randrange(3000), draw.randrange(3000)) for _ in range(2500)]
    want = labels([(k, None) for k in range(3000)], edges)
    for nodes in (1 << 19, 10):
        monkeypatch.setattr(near_dedup, "FOREST_NODES", nodes)
        got = {r["id"]: r["component"] for r in near_dedup.connect(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert all(want[k] == c for k, c in got.items()) and set(got) >= {x for a, b in edges for x in (a, b) if a != b}
