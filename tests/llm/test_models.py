"""The trained models against brute force: segmentations, the gradient and splits of trees, on small random cases."""

import itertools
import math
import random
import re

import numpy as np

from pixelspark.llm import pii, url_filter


def segmentations(n, spans):
    """Every way to cover n tokens with outside tokens and labelled spans: lists of (first, end, kind or None, span)."""
    if n == 0:
        yield []
        return
    for head in segmentations(n - 1, [s for s in spans if s[1] <= n - 1]):
        yield [*head, (n - 1, n, None, None)]
    for s in spans:
        if s[1] == n:
            for head in segmentations(s[0], [r for r in spans if r[1] <= s[0]]):
                for y in range(len(pii.KINDS)):
                    yield [*head, (*s, y, s)]


def total(model, cover, spans, x):
    score, last = 0.0, 0
    for _, _, y, s in cover:
        now = 0 if y is None else y + 1
        score += model.t[last, now] + (0.0 if y is None else float(model.w[y] @ x[spans.index(s)]))
        last = now
    return score


def cases():
    rng, draw = np.random.default_rng(7), random.Random(7)
    for _ in range(25):
        n = draw.randrange(1, 6)
        every = list(itertools.combinations(range(n + 1), 2))
        spans = sorted(draw.sample(every, min(len(every), draw.randrange(1, 4))))
        model = pii.SemiMarkovCrf()
        model.w, model.t = rng.normal(size=model.w.shape), rng.normal(size=model.t.shape)
        yield model, n, spans, rng.normal(size=(len(spans), pii.N_FEATURES))


def test_best_segmentation_is_the_best_of_all():
    for model, n, spans, x in cases():
        every = list(segmentations(n, spans))
        top = max(every, key=lambda c: total(model, c, spans, x))
        assert model.best(n, spans, x) == [(i, j, y) for i, j, y, _ in top if y is not None]


def test_gradient_is_that_of_the_log_likelihood():
    for model, n, spans, x in cases():
        every = list(segmentations(n, spans))
        chosen = every[len(every) // 2]
        gold = {(i, j): y for i, j, y, _ in chosen if y is not None}

        def likelihood(model=model, every=every, chosen=chosen, spans=spans, x=x):
            return total(model, chosen, spans, x) - math.log(sum(math.exp(total(model, c, spans, x)) for c in every))

        gw, gt = model.gradient(n, spans, x, gold)
        for values, slope in ((model.w, gw), (model.t, gt)):
            for at in list(np.ndindex(values.shape))[:: max(1, values.size // 6)]:
                keep = values[at]
                values[at] = keep + 1e-5
                up = likelihood()
                values[at] = keep - 1e-5
                down = likelihood()
                values[at] = keep
                assert abs((up - down) / 2e-5 - slope[at]) < 1e-4


def test_one_tree_takes_the_best_split():
    rng = np.random.default_rng(3)
    for _ in range(10):
        x = rng.integers(0, 9, (80, 3)).astype(float)
        y = (x[:, 1] + rng.normal(0, 2, 80) > 4).astype(float)
        model = url_filter.BoostedTrees(rounds=1, depth=1).fit(x, y)
        p = y.mean()
        g, h = y - p, np.full(80, p * (1 - p))

        def gain(f, c, g=g, h=h, x=x):
            left = x[:, f] <= c
            return sum(g[side].sum() ** 2 / (h[side].sum() + model.damping) for side in (left, ~left))

        feature, cut, value = model.trees[0]
        # quantiles between two values split like the value below them
        assert gain(feature[0], cut[0]) >= max(gain(f, c) for f in range(3) for c in np.unique(np.quantile(x[:, f], np.linspace(0, 1, model.bins + 1)[1:-1]))) - 1e-9
        right = x[:, feature[0]] > cut[0]
        want = [model.rate * g[side].sum() / (h[side].sum() + model.damping) for side in (~right, right)]
        assert np.allclose(value, want) and np.allclose(model.score(x), math.log(p / (1 - p)) + np.where(right, want[1], want[0]))


def judged_by_hand(url):
    """Host, path, rule and the rule's verdict of a URL, as the contract says them."""
    host = path = ""
    if url and "://" in url:
        rest = url[url.index("://") + 3 :]
        cut = next((k for k, c in enumerate(rest) if c in "/?#"), len(rest))
        host, rest = re.sub("[A-Z]", lambda m: m[0].lower(), rest[:cut]), rest[cut:]
        path = rest[: next((k for k, c in enumerate(rest) if c in "?#"), len(rest))]
    fits = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def test_rules_against_a_plain_reading(spark):
    draw = random.Random(8)
    urls = [r["url"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("url").collect()] + [None, "", "://", "a://b://c/de/", "http://com/de/", "http://COM/fr/x?/de/#", "http://É.Example.org/en/1"]
    urls += ["".join(draw.choice(("http", "://", "/", "?", "#", "example.org", "com", "org", ".", "/es/", "/en/1", "/de/", "/fr/", "A", "x")) for _ in range(draw.randrange(1, 9))) for _ in range(800)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "'clash' AS host", "1 AS verdict", "2 AS rule", "3 AS score")
    got = {r["page_id"]: r for r in url_filter.judge(pages, url_filter.train_on(pages, 200)).collect()}
    for k, url in enumerate(urls):
        host, path, rule, verdict = judged_by_hand(url)
        assert (got[k]["host"], got[k]["path"], got[k]["rule"]) == (host, path, rule), url
        assert got[k]["verdict"] in ([verdict] if verdict else ["allow", "block"]) and (got[k]["score"] is None) == (rule is not None)
    none = pages.limit(0)
    assert url_filter.judge(none, url_filter.train_on(none)).count() == 0 and url_filter.train_on(none).trees is None


def test_promotional_urls_of_a_table_without_labels(spark):
    """On all URLs of pages, as the query judges them: what shows catchwords in its host is blocked, hosts without stay, whatever their suffix."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    got = url_filter.op6_url_filter(spark, "/root/testdata/sf0.1").where("rule IS NULL").select("host", "verdict").collect()
    assert len(got) < pages.count()
    for suffix in ("com", "net", "org"):
        of = [r for r in got if r["host"].endswith(suffix)]
        shown = [r["verdict"] for r in of if any(w in r["host"] for w in url_filter.PROMOTION if len(w) > 3)]
        plain = [r["verdict"] for r in of if "-" not in r["host"] and not any(w in r["host"] for w in url_filter.PROMOTION)]
        print(suffix, len(shown), shown.count("block"), len(plain), plain.count("block"))
        assert shown.count("block") >= 0.9 * len(shown) and plain.count("block") <= 0.05 * len(plain), suffix


def test_smallest_hashes_are_those_of_a_full_sort(spark, monkeypatch):
    urls = [(f"https://h{i % 97}.org/p/{i}", i % 2 == 0) for i in range(600)] + [("https://twice.org/", True), ("https://twice.org/", False)]
    rows = spark.createDataFrame(urls, "url string, blocked boolean").repartition(7)
    full = [tuple(r) for r in rows.selectExpr("url", "blocked", "xxhash64(url) h").orderBy("h", "url", "blocked").drop("h").collect()]
    for bits, most in ((16, 50), (2, 50), (16, 601), (16, 602), (16, 5000), (2, 1)):
        monkeypatch.setattr(url_filter, "HASH_BITS", bits)
        assert [tuple(r) for r in url_filter.smallest_hashes(rows, most).collect()] == full[:most]
    assert url_filter.smallest_hashes(rows.where("false"), 9).count() == 0


def whole_text_spans(text, model):
    """The segmentation of all tokens at once, with every span of up to the method's bound as it was first put."""
    tokens = [m.span() for m in pii.TOKEN.finditer(text)]
    spans = set()
    for i, (a, e) in enumerate(tokens):
        if pii.MIXED.fullmatch(text, a, e):
            spans.add((i, i + 1))
        for j in range(i + 1, min(len(tokens), i + pii.MAX_TOKENS) + 1):
            s = text[a : tokens[j - 1][1]]
            if 7 <= len(s) <= pii.MAX_SPAN_CHARS and (s[-1].isalnum() or s[-1] == "_"):
                number = s[0] in "0123456789+(" and (pii.PHONE_SHAPE.fullmatch(s) or pii.IP_SHAPE.fullmatch(s) or re.fullmatch("[0-9]+", s.replace(" ", "").replace("-", "")))
                if number or ((s[0].isalnum() or s[0] == "_") and j - i >= 5 and pii.MAIL_SHAPE.fullmatch(s)):
                    spans.add((i, j))
    spans = sorted(spans)
    x = np.array([pii.features(text, tokens, i, j) for i, j in spans]).reshape(-1, pii.N_FEATURES)
    return [(pii.KINDS[y], tokens[i][0], tokens[j - 1][1]) for i, j, y in model.best(len(tokens), spans, x)]


def test_pii_reads_whole_texts():
    model, draw, found = pii.trained(), random.Random(21), 0
    token = "a" * 60 + "7" + "b" * 50
    assert pii.model_spans(f"secret: {token}", model) == [("secret", 8, 119)]
    far = "w " * 300
    assert pii.model_spans(f"{far}secret: {'x' * 400}1{'y' * 400} {far}", model) == [("secret", 608, 1409)]
    assert pii.model_spans("go to the one at thing. Then at last", model) == []
    for _ in range(400):
        parts = []
        for _ in range(draw.randrange(1, 9)):
            long = "".join(draw.choices("abcdefgh_é", k=draw.randrange(1, 260)))
            parts += [pii._sentence(draw)[0], draw.choice((" ", "\n" * 9, "", ": ", " " * 200)), draw.choice((long, long + "4" + long, "password = " + long + "9", "word " * draw.randrange(80), "12 " * draw.randrange(9), "(((+1", "é", "x at y.z dot com", "a@", "at", "²³¹²³¹²³"))]
        text = "".join(parts)
        want = whole_text_spans(text, model)
        found += len(want)
        assert pii.model_spans(text, model) == want, text
    assert found > 500
