"""URL filtering: exact host and path rules first, gradient-boosted trees on lexical features for the rest.

The trees are trained on labelled URLs. `train_from` takes them from a table, at most `max_labelled` of them (the ones
with the smallest hash, a documented bound on what reaches the driver). No table labels the URLs of the query, so it trains on
its own: at most SAMPLE of the table's URLs stand for ordinary ones, and each once more with its name replaced by joined
catchwords, and some with more parameters or a long key in the path, for promotional ones (`mirrored`). Scheme, suffix,
path and the rest are the same in both kinds, so only what promotion looks like tells them apart; what promotional URLs there
are among the table's is a small part of the ordinary kind. Rates of whole host names would learn them by heart and are left out.
Rules say nothing about the URLs that no rule fits, and are not learned from. Every URL is scored. Features: lengths, path
depth, digit ratio, character entropy, counts of parameters, hyphens and host labels, and smoothed label rates of the
host's last label and last two (and, of labelled tables, three) labels.

Edge cases: a null URL, or one without "://", has an empty host and path, fits no rule and is judged by the trees as an
empty text; without labelled URLs of both kinds every URL not covered by a rule is allowed; a very long URL is read whole; rules that are as
long as each other and both fit are settled by the last one listed; of labelled URLs with equal hashes the first in order are taken; repeated rows are judged
alike; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash, table
from .exact_dedup import ascii_lower

#: Labelled URLs that may reach the driver for training.
MAX_LABELLED = 20_000
#: URLs of its table that the query trains on.
SAMPLE = 6_000
#: Bits of a hash that labelled URLs are counted by to choose those with the smallest one.
HASH_BITS = 16
FOLDS = 5
#: host, path prefix, verdict
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


def host_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))).otherwise("")


def path_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits (host and all subdomains, path prefix), and its verdict; null without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


# --- features ------------------------------------------------------------------------------------------------------


def suffixes(host: str) -> tuple[str, str, str]:
    labels = host.split(".")
    return tuple(f"{k}:{'.'.join(labels[-k:])}" for k in (1, 2, 3))


def split_url(url: str) -> tuple[str, str, str]:
    _, _, rest = url.partition("://")
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    tail = rest[cut:]
    end = min((i for i in map(tail.find, "?#") if i >= 0), default=len(tail))
    return rest[:cut].lower(), tail[:end], tail[end:]


def lexical(url: str, rates: dict[str, float], base: float) -> list[float]:
    host, path, query = split_url(url)
    n = len(url)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(url).values()) if n else 0.0
    digits = sum("0" <= c <= "9" for c in url)
    params = query.count("&") + 1 if "?" in query and len(query) > 1 else 0
    return [n, len(host), len(path), path.count("/"), digits / n if n else 0.0, entropy, params, host.count("-"), host.count("."), max(map(len, host.split("."))), float("#" in query), *(rates.get(s, base) for s in suffixes(host))]


def suffix_rates(urls: list[str], labels: np.ndarray, strength: float = 20.0) -> tuple[dict[str, float], float]:
    """Label rates of host suffixes, drawn towards the overall rate."""
    base = float(labels.mean())
    seen: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0])
    for url, y in zip(urls, labels.tolist(), strict=True):
        for s in suffixes(split_url(url)[0]):
            seen[s][0] += y
            seen[s][1] += 1
    return {s: (a + strength * base) / (n + strength) for s, (a, n) in seen.items()}, base


# --- trees ---------------------------------------------------------------------------------------------------------


@dataclass
class BoostedTrees:
    """Logistic gradient boosting on binned features; each tree is complete, of a fixed depth."""

    rounds: int = 60
    depth: int = 3
    rate: float = 0.2
    bins: int = 32
    damping: float = 1.0
    start: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)], 1)
        p = min(max(float(y.mean()), 1e-4), 1 - 1e-4)
        self.start = math.log(p / (1 - p))
        score, inner = np.full(len(y), self.start), 2**self.depth - 1
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-score))
            g, h = y - q, q * (1 - q)
            feature, cut, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
            for level in range(self.depth):
                first, width = 2**level - 1, 2**level
                best = np.full(width, -np.inf)
                split = np.zeros((width, 2), np.int64)
                for f in range(x.shape[1]):
                    if not len(cuts[f]):
                        continue
                    m = len(cuts[f]) + 1
                    at = (node - first) * m + binned[:, f]
                    gs = np.bincount(at, g, width * m).reshape(width, m).cumsum(1)
                    hs = np.bincount(at, h, width * m).reshape(width, m).cumsum(1)
                    gl, hl, gt, ht = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                    gain = gl**2 / (hl + self.damping) + (gt - gl) ** 2 / (ht - hl + self.damping)
                    k = gain.argmax(1)
                    top = gain[np.arange(width), k]
                    better = top > best + 1e-12
                    best[better], split[better, 0], split[better, 1] = top[better], f, k[better]
                for w in range(width):
                    if np.isfinite(best[w]):
                        feature[first + w], cut[first + w] = split[w, 0], cuts[split[w, 0]][split[w, 1]]
                node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
            leaf = node - inner
            value = self.rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + self.damping)
            score += value[leaf]
            self.trees.append((feature, cut, value))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        total, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += value[node - len(feature)]
        return total


@dataclass
class UrlModel:
    trees: BoostedTrees | None
    rates: dict[str, float]
    base: float

    def score(self, urls: Sequence[str]) -> np.ndarray:
        """Log-odds of being blocked."""
        if self.trees is None or not len(urls):
            return np.full(len(urls), -1.0)
        return self.trees.score(np.array([lexical(u, self.rates, self.base) for u in urls], float))


def train(urls: list[str], blocked: Sequence[bool], host_labels: int = 3) -> UrlModel:
    """Trees on labelled URLs; rates of a host's last `host_labels` labels at most."""
    y = np.array(blocked, float)
    if not len(y) or y.min() == y.max():
        return UrlModel(None, {}, 0.0)
    short = lambda found: ({s: v for s, v in found[0].items() if int(s[0]) <= host_labels}, found[1])
    rates, base = short(suffix_rates(urls, y))
    # a training row's own label must not reach its suffix rates: they come from the other folds
    fold = np.arange(len(urls)) % FOLDS
    x = np.empty((len(urls), len(lexical("", {}, 0.0))))
    for k in range(FOLDS):
        rest = np.flatnonzero(fold != k)
        own, level = short(suffix_rates([urls[i] for i in rest], y[rest]))
        for i in np.flatnonzero(fold == k):
            x[i] = lexical(urls[i], own, level)
    return UrlModel(BoostedTrees().fit(x, y), rates, base)


#: Parts of generated training URLs.
PLAIN = ("al", "ber", "con", "der", "el", "fer", "gan", "hol", "in", "jor", "kel", "lan", "mor", "nor", "or", "per", "ran", "ser", "ther", "un", "ver", "wil")
PROMOTION = ("casino", "pills", "cheap", "free", "bets", "win", "bonus", "deal", "ads", "click", "track", "farm", "spam", "loan", "slots", "promo", "hot", "now")
SECTIONS = ("en", "de", "fr", "es", "news", "post", "wiki", "docs", "item", "about", "archive")


def labelled_urls(n: int = 6000, seed: int = 11) -> tuple[list[str], list[bool]]:
    """n URLs, half of them promotional: joined catchwords, many parameters, long or digit-heavy paths."""
    draw = random.Random(seed)
    urls, blocked = [], []
    for k in range(n):
        bad = bool(k % 2)
        if bad:
            words = draw.sample(PROMOTION, draw.choice((2, 2, 2, 3)))
            host = draw.choice(("-", "-", "-", "")).join(words) + (str(draw.randrange(10, 999)) if draw.random() < 0.3 else "")
        else:
            host = "".join(draw.choices(PLAIN, k=draw.choice((1, 2, 2, 3)))) + ("-" + draw.choice(PLAIN) if draw.random() < 0.02 else "")
        host = draw.choice(("", "www.", "blog.", "m.")) + host + draw.choice(("", ".example")) + draw.choice((".com", ".org", ".net"))
        path = "".join(f"/{draw.choice(SECTIONS)}" for _ in range(draw.choice((1, 1, 2, 3)))) + f"/{draw.randrange(1000)}" + draw.choice(("", ".html", "/"))
        if bad and draw.random() < 0.4:
            path += "/" + "".join(draw.choices("0123456789abcdef", k=draw.randrange(8, 32)))
        query = draw.choice(("", "", "?page=2&ref=x", "?utm_source=feed"))
        if bad and draw.random() < 0.4:
            query = "?" + "&".join(f"{draw.choice(PROMOTION)}={draw.randrange(10**6)}" for _ in range(draw.randrange(2, 7)))
        urls.append(draw.choice(("http://", "https://")) + host + path + query + draw.choice(("", "", "#top")))
        blocked.append(bad)
    return urls, blocked


def mirrored(urls: list[str], seed: int = 11) -> list[str]:
    """Each URL with its name (the host label before the last two, or the first) replaced by joined catchwords."""
    draw, out = random.Random(seed), []
    for url in urls:
        scheme, mark, rest = url.partition("://")
        host, path, tail = split_url(url)
        labels = host.split(".")
        words = draw.sample(PROMOTION, draw.choice((2, 2, 2, 3)))
        labels[max(0, len(labels) - 3)] = draw.choice(("-", "-", "-", "")).join(words) + (str(draw.randrange(10, 999)) if draw.random() < 0.3 else "")
        if draw.random() < 0.2:
            path += "/" + "".join(draw.choices("0123456789abcdef", k=draw.randrange(8, 32)))
        if draw.random() < 0.2:
            tail = "?" + "&".join(f"{draw.choice(PROMOTION)}={draw.randrange(10**6)}" for _ in range(draw.randrange(2, 7)))
        out.append(f"{scheme}{mark}{'.'.join(labels)}{path}{tail}")
    return out


def train_on(pages: DataFrame, sample: int = SAMPLE, url: str = "url") -> UrlModel:
    """A model of a table without labels: a bounded sample of its URLs against their mirrored forms."""
    rows = pages.select(F.col(url).cast("string").alias("url")).where(F.instr("url", "://") > 0).distinct()
    urls = sorted(r["url"] for r in smallest_hashes(rows, sample).collect())
    return train(urls + mirrored(urls), [False] * len(urls) + [True] * len(urls), 2)


def smallest_hashes(rows: DataFrame, most: int, column: str = "url") -> DataFrame:
    """The `most` rows with the smallest hash of a column (ties by all columns).

    Rows are counted by the first bits of their hash, so all but those up to the place where `most` is reached are left
    out where they lie: what is then sorted is `most` rows and the share of one place, not `most` rows of each partition.
    """
    mark = "__hash"
    hashed = stash(rows.withColumn(mark, F.xxhash64(column)), "hashed")
    place = F.shiftright(mark, 64 - HASH_BITS)
    counts = sorted((r["place"], r["count"]) for r in hashed.groupBy(place.alias("place")).count().collect())  # at most 2 ** HASH_BITS rows
    reached = np.searchsorted(np.cumsum([n for _, n in counts]), most)
    last = counts[min(int(reached), len(counts) - 1)][0] if counts else 0
    return hashed.where(place <= last).orderBy(mark, *rows.columns).limit(most).drop(mark)


def train_from(labelled: DataFrame, max_labelled: int = MAX_LABELLED) -> UrlModel:
    """A model from the columns url and blocked; distinct pairs, at most max_labelled of them, chosen by hash."""
    rows = labelled.where("url IS NOT NULL AND blocked IS NOT NULL").select("url", "blocked").distinct()
    got = smallest_hashes(rows, max_labelled).collect()
    return train([r["url"] for r in got], [r["blocked"] for r in got])


def judge(pages: DataFrame, model: UrlModel, rules: Sequence[tuple[str, str, str]] = RULES, url: str = "url", keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """keep columns, host, path, rule, verdict and the model's score of each row (null where a rule decides)."""
    shared = pages.sparkSession.sparkContext.broadcast(model)  # at most max_labelled URLs' suffixes and a few trees

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        for batch in batches:
            yield pd.Series(own.score(["" if u is None else u for u in batch]))

    base = pages.select(*keep, F.col(url).cast("string").alias("__url")).withColumns({"host": F.coalesce(host_of(F.col("__url")), F.lit("")), "path": F.coalesce(path_of(F.col("__url")), F.lit(""))})
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = base.withColumns({"rule": rule, "__verdict": verdict, "score": score(F.col("__url"))})
    verdict = F.coalesce("__verdict", F.when(F.col("score") > 0, "block").otherwise("allow"))
    return ruled.select(*keep, "host", "path", "rule", verdict.alias("verdict"), F.when(F.col("rule").isNull(), F.col("score")).alias("score"))


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("page_id"), "url")
    return judge(pages, train_on(pages))


QUERIES = {"op6_url_filter": op6_url_filter}
ORACLES: dict[str, str] = {}
