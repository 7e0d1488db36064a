r"""Near-duplicate detection by a signature-coordinate inverted join.

1. Each document becomes the set of its distinct word shingles and a MinHash signature of `COORDINATES` values. Equal sets
   form a class; from here on one member stands for it.
2. Every (coordinate, value) pair of a signature is a token. All tokens are counted, and those of one class only are
   skipped: a class with more than COORDINATES - MATCHES of them can agree with none and is settled. The rest are
   ordered rarest first. Two signatures that agree in at least `MATCHES` coordinates share at least `LEAST` tokens
   among their first COORDINATES - MATCHES + LEAST, so only these are posted; the frequent rest (common word pairs,
   shared passages) is skipped without losing a pair.
3. Posting lists are split by set size, as linked sets differ in size by a quarter at most. First each class is
   compared with the head of the list it shares most tokens with: as many comparisons as classes, however long a list.
   Verified links give first components. What agreeing signatures hold together is a family.
4. What can still be linked lies in different components. A large family counts as one in a list: a class that shares
   enough tokens with it, or lies in it but outside its main component, is compared with all its members in blocks, and
   no pair becomes a row. Of other classes, those of one short list are paired when they share enough tokens in short
   lists. A pair that agrees and does not is together in a long list (of more than LONG: a boilerplate that many documents
   share), at a place no later than their bound: long lists are compared in blocks on the signatures, and the classes that
   agree with any are compared in blocks on the full sets, as families are. Only links become rows.
5. Compared pairs must agree in MATCHES coordinates (in blocks: no need) and are confirmed on the full sets.
6. Components come from alternating large-star and small-star rounds; between them each task joins the edges it holds.

With MATCHES of COORDINATES, a pair of similarity 0.8 is missed with probability below 1e-5.

Edge cases: documents without words (null or empty texts) have no shingles, link with nothing and stay; fewer words than a shingle
has make one shingle of them all; repeated rows are one class; one key with several texts is several classes, each judged by
itself, and of near copies with one key the smallest digest stays; a null key never represents a class unless all its
keys are null; a very long text becomes one set, read whole by one task;
ties of list heads go to the larger id; an empty table gives an empty result; extra columns are ignored by `components` and kept by `drop_near_duplicates`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import log

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cells, likely, small_batches, stash, table

COORDINATES, MATCHES, LEAST = 128, 82, 8
PREFIX = COORDINATES - MATCHES + LEAST
#: A token with this share of all postings is counted where it is read and not gathered; at most 1 / HOT_SHARE tokens are.
HOT_SHARE, HOT_LEAST = 2.0**-13, 64
#: Classes from which a family is compared in blocks, shingles in a block, and tasks that a family is dealt to. None changes the result.
FAMILY, BLOCK, SALTS = 64, 1 << 16, 16
#: Entries from which a list is compared in blocks, classes in such a block, nodes that a task holds to join edges. None changes the result.
LONG, LIST_BLOCK, FOREST_NODES = 64, 4096, 1 << 19
#: Rows whose texts are Python objects at a time.
SLICE_ROWS = 256
#: Similarity in percent.
PERCENT = 80


# --- sets and signatures -----------------------------------------------------------------------------------------


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The distinct shingles as sorted 64-bit hashes. Words are split at ASCII white space, A-Z lower-cased."""
    from xxhash import xxh3_64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(size, len(h))
    total = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        total *= np.uint64(0x9E3779B97F4A7C15)
        total += h[k : len(h) - n + 1 + k]
    total ^= total >> np.uint64(31)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    total ^= np.uint64(n)
    return np.unique(total)


@lru_cache(maxsize=1)
def hash_family() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20)
    return draw.integers(1, 2**63, COORDINATES, np.uint64) * np.uint64(2) + np.uint64(1), draw.integers(0, 2**63, COORDINATES, np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of each hash function over the set."""
    a, b = hash_family()
    least = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(shingles), 1024):
        x = shingles[k : k + 1024]
        np.minimum(least, ((a[:, None] * x + b[:, None]) >> np.uint64(32)).min(axis=1).astype(np.uint32), out=least)
    return least


def sign(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set, signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in _slices(batches, SLICE_ROWS):
            n, digest, sig = [], [], []
            for text in batch.column(1).to_pylist():
                s = shingle_set(text, size)
                n.append(len(s))
                digest.append(xxh3_128_digest(s.tobytes()))
                sig.append(signature(s).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary())], ["doc_id", "n_shingles", "digest", "sig"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_shingles long, digest binary, sig binary")


def tokens(sig: np.ndarray) -> np.ndarray:
    """Tokens of signatures (rows x COORDINATES): the coordinate's number above its value."""
    return sig.astype(np.int64) + (np.arange(COORDINATES, dtype=np.int64) << 32)


def _signatures(batch: pa.RecordBatch, column: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(column).to_pylist()), np.uint32).reshape(-1, COORDINATES)


def _slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    return (whole.slice(a, rows) for whole in batches for a in range(0, whole.num_rows, rows))


def hot_tokens(classes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Tokens with a large share of all postings, sorted, and about how many postings they have: at most 1 / HOT_SHARE."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, 4096):
            t, n = np.unique(tokens(_signatures(batch, 0)), return_counts=True)
            often = n >= max(HOT_LEAST, HOT_SHARE * batch.num_rows * COORDINATES)
            yield pa.RecordBatch.from_arrays([pa.array(t[often]), pa.array(n[often])], ["token", "n"])

    counted = classes.select("sig").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    rows = counted.filter(F.col("n") >= max(HOT_LEAST, HOT_SHARE * COORDINATES * classes.count())).sort("token").collect()  # at most 1 / HOT_SHARE
    return np.array([r["token"] for r in rows], np.int64), np.array([r["n"] for r in rows], np.int64)


def size_band(n: Column) -> Column:
    """Linked sets are in the same band of sizes or the next."""
    return F.floor(F.log(n) / F.lit(log(100 / PERCENT)) + F.lit(1e-9)).cast("int")


def post(classes: DataFrame) -> DataFrame:
    """token, id, place: of each class that can agree with another one, those of its PREFIX rarest tokens that others have
    too; place: the how manieth of all its tokens, from 1.

    Postings are gathered by token once, to count them, and those of shared tokens once more by class. Hot tokens are not
    gathered: each of their postings is a group of its own.
    """
    hot, known = hot_tokens(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, 2000):
            t = tokens(_signatures(batch, 1)).ravel()
            count = np.zeros(len(t), np.int64)
            if len(hot):
                at = np.minimum(np.searchsorted(hot, t), len(hot) - 1)
                count = np.where(hot[at] == t, known[at], 0)
            yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(np.repeat(np.asarray(batch.column(0)), COORDINATES)), pa.array(count)], ["token", "id", "hot"])

    every = classes.select("id", "sig").mapInArrow(run, "token long, id long, hot long")
    met = F.count(F.lit(1)).over(Window.partitionBy("token", F.when(F.col("hot") > 0, F.col("id"))))
    shared = every.withColumn("n", F.when(F.col("hot") > 0, F.col("hot")).otherwise(met)).filter("n > 1")
    mine = shared.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("mine")).filter(F.size("mine") >= MATCHES)
    # the tokens of this class only, COORDINATES less those here, are the rarest
    first = mine.select("id", (COORDINATES - F.size("mine") + 1).alias("low"), F.posexplode(F.slice("mine", F.lit(1), F.size("mine") - (COORDINATES - PREFIX))).alias("k", "p"))
    return first.select("p.token", "id", (F.col("low") + F.col("k")).alias("place"))


# --- comparing ---------------------------------------------------------------------------------------------------


def agreeing(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """pairs (a, b) whose signatures agree in at least MATCHES coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = (_signatures(batch, 2) == _signatures(batch, 3)).sum(axis=1) >= MATCHES
            yield batch.select([0, 1]).filter(pa.array(same))

    x, y = classes.select(F.col("id").alias("a"), F.col("sig").alias("sig_a")), classes.select(F.col("id").alias("b"), F.col("sig").alias("sig_b"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def sets_of(ids: DataFrame, docs: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    """id, set: the full sets of the classes named in ids, built again from the texts."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in _slices(batches, SLICE_ROWS):
            sets = [shingle_set(t, size).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([xxh3_128_digest(s) for s in sets], pa.binary()), pa.array(sets, pa.binary())], ["doc_id", "digest", "set"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    named = stash(ids.join(classes.select("id", "doc_id", "digest"), "id"), "named")
    asked = likely(texts, cells(named, "doc_id"), "doc_id").join(named.select("doc_id").distinct(), "doc_id", "left_semi")
    # a key may be there with several texts: the digest tells which of them is the class; rows may be repeated
    return asked.mapInArrow(build, "doc_id long, digest binary, set binary").join(named, ["doc_id", "digest"]).select("id", "set")


def confirmed(pairs: DataFrame, docs: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    """pairs (a, b) whose full sets have a similarity of at least PERCENT."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                u, v = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(u, v, assume_unique=True))
                keep.append(100 * both >= PERCENT * (len(u) + len(v) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    sets = stash(sets_of(ids, docs, classes, size), "sets")
    x, y = sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), sets.select(F.col("id").alias("b"), F.col("set").alias("set_b"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "set_a", "set_b").mapInArrow(compare, "a long, b long")


# --- components --------------------------------------------------------------------------------------------------


def forest(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with the same components: every node with the smallest one that its task joins it to, among FOREST_NODES nodes at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict[int, int] = {}

        def stars() -> Iterator[pa.RecordBatch]:
            nodes = list(root)
            tops = list(map(find, nodes))
            root.clear()
            for k in range(0, len(nodes), 10_000):
                out = pa.RecordBatch.from_arrays([pa.array(nodes[k : k + 10_000], pa.int64()), pa.array(tops[k : k + 10_000], pa.int64())], ["u", "v"])
                yield out.filter(pc.not_equal(out.column(0), out.column(1)))

        def find(x: int) -> int:
            top = x
            while (up := root.setdefault(top, top)) != top:
                top = up
            while root[x] != top:
                root[x], x = top, root[x]
            return top

        for batch in batches:
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                u, v = find(u), find(v)
                if u != v:
                    root[max(u, v)] = min(u, v)
            if len(root) > FOREST_NODES:  # what is handed on has the same components
                yield from stars()
        yield from stars()

    return edges.mapInArrow(run, "u long, v long")


def connect(links: DataFrame) -> DataFrame:
    """id, component of every linked id: the smallest id it reaches.

    An edge takes 16 bytes where a document takes thousands, so edges are kept in an eighth of the shuffle partitions.
    """
    spark = links.sparkSession
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8)
    edges = stash(forest(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").coalesce(parts)), "edges")
    while True:
        # a forest of stars is done: every u has one v, and no v is a u
        roles = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("top")).union(edges.select("v", F.lit(0), F.lit(1)).distinct())
        if roles.groupBy("x").agg(F.sum("up").alias("ups"), F.max("top").alias("top")).filter("ups > 1 OR (ups > 0 AND top > 0)").isEmpty():
            break
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = stash(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct().coalesce(parts), "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stash(forest(small.union(least).coalesce(parts)), "edges")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """found with more links: its components stand for the links that led to them."""
    return stash(connect(found.select(F.col("id").alias("a"), F.col("component").alias("b")).union(links)), "found")


def live_postings(postings: DataFrame, classes: DataFrame) -> DataFrame:
    """token, band, n, id, place of postings with others in the bands around, of classes with enough of them; reach: the entries
    of their list in these bands; company: the sum of reach over a class."""
    rows = stash(postings.join(classes.select("id", "n"), "id").select("token", size_band(F.col("n")).alias("band"), "n", "id", "place"), "postings")
    sizes = rows.groupBy("token", "band").agg(F.count(F.lit(1)).alias("length"))
    near = sizes.select("token", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"), "length").groupBy("token", "band").agg(F.sum("length").alias("reach"))
    mine = Window.partitionBy("id")
    live = rows.join(near.filter("reach > 1"), ["token", "band"]).withColumns({"company": F.sum("reach").over(mine), "held": F.count(F.lit(1)).over(mine)})
    return stash(live.filter(F.col("held") >= LEAST).select("token", "band", "n", "id", "place", "company"), "live")


def compatible(a: str, b: str) -> Column:
    """Sizes a and b of sets that may be similar enough."""
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def head_pairs(live: DataFrame) -> DataFrame:
    """Each class with the list head it shares most tokens with.

    A list's head is its member with the most company over all its lists: the original of a group of edited copies is
    closer to each of them than they are to each other.
    """
    heads = live.groupBy("token", "band").agg(F.max(F.struct("company", "id", "n")).alias("head"))
    around = heads.select("token", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"), "head")
    met = live.join(around, ["token", "band"]).filter((F.col("id") != F.col("head.id")) & compatible("n", "head.n"))
    shared = met.groupBy("id", F.col("head.id").alias("head")).agg(F.count(F.lit(1)).alias("shared")).filter(F.col("shared") >= LEAST)
    best = shared.groupBy("id").agg(F.max(F.struct("shared", "head")).alias("best"))
    return best.select(F.least("id", "best.head").alias("a"), F.greatest("id", "best.head").alias("b")).distinct()


def by_family(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """rows joined with the one row of facts on their family, SALTS tasks to a family."""
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    return salted.join(facts.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["family", "__salt"]).drop("__salt")


def large_families(agreed: DataFrame, found: DataFrame, classes: DataFrame) -> DataFrame:
    """id, family, n, component of the members of families of over FAMILY classes."""
    families = stash(connect(agreed), "families").withColumnRenamed("component", "family")
    large = families.groupBy("family").agg(F.count(F.lit(1)).alias("members")).filter(F.col("members") > FAMILY).select("family")
    named = by_family(families, large).join(found, "id", "left").join(classes.select("id", "n"), "id")
    return stash(named.select("id", "family", "n", F.coalesce("component", "id").alias("component")), "family")


def outsiders(members: DataFrame) -> DataFrame:
    """id, family of the members outside their family's largest component."""
    main = members.groupBy("family", "component").agg(F.count(F.lit(1)).alias("k")).groupBy("family").agg(F.max(F.struct("k", "component")).alias("main"))
    return by_family(members, main).filter(F.col("component") != F.col("main.component")).select("id", "family")


def in_slots(rows: DataFrame) -> DataFrame:
    """rows in the slot of their band and the next: all tokens shared by sets of bands at most one apart meet in one slot."""
    return rows.withColumn("slot", F.explode(F.array(F.col("band"), F.col("band") + 1)))


def strangers(live: DataFrame, members: DataFrame) -> DataFrame:
    """id, family of classes that share enough tokens with a large family that they are not in. A family is one row in a list."""
    own = members.select("id", F.col("family").alias("own"))
    lists = in_slots(live.join(members.select("id", "family"), "id")).groupBy("token", "slot", "family").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    met = in_slots(live.join(own, "id", "left")).join(lists, ["token", "slot"])
    near = met.filter((F.col("own").isNull() | (F.col("own") != F.col("family"))) & (100 * F.col("n") >= PERCENT * F.col("low")) & (100 * F.col("high") >= PERCENT * F.col("n")))
    return near.groupBy("id", "family", "slot").agg(F.count(F.lit(1)).alias("shared")).filter(F.col("shared") >= LEAST).select("id", "family").distinct()


def family_links(asked: DataFrame, members: DataFrame, found: DataFrame, docs: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    """Links between classes and the families they are asked to be compared with (id, family), on the full sets.

    A block of the ones meets a block of the others at a time, so that no pair is ever a row, and blocks hold about BLOCK shingles.
    One link for each pair of a class and a component is enough.
    """
    targets = by_family(members, asked.select("family").distinct())
    ones = asked.join(classes.select("id", "n"), "id").join(found, "id", "left").select("id", "family", "n", F.coalesce("component", "id").alias("component"))
    facts = targets.groupBy("family").agg(F.ceil(F.sum("n") / BLOCK).alias("blocks")).join(ones.groupBy("family").agg(F.ceil(F.sum("n") / (BLOCK // 4)).alias("parts")), "family")
    sets = stash(sets_of(targets.select("id").union(ones.select("id")).distinct(), docs, classes, size), "sets")
    lists = lambda k: [F.collect_list(c).alias(f"{c}s_{k}") for c in ("id", "component", "set")]
    others = by_family(targets, facts).join(sets, "id").groupBy("family", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block")).agg(*lists("y"))
    parts = by_family(ones, facts).join(sets, "id").groupBy("family", "blocks", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part")).agg(*lists("x"))
    met = parts.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).join(others, ["family", "block"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for xs, cx, sx, ys, cy, sy in zip(*[batch.column(k) for k in range(6)], strict=True):
                xs, cx, ys, cy = (np.array(v.as_py(), np.int64) for v in (xs, cx, ys, cy))
                sets = [np.frombuffer(v.as_buffer(), np.uint64) for v in sy.values]
                n = np.array([len(v) for v in sets])
                owner, every = np.repeat(np.arange(len(sets)), n), np.concatenate(sets)
                order = np.argsort(every, kind="stable")
                every, owner = every[order], owner[order]
                for x, c, u in zip(xs.tolist(), cx.tolist(), sx.values, strict=True):
                    u = np.frombuffer(u.as_buffer(), np.uint64)
                    lo, hi = np.searchsorted(every, u, "left"), np.searchsorted(every, u, "right")
                    hit = np.repeat(lo - np.concatenate([[0], np.cumsum(hi - lo)[:-1]]), hi - lo) + np.arange(int((hi - lo).sum()))
                    both = np.bincount(owner[hit], minlength=len(sets))
                    good = np.flatnonzero((100 * both >= PERCENT * (len(u) + n - both)) & (cy != c))
                    for k in good[np.unique(cy[good], return_index=True)[1]].tolist():
                        a.append(min(x, int(ys[k])))
                        b.append(max(x, int(ys[k])))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return met.select("ids_x", "components_x", "sets_x", "ids_y", "components_y", "sets_y").mapInArrow(compare, "a long, b long").distinct()


def open_lists(live: DataFrame, found: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Postings of classes in no large family, of lists that hold several components: short lists, and long ones up to where they can matter."""
    rows = live.join(members.select("id"), "id", "left_anti").join(found, "id", "left").select("token", "band", "id", "n", "place", F.coalesce("component", "id").alias("group"))
    # lists that hold a single component have no pair to offer
    near = in_slots(rows)
    mixed = near.groupBy("token", "slot").agg(F.min("group").alias("low"), F.max("group").alias("high"), F.count(F.lit(1)).alias("length")).filter("low <> high").select("token", "slot", "length")
    there = stash(near.join(mixed, ["token", "slot"]), "open")
    short = there.filter(F.col("length") <= LONG)
    # a pair with s < LEAST tokens in short lists shares one in a long list among the first COORDINATES - MATCHES + s + 1 of both
    few = short.groupBy("id").agg(F.count(F.lit(1)).alias("s"))
    long = there.filter(F.col("length") > LONG).join(few, "id", "left").filter(F.col("place") <= COORDINATES - MATCHES + 1 + F.least(F.lit(LEAST - 1), F.coalesce("s", F.lit(0))))
    return short, long.drop("s")


def short_pairs(short: DataFrame, checked: DataFrame) -> DataFrame:
    """Pairs of classes that share enough tokens in short lists, less those checked: at most LONG rows for a posting."""
    x, y = (short.select("token", "slot", *[F.col(c).alias(c + k) for c in ("band", "id", "n", "group")]) for k in "xy")
    # both of one band meet in two slots: they count in the slot of their own number only
    met = x.join(y, ["token", "slot"]).filter((F.col("idx") < F.col("idy")) & (F.col("groupx") != F.col("groupy")) & ((F.col("bandx") != F.col("bandy")) | (F.col("slot") == F.col("bandx"))) & compatible("nx", "ny"))
    pairs = met.groupBy(F.col("idx").alias("a"), F.col("idy").alias("b")).count().filter(F.col("count") >= LEAST).select("a", "b")
    return pairs.join(checked, ["a", "b"], "left_anti")


def codes(classes: DataFrame) -> DataFrame:
    """id, code: a byte for each coordinate of the signature, equal where the coordinates are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            short = ((_signatures(batch, 1) * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in short], pa.binary())], ["id", "code"])

    return classes.select("id", "sig").mapInArrow(run, "id long, code binary")


def agreeing_in_lists(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """id, family, n, component: the classes whose signature agrees, as their codes do, with one of another component in a list
    (family); a row for each class and list at most. A block of a list meets a block at a time."""
    rows = stash(rows.withColumn("family", F.xxhash64("token", "slot")).drop("token", "slot", "place", "length", "band"), "long")
    lists = stash(rows.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / LIST_BLOCK).alias("blocks")), "lists")
    coded = stash(codes(likely(classes, cells(rows.select("id").distinct(), "id"), "id")), "codes")
    dealt = rows.join(lists, "family").join(coded, "id").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    gathered = stash(dealt.groupBy("family", "blocks", "block").agg(*[F.collect_list(c).alias(c) for c in ("id", "n", "group", "code")]), "blocks")
    ones = gathered.withColumn("other", F.explode(F.sequence("block", F.col("blocks") - 1)))
    others = gathered.select("family", F.col("block").alias("other"), *[F.col(c).alias(c + "y") for c in ("id", "n", "group", "code")])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                side = [[batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in range(at, at + 3)] + [np.frombuffer(b"".join(batch.column(at + 3)[k].values.to_pylist()), np.uint8).reshape(-1, COORDINATES).T.copy()] for at in (1, 5)]
                (ix, nx, gx, cx), (iy, ny, gy, cy) = side
                hit = np.zeros(len(ix), bool), np.zeros(len(iy), bool)
                for a in range(0, len(ix), 256):
                    same = np.zeros((len(ix[a : a + 256]), len(iy)), np.uint8)
                    for u, v in zip(cx[:, a : a + 256], cy, strict=True):
                        same += u[:, None] == v[None, :]
                    p, q = np.nonzero(same >= MATCHES)
                    p += a
                    good = (gx[p] != gy[q]) & (100 * np.minimum(nx[p], ny[q]) >= PERCENT * np.maximum(nx[p], ny[q]))
                    hit[0][p[good]], hit[1][q[good]] = True, True
                out = [np.concatenate([v[h] for v, h in zip(pair, hit, strict=True)]) for pair in ((ix, iy), (nx, ny), (gx, gy))]
                yield pa.RecordBatch.from_arrays([pa.array(out[0]), pa.array([batch.column(0)[k].as_py()] * len(out[0]), pa.int64()), pa.array(out[1]), pa.array(out[2])], ["id", "family", "n", "component"])

    met = ones.join(others, ["family", "other"]).select("family", "id", "n", "group", "code", "idy", "ny", "groupy", "codey")
    return met.mapInArrow(compare, "id long, family long, n long, component long").distinct()


def components(docs: DataFrame, size: int) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    return judged(docs, size).drop("digest")


def judged(docs: DataFrame, size: int) -> DataFrame:
    """One row per document: doc_id, n_shingles, digest of the set, component_id, kept."""
    with small_batches(docs.sparkSession):
        return _judged(docs, size)


def _judged(docs: DataFrame, size: int) -> DataFrame:
    rows = stash(sign(docs, size), "signed")
    grouped = rows.filter("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"))
    classes = stash(grouped.filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("id"), "*"), "classes")
    # a key that names several classes cannot stand for one of them: then classes are numbered
    several = not classes.groupBy("doc_id").count().filter("count > 1").isEmpty()
    if several:
        classes = stash(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    live = live_postings(post(classes), classes)
    alive = live.select("id").distinct()
    signed = stash(likely(classes, cells(alive, "id"), "id").join(alive, "id", "left_semi"), "alive")
    first = stash(head_pairs(live), "pairs")
    agreed = stash(agreeing(first, signed), "pairs")
    found = stash(connect(stash(confirmed(agreed, docs, signed, size), "links")), "found")
    members = large_families(agreed, found, signed)
    asked = stash(outsiders(members).union(strangers(live, members)), "asked")
    inside = stash(family_links(asked, members, found, docs, signed, size), "links")
    short, long = open_lists(live, found, members)
    rest = stash(agreeing(stash(short_pairs(short, first), "pairs"), signed), "pairs")
    close = stash(agreeing_in_lists(long, signed), "close")
    among = family_links(close.select("id", "family"), close, found, docs, signed, size)
    more = stash(inside.union(confirmed(rest, docs, signed, size)).union(among), "links")
    if not more.isEmpty():
        found = joined(found, more)
    named = classes.select("digest", "id", "doc_id").join(found, "id", "left").select("digest", "doc_id", F.coalesce("component", "id").alias("component"))
    if several:
        first = named.groupBy("component").agg(F.min(F.struct("doc_id", "digest")).alias("first"))
        named = named.join(first, "component").select("digest", F.col("first.doc_id").alias("component"), (F.col("digest") == F.col("first.digest")).alias("stays"))
    else:
        named = named.select("digest", "component", F.lit(True).alias("stays"))
    worded = F.col("n_shingles") > 0
    whole = rows.select("doc_id", "n_shingles", "digest").join(named, "digest", "left").select("doc_id", "n_shingles", "digest", F.when(worded, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"), (~worded | F.col("stays")).alias("stays"))
    return whole.withColumn("kept", F.coalesce((F.col("doc_id") == F.col("component_id")) & F.col("stays"), F.lit(True))).drop("stays")


def drop_near_duplicates(docs: DataFrame, size: int = 5) -> DataFrame:
    """The rows of docs that stay, one of each component, with all their columns."""
    gone = stash(judged(docs, size).filter("NOT kept").select(F.col("doc_id").alias("__gone"), F.col("digest").alias("__digest")).distinct(), "gone")

    @F.pandas_udf("binary")
    def digest(texts: pd.Series) -> pd.Series:
        from xxhash import xxh3_128_digest

        return pd.Series([xxh3_128_digest(shingle_set(t, size).tobytes()) for t in texts], dtype=object)

    keyed = docs.withColumn("__gone", F.col("doc_id").cast("long"))
    presence = cells(gone, "__gone")
    # most rows are known to stay without a shuffle; the others are looked up by key and set, as a key may have several texts
    stay, asked = likely(keyed, presence, "__gone", there=False), likely(keyed, presence, "__gone").withColumn("__digest", digest(F.col("text").cast("string")))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return stay.select(*columns).unionByName(asked.join(gone, ["__gone", "__digest"], "left_anti").select(*columns))


def op9_minhash(spark, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents"), 2).select("doc_id", "n_shingles", "component_id", "kept")


QUERIES = {"op9_minhash": op9_minhash}
#: Shingle sets, every pair of sets of fitting sizes, and components by recursion.
ORACLES = {
    "op9_minhash": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS shingle FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), t AS (SELECT doc_id, shingle, n FROM s JOIN n USING (doc_id)
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n + b.n) AS sizes, count(*) AS shared FROM t a JOIN t b
  ON a.shingle = b.shingle AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= {PERCENT} * greatest(a.n, b.n) GROUP BY ALL
), l AS (SELECT x, y FROM p WHERE 100 * shared >= {PERCENT} * (sizes - shared)
), e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l
), r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.y FROM r JOIN e ON e.x = r.b
), c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""
}
