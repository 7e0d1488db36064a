r"""Quality rules by distribution divergence.

The base rules count words, symbols, repeated lines and repeated 8-word windows. A document that passes them is compared
with the reference of its language: the Jensen-Shannon distance (square root of the divergence, base 2) between the
document's and the reference's histograms of character classes, and of the language's most common words (all others
form one more bin). A histogram is judged only from a minimum length on, as short texts scatter.

A document in a language without a reference is compared with all references and the closest counts; when more than
half of its characters lie outside ASCII no reference applies to it and the divergence rules let it pass.

Everything is computed row by row from arrays inside the JVM: no shuffle, no Python. Words and windows are
compared by 64-bit hashes.

Edge cases: a null text has no words and fails the base rules; empty and very long texts are read whole; repeated rows are judged
alike; an empty table gives an empty result; extra columns are ignored by `judge_quality` and kept by `keep_good`.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, table

#: WINDOW is a power of two.
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30
SYMBOLS = "#*$%&|<>"
#: Lengths from which the histograms are judged, and the largest distances that pass.
MIN_CHARS, MIN_HISTOGRAM_WORDS = 200, 100
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.35, 0.30

#: Character classes (all but the last are ASCII); the last bin, `other`, is the rest.
CLASSES = {"lower": "a-z", "upper": "A-Z", "digit": "0-9", "space": SPACE_CLASS, "punct": r"""!"'(),\-./:;?""", "symbol": r"#$%&*+<=>@\[\\\]^_`{|}~"}


@dataclass(frozen=True)
class Reference:
    """Shares of the character classes in the order of CLASSES (the rest is `other`), and of common words among all words."""

    classes: tuple[float, ...]
    words: Mapping[str, float]


#: Shares measured on labelled good documents with `measure_reference`, rounded.
REFERENCES = {
    "en": Reference((0.794, 0.0135, 0.001, 0.167, 0.0237, 0.0), {"the": 0.059, "of": 0.034, "and": 0.025, "to": 0.019, "a": 0.015, "in": 0.013, "is": 0.011, "that": 0.010, "it": 0.009, "for": 0.008, "was": 0.007, "on": 0.007, "with": 0.006, "as": 0.006, "by": 0.005, "be": 0.005}),
    "fr": Reference((0.706, 0.0104, 0.001, 0.167, 0.0239, 0.0), {"de": 0.058, "la": 0.035, "le": 0.024, "et": 0.019, "les": 0.015, "des": 0.013, "en": 0.012, "un": 0.010, "du": 0.009, "une": 0.008, "que": 0.007, "pour": 0.007, "est": 0.007, "dans": 0.006, "qui": 0.005, "par": 0.005}),
    "de": Reference((0.772, 0.0121, 0.001, 0.155, 0.0217, 0.0), {"der": 0.058, "die": 0.034, "und": 0.025, "in": 0.019, "den": 0.015, "von": 0.013, "zu": 0.010, "das": 0.010, "mit": 0.009, "sich": 0.008, "des": 0.008, "auf": 0.007, "für": 0.006, "ist": 0.006, "im": 0.005, "dem": 0.005}),
    "es": Reference((0.724, 0.0120, 0.001, 0.162, 0.0231, 0.0), {"de": 0.058, "la": 0.034, "que": 0.024, "el": 0.019, "en": 0.015, "y": 0.013, "los": 0.011, "se": 0.010, "las": 0.009, "del": 0.009, "un": 0.008, "por": 0.007, "con": 0.006, "no": 0.006, "una": 0.005, "su": 0.005}),
}


def divergence(shares: Column, reference: list[float]) -> Column:
    """Jensen-Shannon distance of two histograms, one an array column; each adds up to 1."""

    def term(p: Column, q: Column) -> Column:
        part = lambda x: F.when(x > 0, x * F.log2(2 * x / (p + q))).otherwise(F.lit(0.0))
        return part(p) + part(q)

    terms = F.zip_with(shares, F.array(*[F.lit(float(q)) for q in reference]), term)
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0)))


def class_reference(r: Reference) -> list[float]:
    return [*r.classes, 1.0 - sum(r.classes)]


def word_reference(r: Reference) -> list[float]:
    return [*r.words.values(), 1.0 - sum(r.words.values())]


def _count(chars: str, text: Column) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, f"[{chars}]+", ""))


def count_base(docs: DataFrame) -> DataFrame:
    """docs (__text, ...) with the words and the base counts.

    Each step is a projection of its own: values that a later lambda mentions must be computed once per row, not once
    per element.
    """
    text = F.col("__text")
    df = docs.withColumns({"__words": F.array_remove(F.split(text, f"[{SPACE_CLASS}]+"), ""), "__chars": F.length(text), "__no_lower": F.regexp_replace(text, f"[{CLASSES['lower']}]+", "")})
    # what is neither a lower-case letter nor white space: little text, in which the other classes are counted
    df = df.withColumn("__rest", F.regexp_replace("__no_lower", f"[{SPACE_CLASS}]+", ""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE_CLASS}]"))
    df = df.withColumns({
        "__lines": F.when(text.contains("\n"), lines).otherwise(F.array().cast("array<string>")),
        "__hashes": F.transform("__words", lambda w: F.xxhash64(w)),
        "n_words": F.size("__words").cast("long"),
        "word_chars": (F.col("__chars") - F.length("__no_lower") + F.length("__rest")).cast("long"),
        "n_symbols": _count(SYMBOLS, F.col("__rest")).cast("long"),
    })
    # hashes of two, four and eight words, each from two of half the length. A window that comes again brings with it seven
    # pairs and five fours that came before; where fewer did, longer hashes are not needed.
    df = df.withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
    for name, half, length in (("__pairs", "__hashes", 2), ("__fours", "__pairs", 4), ("__grams", "__fours", 8)):
        many = F.size(half) - length // 2
        longer = F.zip_with(F.slice(half, F.lit(1), many), F.slice(half, F.lit(length // 2 + 1), many), lambda a, b: F.xxhash64(a, b))
        again = F.size(half) - F.size(F.array_distinct(half))
        df = df.withColumn(name, F.when(again > WINDOW - length // 2, longer))
    order = F.sort_array(F.transform("__grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    df = df.withColumn("__order", F.when(F.size(F.array_distinct("__grams")) < F.size("__grams"), order))
    same = lambda x, k: F.coalesce(F.get(F.col("__order"), k)["g"] == x["g"], F.lit(False))
    df = df.withColumn("__found", F.sort_array(F.transform(F.filter("__order", lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"])))
    covered = F.transform("__found", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("__found"), k + 1) - p, F.lit(WINDOW))))
    df = df.withColumn("n_repeat_words", F.coalesce(F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long")))
    return df.drop("__lines", "__pairs", "__fours", "__grams", "__order", "__found")


def count_histograms(df: DataFrame, references: Mapping[str, Reference]) -> DataFrame:
    """df with the counts of the character classes and, by language, of the common words."""
    within = {"lower": F.col("__chars") - F.length("__no_lower"), "space": F.col("__chars") - F.col("word_chars")}
    df = df.withColumns({f"__c_{name}": within[name] if name in within else _count(chars, F.col("__rest")) for name, chars in CLASSES.items()})
    every = sorted({w for r in references.values() for w in r.words})
    df = df.withColumn("__common", F.filter("__hashes", lambda h: h.isin([F.xxhash64(F.lit(w)) for w in every])))
    for lang, r in references.items():
        asked = (F.col("__lang") == lang) | F.col("__any_lang")
        counts = F.array(*[F.size("__common") - F.size(F.array_remove("__common", F.xxhash64(F.lit(k)))) for k in r.words])
        df = df.withColumn(f"__w_{lang}", F.when(asked, counts))
    return df


def judge_rows(docs: DataFrame, references: Mapping[str, Reference]) -> DataFrame:
    """docs (with __text and __lang) with base counts, distances, base_failed and kept."""
    df = count_base(docs.withColumn("__any_lang", F.coalesce(~F.col("__lang").isin(list(references)), F.lit(True))))
    df = df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    df = count_histograms(df, references)
    chars = F.greatest(F.col("__chars"), F.lit(1)).cast("double")
    shares = F.array(*[F.col(f"__c_{name}") / chars for name in CLASSES])
    df = df.withColumn("__shares", _with_rest(shares))
    by_class, by_word = [], []
    for lang, r in references.items():
        asked = (F.col("__lang") == lang) | F.col("__any_lang")
        by_class.append(F.when(asked, divergence(F.col("__shares"), class_reference(r))))
        bins = F.transform(f"__w_{lang}", lambda n: n / F.greatest(F.col("n_words"), F.lit(1)))
        by_word.append(F.when(asked, divergence(_with_rest(bins), word_reference(r))))
    df = df.withColumns({"class_distance": F.least(*by_class), "word_distance": F.least(*by_word)})
    foreign = F.col("__any_lang") & (F.get("__shares", F.lit(len(CLASSES))) > 0.5)
    far = ((F.col("__chars") >= MIN_CHARS) & (F.col("class_distance") > MAX_CLASS_DISTANCE)) | ((F.col("n_words") >= MIN_HISTOGRAM_WORDS) & (F.col("word_distance") > MAX_WORD_DISTANCE))
    return df.withColumn("kept", ~F.col("base_failed") & (foreign | ~far))


def _with_rest(shares: Column) -> Column:
    """shares and, as a last bin, what is missing to 1."""
    return F.concat(shares, F.array(F.greatest(F.aggregate(shares, F.lit(1.0), lambda a, x: a - x), F.lit(0.0))))


VERDICT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def judge_quality(docs: DataFrame, references: Mapping[str, Reference] = REFERENCES) -> DataFrame:
    """One row per document: doc_id, the base counts, base_failed, kept and both distances."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text"), F.col("lang").cast("string").alias("__lang"))
    return judge_rows(rows, references).select("doc_id", *VERDICT, "class_distance", "word_distance")


def keep_good(docs: DataFrame, references: Mapping[str, Reference] = REFERENCES) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns."""
    rows = docs.withColumns({"__text": F.coalesce(F.col("text").cast("string"), F.lit("")), "__lang": F.col("lang").cast("string"), "__row": F.struct(*[F.col(f"`{c}`") for c in docs.columns])}).select("__text", "__lang", "__row")
    # a filter would be pushed below the projections and expand them again and again; a generator is not
    judged = judge_rows(rows, references)
    return judged.select(F.explode(F.when(F.col("kept"), F.array("__row")).otherwise(F.slice(F.array("__row"), 1, 0))).alias("__row")).select(*[F.col("__row").getField(c).alias(c) for c in docs.columns])


def measure_reference(docs: DataFrame, words: Mapping[str, tuple[str, ...]]) -> DataFrame:
    """Mean shares by language (columns of docs: text, lang) from which references are written down."""
    blank = {lang: Reference((0.0,) * len(CLASSES), dict.fromkeys(w, 0.0)) for lang, w in words.items()}
    rows = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("__text"), F.col("lang").alias("__lang"), F.lit(False).alias("__any_lang"))
    df = count_histograms(count_base(rows), blank)
    shares = [(F.sum(f"__c_{c}") / F.sum("__chars")).alias(c) for c in CLASSES]
    counts = [F.array(*[F.sum(F.get(F.col(f"__w_{lang}"), F.lit(k))) / F.sum("n_words") for k in range(len(w))]).alias(f"words_{lang}") for lang, w in words.items()]
    return df.groupBy(F.col("__lang").alias("lang")).agg(*shares, *counts)


def op3_quality(spark, sf_dir: str) -> DataFrame:
    return judge_quality(table(spark, sf_dir, "documents")).select("doc_id", *VERDICT)


def oracle(references: Mapping[str, Reference] = REFERENCES) -> str:
    """The same in SQL, with windows compared as texts."""
    space = r"[\x20\x09-\x0D]"

    def js(shares: list[str], reference: list[float]) -> str:
        terms = [f"CASE WHEN {p} > 0 THEN {p} * log2(2 * {p} / ({p} + {q!r})) ELSE 0 END" + (f" + {q!r} * log2(2 * {q!r} / ({p} + {q!r}))" if q > 0 else "") for p, q in zip(shares, reference, strict=True)]
        return f"sqrt(greatest(({' + '.join(terms)}) / 2, 0))"

    names = ", ".join(f"'{x}'" for x in references)
    shares = [f"(c_{c} / chars)" for c in CLASSES]
    shares.append(f"greatest(1.0 - ({' + '.join(shares)}), 0)")
    by_class, by_word = [], []
    for lang, r in references.items():
        bins = [f"(len(list_filter(words, lambda w: w = '{w}')) / wn)" for w in r.words]
        by_class.append(f"CASE WHEN lang = '{lang}' OR any_lang THEN {js(shares, class_reference(r))} END")
        by_word.append(f"CASE WHEN lang = '{lang}' OR any_lang THEN {js([f'w_{lang}[{k + 1}]' for k in range(len(bins) + 1)], word_reference(r))} END")
    word_columns = ", ".join(f"CASE WHEN lang = '{lang}' OR any_lang THEN [{', '.join(b := [f'(len(list_filter(common, lambda w: w = {chr(39)}{w}{chr(39)})) / wn)' for w in r.words])}, greatest(1.0 - ({' + '.join(b)}), 0)] END AS w_{lang}" for lang, r in references.items())
    every = ", ".join(f"'{w}'" for w in sorted({w for r in references.values() for w in r.words}))
    counts = ", ".join(f"length(text) - length(regexp_replace(text, '[{chars.replace(chr(39), chr(39) * 2)}]', '', 'g')) AS c_{c}" for c, chars in CLASSES.items())
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, lang, coalesce(lang NOT IN ({names}), true) AS any_lang FROM documents),
s AS (SELECT *, list_filter(regexp_split_to_array(text, '{space}+'), lambda x: x <> '') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
g AS (SELECT r, unnest(range(1, len(words) - {WINDOW - 2})) AS p, words FROM s WHERE len(words) >= {WINDOW}),
t AS (SELECT r, p, array_to_string(words[p:p + {WINDOW - 1}], ' ') AS w FROM g),
f AS (SELECT r, p, count(*) OVER (PARTITION BY r, w) AS c FROM t),
n AS (SELECT r, p, lead(p) OVER (PARTITION BY r ORDER BY p) AS q FROM f WHERE c > 1),
e AS (SELECT r, sum(least({WINDOW}, coalesce(q - p, {WINDOW}))) AS n_repeat_words FROM n GROUP BY r),
b AS (SELECT s.r, doc_id, text, lang, any_lang, len(words) AS n_words, greatest(len(words), 1)::DOUBLE AS wn, greatest(length(text), 1)::DOUBLE AS chars, length(regexp_replace(text, '{space}', '', 'g')) AS word_chars,
  length(text) - length(regexp_replace(text, '[{SYMBOLS}]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
  list_filter(words, lambda w: w IN ({every})) AS common, {counts} FROM s LEFT JOIN e ON s.r = e.r),
h AS (SELECT *, {word_columns} FROM b),
j AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed, {shares[-1]} AS s_other, least({', '.join(by_class)}) AS class_distance, least({', '.join(by_word)}) AS word_distance FROM h)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND ((any_lang AND s_other > 0.5) OR NOT ((length(text) >= {MIN_CHARS} AND class_distance > {MAX_CLASS_DISTANCE}) OR (n_words >= {MIN_HISTOGRAM_WORDS} AND word_distance > {MAX_WORD_DISTANCE}))) AS kept
FROM j
"""


QUERIES = {"op3_quality": op3_quality}
ORACLES = {"op3_quality": oracle()}
