r"""Personal data: exact base patterns, and a semi-Markov conditional random field for spans the patterns miss.

The base finds emails, IPv4 addresses, payment cards and international phone numbers by fixed patterns. The model scores
every candidate span of the whole text (one token of any length, or up to `MAX_TOKENS` tokens and MAX_SPAN_CHARS characters) by
features of the span (shape, check sums, digit counts, words before it) rather than of single tokens, and a dynamic
programme over token positions jointly chooses boundaries and types. Every candidate has a digit or the middle of an
address in it, so text far from these is outside in every segmentation and is not tokenised; the result is that of the
programme over all tokens of the text. It adds national phone numbers, obfuscated emails
and `secret` values (passwords, access tokens). Spans that overlap a base span are not added. Its weights are
trained here by conditional likelihood on sentences from a seeded generator.

Spans are in code points of the text, end exclusive, and are listed by kind in the order of KINDS, then by start.

Edge cases: a null or empty text has no spans; texts are read whole, and every pattern runs in time about linear in the
text; repeated rows are searched alike; an empty table gives an empty result; extra columns are ignored by `find` and
kept by `mask`.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

KINDS = ("email", "ip", "card", "phone", "secret")
Span = tuple[str, int, int]

# --- base ----------------------------------------------------------------------------------------------------------

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# A match can only start where a run of digits starts: later in the run the same characters follow.
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(2 * int(c) - 9 * (c > "4") for c in even)) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns by kind and start; matches that fail a check are dropped."""
    out: list[Span] = []
    if "@" in text:
        floor = 0
        for m in DOMAIN.finditer(text):
            at = m.start()
            low = max(floor, text.rfind("@", floor, at) + 1)
            start = low + len(text[low:at].rstrip(LOCAL))
            if start < at:
                out.append(("email", start, m.end()))
                floor = m.end()
    if not DIGITS.search(text):
        return out
    for m in IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m.groups()):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= len(DIGITS.findall(m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


# --- model ---------------------------------------------------------------------------------------------------------

MAX_TOKENS, MAX_SPAN_CHARS = 14, 128
#: Every candidate has a digit, or the middle of an address: `@`, or `at` before a host with a dot.
MIDDLE = r"@|\bat\b(?=[\])]? ?[\w-]+(?:\.| ?[\[(]?\bdot\b))"
TRIGGER = re.compile(f"[0-9]+|{MIDDLE}", re.A)
TOKEN = re.compile(r"\w+|[^\w\s]")
WORD = re.compile(r"\w*")
MAIL_SHAPE = re.compile(r"[\w.%+-]+ ?(?:@|[\[(]?\bat\b[\])]?) ?[\w-]+(?:(?:\.| ?[\[(]?\bdot\b[\])]? ?)[\w-]+)+", re.A)
IP_SHAPE = re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}")
PHONE_SHAPE = re.compile(r"\+?(?:[0-9]{1,3}[ .-])?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){1,4}")
NATIONAL = re.compile(r"(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}")
DATE = re.compile(r"[0-9]{4}[-./][0-9]{1,2}[-./][0-9]{1,2}|[0-9]{1,2}[-./][0-9]{1,2}[-./][0-9]{2,4}")
MIXED = re.compile(r"(?=\w*[0-9])(?=\w*[A-Za-z])\w{8,}", re.A)
HEX = re.compile(r"(?=\w*[0-9])(?=\w*[a-f])[0-9a-f]{12,}", re.A)
CUES = tuple(frozenset(x.split()) for x in ("password passwd pwd token secret apikey api_key key pin", "phone tel telephone call mobile fax cell", "card visa credit mastercard", "mail email e-mail contact write"))
N_FEATURES = 22


def features(text: str, tokens: list[tuple[int, int]], i: int, j: int, lead: list[tuple[int, int]] = []) -> list[float]:  # noqa: B006
    """What is seen of the span of tokens i to j - 1 as a whole, and of the words before it. lead: tokens before the first one."""
    a, b = tokens[i][0], tokens[j - 1][1]
    s = text[a:b]
    digits = "".join(c for c in s if "0" <= c <= "9")
    n, before = len(digits), [text[x:y].lower() for x, y in [*lead, *tokens[max(0, i - 4) : i]][-4:]]
    before_at, after_at = text[a - 1 : a], text[b : b + 1]
    letters = sum(c.isalpha() for c in s)
    mail = bool(MAIL_SHAPE.fullmatch(s))
    cue = [float(any(w in c for w in before)) for c in CUES]
    assigned = bool(before) and (before[-1] in "=:" or (len(before) > 1 and before[-1] in "\"'" and before[-2] in "=:"))
    secret = bool(MIXED.fullmatch(s))
    part = (before_at.isalnum() or after_at.isalnum() or before_at == "_" or (bool(before_at) and before_at in ".-/" and text[max(0, a - 2) : a - 1].isdigit()) or (bool(after_at) and after_at in ".-/" and text[b + 1 : b + 2].isdigit()))
    return [
        1.0, float(mail), float(mail and "@" not in s), float("@" in s and not mail), float(7 <= n <= 15), float(16 <= n <= 19 and luhn(digits)), float(16 <= n <= 19), float(bool(IP_SHAPE.fullmatch(s)) and all(int(x) < 256 for x in s.split("."))),
        float(bool(PHONE_SHAPE.fullmatch(s))), float(bool(NATIONAL.fullmatch(s))), float(bool(DATE.fullmatch(s))), float(secret), float(bool(HEX.fullmatch(s))), *cue, float(assigned and secret), float(assigned and cue[0] > 0 and secret), float(part), float(letters > 0 and n > 0 and not secret and not mail), float(letters == 0 and n == len(s)),
    ]


def candidates(text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Token ranges that may be an entity: some shape fits the whole span or it is one long mixed token."""
    out: set[tuple[int, int]] = set()
    middles = [m.start() for m in re.finditer(MIDDLE, text[tokens[0][0] : tokens[-1][1] + MAX_SPAN_CHARS], re.A)] if tokens else []
    base, at = tokens[0][0] if tokens else 0, 0
    for i, (a, e) in enumerate(tokens):
        c = text[a]
        number, word = "0" <= c <= "9" or c in "+(", c.isalnum() or c == "_"
        if word and e - a >= 8 and MIXED.fullmatch(text, a, e):
            out.add((i, i + 1))
        while at < len(middles) and middles[at] + base < a:
            at += 1
        mail = word and at < len(middles) and middles[at] + base - a <= MAX_SPAN_CHARS
        if not (number or mail):
            continue
        for j in range(i + 1, min(len(tokens), i + MAX_TOKENS) + 1):
            b = tokens[j - 1][1]
            if b - a > MAX_SPAN_CHARS:
                break
            if b - a < 7 or not (text[b - 1].isalnum() or text[b - 1] == "_"):
                continue
            if number and (PHONE_SHAPE.fullmatch(text, a, b) or IP_SHAPE.fullmatch(text, a, b) or ((s := text[a:b].replace(" ", "").replace("-", "")).isdigit() and s.isascii())):
                out.add((i, j))
            elif mail and j - i >= 5 and MAIL_SHAPE.fullmatch(text, a, b):
                out.add((i, j))
    return sorted(out)


class SemiMarkovCrf:
    """Weights by kind and feature, and by previous and next label (0: outside)."""

    def __init__(self) -> None:
        self.w = np.zeros((len(KINDS), N_FEATURES))
        self.t = np.zeros((len(KINDS) + 1, len(KINDS) + 1))

    def _ends(self, n: int, spans: list[tuple[int, int]]) -> list[list[int]]:
        ends: list[list[int]] = [[] for _ in range(n + 1)]
        for k, (_, j) in enumerate(spans):
            ends[j].append(k)
        return ends

    def best(self, n: int, spans: list[tuple[int, int]], x: np.ndarray) -> list[tuple[int, int, int]]:
        """The highest-scoring segmentation of n tokens: (first, end, kind) of its entities."""
        score, ends, labels = x @ self.w.T, self._ends(n, spans), len(KINDS) + 1
        top = np.full((n + 1, labels), -np.inf)
        top[0, 0] = 0.0
        back: list[list[tuple[int, int] | None]] = [[None] * labels for _ in range(n + 1)]
        for j in range(1, n + 1):
            v = top[j - 1] + self.t[:, 0]
            p = int(v.argmax())
            top[j, 0], back[j][0] = v[p], (j - 1, p)
            for k in ends[j]:
                i = spans[k][0]
                for y in range(1, labels):
                    v = top[i] + self.t[:, y]
                    p = int(v.argmax())
                    if (s := v[p] + score[k, y - 1]) > top[j, y]:
                        top[j, y], back[j][y] = s, (i, p)
        out, j, y = [], n, int(top[n].argmax())
        while j:
            i, p = back[j][y]
            if y:
                out.append((i, j, y - 1))
            j, y = i, p
        return out[::-1]

    def gradient(self, n: int, spans: list[tuple[int, int]], x: np.ndarray, gold: dict[tuple[int, int], int]) -> tuple[np.ndarray, np.ndarray]:
        """Observed less expected feature counts, by forward and backward sums over segmentations."""
        score, ends, labels = x @ self.w.T, self._ends(n, spans), len(KINDS) + 1
        f = np.full((n + 1, labels), -np.inf)
        f[0, 0] = 0.0
        for j in range(1, n + 1):
            f[j, 0] = np.logaddexp.reduce(f[j - 1] + self.t[:, 0])
            for k in ends[j]:
                f[j, 1:] = np.logaddexp(f[j, 1:], np.logaddexp.reduce(f[spans[k][0]][:, None] + self.t[:, 1:], axis=0) + score[k])
        b = np.full((n + 1, labels), -np.inf)
        b[n] = 0.0
        starts: list[list[int]] = [[] for _ in range(n + 1)]
        for k, (i, _) in enumerate(spans):
            starts[i].append(k)
        for i in range(n - 1, -1, -1):
            b[i] = self.t[:, 0] + b[i + 1, 0]
            for k in starts[i]:
                b[i] = np.logaddexp(b[i], np.logaddexp.reduce(self.t[:, 1:] + score[k] + b[spans[k][1], 1:], axis=1))
        z = np.logaddexp.reduce(f[n])
        gw, gt = np.zeros_like(self.w), np.zeros_like(self.t)
        for i in range(n):
            gt[:, 0] -= np.exp(f[i] + self.t[:, 0] + b[i + 1, 0] - z)
        for k, (i, j) in enumerate(spans):
            p = np.exp(f[i][:, None] + self.t[:, 1:] + score[k] + b[j, 1:] - z)
            gt[:, 1:] -= p
            gw -= np.outer(p.sum(0), x[k])
            if (y := gold.get((i, j))) is not None:
                gw[y] += x[k]
        at, last = 0, 0
        begin = {i: (j, y) for (i, j), y in gold.items()}
        while at < n:
            j, y = begin.get(at, (at + 1, -1))
            gt[last, y + 1] += 1
            at, last = j, y + 1
        return gw, gt


def _sentence(draw: random.Random) -> tuple[str, list[Span]]:
    """A generated training sentence with its entities; some sentences hold look-alikes only."""
    word = lambda: "".join(draw.choices(("th", "en", "er", "in", "on", "la", "de", "ou", "st", "re", "un"), k=draw.randrange(1, 5)))
    digits = lambda n: "".join(draw.choices("0123456789", k=n))
    hexa = lambda n: "".join(draw.choices("0123456789abcdef", k=n))

    def card() -> str:
        body = "4" + digits(14)
        return next(body + c for c in "0123456789" if luhn(body + c))

    name, host = word() + draw.choice((".", "", "_")) + word(), word() + draw.choice(("", digits(1)))
    makers = {
        "email": lambda: draw.choice((f"{name}@{host}.com", f"{name} at {host} dot com", f"{name} [at] {host} [dot] org", f"{name} (at) {host} (dot) net")),
        "ip": lambda: ".".join(str(draw.randrange(256)) for _ in range(4)),
        "card": card,
        "phone": lambda: draw.choice((f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}")),
        "secret": lambda: draw.choice((hexa(18), hexa(32), hexa(40), "".join(draw.choices("abcdefghijkmnpqrstuvwxyzABCDEFGH23456789", k=20)) + "7a")),
    }
    lead = {"email": ("", "email ", "contact "), "ip": ("", "from "), "card": ("", "card "), "phone": ("", "call ", "tel "), "secret": ("password=", 'token = "', "secret: ", "key=", "api_key = '")}
    fake = (
        lambda: f"{draw.randrange(1900, 2100)}-{draw.randrange(1, 13):02}-{draw.randrange(1, 29):02}", lambda: digits(4), lambda: digits(draw.randrange(5, 13)), lambda: f"{digits(1)}.{digits(1)}.{digits(2)}", lambda: f"${digits(3)}.{digits(2)}", lambda: f"{digits(3)},{digits(3)}",
        lambda: f"{digits(2)} {digits(3)} {digits(4)}", lambda: f"id {hexa(12)}", lambda: f"{word()}{word()}{digits(4)}", lambda: f"{word()} at {digits(2)} dot {digits(1)}", lambda: f"v{digits(1)}.{digits(1)}", lambda: f"{digits(3)}-{digits(2)}-{digits(3)}", lambda: f"commit {hexa(40)}", lambda: f"x = {digits(6)}", lambda: digits(16), lambda: f"{300 + draw.randrange(600)}.1.2.3",
    )
    text, spans = " ".join(word() for _ in range(draw.randrange(1, 5))), []
    for _ in range(draw.randrange(1, 4)):
        text += " "
        if draw.random() < 0.55:
            kind = draw.choice(KINDS)
            text += draw.choice(lead[kind])
            value = makers[kind]()
            spans.append((kind, len(text), len(text) + len(value)))
            text += value + {'"': '"', "'": "'"}.get(text[-1:], "")
        else:
            text += draw.choice(fake)()
        text += draw.choice(("", "", ",", ".")) + " " + " ".join(word() for _ in range(draw.randrange(1, 4)))
    return text, spans


TRAINING_SENTENCES, EPOCHS, TRAINING_SEED = 500, 6, 5


@lru_cache(maxsize=1)
def trained() -> SemiMarkovCrf:
    """The model, trained on TRAINING_SENTENCES generated sentences; the same on every machine."""
    draw, model, examples = random.Random(TRAINING_SEED), SemiMarkovCrf(), []
    for _ in range(TRAINING_SENTENCES):
        text, gold = _sentence(draw)
        tokens = [m.span() for m in TOKEN.finditer(text)]
        spans = candidates(text, tokens)
        by_place = {(tokens[i][0], tokens[j - 1][1]): (i, j) for i, j in spans}
        if spans and all((a, b) in by_place for _, a, b in gold):
            examples.append((len(tokens), spans, np.array([features(text, tokens, i, j) for i, j in spans]), {by_place[a, b]: KINDS.index(k) for k, a, b in gold}))
    sum_w, sum_t = np.full_like(model.w, 1e-6), np.full_like(model.t, 1e-6)
    for _ in range(EPOCHS):
        draw.shuffle(examples)
        for a in range(0, len(examples), 8):
            gw, gt = -0.002 * model.w, -0.002 * model.t
            for example in examples[a : a + 8]:
                dw, dt = model.gradient(*example)
                gw, gt = gw + dw, gt + dt
            sum_w, sum_t = sum_w + gw**2, sum_t + gt**2
            model.w += 0.5 * gw / np.sqrt(sum_w)
            model.t += 0.5 * gt / np.sqrt(sum_t)
    return model


def zones(text: str) -> Iterator[tuple[int, int]]:
    """Stretches of text, from token border to token border, that hold all candidates: what can be part of a span with a
    trigger in it. A token without end is part of its zone as a whole."""
    lo = hi = -1
    for m in TRIGGER.finditer(text):
        a = max(0, m.start() - MAX_SPAN_CHARS)
        if lo >= 0 and a > hi:
            hi = WORD.match(text, hi).end()
        if lo < 0 or a > hi:
            if lo >= 0:
                yield lo, hi
            while a > max(0, hi) and text[a - 1].isalnum() | (text[a - 1] == "_"):
                a -= 1
            lo = a
        hi = max(hi, min(len(text), m.end() + MAX_SPAN_CHARS))
    if lo >= 0:
        yield lo, WORD.match(text, hi).end()


def tokens_before(text: str, at: int, most: int = 4) -> list[tuple[int, int]]:
    """The last tokens before a token border."""
    out: list[tuple[int, int]] = []
    while at and len(out) < most:
        end = at
        while at and (text[at - 1].isalnum() or text[at - 1] == "_"):
            at -= 1
        if at == end:
            at -= 1
            if text[at].isspace():
                continue
        out.append((at, end))
    return out[::-1]


def model_spans(text: str, model: SemiMarkovCrf) -> list[Span]:
    """Entities that the model finds in the whole text.

    A token that no candidate holds is outside an entity in every segmentation, so the best one is found for each stretch
    of candidates that overlap or touch, with the token behind it, where there is one.
    """
    out: list[Span] = []
    for a, b in zones(text):
        tokens = [m.span() for m in TOKEN.finditer(text, a, b)]
        spans = candidates(text, tokens)
        lead, k = tokens_before(text, a) if spans else [], 0
        while k < len(spans):
            first, end, last = spans[k][0], spans[k][1], k
            while last < len(spans) and spans[last][0] <= end:
                end, last = max(end, spans[last][1]), last + 1
            x = np.array([features(text, tokens, i, j, lead) for i, j in spans[k:last]])
            behind = end < len(tokens) or bool(TOKEN.search(text, b))
            for i, j, y in model.best(end - first + behind, [(i - first, j - first) for i, j in spans[k:last]], x):
                out.append((KINDS[y], tokens[i + first][0], tokens[j + first - 1][1]))
            k = last
    return out


def all_spans(text: str | None, model: SemiMarkovCrf) -> tuple[list[Span], list[Span]]:
    """Base spans, and these with the model's, both by kind as listed and start."""
    if not text:
        return [], []
    base = base_spans(text)
    taken = sorted((s, e) for _, s, e in base)
    starts = [s for s, _ in taken]
    reach = np.maximum.accumulate([e for _, e in taken]) if taken else []
    more, last = [], -1
    for k, s, e in model_spans(text, model):
        p = int(np.searchsorted(starts, e)) if taken else 0
        if (not p or reach[p - 1] <= s) and s >= last:
            more.append((k, s, e))
            last = e
    return base, sorted([*base, *more], key=lambda x: (KINDS.index(x[0]), x[1]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find(docs: DataFrame) -> DataFrame:
    """One row per document: base counts and digest, and all spans."""
    model = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                base, every = all_spans(text, model)
                counts = [sum(k == kind for k, _, _ in base) for kind in KINDS[:4]]
                rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in columns[:4]], *[pa.array(c, pa.string()) for c in columns[4:]]], [x.split()[0] for x in FOUND.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, FOUND)


def masked(text: str, spans: list[Span]) -> str:
    """text with every span replaced by its kind in angle brackets; overlapping spans become one."""
    out, at = [], 0
    for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"<{k.upper()}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the personal data in column text replaced."""
    model = trained()

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([x if pd.isna(x) else masked(x, all_spans(x, model)[1]) for x in batch], dtype=object)

    return docs.withColumn(text, run(F.col(text).cast("string")))


def op4_pii(spark, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))


QUERIES = {"op4_pii": op4_pii}
ORACLES: dict[str, str] = {}
