"""Licence scan: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Two kinds of templates are compared: whole licence texts (`license_texts`, and the variants made of them) and the
phrases, titles, header sentences and SPDX tags by which files name a licence. Term frequencies are weighted by inverse
document frequency over the templates (a term that no template has weighs as much as the rarest); the best template at
or above `MIN_COSINE` wins. A phrase with a number, such as a version, is only found in a text with that number, so a
licence named without its version, or with another, is not taken for one that has it.

Licence texts are looked for first: in the file as a whole, and in each paragraph with a cue word, joined with the
paragraphs around it for as long as that brings it closer to a licence text. Without one that is at least `TEXT_COSINE` close, the
phrases are looked for in every paragraph and line with a cue word, as a whole and by sentences, and the closest of all
counts; wrapped lines and comment signs make no difference. A file named like a licence file (LICENSE, COPYING, ...) licenses its directory. A file without a licence
of its own inherits that of the nearest directory above it, found by joins of directory paths; directories, not files,
are joined, so a crowded directory costs one row. A licence file with text that is not recognised gives no licence, but
ends the search above it: what it covers is not under a licence from further up.

Edge cases: a null or empty text has no licence of its own and may inherit one, and does not end a search; nor does an
unrecognised NOTICE; a null path has no directory; whole texts are read; of equal scores the first template by name
wins, of several licence files in a directory a recognised one, then the best score, then the first name; repeated rows
are answered alike; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import pkgutil
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash, table

GNU = {"GPL": "gnu general public license", "LGPL": "gnu lesser general public license", "AGPL": "gnu affero general public license"}
GNU_VERSIONS = [("GPL", "1.0"), ("GPL", "2.0"), ("GPL", "3.0"), ("LGPL", "2.1"), ("LGPL", "3.0"), ("AGPL", "3.0")]
CC_KINDS = {"BY": "attribution", "BY-SA": "attribution sharealike", "BY-NC": "attribution noncommercial", "BY-ND": "attribution noderivatives", "BY-NC-SA": "attribution noncommercial sharealike", "BY-NC-ND": "attribution noncommercial noderivatives"}

#: Short forms in which the licences are usually named in file headers.
TEMPLATES = {
    "Apache-2.0": ("licensed under the apache license version 2.0", "you may not use this file except in compliance with the license", "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license", "apache license version 2.0", "apache license version 2.0 january 2004"),
    "MIT": ("released under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software", "licensed under the mit license", "the mit license", "use of this source code is governed by the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    "ISC": ("released under the isc license", "licensed under the isc license", "the isc license", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    "GPL-3.0": ("this work is licensed under the gnu general public license version 3",),
    "BSD-2-Clause": ("licensed under the bsd 2 clause license", "the bsd 2 clause license"),
    "BSD-3-Clause": ("redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "licensed under the bsd 3 clause license", "the bsd 3 clause license"),
    "MPL-2.0": ("this source code form is subject to the terms of the mozilla public license v 2.0", "licensed under the mozilla public license version 2.0", "mozilla public license version 2.0"),
    "BSL-1.0": ("distributed under the boost software license version 1.0", "boost software license version 1.0"),
    "Unlicense": ("this is free and unencumbered software released into the public domain",),
    "Proprietary": ("all rights reserved", "confidential and proprietary unauthorized copying of this file is prohibited"),
}
#: Names under which an SPDX tag may give each licence, without -only, -or-later and +.
SPDX = ["0BSD", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "BSL-1.0", "CC0-1.0", "ISC", "MIT", "MIT-0", "MPL-1.1", "MPL-2.0", "Unlicense", "Zlib", "GFDL-1.2", "GFDL-1.3", "LGPL-2.0"]
TEXTS = ["Apache-2.0", "Artistic-1.0-Perl", "BSD-3-Clause", "BSL-1.0", "CC0-1.0", "GFDL-1.2", "GFDL-1.3", "GPL-1.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-1.1", "MPL-2.0", "Unlicense", "Zlib"]
MIN_COSINE = 0.75
#: From here on a licence text needs no comparison with phrases, which a text may share with its variants.
TEXT_COSINE = 0.9
CUE = re.compile(r"licen[sc]e|rights reserved|redistribut|permission is|hereby granted|permission to use|public domain|proprietary|spdx", re.I)
TERM = re.compile(r"[a-z]+|[0-9]+(?:\.[0-9]+)?")
SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[A-Z])")
#: Signs that begin a line of a comment, and those of them that every line of the comment has.
SIGN = re.compile(r"^\s*(?:/\*+|\*+/?|(//+!?|#+|--+|;+|%+|dnl\b|rem\b)|<!--|\"\"\"|''')?\s*", re.I)
LICENSE_FILE = r"(?i)^(LICEN[SC]E|COPYING|NOTICE|UNLICENSE)(\.[A-Za-z0-9]+)?$"
#: Licence files whose text, where it is not recognised, still is the licence of their directory.
DECISIVE_FILE = r"(?i)^(LICEN[SC]E|COPYING|UNLICENSE)(\.[A-Za-z0-9]+)?$"


def terms(text: str) -> Counter:
    """Terms of a text; 2.0 and 2 are the same version."""
    return Counter(w.removesuffix(".0") if w[0] <= "9" else w for w in TERM.findall(text.lower()))


def phrases() -> list[tuple[str, str]]:
    """(licence, phrase) of every short form."""
    out = [(name, t) for name, texts in TEMPLATES.items() for t in texts]
    for kind, version in GNU_VERSIONS:
        name, full = f"{kind}-{version}", f"{GNU[kind]} version {version}"
        out += [(name, t) for t in (full, f"licensed under the {full}", f"under the terms of the {full}")]
        for thing in ("program", "library") if kind == "LGPL" else ("program",):
            head = f"this {thing} is free software you can redistribute it and or modify it under the terms of the {GNU[kind]}"
            # the licence is published by the foundation, or named plainly
            out += [(name, f"{head} as published by the free software foundation {x}") for x in (f"either version {version} of the license or at your option any later version", f"version {version} of the license", f"version {version}")]
            out.append((name, f"{head} version {version}"))
        out += [(name, f"spdx license identifier {kind} {version}{x}") for x in ("", " only", " or later")]
    for kind, words in CC_KINDS.items():
        name = f"CC-{kind}-4.0"
        short = kind.replace("-", " ")
        out += [(name, t) for t in (f"licensed under cc {short} 4.0", f"licensed under a creative commons {words} 4.0 international license", f"creative commons {words} 4.0 international public license", f"spdx license identifier cc {short} 4.0")]
    out += [(name, f"spdx license identifier {name}") for name in SPDX]
    return out


def licence_texts() -> list[tuple[str, str]]:
    """(licence, text) of every whole text: the files, and licences that differ from them in a clause."""
    out = {name: pkgutil.get_data(__package__, f"license_texts/{name}.txt").decode() for name in TEXTS}
    bsd, mit, isc, gpl = out["BSD-3-Clause"], out["MIT"], out["ISC"], out["GPL-3.0"]
    third = bsd[bsd.index("3. Neither") : bsd.index("THIS SOFTWARE")]
    out["BSD-2-Clause"] = bsd.replace(third, "\n")
    out["BSD-4-Clause"] = bsd.replace("3. Neither", "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization.\n4. Neither")
    out["MIT-0"] = re.sub(r",\s+subject to.*?(?=THE SOFTWARE IS)", ".\n\n", mit, flags=re.S).replace("The MIT License (MIT)", "MIT No Attribution")
    out["0BSD"] = re.sub(r", provided that the above.*?copies\.", ".", isc, flags=re.S)
    out["AGPL-3.0"] = gpl.replace("GNU GENERAL PUBLIC LICENSE", "GNU AFFERO GENERAL PUBLIC LICENSE").replace("GNU General Public License", "GNU Affero General Public License")
    # the lesser licence is often kept with the one that it adds to
    return [*out.items(), ("LGPL-3.0", out["LGPL-3.0"] + gpl)]


class Passage:
    """Terms of a growing text, with its products with the licence texts and its length."""

    def __init__(self, own: TemplateIndex, counts: Counter) -> None:
        self.own, self.counts, self.dots, self.square = own, Counter(), np.zeros(len(own.text_names)), 0.0
        self.add(*self.with_(counts), counts)

    def with_(self, counts: Counter) -> tuple[np.ndarray, float]:
        """Products and squared length after adding counts."""
        dots, square = self.dots.copy(), self.square
        for w, n in counts.items():
            weight, old = self.own.idf.get(w, self.own.top), self.counts[w] if w in self.counts else 0
            square += weight * weight * n * (2 * old + n)
            if w in self.own.text_rows:
                dots += n * weight * self.own.text_rows[w]
        return dots, square

    def add(self, dots: np.ndarray, square: float, counts: Counter) -> None:
        self.dots, self.square = dots, square
        self.counts.update(counts)

    def cosine(self) -> tuple[float, str | None]:
        return _closest(self.dots, self.square, self.own.text_names)


def _closest(dots: np.ndarray, square: float, names: list[str]) -> tuple[float, str | None]:
    if not square:
        return 0.0, None
    scores = dots / math.sqrt(square)
    top = float(scores.max())
    return top, min(names[k] for k in np.flatnonzero(scores >= top - 1e-12))


def paragraphs(text: str) -> list[tuple[str, list[str]]]:
    """Runs of lines with words, joined without their comment signs, and the lines; a comment and the code after it are apart."""
    out: list[tuple[str, list[str]]] = []
    lines: list[str] = []
    plain: list[str] = []

    def close() -> None:
        if lines:
            out.append((" ".join(plain), list(lines)))
            lines.clear(), plain.clear()

    signed = False
    for line in text.split("\n"):
        sign = SIGN.match(line)
        body = line[sign.end() :].strip()
        if not re.search(r"\w", body):
            close()
            continue
        if signed and not sign[1]:
            close()
        signed = bool(sign[1])
        lines.append(line)
        plain.append(body)
        if body.endswith(("*/", "-->")):
            close()
    close()
    return out


class TemplateIndex:
    """TF-IDF vectors of the templates: phrases as postings by term, licence texts as rows of their weights by term."""

    def __init__(self) -> None:
        rows = [(name, terms(t)) for name, t in sorted(phrases())]
        texts = [(name, terms(t)) for name, t in sorted(licence_texts())]
        seen = Counter(w for _, c in rows + texts for w in c)
        total = len(rows) + len(texts)
        self.names, self.text_names = [name for name, _ in rows], [name for name, _ in texts]
        self.numbers = [{w for w in c if w[0] <= "9"} for _, c in rows]
        self.top = math.log(1 + total) + 1
        self.idf = {w: math.log((1 + total) / (1 + k)) + 1 for w, k in seen.items()}
        length = lambda counts: math.sqrt(sum((n * self.idf[w]) ** 2 for w, n in counts.items()))
        self.postings: dict[str, list[tuple[int, float]]] = {}
        for k, (_, counts) in enumerate(rows):
            size = length(counts)
            for w, n in counts.items():
                self.postings.setdefault(w, []).append((k, n * self.idf[w] / size))
        self.text_rows: dict[str, np.ndarray] = {}
        for k, (_, counts) in enumerate(texts):
            size = length(counts)
            for w, n in counts.items():
                self.text_rows.setdefault(w, np.zeros(len(texts)))[k] = n * self.idf[w] / size

    def best(self, text: str, whole: bool = False) -> tuple[str | None, float]:
        """The closest licence text or phrase and its cosine; None below MIN_COSINE.

        whole: also where there is no cue word, as in a licence file.
        """
        if not (whole or CUE.search(text)):
            return None, 0.0
        parts = paragraphs(text)
        found = self._text(parts)
        if found[1] < TEXT_COSINE:
            for part in sorted(self._units(parts)):
                found = self._phrase(part, found)
        return found

    def _text(self, parts: list[tuple[str, list[str]]]) -> tuple[str | None, float]:
        counts = [terms(plain) for plain, _ in parts]
        every: Counter = Counter()
        for c in counts:
            every.update(c)
        top, name = Passage(self, every).cosine()
        done = 0
        for k, (plain, _) in enumerate(parts):
            if k < done or not CUE.search(plain):
                continue
            # paragraphs join on either side, from the last passage on, while they bring a licence text closer
            grown, low, high = Passage(self, counts[k]), k, k
            score, own = grown.cosine()
            rising = True
            while rising:
                rising = False
                for at in (high + 1, low - 1):
                    if not done <= at < len(parts):
                        continue
                    dots, square = grown.with_(counts[at])
                    tried = _closest(dots, square, self.text_names)
                    if tried[0] > score + 1e-9:
                        grown.add(dots, square, counts[at])
                        (score, own), low, high, rising = tried, min(low, at), max(high, at), True
            done = high + 1
            if score > top + 1e-12 or (abs(score - top) <= 1e-12 and own and (name is None or own < name)):
                top, name = score, own
        return (name, top) if top >= MIN_COSINE else (None, 0.0)

    def _units(self, parts: list[tuple[str, list[str]]]) -> set[str]:
        """Paragraphs and lines with a cue, whole and by sentences."""
        out = set()
        for plain, lines in parts:
            if CUE.search(plain):
                for unit in (plain, *lines):
                    out |= {x for x in (unit, *SENTENCE.split(unit)) if CUE.search(x)}
        return out

    def _phrase(self, part: str, found: tuple[str | None, float]) -> tuple[str | None, float]:
        counts = terms(part)
        size = math.sqrt(sum((n * self.idf.get(w, self.top)) ** 2 for w, n in counts.items()))
        scores: dict[int, float] = {}
        for w, n in counts.items():
            for k, x in self.postings.get(w, ()):
                scores[k] = scores.get(k, 0.0) + n * self.idf[w] * x / size
        for k, s in sorted(scores.items()):
            if s >= MIN_COSINE and self.numbers[k] <= counts.keys() and (s > found[1] + 1e-12 or (abs(s - found[1]) <= 1e-12 and (found[0] is None or self.names[k] < found[0]))):
                found = (self.names[k], s)
        return found


@lru_cache(maxsize=1)
def index() -> TemplateIndex:
    return TemplateIndex()


def directory(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def score_files(files: DataFrame) -> DataFrame:
    """key, path, own_license, own_score of each file, and whether it has any text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index()
        for batch in batches:
            named = [bool(re.match(LICENSE_FILE, (p or "").rpartition("/")[2])) for p in batch.column(1).to_pylist()]
            got = [own.best(t or "", whole) for t, whole in zip(batch.column(2).to_pylist(), named, strict=True)]
            told = [bool(t and not t.isspace()) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64()), pa.array(told, pa.bool_())], ["doc_id", "path", "own_license", "own_score", "told"])

    return files.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, path string, own_license string, own_score double, told boolean")


def scan(files: DataFrame) -> DataFrame:
    """One row per file (doc_id, path, text): its own licence, or the one inherited from the nearest directory above."""
    scored = stash(score_files(files), "licences").withColumn("dir", directory(F.col("path")))
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    best = F.min(F.struct(F.col("own_license").isNull().alias("unknown"), (-F.col("own_score")).alias("order"), "path", "own_license")).alias("best")
    decides = F.when(F.col("own_license").isNotNull(), name.rlike(LICENSE_FILE)).otherwise(name.rlike(DECISIVE_FILE) & F.col("told"))
    # given is null where the directory's licence is not recognised
    given = scored.filter(decides).groupBy(F.col("dir").alias("given_by")).agg(best).select("given_by", F.col("best.own_license").alias("given"))
    dirs = scored.filter(F.col("own_license").isNull() & F.col("path").isNotNull()).select("dir").distinct()
    # a directory and its ancestors, the nearest first; the root is ""
    parts = F.split("dir", "/")
    up = dirs.select("dir", F.posexplode(F.transform(F.sequence(F.size(parts), F.lit(0)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("distance", "given_by"))
    near = up.join(given, "given_by").groupBy("dir").agg(F.min(F.struct("distance", "given_by", "given")).alias("near"))
    whole = scored.join(near, "dir", "left")
    inherited = F.col("own_license").isNull() & F.col("path").isNotNull() & F.col("near.given").isNotNull()
    return whole.select("doc_id", "path", "own_license", F.coalesce("own_license", F.when(inherited, F.col("near.given"))).alias("license"), F.when(inherited, F.col("near.given_by")).alias("inherited_from"), F.when(inherited, F.col("near.distance")).alias("distance"))


def op8_license_scan(spark, sf_dir: str) -> DataFrame:
    """Documents have no paths: a document is filed under its source and its hundred; each hundred's first is its LICENSE."""
    docs = table(spark, sf_dir, "documents")
    hundred, first = F.floor(F.col("doc_id") / 100), F.col("doc_id") % 100 == 0
    path = F.concat_ws("/", F.lit("corpus"), hundred.cast("string"), F.when(first, F.lit("LICENSE")).otherwise(F.concat(F.coalesce("source", F.lit("unknown")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))))
    return scan(docs.select("doc_id", path.alias("path"), "text"))


QUERIES = {"op8_license_scan": op8_license_scan}
ORACLES: dict[str, str] = {}
