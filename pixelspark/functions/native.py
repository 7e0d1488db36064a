"""Predictor, guards, report texts and pixel projections as column expressions; none of them leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema as S


def predict_quality(target: Column) -> Column:
    """The encoder quality at which a search starts."""
    return F.least(F.greatest(F.lit(8.30) * F.exp(F.lit(0.0285) * target), F.lit(30.0)), F.lit(98.0))


def sniff(content: Column) -> Column:
    """Format by the first bytes."""
    return F.when(F.startswith(content, F.lit(b"\x89PNG")), "png").when(F.startswith(content, F.lit(b"\xff\xd8")) & (F.octet_length(content) >= 4), "jpeg").otherwise("unknown")


def extension_ok(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin("jpg", "jpeg", "png")


def guard_code(width: Column, height: Column, target: Column) -> Column:
    """Error code before any encoding of a quality job, in the order in which checks apply; 0 if none."""
    w, h = width.cast("long"), height.cast("long")
    return F.when(w * h > S.MAX_PIXELS, 8).when(target > S.SCORE_CEILING, 5).when(F.least(w, h) < S.MIN_DIM, 4).otherwise(0)


def never_grow(new: Column, old: Column) -> Column:
    return F.when(new >= old, 6).otherwise(0)


def error_name(code: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in S.ERRORS.items() for x in kv]), code)


def error_message(code: Column) -> Column:
    """What a user is told about a code."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in S.MESSAGES.items() for x in kv]), code), F.lit("unknown error"))


def hdr_note(hdr: Column) -> Column:
    return F.when(hdr == "preserved", "  hdr gain map preserved").when(hdr == "dropped", "  HDR GAIN MAP DROPPED").otherwise("")


def ratio(new: Column, old: Column) -> Column:
    """New size over old; null for an empty file."""
    return new / F.nullif(old, F.lit(0))


def score_or_null(score: Column) -> Column:
    return F.when(~F.isnan(score), score)


def megapixels(width: Column, height: Column) -> Column:
    return width.cast("double") * height.cast("double") / 1e6


def file_name(path: Column) -> Column:
    """The last part of a path."""
    return F.element_at(F.split(F.rtrim(path, F.lit("/")), "/"), -1)


def has_alpha(alphas: Column) -> Column:
    """Whether any of an array of alpha values lets the background through."""
    return F.exists(alphas, lambda a: a != 255)


def interpolated(probes: Column, target: Column) -> Column:
    """The quality between the nearest scores below and at or above the target, on a straight line; null without both.

    probes: an array of (quality, score) in the order of probing, the first of equal scores counts.
    """
    ranked = F.transform(probes, lambda p, k: F.struct(p["score"].cast("double").alias("score"), k.alias("k"), p["quality"].cast("double").alias("quality")))
    below = F.array_max(F.transform(F.filter(ranked, lambda p: p["score"] < target), lambda p: F.struct(p["score"].alias("score"), (-p["k"]).alias("k"), p["quality"].alias("quality"))))
    above = F.array_min(F.filter(ranked, lambda p: p["score"] >= target))
    return below["quality"] + (target - below["score"]) / F.nullif(above["score"] - below["score"], F.lit(0.0)) * (above["quality"] - below["quality"])


def fixed(value: Column, digits: int) -> Column:
    """Digits after the point, halves to even as in C; without thousands separators."""
    return F.replace(F.format_number(value, digits), F.lit(","), F.lit(""))


def format_bytes(n: Column) -> Column:
    """B, KB or MB in steps of 1024."""
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1048576, F.concat(fixed(n / 1024, 1), F.lit(" KB"))).otherwise(F.concat(fixed(n / 1048576, 1), F.lit(" MB")))


def detail(old: Column, new: Column, score: Column, hdr: Column, quantized: Column) -> Column:
    """One line on a finished job."""
    saved = F.round(100 - 100 * new / F.nullif(old, F.lit(0))).cast("int")
    return F.concat_ws(
        ", ", F.concat(format_bytes(old), F.lit(" to "), format_bytes(new)), F.concat(saved.cast("string"), F.lit("% smaller")), F.when(score.isNotNull(), F.concat(F.lit("score "), fixed(score, 1))),
        F.when(hdr == "preserved", "HDR kept").when(hdr == "dropped", "HDR removed"), F.when(quantized, "colours reduced"),
    )


def concurrency_limit(any_quality: Column, cores: Column, ram: Column) -> Column:
    """How many jobs may run at once."""
    by_memory = F.floor(F.lit(S.RAM_SHARE) * ram / F.lit(S.JOB_BYTES))
    return F.when(any_quality, F.greatest(F.lit(1).cast("long"), F.least(cores.cast("long"), by_memory))).otherwise(cores.cast("long"))


def composite(colour: Column, alpha: Column, background: Column) -> Column:
    """An 8-bit colour over a uniform background, rounded down."""
    return F.floor((colour * alpha + background * (255 - alpha)) / 255)


def oriented_place(x: Column, y: Column, width: Column, height: Column, orientation: Column) -> Column:
    """Where the pixel (x, y) goes under orientation 1 to 8: x, y and the new width."""
    to = {2: (width - 1 - x, y), 3: (width - 1 - x, height - 1 - y), 4: (x, height - 1 - y), 5: (y, x), 6: (height - 1 - y, x), 7: (height - 1 - y, width - 1 - x), 8: (y, width - 1 - x)}
    nx, ny, nw = x, y, F.when(orientation.between(5, 8), height).otherwise(width)
    for k, (a, b) in to.items():
        nx, ny = F.when(orientation == k, a).otherwise(nx), F.when(orientation == k, b).otherwise(ny)
    return F.struct(nx.alias("x"), ny.alias("y"), nw.alias("w"))
