"""The operators under names that SQL can call: scalar functions on content, and table functions for lateral joins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import jpeg, png, search

PREFIX = "image_"
SEGMENT = "ord int, marker string, name string, payload_start long, length long, tag string"
CHUNK = "ord int, kind string, offset long, length long"
PROBE = "probe int, quality double, score double, bytes long"


def _function(kind: str, one):
    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([one(None if x is None else bytes(x)) for x in batch], dtype=object)

    return run


def register(spark: SparkSession) -> list[str]:
    """Register every function with the session; returns their names.

    Scalar: image_strip_jpeg, image_strip_png, image_icc_profile, image_orientation, image_signals_hdr. Tables, to be joined
    laterally: image_segments(content), image_chunks(content), image_search(target, original, scores, sizes).
    Null or damaged content gives null, and no rows from a table function.
    """
    scalars = {
        "strip_jpeg": ("binary", jpeg.strip), "strip_png": ("binary", png.strip), "icc_profile": ("binary", jpeg.icc_profile),
        "orientation": ("int", jpeg.orientation), "signals_hdr": ("boolean", jpeg.signals_hdr),
    }
    for name, (kind, one) in scalars.items():
        spark.udf.register(PREFIX + name, _function(kind, one))

    @F.udtf(returnType=SEGMENT)
    class Segments:
        def eval(self, content: bytes):  # noqa: ANN201
            for k, s in enumerate(jpeg.segments(content and bytes(content))):
                yield k, f"FF{s.marker:02X}", jpeg.segment_name(s.marker), s.start, len(s.payload) + 2, s.payload[:14].split(b"\0")[0].decode("latin-1")

    @F.udtf(returnType=CHUNK)
    class Chunks:
        def eval(self, content: bytes):  # noqa: ANN201
            for k, c in enumerate(png.chunks(content and bytes(content)) or []):
                yield k, c.kind.decode("latin-1"), c.offset, len(c.whole)

    @F.udtf(returnType=PROBE)
    class Search:
        """The probes of a search over known curves: scores and sizes at qualities 20 to 98."""

        def eval(self, target: float, original: int, scores: list, sizes: list):  # noqa: ANN201
            at = lambda q: int(q) - search.LOWEST
            found = search.search(lambda q: (scores[at(q)], sizes[at(q)]), target, original)
            for k, (q, v, n) in enumerate(found.probes):
                yield k + 1, float(q), float(v), int(n)

    tables = {"segments": Segments, "chunks": Chunks, "search": Search}
    for name, table in tables.items():
        spark.udtf.register(PREFIX + name, table)
    return [PREFIX + name for name in (*scalars, *tables)]


def results_view(results: DataFrame, name: str = "results") -> DataFrame:
    """results as a view, one row per file; probes can be exploded from it."""
    results.createOrReplaceTempView(name)
    return results
