"""Container operators over DataFrames of binary content; one row in gives one typed row out, and none leaves the JVM.

A null content gives what the operator gives for no file (mostly null), an empty table an empty one, repeated rows are
treated alike, and a content on which an operator fails gives null and does not end the task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import containers as C
from . import jpeg


def _named(one: Callable[..., Column]) -> Callable[..., Column]:
    """one, for columns or their names."""
    return lambda *columns: one(*[F.col(c) if isinstance(c, str) else c for c in columns])


strip_png, strip_jpeg, icc_profile = _named(C.strip_png), _named(C.strip_jpeg), _named(C.icc_profile)
orientation, signals_hdr = _named(C.orientation), _named(C.signals_hdr)
png_chunks, jpeg_segments, picture_ranges = _named(C.png_chunks), _named(C.jpeg_segments), _named(C.picture_ranges)
carry_colour = _named(C.carry_colour)
attach_picture = _named(lambda primary, secondary: F.when(secondary.isNotNull(), C.attach(primary, F.array(secondary))))
strip_display = C.strip_display


def needles(content: Column | str) -> Column:
    """Which of the byte strings that tell of metadata the content holds; null counts as empty."""
    raw = F.coalesce(F.col(content) if isinstance(content, str) else content, F.lit(b""))
    return F.array_compact(F.array(*[F.when(F.contains(raw, F.lit(n)), F.lit(n.decode())) for n in jpeg.NEEDLES]))


def optimize_strip(files: DataFrame, content: str = "content", path: str = "path") -> DataFrame:
    """Strip results of files (path, content) in the result columns: done, already_optimal or failed."""
    from .reencode import optimize

    return optimize(files.select(F.col(path).alias("path"), F.col(content).alias("content")), "strip")
