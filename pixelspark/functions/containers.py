"""JPEG and PNG containers as column expressions: a byte cursor that a fold carries through the file, inside the JVM.

A walk ends by itself where the file does, so the number of steps is not known before. `_walk` folds over short sequences
inside of long ones, and once a walk has ended each of these is empty: a file of many megabytes with twenty segments
costs some hundred steps. Contents are bound once (`_let`), as reading a binary column inside a lambda would copy it each
time; parts that are kept are gathered as byte ranges, neighbours as one, and copied once.

Functions of JPEG take the column of `jpeg_segments` too, so that a plan which has it walks each file once. `strip_display` is
made of several steps and works on a DataFrame.

Every function takes a binary column, and gives null for null, for another kind of file and for a file whose structure
does not hold (lenient ones: what is in front of the damage). All positions are in bytes from 0.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Signatures, markers, tags and lists of the two formats.
PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"
PNG_KEEP = ("IHDR", "PLTE", "IDAT", "IEND", "tRNS", "iCCP", "sRGB", "gAMA", "cHRM", "cICP", "acTL", "fcTL", "fdAT")
PNG_COLOUR = ("iCCP", "sRGB", "gAMA", "cHRM", "cICP")
APP0, APP1, APP2, APP15, COM, SOS, EOI = 0xE0, 0xE1, 0xE2, 0xEF, 0xFE, 0xDA, 0xD9
ALONE = (0xD0, 0xD1, 0xD2, 0xD3, 0xD4, 0xD5, 0xD6, 0xD7, 0xD8, 0x01)
FRAMES = (0xC0, 0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF)
ICC, EXIF, XMP = b"ICC_PROFILE\0", b"Exif\0\0", b"http://ns.adobe.com/xap/1.0/\0"
MPF, ISO_GAIN_MAP = b"MPF\0", b"urn:iso:std:iso:ts:21496"
GAIN_MAP = (b"hdrgainmap", b"iso:ts:21496", b"hdr-gain-map", b"hdrgm:", b"GContainer")

#: Steps in one short sequence of a walk.
STEPS = 32
RANGE = "struct<a:bigint,b:bigint>"


_made: dict[tuple, object] = {}


def once(make: Callable) -> Callable:
    """make, which builds columns from names, called once in a Spark application for the same names: a walk has some hundred expressions."""

    @wraps(make)
    def get(*names: str | None) -> object:
        key = (SparkContext._active_spark_context.applicationId, make.__qualname__, names)
        if key not in _made:
            _made[key] = make(*names)
        return _made[key]

    return get


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _walk(start: Column, going: Callable[[Column], Column], step: Callable[[Column], Column], most: Column) -> Column:
    """start carried through step while going, `most` steps at most."""

    def several(state: Column, depth: int) -> Column:
        if not depth:
            return F.when(going(state), step(state)).otherwise(state)
        some = F.when(going(state), F.sequence(F.lit(1), F.lit(STEPS))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(some, state, lambda s, _: several(s, depth - 1))

    rounds = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(most / STEPS**2)).cast("int"))
    return F.aggregate(rounds, start, lambda s, _: several(s, 2))


def part(b: Column, a: Column, end: Column) -> Column:
    """Bytes a to end - 1 (positions are limited to two gigabytes, as contents are)."""
    return F.substring(b, (a + 1).cast("int"), (end - a).cast("int"))


def number(b: Column, at: Column | int, n: int, little: Column | None = None) -> Column:
    """n bytes at a position as a number; null beyond the end. little: the lowest byte comes first."""
    at = F.lit(at) if isinstance(at, int) else at
    big = F.conv(F.hex(part(b, at, at + n)), 16, 10).cast("long")
    if little is None:
        return big
    backwards = F.conv(F.concat(*[F.hex(part(b, at + k, at + k + 1)) for k in reversed(range(n))]), 16, 10).cast("long")
    return F.when(little, backwards).otherwise(big)


def to_bytes(value: Column, n: int) -> Column:
    """A number as n bytes, the highest first."""
    return F.unhex(F.lpad(F.hex(value.cast("long")), 2 * n, "0"))


def latin(b: Column) -> Column:
    """Bytes as a string of one character each."""
    return F.decode(b, "ISO-8859-1")


def _size(b: Column) -> Column:
    return F.octet_length(b).cast("long")


def _taken(b: Column, ranges: Column, first: bytes = b"") -> Column:
    """The bytes of ranges one behind the other, behind `first`."""
    merged = F.aggregate(
        ranges, F.array().cast(f"array<{RANGE}>"),
        lambda done, r: F.when((F.size(done) > 0) & (F.get(done, F.size(done) - 1)["b"] == r["a"]), F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(F.get(done, F.size(done) - 1)["a"].alias("a"), r["b"].alias("b"))))).otherwise(F.concat(done, F.array(r))),
    )
    return F.aggregate(merged, F.lit(first), lambda out, r: F.concat(out, part(b, r["a"], r["b"])))


# --- PNG -----------------------------------------------------------------------------------------------------------

CHUNKS = "array<struct<ord:int,kind:string,offset:bigint,length:bigint>>"


def png_chunks(content: Column) -> Column:
    """ord, kind, offset and whole length of the chunks up to IEND; null where one overruns the file or IEND is missing."""
    return _let(content, _png_chunks)


def _png_chunks(b: Column) -> Column:
    n = _size(b)

    def step(s: Column) -> Column:
        def found(size: Column, kind: Column) -> Column:
            end = s["at"] + 12 + size
            listed = F.concat(s["out"], F.array(F.struct(F.size(s["out"]).alias("ord"), kind.alias("kind"), s["at"].alias("offset"), (12 + size).alias("length"))))
            return F.when(end > n, _state(s["at"], 2, s["out"])).otherwise(_state(end, F.when(kind == "IEND", 1).otherwise(0), listed))

        here = F.struct(number(b, s["at"], 4).alias("size"), latin(part(b, s["at"] + 4, s["at"] + 8)).alias("kind"))
        return F.when(s["at"] + 12 > n, _state(s["at"], 2, s["out"])).otherwise(_let(here, lambda h: found(h["size"], h["kind"])))

    start = _state(F.lit(len(PNG_SIGNATURE)), 0, F.array().cast(CHUNKS))
    walked = _walk(start, lambda s: s["ended"] == 0, step, n / 12 + 1)
    return F.when(F.startswith(b, F.lit(PNG_SIGNATURE)), _let(walked, lambda s: F.when(s["ended"] == 1, s["out"])))


def _state(at: Column, ended: Column | int, out: Column) -> Column:
    """A walk's cursor, whether it has ended (1: where it should, 2: not), and what it has found."""
    return F.struct(at.cast("long").alias("at"), (F.lit(ended) if isinstance(ended, int) else ended).cast("int").alias("ended"), out.alias("out"))


def _chunk_ranges(chunks: Column) -> Column:
    return F.transform(chunks, lambda c: F.struct(c["offset"].alias("a"), (c["offset"] + c["length"]).alias("b")))


def _has(chunks: Column, kind: str) -> Column:
    return F.exists(chunks, lambda c: c["kind"] == kind)


def strip_png(content: Column) -> Column:
    """The file with kept chunks only; null where it has no header, no pixels or no end."""
    kept = lambda cs: F.filter(cs, lambda c: c["kind"].isin(*PNG_KEEP))
    return _let(content, lambda b: _let(_png_chunks(b), lambda cs: F.when(_has(cs, "IHDR") & _has(cs, "IDAT"), _taken(b, _chunk_ranges(kept(cs)), PNG_SIGNATURE))))


def colour_bytes(content: Column) -> Column:
    """The colour chunks one behind the other, the first of each kind; empty where there are none, null where the file does not hold."""
    first = lambda cs: F.filter(cs, lambda c, k: F.array_position(F.transform(cs, lambda x: x["kind"]), c["kind"]) == k + 1)
    return _let(content, lambda b: _let(F.filter(_png_chunks(b), lambda c: c["kind"].isin(*PNG_COLOUR)), lambda cs: _taken(b, _chunk_ranges(first(cs)))))


def carry_colour(original: Column, encoded: Column) -> Column:
    """encoded with the colour chunks of original behind its header, one of a kind, none that it has already; null where encoded does not hold."""

    def carried(a: Column, b: Column, mine: Column) -> Column:
        colour = F.filter(F.coalesce(_png_chunks(a), F.array().cast(CHUNKS)), lambda c: c["kind"].isin(*PNG_COLOUR))
        have = F.transform(mine, lambda c: c["kind"])
        fresh = lambda cs: F.filter(cs, lambda c, k: ~F.array_contains(have, c["kind"]) & (F.array_position(F.transform(cs, lambda x: x["kind"]), c["kind"]) == k + 1))
        behind = F.get(_chunk_ranges(F.filter(mine, lambda c: c["kind"] == "IHDR")), F.lit(0))["b"]
        added = _let(colour, lambda cs: _taken(a, _chunk_ranges(fresh(cs))))
        end = F.element_at(_chunk_ranges(mine), -1)["b"]
        return F.when(behind.isNull(), part(b, F.lit(0), end)).otherwise(F.concat(part(b, F.lit(0), behind), F.coalesce(added, F.lit(b"")), part(b, behind, end)))

    return _let(F.struct(original.alias("a"), encoded.alias("b")), lambda p: _let(_png_chunks(p["b"]), lambda mine: F.when(mine.isNotNull(), carried(p["a"], p["b"], mine))))


# --- JPEG segments -------------------------------------------------------------------------------------------------

SEGMENTS = "array<struct<ord:int,marker:int,payload_start:bigint,length:bigint>>"


def is_jpeg(b: Column) -> Column:
    return F.startswith(b, F.lit(b"\xff\xd8")) & (_size(b) >= 4)


def jpeg_segments(content: Column) -> Column:
    """ord, marker, start and length of the payload of the segments before the scan; of a damaged file those before the damage."""
    return _let(content, _jpeg_segments)


def _jpeg_segments(b: Column) -> Column:
    n = _size(b)

    def step(s: Column) -> Column:
        def found(sync: Column, marker: Column, size: Column) -> Column:
            end = s["at"] + 2 + size
            listed = F.concat(s["out"], F.array(F.struct(F.size(s["out"]).alias("ord"), marker.cast("int").alias("marker"), (s["at"] + 4).alias("payload_start"), (size - 2).alias("length"))))
            return (
                F.when((sync != 255) | marker.isin(SOS, EOI), _state(s["at"], 1, s["out"]))
                .when(marker.isin(*ALONE), _state(s["at"] + 2, 0, s["out"]))
                .when((size < 2) | (end > n), _state(s["at"], 2, s["out"]))
                .otherwise(_state(end, 0, listed))
            )

        here = F.struct(number(b, s["at"], 1).alias("sync"), number(b, s["at"] + 1, 1).alias("marker"), number(b, s["at"] + 2, 2).alias("size"))
        return F.when(s["at"] + 4 > n, _state(s["at"], 1, s["out"])).otherwise(_let(here, lambda h: found(h["sync"], h["marker"], h["size"])))

    walked = _walk(_state(F.lit(2), 0, F.array().cast(SEGMENTS)), lambda s: s["ended"] == 0, step, n / 2 + 1)
    return F.when(b.isNotNull(), F.when(is_jpeg(b), walked["out"]).otherwise(F.array().cast(SEGMENTS)))


def _end(s: Column) -> Column:
    return s["payload_start"] + s["length"]


def _tagged(b: Column, s: Column, marker: int, tag: bytes) -> Column:
    """Whether a segment is of this marker and its payload begins with tag."""
    return (s["marker"] == marker) & (s["length"] >= len(tag)) & (part(b, s["payload_start"], s["payload_start"] + len(tag)) == F.lit(tag))


def _bound(content: Column, segments: Column | None, body: Callable[[Column, Column], Column]) -> Column:
    """body(content, segments), both evaluated once."""
    return _let(content, lambda b: _let(_jpeg_segments(b) if segments is None else segments, lambda segs: body(b, segs)))


def icc_profile(content: Column, segments: Column | None = None) -> Column:
    """The colour profile put together from its parts in the order of their sequence bytes; null without one."""

    def joined(b: Column, segs: Column) -> Column:
        parts = F.filter(segs, lambda s: _tagged(b, s, APP2, ICC) & (s["length"] >= 14))
        ordered = F.array_sort(F.transform(parts, lambda s: F.struct(number(b, s["payload_start"] + 12, 1).alias("seq"), s["ord"].alias("ord"), (s["payload_start"] + 14).alias("a"), _end(s).alias("b"))))
        # sixteen at a time, so that a profile of 255 parts is copied some thirty times and not 255
        lots = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.slice(ordered, k * 16 + 1, F.lit(16)))
        lot = lambda rs: F.aggregate(rs, F.lit(b""), lambda out, r: F.concat(out, part(b, r["a"], r["b"])))
        rest = lot(F.slice(ordered, F.lit(257), F.greatest(F.lit(0), F.size(ordered) - 256)))
        return _let(ordered, lambda o: F.when(F.size(o) > 0, F.concat(F.aggregate(F.transform(lots, lot), F.lit(b""), lambda out, x: F.concat(out, x)), rest)))

    return _bound(content, segments, joined)


def orientation(content: Column, segments: Column | None = None) -> Column:
    """The orientation tag of the first Exif block that has one, as written; 1 without one."""

    def of_block(b: Column, s: Column) -> Column:
        base, m = s["payload_start"] + len(EXIF), s["length"] - len(EXIF)
        order = latin(part(b, base, base + 2))

        def tag(h: Column) -> Column:
            first, little = h["ifd"] + 2, h["little"]
            fit = F.least(number(b, base + h["ifd"], 2, little), F.floor((m - first) / 12))
            at = lambda k: base + first + 12 * k
            places = F.when((first <= m) & (fit > 0), F.sequence(F.lit(0).cast("long"), fit - 1)).otherwise(F.array().cast("array<bigint>"))
            hit = F.get(F.filter(places, lambda k: number(b, at(k), 2, little) == 0x0112), F.lit(0))
            return F.when(hit.isNotNull(), number(b, at(hit) + 8, 2, little))

        head = F.struct(number(b, base + 4, 4, order == "II").alias("ifd"), (order == "II").alias("little"))
        return F.when((m >= 8) & order.isin("MM", "II"), _let(head, tag))

    def first(b: Column, segs: Column) -> Column:
        blocks = F.filter(segs, lambda s: _tagged(b, s, APP1, EXIF))
        return F.coalesce(F.get(F.filter(F.transform(blocks, lambda s: of_block(b, s)), lambda v: v.isNotNull()), F.lit(0)), F.lit(1)).cast("int")

    return _bound(content, segments, first)


def orientation_segment(value: Column) -> Column:
    """An Exif block, marker and all, that says the orientation and nothing else."""
    return F.concat(F.lit(bytes.fromhex("FFE10022") + EXIF + bytes.fromhex("4D4D002A00000008000101120003") + bytes.fromhex("00000001")), to_bytes(value, 2), F.lit(bytes(6)))


def strip_jpeg(content: Column) -> Column:
    """The file without metadata and without anything behind its end; null where its structure does not hold."""
    return _let(content, _strip_jpeg)


def _strip_jpeg(b: Column) -> Column:
    n = _size(b)
    none = F.array().cast(f"array<{RANGE}>")

    def step(s: Column) -> Column:
        take = lambda a, e: F.concat(s["out"], F.array(F.struct(a.alias("a"), e.alias("b"))))

        def found(sync: Column, marker: Column, size: Column) -> Column:
            end = s["at"] + 2 + size
            described = marker.between(APP0, APP15) | (marker == COM)
            icc = (marker == APP2) & (size >= 2 + len(ICC)) & (part(b, s["at"] + 4, s["at"] + 4 + len(ICC)) == F.lit(ICC))
            return (
                F.when(sync != 255, _state(s["at"], 2, s["out"]))
                .when(marker.isin(*ALONE), _state(s["at"] + 2, 0, take(s["at"], s["at"] + 2)))
                .when(marker == SOS, _state(s["at"], 3, s["out"]))
                .when(marker == EOI, _state(s["at"], 1, take(s["at"], s["at"] + 2)))
                .when((size < 2) | (end > n), _state(s["at"], 2, s["out"]))
                .otherwise(_state(end, 0, F.when(described & ~icc, s["out"]).otherwise(take(s["at"], end))))
            )

        here = F.struct(number(b, s["at"], 1).alias("sync"), number(b, s["at"] + 1, 1).alias("marker"), number(b, s["at"] + 2, 2).alias("size"))
        return F.when(s["at"] + 4 > n, _state(s["at"], 2, s["out"])).otherwise(_let(here, lambda h: found(h["sync"], h["marker"], h["size"])))

    def finished(s: Column) -> Column:
        # the scan ends at the first end marker behind its start
        scan = lambda: _let(F.locate("\xff\xd9", latin(part(b, s["at"], n))), lambda k: F.when(k > 0, part(b, s["at"], s["at"] + k + 1)))
        return F.when(s["ended"] == 1, _taken(b, s["out"], b"\xff\xd8")).when(s["ended"] == 3, F.concat(_taken(b, s["out"], b"\xff\xd8"), scan()))

    walked = _walk(_state(F.lit(2), 0, none), lambda s: s["ended"] == 0, step, n / 2 + 1)
    return F.when(is_jpeg(b), _let(walked, finished))


# --- several pictures in a file ------------------------------------------------------------------------------------

PLACES = "array<struct<start:bigint,size:bigint>>"


def picture_ranges(content: Column, segments: Column | None = None) -> Column:
    """start and size of each picture that the multi-picture index lists; null without a sound index.

    Pictures behind the first lie apart from each other, so together they are no longer than the file.
    """
    return _bound(content, segments, _picture_ranges)


def _first(b: Column, segs: Column, marker: int, tag: bytes) -> Column:
    return F.get(F.filter(segs, lambda s: _tagged(b, s, marker, tag)), F.lit(0))


def _picture_ranges(b: Column, segs: Column) -> Column:
    n = _size(b)

    def listed(s: Column) -> Column:
        base, m = s["payload_start"] + len(MPF), s["length"] - len(MPF)
        order = latin(part(b, base, base + 2))
        little = order == "II"

        def entry(ifd: Column) -> Column:
            fit = F.least(number(b, base + ifd, 2, little), F.floor((m - ifd - 2) / 12))
            places = F.when(fit > 0, F.sequence(F.lit(0).cast("long"), fit - 1)).otherwise(F.array().cast("array<bigint>"))
            return F.get(F.filter(F.transform(places, lambda k: ifd + 2 + 12 * k), lambda at: number(b, base + at, 2, little) == 0xB002), F.lit(0))

        def pictures(h: Column) -> Column:
            count = F.floor(h["size"] / 16)
            at = lambda k: base + h["at"] + 16 * k
            rows = F.when(count > 0, F.transform(F.sequence(F.lit(0).cast("long"), count - 1), lambda k: F.struct(number(b, at(k) + 8, 4, little).alias("offset"), number(b, at(k) + 4, 4, little).alias("size")))).otherwise(F.array().cast("array<struct<offset:bigint,size:bigint>>"))
            placed = F.transform(rows, lambda r: F.struct(F.when(r["offset"] > 0, base + r["offset"]).otherwise(F.lit(0)).alias("start"), r["size"].alias("size")))
            return F.when((h["size"] % 16 == 0) & (h["at"] + h["size"] <= m), _let(placed, _sound))

        def _sound(rows: Column) -> Column:
            inside = F.forall(rows, lambda r: r["start"] + r["size"] <= n)
            apart = F.array_sort(F.filter(F.slice(rows, F.lit(2), F.greatest(F.lit(0), F.size(rows) - 1)), lambda r: r["size"] > 0))
            clear = _let(apart, lambda rs: F.forall(F.zip_with(F.slice(rs, F.lit(1), F.greatest(F.lit(0), F.size(rs) - 1)), F.slice(rs, F.lit(2), F.greatest(F.lit(0), F.size(rs) - 1)), lambda x, y: x["start"] + x["size"] <= y["start"]), lambda ok: ok))
            return F.when(inside & clear, rows)

        def at_entry(e: Column) -> Column:
            return F.when(e.isNotNull(), _let(F.struct(number(b, base + e + 4, 4, little).alias("size"), number(b, base + e + 8, 4, little).alias("at")), pictures))

        return F.when((m >= 8) & order.isin("MM", "II"), _let(number(b, base + 4, 4, little), lambda ifd: _let(entry(ifd), at_entry)))

    return _let(_first(b, segs, APP2, MPF), lambda s: F.when(s.isNotNull(), listed(s)))


def secondaries(content: Column, ranges: Column | None = None) -> Column:
    """The pictures behind the first that the index lists (`picture_ranges`, if it is there already); none without a sound index."""
    return _let(content, lambda b: F.when(b.isNotNull(), _secondaries(b, picture_ranges(b) if ranges is None else ranges)))


def _secondaries(b: Column, ranges: Column) -> Column:
    rows = F.coalesce(F.slice(ranges, F.lit(2), F.greatest(F.lit(0), F.size(ranges) - 1)), F.array().cast(PLACES))
    return F.transform(rows, lambda r: part(b, r["start"], r["start"] + r["size"]))


def is_gain_map(picture: Column) -> Column:
    found = F.lit(False)
    for needle in GAIN_MAP:
        found = found | F.contains(picture, F.lit(needle))
    return found


def signals_hdr(content: Column, segments: Column | None = None, pictures: Column | None = None) -> Column:
    """Whether a file says that it has a gain map: in a further picture, an ISO block or its own XMP."""
    sure = lambda value: F.coalesce(value, F.lit(False))

    def told(b: Column, segs: Column) -> Column:
        iso = F.exists(segs, lambda s: _tagged(b, s, APP2, ISO_GAIN_MAP))
        maps = F.exists(_let(_picture_ranges(b, segs), lambda rs: _secondaries(b, rs)) if pictures is None else pictures, is_gain_map)
        return sure(iso) | sure(F.contains(b, F.lit(b"hdrgm:"))) | sure(maps)

    return _bound(content, segments, told)


def _segment(marker: int, payload: Column) -> Column:
    return F.concat(F.lit(bytes([255, marker])), to_bytes(_size(payload) + 2, 2), payload)


def _leading(b: Column) -> Column:
    """Where segments are put in: behind the leading APP0 and APP1 blocks."""
    front = lambda segs: F.aggregate(segs, F.lit(2).cast("long"), lambda at, s: F.when(s["marker"].isin(APP0, APP1) & (_before(segs, s) == at), _end(s)).otherwise(at))
    return _let(_jpeg_segments(b), front)


def _before(segs: Column, s: Column) -> Column:
    """The end of the segment in front of s, 2 for the first."""
    return F.when(s["ord"] == 0, F.lit(2).cast("long")).otherwise(_end(F.get(segs, s["ord"] - 1)))


def attach(primary: Column, pictures: Column, iso: Column | None = None) -> Column:
    """primary with an index of pictures (an array) and behind it an ISO block, followed by the pictures; null where a block is too long.

    The index tells sizes and places, which follow from the lengths of all that is put in, so it is written once.
    """
    iso = F.lit(None).cast("binary") if iso is None else iso

    def whole(p: Column, at: Column) -> Column:
        b, extra = p["primary"], F.coalesce(F.when(_size(p["iso"]) > 0, _segment(APP2, p["iso"])), F.lit(b""))
        sizes = F.transform(p["pictures"], _size)
        n = F.size(p["pictures"]).cast("long") + 1
        size = 54 + 16 * n
        base, end = at + 8, _size(b) + 4 + size + _size(extra)
        before = lambda k: F.aggregate(F.slice(sizes, F.lit(1), k), F.lit(0).cast("long"), lambda x, y: x + y)
        head = F.concat(F.lit(MPF + bytes.fromhex("4D4D002A000000080003" + "B00000070000000430313030" + "B00100040000000" + "1")), to_bytes(n, 4), F.lit(bytes.fromhex("B0020007")), to_bytes(16 * n, 4), F.lit(bytes.fromhex("0000003200000000")))
        first = F.concat(F.lit(bytes.fromhex("00030000")), to_bytes(end, 4), F.lit(bytes(8)))
        rows = F.transform(sizes, lambda s, k: F.concat(F.lit(bytes(4)), to_bytes(s, 4), to_bytes(end + before(k) - base, 4), F.lit(bytes(4))))
        index = F.concat(head, first, F.aggregate(rows, F.lit(b""), lambda out, r: F.concat(out, r)))
        joined = F.aggregate(p["pictures"], F.lit(b""), lambda out, x: F.concat(out, x))
        fits = (size <= 65533) & (F.coalesce(_size(p["iso"]), F.lit(0)) <= 65533)
        return F.when(fits, F.concat(part(b, F.lit(0), at), _segment(APP2, index), extra, part(b, at, _size(b)), joined))

    bound = F.struct(primary.alias("primary"), pictures.alias("pictures"), iso.alias("iso"))
    return _let(bound, lambda p: F.when(p["primary"].isNotNull() & p["pictures"].isNotNull(), _let(_leading(p["primary"]), lambda at: whole(p, at))))


def _described(b: Column, segs: Column) -> Column:
    """What describes a gain map in its own file: XMP and ISO blocks, markers and all."""
    told = F.filter(segs, lambda s: _tagged(b, s, APP1, XMP) | _tagged(b, s, APP2, ISO_GAIN_MAP))
    return F.aggregate(told, F.lit(b""), lambda out, s: F.concat(out, part(b, s["payload_start"] - 4, _end(s))))


def strip_picture(picture: Column) -> Column:
    """A further picture without metadata other than what describes a gain map."""
    whole = lambda b, plain: _let(_leading(plain), lambda at: F.concat(part(plain, F.lit(0), at), _described(b, _jpeg_segments(b)), part(plain, at, _size(plain))))
    return _let(picture, lambda b: _let(_strip_jpeg(b), lambda plain: F.when(plain.isNotNull(), whole(b, plain))))


@once
def _strip_steps(content: str) -> tuple[list[dict[str, Column]], dict[str, Column]]:
    """The columns that a strip adds one step after the other, and the three that it leaves."""
    c, own = F.col(content), {k: f"__strip_{k}" for k in ("segments", "plain", "ranges", "turned", "pictures", "says", "cleaned", "iso", "bare", "whole", "kept")}
    col = {k: F.col(v) for k, v in own.items()}
    upright = F.when(col["turned"] == 1, col["plain"]).otherwise(F.concat(F.lit(b"\xff\xd8"), orientation_segment(col["turned"]), F.substring(col["plain"], 3, 1 << 30)))
    iso = _bound(c, col["segments"], lambda b, segs: _let(_first(b, segs, APP2, ISO_GAIN_MAP), lambda s: F.when(s.isNotNull(), part(b, s["payload_start"], _end(s)))))
    index = _bound(c, col["segments"], lambda b, segs: F.exists(segs, lambda s: _tagged(b, s, APP2, MPF)))
    steps: list[dict[str, Column]] = [
        {"segments": jpeg_segments(c), "plain": strip_jpeg(c)},
        {"ranges": picture_ranges(c, col["segments"]), "turned": orientation(c, col["segments"])},
        {"pictures": secondaries(c, col["ranges"]), "bare": upright},
        {"says": signals_hdr(c, col["segments"], col["pictures"]), "cleaned": F.transform("__strip_pictures", strip_picture), "iso": F.when(F.size("__strip_pictures") > 0, iso)},
        {"whole": F.when(F.size(col["pictures"]) > 0, F.when(F.forall(col["cleaned"], lambda x: x.isNotNull()), attach(col["bare"], col["cleaned"], col["iso"]))).otherwise(col["bare"])},
        {"kept": signals_hdr(col["whole"])},
    ]
    code = F.when(col["plain"].isNull() | (col["ranges"].isNull() & F.coalesce(index, F.lit(False))), 1).when(col["whole"].isNull(), 2).otherwise(0)
    hdr = F.when((code != 0) | ~col["says"], "absent").when(col["kept"], "preserved").otherwise("dropped")
    return [{own[k]: v for k, v in step.items()} for step in steps], {"data": F.when(code == 0, col["whole"]), "hdr": hdr, "code": code}


def strip_display(files: DataFrame, content: str = "content") -> DataFrame:
    """files with data, hdr and code: a strip that keeps orientation and further pictures, what became of the HDR rendition, and an
    error code: 1 where the file does not hold, 2 where a picture in it does not.

    A file with an index that does not hold, or with pictures that a new index cannot list, is refused, as they would be
    lost. `preserved` is said of what signals HDR as it is written.
    """
    steps, left = _strip_steps(content)
    for step in steps:
        files = files.withColumns(step)
    return files.withColumns(left).drop(*[name for step in steps for name in step])


# --- sizes before any decoding -------------------------------------------------------------------------------------

DIMS = "struct<width:bigint,height:bigint,depth:int,frames:boolean>"


def header_dims(content: Column, segments: Column | None = None) -> Column:
    """width, height, bits a sample and whether there are frames of an animation, from the file's header; null without a sound one.

    PNG: from fixed places of the header. JPEG: from the first frame header in front of the scan.
    """
    return _bound(content, segments, _header_dims)


def _dims(width: Column, height: Column, depth: Column, frames: Column) -> Column:
    return F.struct(width.cast("long").alias("width"), height.cast("long").alias("height"), depth.cast("int").alias("depth"), frames.alias("frames"))


def _header_dims(b: Column, segs: Column) -> Column:
    of_png = (_size(b) >= 33) & (part(b, F.lit(8), F.lit(16)) == F.lit(bytes.fromhex("0000000D49484452")))
    animated = F.coalesce(F.exists(_png_chunks(b), lambda c: c["kind"].isin("acTL", "fcTL", "fdAT")), F.lit(False))
    frame = lambda: F.get(F.filter(segs, lambda s: s["marker"].isin(*FRAMES) & (s["length"] >= 6)), F.lit(0))
    at = lambda s, k: s["payload_start"] + k
    of_jpeg = lambda s: F.when(s.isNotNull(), _dims(number(b, at(s, 3), 2), number(b, at(s, 1), 2), number(b, at(s, 0), 1), F.lit(False)))
    return F.when(F.startswith(b, F.lit(PNG_SIGNATURE)), F.when(of_png, _dims(number(b, 16, 4), number(b, 20, 4), number(b, 24, 1), animated))).when(is_jpeg(b), _let(frame(), of_jpeg))
