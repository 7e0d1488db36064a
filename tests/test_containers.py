import struct

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from pixelspark.operators import jpeg, png, search

IHDR = png.chunk(b"IHDR", bytes(13))
WITH_TEXT = png.SIGNATURE + IHDR + png.chunk(b"tEXt", b"Comment\0secret location") + png.chunk(b"iCCP", b"profile") + png.chunk(b"IDAT", b"pixels") + png.chunk(b"IEND", b"")
BARE = png.SIGNATURE + IHDR + png.chunk(b"IDAT", b"pixels") + png.chunk(b"IEND", b"")
CONTROL = bytes.fromhex("FFD8FFE10008457869660000FFDA00021122FFD9")


def test_png_strip_keeps_colour_and_pixels():
    out = png.strip(WITH_TEXT)
    assert len(WITH_TEXT) == 117 and len(out) == 82 and b"tEXt" not in out and b"iCCP" in out and b"IDAT" in out


@pytest.mark.parametrize("bad", [b"", None, b"no png", WITH_TEXT[:8] + b"\0\0\xff\xff" + WITH_TEXT[12:], WITH_TEXT[:-4], png.SIGNATURE + png.chunk(b"IEND", b"")])
def test_png_strip_refuses(bad):
    assert png.strip(bad) is None


def test_colour_chunks_are_carried_once():
    once = png.with_colour(BARE, png.colour_chunks(WITH_TEXT))
    assert once.index(b"iCCP") < once.index(b"IDAT") and png.with_colour(once, png.colour_chunks(WITH_TEXT)) == once


@pytest.mark.parametrize("planes", [1, 3, 4])
def test_png_codec_round_trip(planes):
    px = np.random.default_rng(planes).integers(0, 256, (9, 17, planes), np.uint8)
    px[3:6] = px[3:4]
    got = png.decode(png.encode(px))
    assert (got[:, :, : max(planes, 3)] == (px if planes > 1 else np.repeat(px, 3, 2))).all()


def test_jpeg_strip():
    assert len(jpeg.strip(CONTROL)) == 10
    for k, bad in ((5, b"\x09"), (4, b"\xff\x00")):
        assert jpeg.strip(CONTROL[:k] + bad + CONTROL[k + len(bad) :]) is None
    assert jpeg.strip(bytes.fromhex("FFD8FFDA0002112233")) is None
    tagged = CONTROL[:2] + jpeg.segment(0xED, jpeg.ICC) + CONTROL[2:]
    assert b"ICC_PROFILE" not in jpeg.strip(tagged)


@pytest.mark.parametrize("value", range(2, 9))
def test_orientation_round_trip(value):
    assert jpeg.orientation(b"\xff\xd8" + jpeg.orientation_segment(value) + b"\xff\xd9") == value


def test_pictures_survive_a_strip():
    picture = lambda note: CONTROL[:2] + jpeg.segment(jpeg.APP1, jpeg.XMP + note) + CONTROL[2:]
    for note, hdr in ((b"hdrgainmap", "preserved"), (b'hdrgm:Version="1.0"', "preserved"), (b"something else", "absent")):
        whole = jpeg.attach(CONTROL, [picture(note), picture(b"other")])
        assert jpeg.secondaries(whole) == [picture(note), picture(b"other")]
        out, state = jpeg.strip_keeping_display(whole)
        assert state == hdr and len(jpeg.secondaries(out)) == 2 and b"Exif" not in out and note in out
    assert jpeg.secondaries(CONTROL) == []


def test_every_listed_picture_survives_or_the_file_is_refused():
    pictures = [CONTROL[:2] + jpeg.segment(jpeg.APP1, jpeg.XMP + b"hdrgainmap %d" % k) + CONTROL[2:] for k in range(70)]
    whole = jpeg.attach(CONTROL, pictures)
    out, state = jpeg.strip_keeping_display(whole)
    assert state == "preserved" and [b"hdrgainmap %d" % k in p for k, p in enumerate(jpeg.secondaries(out))] == [True] * 70
    two = jpeg.attach(CONTROL, pictures[:2])
    second, third = (b"".join(struct.pack(">I", x) for x in e[::-1]) for e in [(a - jpeg.picture_index(two).start - 4, n) for a, n in jpeg.picture_ranges(two)[1:]])
    assert two.count(second) == 1 and two.count(third) == 1
    for bad in (two.replace(third, second), two.replace(third, third[:4] + b"\x7f" + third[5:])):
        assert jpeg.picture_ranges(bad) is None and jpeg.strip_keeping_display(bad) == (None, "absent")


@given(st.integers(0, len(WITH_TEXT)), st.integers(0, 255))
def test_damage_never_raises(at, byte):
    for whole, strip in ((WITH_TEXT, png.strip), (CONTROL, jpeg.strip), (jpeg.attach(CONTROL, [CONTROL]), lambda x: jpeg.strip_keeping_display(x)[0])):
        for bad in (whole[:at], whole[:at] + bytes([byte]) + whole[at + 1 :]):
            out = strip(bad)
            assert out is None or strip(out) is not None
            jpeg.segments(bad), jpeg.orientation(bad), jpeg.picture_ranges(bad), jpeg.icc_profile(bad)


def test_search_bounds():
    curve = lambda q: (40 + 0.5 * q, int(10 * q))
    got = search.search(curve, 80.0, 10_000)
    assert got.code == 0 and got.score >= 80 and len(got.probes) <= 6 and got.quality <= 81
    assert search.search(curve, 99.0, 10_000).code == 5 and search.search(curve, 80.0, 10).code == 6
    assert search.search(lambda q: (float("nan"), 1), 80.0, 10).code == 5
