"""JPEG containers: segments, colour profile, orientation, strict strip, multi-picture index."""

from __future__ import annotations

import struct
from dataclasses import dataclass

ICC, EXIF, XMP = b"ICC_PROFILE\0", b"Exif\0\0", b"http://ns.adobe.com/xap/1.0/\0"
MPF, ISO_GAIN_MAP = b"MPF\0", b"urn:iso:std:iso:ts:21496"
# Byte strings by which a picture is recognised as a gain map, and those that the inspection lists.
GAIN_MAP = (b"hdrgainmap", b"iso:ts:21496", b"hdr-gain-map", b"hdrgm:", b"GContainer")
NEEDLES = (b"GPS", b"Exif", b"ns.adobe.com/xap", b"jumb", b"c2pa", b"Photoshop", b"ICC_PROFILE")
APP0, APP1, APP2, APP15, COM, SOS, EOI = 0xE0, 0xE1, 0xE2, 0xEF, 0xFE, 0xDA, 0xD9
# Markers without a length (restarts, start of image, temporary), and what the inspection calls application data.
ALONE = (0xD0, 0xD1, 0xD2, 0xD3, 0xD4, 0xD5, 0xD6, 0xD7, 0xD8, 0x01)


@dataclass(frozen=True)
class Segment:
    marker: int
    start: int
    payload: bytes


def is_jpeg(content: bytes | None) -> bool:
    return bool(content) and len(content) >= 4 and content[:2] == b"\xff\xd8"


def segments(content: bytes | None) -> list[Segment]:
    """Segments before the scan; a damaged file gives those before the damage."""
    out: list[Segment] = []
    at = 2 if is_jpeg(content) else len(content or b"")
    while at + 4 <= len(content or b""):
        marker = content[at + 1]
        if content[at] != 0xFF or marker in (SOS, EOI):
            break
        if marker in ALONE:
            at += 2
            continue
        end = at + 2 + int.from_bytes(content[at + 2 : at + 4], "big")
        if end < at + 4 or end > len(content):
            break
        out.append(Segment(marker, at + 4, content[at + 4 : end]))
        at = end
    return out


def icc_profile(content: bytes | None) -> bytes | None:
    """The colour profile put together from its parts in the order of their sequence bytes."""
    parts = [s.payload for s in segments(content) if s.marker == APP2 and s.payload.startswith(ICC) and len(s.payload) >= 14]
    return b"".join(p[14:] for p in sorted(parts, key=lambda p: p[12])) if parts else None


def orientation(content: bytes | None) -> int:
    """The orientation tag of the first Exif block that has one, as written; 1 without one."""
    for s in segments(content):
        block = s.payload[6:] if s.marker == APP1 and s.payload.startswith(EXIF) else b""
        order = {b"MM": "big", b"II": "little"}.get(block[:2])
        if order is None or len(block) < 8:
            continue
        read = lambda at, n: int.from_bytes(block[at : at + n], order)  # noqa: B023, E731
        ifd = read(4, 4)
        for at in range(ifd + 2, min(ifd + 2 + 12 * read(ifd, 2), len(block) - 11), 12) if ifd + 2 <= len(block) else ():
            if read(at, 2) == 0x0112:
                return read(at + 8, 2)
    return 1


# What the inspection calls application segments; others of FFE0 to FFEF are APPn.
NAMES = {0xE0: "APP0 JFIF", 0xE1: "APP1 EXIF/XMP", 0xE2: "APP2 ICC/MPF", 0xEA: "APP10 AROT", 0xEB: "APP11 C2PA/JUMBF", 0xED: "APP13 IPTC", 0xEE: "APP14 Adobe"}


def segment_name(marker: int) -> str | None:
    """The name of an application segment; None for any other."""
    return NAMES.get(marker, "APPn") if APP0 <= marker <= APP15 else None


def segment(marker: int, payload: bytes) -> bytes:
    return bytes([0xFF, marker]) + struct.pack(">H", len(payload) + 2) + payload


def orientation_segment(value: int) -> bytes:
    """An Exif block that says the orientation and nothing else."""
    return segment(APP1, EXIF + struct.pack(">2sHIHHHIHHI", b"MM", 42, 8, 1, 0x0112, 3, 1, value, 0, 0))


def kept(s: Segment) -> bool:
    """Whether a strip keeps a segment: all but application data and comments, and colour profiles."""
    described = APP0 <= s.marker <= APP15 or s.marker == COM
    return not described or (s.marker == APP2 and s.payload.startswith(ICC))


def strip(content: bytes | None) -> bytes | None:
    """The file without metadata and without anything after its end; None where its structure does not hold."""
    if not is_jpeg(content):
        return None
    out, at = [content[:2]], 2
    while at + 4 <= len(content):
        if content[at] != 0xFF:
            return None
        marker = content[at + 1]
        if marker in ALONE:
            out.append(content[at : at + 2])
            at += 2
            continue
        if marker == SOS:
            end = content.find(b"\xff\xd9", at)
            return None if end < 0 else b"".join([*out, content[at : end + 2]])
        if marker == EOI:
            return b"".join([*out, b"\xff\xd9"])
        end = at + 2 + int.from_bytes(content[at + 2 : at + 4], "big")
        if end < at + 4 or end > len(content):
            return None
        if kept(Segment(marker, at + 4, content[at + 4 : end])):
            out.append(content[at:end])
        at = end
    return None


def needles(content: bytes | None) -> list[str]:
    return [n.decode() for n in NEEDLES if n in (content or b"")]


def picture_index(content: bytes | None) -> Segment | None:
    """The segment of the multi-picture index."""
    return next((s for s in segments(content) if s.marker == APP2 and s.payload.startswith(MPF)), None)


def picture_ranges(content: bytes | None) -> list[tuple[int, int]] | None:
    """(start, size) of each picture that the multi-picture index lists; None without a sound index.

    Secondary pictures lie apart from each other, so together they are no longer than the file, whatever their number.
    """
    index = picture_index(content)
    if index is None:
        return None
    body, base = index.payload[4:], index.start + 4
    order = {b"MM": "big", b"II": "little"}.get(body[:2])
    if order is None:
        return None
    read = lambda at, n: int.from_bytes(body[at : at + n], order)
    ifd = read(4, 4)
    entry = next((at for at in range(ifd + 2, ifd + 2 + 12 * read(ifd, 2), 12) if at + 12 <= len(body) and read(at, 2) == 0xB002), None)
    if entry is None:
        return None
    size, at = read(entry + 4, 4), read(entry + 8, 4)
    if size % 16 or at + size > len(body):
        return None
    out = []
    for k in range(size // 16):
        length, offset = read(at + 16 * k + 4, 4), read(at + 16 * k + 8, 4)
        start = base + offset if offset else 0
        if start + length > len(content):
            return None
        out.append((start, length))
    apart = sorted(r for r in out[1:] if r[1])
    if any(a + n > b for (a, n), (b, _) in zip(apart, apart[1:], strict=False)):
        return None
    return out


def secondaries(content: bytes | None) -> list[bytes]:
    return [content[a : a + n] for a, n in (picture_ranges(content) or [])[1:]]


def is_gain_map(picture: bytes) -> bool:
    return any(n in picture for n in GAIN_MAP)


def signals_hdr(content: bytes | None) -> bool:
    """Whether a file says that it has a gain map: in a secondary picture, an ISO block or its own XMP."""
    iso = any(s.marker == APP2 and s.payload.startswith(ISO_GAIN_MAP) for s in segments(content))
    return iso or b"hdrgm:" in (content or b"") or any(map(is_gain_map, secondaries(content)))


def insert_segments(content: bytes, added: list[tuple[int, bytes]]) -> bytes | None:
    """content with segments after its leading APP0 and APP1 blocks; None where one is too long."""
    if any(len(p) > 65533 for _, p in added):
        return None
    at = leading(content)
    return content[:at] + b"".join(segment(m, p) for m, p in added) + content[at:]


def leading(content: bytes) -> int:
    """Where segments are put in: behind the leading APP0 and APP1 blocks."""
    at = 2
    for s in segments(content):
        if s.marker not in (APP0, APP1):
            break
        at = s.start + len(s.payload)
    return at


def attach(primary: bytes, pictures: list[bytes], iso: bytes | None = None) -> bytes | None:
    """primary with an index of pictures (and behind it an ISO block), followed by them; None where a block is too long."""
    n = 1 + len(pictures)
    size = 4 + 50 + 16 * n
    if size > 65533 or (iso is not None and len(iso) > 65533):
        return None
    behind = segment(APP2, iso) if iso else b""
    at = leading(primary)
    # the index tells places from its own header, behind marker, length and tag
    base, end = at + 8, len(primary) + 4 + size + len(behind)
    places = [end + sum(map(len, pictures[:k])) - base for k in range(len(pictures))]
    head = struct.pack(">2sHIH", b"MM", 42, 8, 3) + struct.pack(">HHI4s", 0xB000, 7, 4, b"0100") + struct.pack(">HHII", 0xB001, 4, 1, n) + struct.pack(">HHII", 0xB002, 7, 16 * n, 50) + struct.pack(">I", 0)
    listed = [(0x00030000, end, 0), *((0, len(p), place) for p, place in zip(pictures, places, strict=True))]
    index = MPF + head + b"".join(struct.pack(">IIIHH", kind, length, offset, 0, 0) for kind, length, offset in listed)
    return primary[:at] + segment(APP2, index) + behind + primary[at:] + b"".join(pictures)


def strip_keeping_display(content: bytes | None) -> tuple[bytes | None, str]:
    """A strip that keeps orientation and secondary pictures, and what became of the HDR rendition."""
    return strip_result(content)[:2]


def strip_result(content: bytes | None) -> tuple[bytes | None, str, int]:
    """strip_keeping_display with the error code: 1 where the file does not hold, 2 where a picture in it does not.

    A file with an index that does not hold, or with pictures that a new index cannot list, is refused, as they would be lost.
    """
    bare = strip(content)
    if bare is None or (picture_index(content) is not None and picture_ranges(content) is None):
        return None, "absent", 1
    turned = orientation(content)
    if turned != 1:
        bare = bare[:2] + orientation_segment(turned) + bare[2:]
    pictures = secondaries(content)
    told = lambda out: "preserved" if signals_hdr(out) else "dropped" if signals_hdr(content) else "absent"
    if not pictures:
        return bare, told(bare), 0
    cleaned = []
    for p in pictures:
        plain = strip(p)
        if plain is None:
            return None, "absent", 2
        described = [(s.marker, s.payload) for s in segments(p) if (s.marker == APP1 and s.payload.startswith(XMP)) or (s.marker == APP2 and s.payload.startswith(ISO_GAIN_MAP))]
        whole = insert_segments(plain, described)
        if whole is None:
            return None, "absent", 2
        cleaned.append(whole)
    iso = next((s.payload for s in segments(content) if s.marker == APP2 and s.payload.startswith(ISO_GAIN_MAP)), None)
    whole = attach(bare, cleaned, iso)
    if whole is None:
        return None, "absent", 2
    return whole, told(whole), 0
