"""Terms of whole texts, found over the flat bytes of an Arrow column.

A term is a maximal run of bytes that a table of 256 entries keeps. As all classes here differ in ASCII characters only
and keep every byte of longer UTF-8 sequences, runs of bytes are runs of characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are split at a time; a longer text is split by itself.
SLICE_BYTES = 4 << 20
#: Distinct rows that a task holds before it hands them on.
HELD_ROWS = 1 << 19


def _folded(kept: bytes) -> np.ndarray:
    table = np.zeros(256, np.uint8)
    table[list(kept)] = list(kept.lower())
    return table


_LETTERS, _HIGH = bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)), bytes(range(0x80, 0x100))
#: What each byte becomes: itself, A-Z in lower case, and 0 where a term ends.
LETTERS, ALNUM = _folded(_LETTERS + _HIGH), _folded(_LETTERS + _HIGH + bytes(range(0x30, 0x3A)))


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of strings and the offsets of its rows in them; a null is empty."""
    texts = pc.fill_null(texts, "").cast(pa.string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    return (np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data else np.empty(0, np.uint8)), at - at[0]


def slices(batches: Iterator[pa.RecordBatch], column: int, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Batches whose texts have `most` bytes (SLICE_BYTES) at most, or one row."""
    most = most or SLICE_BYTES
    for batch in batches:
        ends = np.cumsum(np.diff(flat(batch.column(column))[1].astype(np.int64)))
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(ends, most + (ends[a - 1] if a else 0), "right")))
            yield batch.slice(a, b - a)
            a = b


def split(texts: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """For each term in order: its row and its number in the third, the distinct terms."""
    data, offsets = flat(texts)
    folded = table[data]
    inside = folded != 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < len(data)]
    begins[first] = inside[first]
    starts = np.flatnonzero(begins)
    kept = folded[inside]
    ends = np.append((np.cumsum(inside, dtype=np.int32)[starts] - 1), len(kept)).astype(np.int32)
    row = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(np.searchsorted(starts, offsets)))
    found = pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(kept)).dictionary_encode()
    return row, found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


class Sums:
    """Sums by key that a task has gathered so far, handed on in batches before they grow beyond HELD_ROWS."""

    def __init__(self, keys: list[str], sums: list[str]) -> None:
        self.keys, self.sums, self.parts, self.rows = keys, sums, [], 0

    def add(self, *columns: pa.Array) -> Iterator[pa.RecordBatch]:
        part = pa.table(list(columns), [*self.keys, *self.sums])
        self.parts.append(part)
        self.rows += part.num_rows
        if self.rows > HELD_ROWS:
            held = self._merged()
            self.parts, self.rows = [held], held.num_rows
            if self.rows > HELD_ROWS // 2:
                yield from self.rest()

    def _merged(self) -> pa.Table:
        held = pa.concat_tables(self.parts).group_by(self.keys, use_threads=False).aggregate([(c, "sum") for c in self.sums])
        return held.select([*self.keys, *[f"{c}_sum" for c in self.sums]]).rename_columns([*self.keys, *self.sums])

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            yield from self._merged().combine_chunks().to_batches(max_chunksize=1 << 16)
        self.parts, self.rows = [], 0
