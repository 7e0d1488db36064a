"""Packing token pieces into fixed-length sequences by first-fit decreasing.

Documents are tokenized and cut into pieces of at most `capacity` ids where they are read; only one short row per
piece (no ids) is shuffled. Pieces are dealt to randomised groups of bounded expected size, and each group is packed on
its own: pieces in decreasing length go to the first bin with room, found in a tournament tree over bin capacities in
logarithmic time. Neither a long document nor a group of equal documents can gather in one group, as the group is drawn
per piece.

Edge cases: a null or empty text is one piece that holds the end id only; a document longer than a sequence is cut at
multiples of the capacity; repeated rows are packed once each; an empty table gives no pieces; a null key stays null;
extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache
from typing import TYPE_CHECKING

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash, table

if TYPE_CHECKING:
    from tokenizers import Tokenizer

CAPACITY = 2048
#: Expected pieces of a group: it bounds a task's memory and is large enough to fill bins well.
GROUP_PIECES = 8192
END_ID = 1
#: Words and parts remembered per Python worker, and the longest one remembered. Those not met lately go first. Only
#: speed depends on them.
MEMORY = 100_000
MEMORY_LENGTH = 64
SLICE_CHARS = 500_000
#: Rows whose texts are Python objects at a time.
SLICE_ROWS = 256
#: Parts encoded at a time.
LOT = 256

#: For a tokenizer that normalizes and splits like this (fixed values) texts are cut into parts here: texts of these
#: characters only, as they are lower-cased alike everywhere and never composed. Other texts are cut into words.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
PLAIN = re.compile("[ \n!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
#: Letters, which no other alternative takes, come first.
PART = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^ \na-z0-9\u00df-\u00f6\u00f8-\u00ff]+")

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = PIECES + ", sequence_id long, offset long, sequence_tokens long, padded_tokens long"


class Memory:
    """Ids of words or parts: those met lately, and those met before them, which go unless they are met again."""

    def __init__(self):
        self.late: dict[str, bytes] = {}
        self.early: dict[str, bytes] = {}

    def missing(self, wanted: set[str]) -> list[str]:
        """Those of wanted that are not remembered; the others are in `late` from now on."""
        if len(self.late) > MEMORY // 2:
            self.late, self.early = {}, self.late
        unmet = wanted.difference(self.late)
        again = unmet.intersection(self.early)
        self.late.update((x, self.early.pop(x)) for x in again)
        return list(unmet.difference(again))


class WordTokenizer:
    """Ids of the tokenizers library, remembered per part or word for tokenizers that never merge across a space or line feed."""

    def __init__(self, path: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; read when a batch is encoded
        from tokenizers import Tokenizer

        with open(path) as f:
            steps = json.load(f)
        split = [s["pattern"].get("Regex", "") for s in steps["pre_tokenizer"]["pretokenizers"] if s["type"] == "Split" and s["behavior"] == "Removed" and s.get("invert")]
        self.by_word = any(r"[^\s\p{L}\p{N}]+" in p for p in split)  # white space is dropped and ends every token
        normalizers = [n["type"] for n in (steps.get("normalizer") or {}).get("normalizers", ())]
        self.by_part = split == [SPLIT] and normalizers == NORMALIZERS
        self.path = path
        # parts are normalized and split already, so the tokenizer of parts keeps only what comes after
        rest = [s for s in steps["pre_tokenizer"]["pretokenizers"] if s["type"] != "Split"]
        again = steps | {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, *rest]}}
        self.of_parts = Tokenizer.from_str(json.dumps(again)) if self.by_part else self.own
        self.words, self.parts = Memory(), Memory()
        suffix, known = steps["model"].get("end_of_word_suffix"), self.of_parts.get_vocab()
        self.ends = np.zeros(max(known.values(), default=0) + 1, bool)
        self.ends[[i for w, i in known.items() if suffix and w.endswith(suffix)]] = True

    @cached_property
    def own(self) -> Tokenizer:
        """The tokenizer as it is, loaded once a text needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _fresh(self, words: list[str], by: Tokenizer | None = None) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in (by or self.own).encode_batch_fast(words, add_special_tokens=False)]

    def _parts(self, parts: list[str]) -> list[bytes]:
        """Ids of each part, encoded many at a time: a part's last token, and no other, has the suffix of word ends."""
        found: list[bytes] = []
        lots = [parts[k : k + LOT] for k in range(0, len(parts), LOT)]
        for lot, ids in zip(lots, self._fresh([" ".join(lot) for lot in lots], self.of_parts), strict=True):
            stops = (np.flatnonzero(self.ends[np.frombuffer(ids, "<u4")]) + 1) * 4
            if len(stops) != len(lot) or stops[-1] != len(ids):
                found += self._fresh(lot)
                continue
            at = stops.tolist()
            found += [ids[a:b] for a, b in zip([0, *at], at, strict=False)]
        return found

    def _remembered(self, memory: Memory, held: list[list[str]], encode: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        """Ids of each list of words or parts; only those not remembered are encoded, all of them at a time."""
        fresh = memory.missing(set().union(*held))
        memory.late.update(zip(fresh, encode(fresh), strict=True))
        get = memory.late.__getitem__
        found = [b"".join(map(get, x)) for x in held]
        for x in fresh:
            if len(x) > MEMORY_LENGTH:
                del memory.late[x]
        return found

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids of each text as bytes of little-endian unsigned 32-bit integers."""
        a = 0
        while a < len(texts):
            b, size = a, 0
            while b < len(texts) and size < SLICE_CHARS:
                size += len(texts[b] or "")
                b += 1
            yield from self._slice(texts[a:b])
            a = b

    def _slice(self, texts: list[str | None]) -> Iterator[bytes]:
        if not self.by_word:
            yield from self._fresh([x or "" for x in texts])
            return
        # a text with a special token in it is cut into words only
        plain = [self.by_part and (not x or (PLAIN.fullmatch(x) is not None and "<|" not in x)) for x in texts]
        parts = iter(self._remembered(self.parts, [PART.findall(x.lower()) if x else [] for x, p in zip(texts, plain, strict=True) if p], self._parts))
        words = iter(self._remembered(self.words, [x.replace("\n", " ").split(" ") if x else [] for x, p in zip(texts, plain, strict=True) if not p], self._fresh))
        for p in plain:
            yield next(parts if p else words)


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def cut_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece of each document's ids with the end id: where it starts, its length and its checksum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end = tokenizer(tokenizer_path), np.array([end_id], "<u4").tobytes()
        context = TaskContext.get()
        seed, rows = (context.partitionId() if context else 0) << 40, 0
        for batch in (whole.slice(k, SLICE_ROWS) for whole in batches for k in range(0, whole.num_rows, SLICE_ROWS)):
            out: list[tuple] = []
            for key, ids in zip(batch.column(0).to_pylist(), own.encode(batch.column(1).to_pylist()), strict=True):
                ids += end
                n = len(ids) // 4
                for start in range(0, n, capacity):
                    piece = ids[start * 4 : (start + capacity) * 4]
                    out.append((key, start, len(piece) // 4, zlib.crc32(piece), n, seed + rows))
                    rows += 1
            columns = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "lot"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, PIECES + ", lot long")


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item. Items go in decreasing length to the first bin with room.

    The tournament tree's leaves are the bins' free capacities and each inner node holds the larger of its two; walking
    down from the root and preferring the left child finds the first bin with room.
    """
    n = len(lengths)
    leaves = 1 << max(0, (n - 1).bit_length())
    tree = [capacity] * (2 * leaves)
    bins, offsets = np.empty(n, np.int64), np.empty(n, np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        size, node = int(lengths[i]), 1
        while node < leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        bins[i], offsets[i] = node - leaves, capacity - tree[node]
        tree[node] -= size
        node //= 2
        while node:
            most = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == most:
                break
            tree[node] = most
            node //= 2
    return bins, offsets


def pack(pieces: DataFrame, n_pieces: int, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES, seed: int = 17) -> DataFrame:
    """pieces (PIECES and `lot`, a number of its own for each row) with the sequence and offset of each.

    padded_tokens is `capacity`, or the sequence's own length where that is a power of two.
    """
    groups = max(1, -(-n_pieces // group_pieces))

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("lot", kind="stable", ignore_index=True)
        bins, offsets = first_fit_decreasing(frame["length"].to_numpy(), capacity)
        used = np.bincount(bins, weights=frame["length"]).astype(np.int64)[bins]
        return frame.drop(columns=["lot", "pack_group"]).assign(sequence_id=(int(key[0]) << 32) + bins, offset=offsets, sequence_tokens=used, padded_tokens=np.where(used & (used - 1) == 0, used, capacity))

    dealt = pieces.withColumn("pack_group", F.pmod(F.xxhash64("lot", F.lit(seed)), F.lit(groups)))
    return dealt.groupBy("pack_group").applyInPandas(run, PACKED)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    pieces = stash(cut_pieces(docs, tokenizer_path, capacity), "pieces")
    return pack(pieces, pieces.count(), capacity)


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), word_bpe_path())


QUERIES = {"op5_packing": op5_packing}
ORACLES: dict[str, str] = {}
