r"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

A batch of texts is cut into words that no merge can cross. The words not seen before become one flat array of
symbol ids. Every round looks up the rank of each adjacent pair, takes the smallest rank in each word (a segmented
minimum), merges the leftmost non-overlapping pairs of that rank in all words at once, and compacts the array; words
without a pair leave it. Merging several equal pairs of a word in one round is the same as merging them one after
another unless a merge creates a pair that ranks at least as high; such words merge their leftmost pair only.

Edge cases: a null text is encoded as the empty text (no ids, decoded to ""); very long texts and texts without any
white space are handled whole; unknown characters become byte pieces; repeated rows give repeated results; an empty table gives an empty result; extra
columns are never looked at by the digest query and are passed through by `encode` and `decode`.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
NO_PAIR = np.int32(2**30)
#: Words remembered per Python worker, and the longest word remembered. Only speed depends on them.
MEMORY_WORDS = 300_000
MEMORY_LENGTH = 64
#: Characters of text whose new words are merged together.
SLICE_CHARS = 4_000_000


class PieceBpe:
    """Encoder and decoder for one SentencePiece BPE model with byte fallback and a dummy prefix."""

    def __init__(self, model_path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = sp.vocab_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        normal = [not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in range(n)]
        if any(sp.is_unused(i) for i in range(n)):
            raise ValueError("models with unused pieces need re-segmentation, which is not supported")
        self.byte_ids = np.full(256, -1, np.int32)
        for i in range(n):
            if sp.is_byte(i):
                self.byte_ids[int(pieces[i][3:5], 16)] = i
        if (self.byte_ids < 0).any():
            raise ValueError("the model has no byte fallback")
        symbols = {p: i for i, p in enumerate(pieces) if normal[i]}
        for p in [p for p, ok in zip(pieces, normal, strict=True) if ok]:
            for ch in p:
                symbols.setdefault(ch, len(symbols) + n)  # a character of some piece that is none itself
        self.n, self.width = n, max(symbols.values()) + 1
        self.char_symbol = np.full(0x110000, -1, np.int32)
        for p, i in symbols.items():
            if len(p) == 1:
                self.char_symbol[ord(p)] = i
        scores = np.array([sp.get_score(i) for i in range(n)])
        order = {s: r for r, s in enumerate(sorted(set(scores[np.array(normal)]), reverse=True))}
        pairs = {}
        for i, p in enumerate(pieces):
            if normal[i]:
                for cut in range(1, len(p)):
                    left, right = symbols.get(p[:cut]), symbols.get(p[cut:])
                    if left is not None and right is not None:
                        pairs[left * self.width + right] = (order[scores[i]], i)
        self._hash_pairs(pairs)
        # A word is a run of spaces and what follows up to the next space, if no piece has a space after another
        # character; a line feed stands alone if no piece holds one.
        crossing = any(SPACE in p.lstrip(SPACE) for p, ok in zip(pieces, normal, strict=True) if ok)
        newline = any("\n" in p for p, ok in zip(pieces, normal, strict=True) if ok)
        self.words = re.compile(r".+" if crossing else rf"{SPACE}*[^{SPACE}]+|{SPACE}+" if newline else rf"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+", re.S)
        self.memory: dict[str, bytes] = {}
        self.decimal = [str(i) for i in range(n)]
        raw = []
        for i, p in enumerate(pieces):
            raw.append(bytes([int(p[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else " ⁇ ".encode() if sp.is_unknown(i) else p.replace(SPACE, " ").encode())
        self.raw, self.is_byte = raw, np.array([sp.is_byte(i) for i in range(n)])
        self.raw_length = np.array([len(x) for x in raw], np.int64)
        self.raw_start = np.concatenate([[0], np.cumsum(self.raw_length)[:-1]])
        self.raw_bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.starts_space = np.array([normal[i] and p.startswith(SPACE) for i, p in enumerate(pieces)])

    def _hash_pairs(self, pairs: dict[int, tuple[int, int]]) -> None:
        """An open-addressed table, filled and read with whole arrays."""
        bits = max(10, int(np.ceil(np.log2(len(pairs) * 8 + 1))))
        self.shift, self.slots = np.uint64(64 - bits), 1 << bits
        self.keys = np.full(self.slots, -1, np.int64)
        self.ranks = np.full(self.slots, NO_PAIR, np.int32)
        self.merged = np.full(self.slots, -1, np.int32)
        keys = np.fromiter(pairs, np.int64, len(pairs))
        values = np.array(list(pairs.values()), np.int32).reshape(-1, 2)
        at = self._slot(keys)
        while len(keys):
            free = self.keys[at] < 0
            first = np.zeros(len(keys), bool)
            first[np.unique(at, return_index=True)[1]] = True
            put = free & first
            self.keys[at[put]], self.ranks[at[put]], self.merged[at[put]] = keys[put], values[put, 0], values[put, 1]
            keys, values, at = keys[~put], values[~put], (at[~put] + 1) % self.slots

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair and what it merges to; symbol -1 pairs with nothing."""
        keys = left.astype(np.int64) * self.width + right
        keys[(left < 0) | (right < 0)] = -2
        at = self._slot(keys)
        found = self.keys[at]
        rank = np.where(found == keys, self.ranks[at], NO_PAIR)
        merged = np.where(found == keys, self.merged[at], -1)
        todo = np.flatnonzero((found != keys) & (found >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) % self.slots
            found = self.keys[at[todo]]
            hit = found == keys[todo]
            rank[todo[hit]], merged[todo[hit]] = self.ranks[at[todo[hit]]], self.merged[at[todo[hit]]]
            todo = todo[~hit & (found >= 0)]
        return rank, merged

    def merge_words(self, words: list[str]) -> list[bytes]:
        """The ids of each non-empty word, as bytes of 32-bit integers."""
        if not words:
            return []
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        length = np.fromiter(map(len, words), np.int64, len(words))
        sym, word = self.char_symbol[points], np.arange(len(words))
        # Symbols that stay single and unknown are written as bytes, so each symbol remembers its first character.
        at = np.arange(len(sym))
        start = np.concatenate([[0], np.cumsum(length)[:-1]])
        rank, into = np.full(len(sym), NO_PAIR), np.full(len(sym), -1, np.int32)
        inner = np.ones(len(sym), bool)
        inner[start + length - 1] = False
        inner = np.flatnonzero(inner)
        rank[inner], into[inner] = self._look_up(sym[inner], sym[inner + 1])
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        while len(word):
            least = np.minimum.reduceat(rank, start)
            over = least == NO_PAIR
            if over.any():
                gone = np.repeat(over, length)
                done.append((word[over], length[over], sym[gone], at[gone]))
                keep = ~gone
                sym, at, rank, into = sym[keep], at[keep], rank[keep], into[keep]
                word, length, least = word[~over], length[~over], least[~over]
                if not len(word):
                    break
                start = np.concatenate([[0], np.cumsum(length)[:-1]])
            of = np.repeat(np.arange(len(word)), length)
            pick = rank == least[of]
            # in a run of overlapping pairs, every second one from the left
            i = np.arange(len(sym))
            head = pick.copy()
            head[1:] &= ~pick[:-1]
            pick &= (i - np.maximum.accumulate(np.where(head, i, 0))) % 2 == 0
            p = np.flatnonzero(pick)
            new, w = into[p], of[p]
            first, end = start[w], start[w] + length[w]
            right_at = np.minimum(p + 2, len(sym) - 1)
            right_rank, right_into = self._look_up(new, np.where(p + 2 < end, sym[right_at], -1))
            after = np.zeros(len(p), bool)  # the symbol to the left was made by the previous merge
            after[1:] = p[:-1] == p[1:] - 2
            after &= p - 2 >= first
            left_sym = np.where(p - 1 >= first, sym[np.maximum(p - 1, 0)], -1)
            left_sym[after] = new[np.flatnonzero(after) - 1]
            left_rank, left_into = self._look_up(left_sym, new)
            early = np.minimum(left_rank, right_rank) <= least[w]
            if early.any():
                one = np.zeros(len(word), bool)
                one[w[early]] = True
                lead = np.ones(len(p), bool)
                lead[1:] = w[1:] != w[:-1]
                keep = lead | ~one[w]
                p, new, w, after = p[keep], new[keep], w[keep], after[keep]
                right_rank, right_into, left_rank, left_into = right_rank[keep], right_into[keep], left_rank[keep], left_into[keep]
                first = first[keep]
            sym[p] = new
            rank[p], into[p] = right_rank, right_into
            has_left = p - 1 >= first
            to = np.where(after, p - 2, p - 1)[has_left]
            rank[to], into[to] = left_rank[has_left], left_into[has_left]
            keep = np.ones(len(sym), bool)
            keep[p + 1] = False
            sym, at, rank, into = sym[keep], at[keep], rank[keep], into[keep]
            length = length - np.bincount(w, minlength=len(word))
            start = np.concatenate([[0], np.cumsum(length)[:-1]])
        out: list[bytes] = [b""] * len(words)
        for ids, lengths, symbols, places in done:
            ends = np.cumsum(lengths)
            odd = (symbols < 0) | (symbols >= self.n)
            odd_word = np.zeros(len(ids), bool)
            odd_word[np.searchsorted(ends, np.flatnonzero(odd), "right")] = True
            flat = symbols.astype("<i4").tobytes()
            a = 0
            for k, b, bad in zip(ids.tolist(), (ends * 4).tolist(), odd_word.tolist(), strict=True):
                out[k] = self._with_bytes(symbols[a // 4 : b // 4], points[places[a // 4 : b // 4]]) if bad else flat[a:b]
                a = b
        return out

    def _with_bytes(self, symbols: np.ndarray, characters: np.ndarray) -> bytes:
        ids: list[int] = []
        for s, c in zip(symbols.tolist(), characters.tolist(), strict=True):
            ids += [s] if 0 <= s < self.n else self.byte_ids[np.frombuffer(chr(c).encode("utf-8", "replace"), np.uint8)].tolist()
        return np.array(ids, "<i4").tobytes()

    def encode(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text, in order, without begin or end ids."""
        held: list[list[str]] = []
        size = 0
        for text in texts:
            held.append(self.words.findall(SPACE + text.replace(" ", SPACE)) if text else [])
            size += len(text or "")
            if size > SLICE_CHARS:
                yield from self._encode_words(held)
                held, size = [], 0
        yield from self._encode_words(held)

    def _encode_words(self, held: list[list[str]]) -> Iterator[np.ndarray]:
        if len(self.memory) > MEMORY_WORDS:
            self.memory.clear()
        new: set[str] = set()
        for words in held:
            new.update(set(words).difference(self.memory))
        fresh = list(new)
        self.memory.update(zip(fresh, self.merge_words(fresh), strict=True))
        get = self.memory.__getitem__
        for words in held:
            yield np.frombuffer(b"".join(map(get, words)), "<i4")
        for w in fresh:
            if len(w) > MEMORY_LENGTH:
                del self.memory[w]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; a leading space from the dummy prefix is dropped."""
        ids = np.asarray(ids, np.int64)
        length = self.raw_length[ids]
        total = int(length.sum())
        if not total:
            return ""
        shift = self.raw_start[ids] - np.concatenate([[0], np.cumsum(length)[:-1]])
        out = self.raw_bytes[np.arange(total) + np.repeat(shift, length)].tobytes()
        lead = bool(self.starts_space[ids[np.argmax(length > 0)]])
        if length.all():
            try:
                return out[lead:].decode()
            except UnicodeDecodeError:
                pass
        return self._decode_slowly(ids.tolist(), lead)

    def _decode_slowly(self, ids: list[int], lead: bool) -> str:
        """Runs of byte pieces may not be UTF-8; each byte that is none becomes U+FFFD."""
        parts, run = [], bytearray()
        for i in [*ids, None]:
            if i is not None and self.is_byte[i]:
                run += self.raw[i]
                continue
            k = 0
            while k < len(run):
                for size in (1, 2, 3, 4):
                    try:
                        parts.append(run[k : k + size].decode())
                        k += size
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    parts.append("�")
                    k += 1
            run.clear()
            if i is not None:
                parts.append(self.raw[i].decode())
        return "".join(parts)[lead:]


@lru_cache(maxsize=2)
def codec(model_path: str) -> PieceBpe:
    """One codec per Python worker and model."""
    return PieceBpe(model_path)


def encode(df: DataFrame, model_path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with the ids of column text as an array column."""

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(model_path)
        for batch in batches:
            yield pd.Series(list(own.encode(None if pd.isna(x) else x for x in batch)), dtype=object)

    return df.withColumn(ids, run(F.col(text).cast("string")))


def decode(df: DataFrame, model_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with the text of the id array (null array: empty) as a string column."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(model_path)
        for batch in batches:
            yield pd.Series(["" if x is None else own.decode(x) for x in batch], dtype=object)

    return df.withColumn(text, run(F.col(ids)))


def encode_digests(df: DataFrame, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_tokens, and SHA-256 digests of the ids and of the text decoded from them.

    Encodes and decodes as `encode` and `decode` do, in one pass without sending the ids back to the JVM.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        for batch in batches:
            n, of_ids, of_text = [], [], []
            for ids in own.encode(batch.column(1).to_pylist()):
                n.append(len(ids))
                of_ids.append(hashlib.sha256(",".join(map(own.decimal.__getitem__, ids.tolist())).encode()).hexdigest())
                of_text.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op1_sentencepiece(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import table

    return encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op1_sentencepiece": op1_sentencepiece}
ORACLES: dict[str, str] = {}
