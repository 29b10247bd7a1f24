"""Byte-level BPE: encoding by ranks in numpy, decoding, and a unit cache in front of either encoder.

``MatrixBpe`` puts words of similar byte length as rows of a padded matrix. In each round every row merges its
leftmost pair of least rank; pair ranks come from an open-addressing hash table in numpy arrays, and rows that
have no pair left are compacted away. Words longer than ``LONGEST`` bytes would make the matrix wide for few rows;
they are merged by the same rule over a heap.

Words repeat, so a bounded cache stands before the matrices: each distinct word of a slice is merged once.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import slices, texts_of

NONE = np.int32(2**31 - 1)
LONGEST = 128
#: Byte lengths up to which words share a matrix.
BUCKETS = (4, 6, 8, 10, 12, 16, 24, 32, 64, LONGEST)


def read_ranks(path: str) -> dict[bytes, int]:
    """token bytes -> rank, from a rank file (base64 token, blank, rank on each line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PairTable:
    """(left id, right id) -> id of the merged token, by multiplicative hashing with linear probing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(len(keys) * 2.5).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int32)
        at, left, self.probes = self._home(keys), np.arange(len(keys)), 1
        while len(left):
            slot = at[left]
            free = self.keys[slot] == -1
            _, winner = np.unique(slot[free], return_index=True)
            take = left[free][winner]
            self.keys[at[take]], self.values[at[take]] = keys[take], values[take]
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & self.mask
            self.probes += bool(len(left))

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        at = self._home(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], NONE)
        open_ = np.flatnonzero((found != keys) & (found != -1))
        for _ in range(self.probes):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & self.mask
            found = self.keys[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out


class MatrixBpe:
    """Ranks as in a rank file; every single byte must have one."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = dict(map(reversed, ranks.items()))
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[(left << 32) | right] = rank
        self.pairs = PairTable(np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int32))
        self.pair_dict = pairs

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """For each word its ids as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        by: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if (whole := self.ranks.get(w)) is not None:
                out[i] = whole.to_bytes(4, "little")
            elif len(w) > LONGEST:
                out[i] = self._long(w)
            elif w:
                by.setdefault(next(b for b in BUCKETS if len(w) <= b), []).append(i)
        for width, rows in by.items():
            for at in range(0, len(rows), step := max(1, 1_000_000 // width)):
                self._bucket(words, rows[at : at + step], width, out)
        return out

    def _bucket(self, words, rows, width, out) -> None:
        raw = np.frombuffer(b"".join(words[i].ljust(width, b"\0") for i in rows), np.uint8).reshape(-1, width)
        length = np.array([len(words[i]) for i in rows])
        ids = self.single[raw]
        ids[np.arange(width) >= length[:, None]] = -1
        rank = np.full(ids.shape, NONE, np.int32)
        rank[:, :-1] = self.pairs.get(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(-1, width - 1)
        rank[:, :-1][ids[:, 1:] < 0] = NONE
        where = np.array(rows)
        while True:
            at = rank.argmin(1)  # the first of the least: leftmost
            best = rank[np.arange(len(at)), at]
            done = best == NONE
            if done.any():
                kept = ids[done].astype("<u4")
                n = (ids[done] >= 0).sum(1)
                for k, (i, m) in enumerate(zip(where[done], n, strict=True)):
                    out[i] = kept[k, :m].tobytes()
                go = ~done
                ids, rank, where, at, best = ids[go], rank[go], where[go], at[go], best[go]
                if not len(where):
                    return
            r = np.arange(len(at))
            ids[r, at] = best
            move = np.arange(ids.shape[1] - 1)
            move = move + (move > at[:, None])
            ids, rank = np.take_along_axis(ids, move, 1), np.take_along_axis(rank, move, 1)
            if ids.shape[1] == 1:
                rank[:] = NONE
                continue
            # the two pairs that the new token is part of
            next_ = ids[r, np.minimum(at + 1, ids.shape[1] - 1)]
            new = self.pairs.get(best, np.maximum(next_, 0))
            rank[r, at] = np.where((at + 1 < ids.shape[1]) & (next_ >= 0), new, NONE)
            has = np.flatnonzero(at > 0)
            rank[has, at[has] - 1] = self.pairs.get(ids[has, at[has] - 1], best[has])

    def _long(self, word: bytes) -> bytes:
        ids = [int(x) for x in self.single[np.frombuffer(word, np.uint8)]]
        n = len(ids)
        after, before, get = [*range(1, n), -1], [-1, *range(n - 1)], self.pair_dict.get
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get((ids[i] << 32) | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else -1
            if j < 0 or ids[j] != b:
                continue  # one of the two has been merged meanwhile
            ids[i], ids[j] = r, -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
                if (s := get((r << 32) | ids[after[i]])) is not None:
                    heapq.heappush(heap, (s, i, r, ids[after[i]]))
            if (p := before[i]) >= 0 and (s := get((ids[p] << 32) | r)) is not None:
                heapq.heappush(heap, (s, p, ids[p], r))
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def decode(self, ids: bytes) -> bytes:
        """The bytes behind ids; a KeyError for an id that the ranks don't have."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class _Held(dict):
    """Ids of words; with ``one`` (a word -> its id bytes) a word that is not held is encoded when asked for."""

    one = None

    def __missing__(self, word: str) -> bytes:
        self[word] = ids = self.one(word)
        return ids


class WordCache:
    """Texts to ids word by word, where a word is a match of the split pattern.

    Either ``encode_words`` (list of words -> list of id bytes) or ``one`` (word -> id bytes) is given. Ids of words are
    held, and let go when ``limit`` words are.
    ``FAST`` equals the split pattern on texts of ASCII, Latin letters and common punctuation, and takes a quarter
    of the time of full Unicode classes; any other text goes through ``full``.
    """

    LETTERS, DIGITS = "A-Za-zªµºÀ-ÖØ-öø-ʯ", "0-9²³¹¼½¾"
    FAST = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{DIGITS}]+| ?[^\s{LETTERS}{DIGITS}]+|\s+(?!\S)|\s+")
    OTHER = re.compile(r"[^\x00-\x1b -ʯ‘-„–—•…]")

    def __init__(self, pattern: str, encode_words=None, one=None, limit: int = 300_000):
        self.encode_words, self.full, self.limit, self.held = encode_words, regex.compile(pattern), limit, _Held()
        self.held.one = one

    def split(self, text: str) -> list[str]:
        return (self.full if self.OTHER.search(text) else self.FAST).findall(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        parts, held = [self.split(t) for t in texts], self.held
        if held.one:
            if len(held) > self.limit:
                held.clear()
            return [b"".join(map(held.__getitem__, p)) for p in parts]
        missing = set().union(*parts) - held.keys()
        if len(held) + len(missing) > self.limit:
            held.clear()
            missing = set().union(*parts)
        if missing:
            missing = list(missing)
            held.update(zip(missing, self.encode_words(missing), strict=True))
        return [b"".join(map(held.__getitem__, p)) for p in parts]


class RankEncoder:
    """Texts to ids by a rank file and the split pattern, without special tokens."""

    def __init__(self, path: str, pattern: str):
        self.bpe = MatrixBpe(read_ranks(path))
        self.cache = WordCache(pattern, lambda words: self.bpe.encode_words([w.encode() for w in words]))

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.cache.encode(texts)


@functools.lru_cache(maxsize=2)
def rank_encoder(path: str, pattern: str) -> RankEncoder:
    """One for each Python worker."""
    return RankEncoder(path, pattern)


def encode_decode(docs: DataFrame, path: str, pattern: str, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, then ids binary (little-endian unsigned 32-bit) and decoded binary (the ids' bytes).

    Row by row, without a shuffle. A null text counts as empty: no ids. Repeated rows stay repeated. Columns of
    ``docs`` other than ``keep`` and the text aren't read, so their names can't clash.
    """

    def run(batches):
        encoder = rank_encoder(path, pattern)
        for b in slices(batches):
            ids = encoder.encode(texts_of(b, text))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(ids, pa.binary()), pa.array(map(encoder.bpe.decode, ids), pa.binary())], [*keep, "ids", "decoded"])

    fields = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    return docs.select(*keep, text).mapInArrow(run, f"{fields}, ids binary, decoded binary")


def encode_digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of ``encode_decode``; the digests are taken where the ids are made."""

    def run(batches):
        encoder = rank_encoder(path, pattern)
        for b in slices(batches):
            ids = encoder.encode(texts_of(b, "text"))
            sha = lambda x: hashlib.sha256(x).hexdigest()
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(map(sha, ids)), pa.array(sha(encoder.bpe.decode(x)) for x in ids)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
