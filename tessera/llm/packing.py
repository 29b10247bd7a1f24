"""Packing documents into token windows by dynamic programming over cut points.

The tokens of all documents of a partition, in the order in which they are read, form one line. It is cut into windows of at
most ``window`` tokens. Cuts lie at document ends, at sentence ends and, where sentences are long, at plain positions. With

    cost(i, j) = padding of the window (i, j] + penalty of cutting at j + ``per_window``

the least total cost is best[j] = min over i of best[i] + cost(i, j). Padding is ``window - (j - i)``, so the minimum over
the last ``window`` positions is that of best[i] + i, which a monotone queue gives in constant time. A window whose length is a
power of two is not padded; those few transitions are looked up beside the queue.

No shuffle: each partition packs its own line, so a run costs at most one unfilled window for each partition, and the
tail of a partition may be cut anywhere, into unpadded powers of two. Memory is bounded by ``block`` tokens and the longest
document: a block is solved, its windows but for the last few are given out, and the rest is solved anew with what follows.
"""

from __future__ import annotations

import functools
import json
import zlib
from array import array
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .bpe import WordCache
from .common import slices, texts_of

#: Columns of ``pack``.
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class FileEncoder:
    """Texts to ids as the tokenizers library gives them for a byte-level BPE file, without added special tokens.

    Texts that hold the string of a special token, or characters outside the fast split, go to the library whole. For the
    others each distinct word is merged once, by the file's own vocabulary.
    """

    def __init__(self, path: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        letters = sorted(pre_tokenizers.ByteLevel.alphabet())
        # the printable stand-ins of bytes, as byte-level BPE files write them
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        assert letters == sorted(byte_of)
        vocab = spec["model"]["vocab"]
        ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if t not in self.special}
        one = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.cache = WordCache(pattern, one=lambda word: array("I", one(word)).tobytes())
        #: Whether a sentence may end after the id.
        self.ends = np.zeros(max(self.library.get_vocab_size(), max(vocab.values()) + 1), bool)
        for token, i in ranks.items():
            self.ends[i] = token.endswith((b".", b"!", b"?", "。".encode())) or b"\n" in token

    def encode(self, texts: list[str]) -> list[bytes]:
        odd = [bool(self.cache.OTHER.search(t)) or any(s in t for s in self.special) for t in texts]
        some = iter(self.cache.encode([t for t, o in zip(texts, odd, strict=True) if not o]))
        return [np.array(self.library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() if o else next(some) for t, o in zip(texts, odd, strict=True)]


@functools.lru_cache(maxsize=2)
def file_encoder(path: str, pattern: str) -> FileEncoder:
    """One for each Python worker."""
    return FileEncoder(path, pattern)


def best_cuts(cuts: np.ndarray, penalty: np.ndarray, window: int, per_window: float) -> list[int]:
    """Indices of the cuts of the cheapest way from ``cuts[0]`` to ``cuts[-1]``; neighbours lie at most ``window`` apart."""
    at, fee = cuts.tolist(), penalty.tolist()
    exact: dict[int, list[int]] = {}
    for k in range(window.bit_length()):
        if (size := 1 << k) < window:
            place = np.minimum(np.searchsorted(cuts, cuts - size), len(cuts) - 1)
            for j in np.flatnonzero(cuts[place] == cuts - size).tolist():
                exact.setdefault(j, []).append(int(place[j]))
    best, back = [0.0] * len(at), [0] * len(at)
    queue, keys = deque([0]), [float(at[0])] * len(at)
    for j in range(1, len(at)):
        p = at[j]
        while p - at[queue[0]] > window:
            queue.popleft()
        i = queue[0]
        cost = keys[i] + window - p
        for e in exact.get(j, ()):
            if best[e] < cost:
                cost, i = best[e], e
        best[j], back[j] = cost + fee[j] + per_window, i
        keys[j] = key = best[j] + p
        while queue and keys[queue[-1]] >= key:
            queue.pop()
        queue.append(j)
    path, j = [], len(at) - 1
    while j:
        path.append(j)
        j = back[j]
    return path[::-1]


class Packer:
    """One line of documents; ``add`` and ``finish`` yield rows (doc_id, start, length, ids, doc_tokens, window number, offset)."""

    def __init__(self, ends: np.ndarray, window=2048, sentence=4.0, plain=24.0, per_window=16.0, gap=128, block=1 << 18, keep=8):
        self.ends, self.window, self.fees, self.per_window, self.gap, self.block, self.keep = ends, window, (sentence, plain), per_window, gap, block, keep
        self.docs: deque = deque()  # (doc_id, ids not yet given out, start of those, tokens of the document)
        self.held = self.number = 0

    def add(self, doc_id, ids: np.ndarray):
        self.docs.append((doc_id, ids, 0, len(ids)))
        self.held += len(ids)
        if self.held >= self.block:
            yield from self._solve(False)

    def finish(self):
        yield from self._solve(True)

    def _solve(self, last: bool):
        if not self.held:
            return
        line = np.concatenate([d[1] for d in self.docs])
        n = len(line)
        stops = np.cumsum([len(d[1]) for d in self.docs])
        ends = self.ends[line]
        after = np.flatnonzero(ends[:-1] & ~ends[1:]) + 1
        cuts = np.unique(np.concatenate([[0], stops, after]))
        wide = np.flatnonzero(np.diff(cuts) > self.gap)
        more = [np.arange(cuts[i] + self.gap, cuts[i + 1], self.gap) for i in wide]
        if last:
            more.append(np.arange(max(0, n - self.window), n))
        sure = np.isin(cuts, stops)
        fee = dict(zip(cuts.tolist(), np.where(sure, 0.0, self.fees[0]).tolist(), strict=True))
        cuts = np.unique(np.concatenate([cuts, *more]))
        penalty = np.array([fee.get(c, self.fees[1]) for c in cuts.tolist()])
        path = cuts[best_cuts(cuts, penalty, self.window, self.per_window)].tolist()
        if not last:
            path = path[: max(1, len(path) - self.keep)]
        begin = 0
        for end in path:
            offset = 0
            while begin < end:
                doc, ids, start, total = self.docs[0]
                take = min(len(ids), end - begin)
                yield doc, start, take, ids[:take].tobytes(), total, self.number, offset
                begin, offset = begin + take, offset + take
                if take == len(ids):
                    self.docs.popleft()
                else:
                    self.docs[0] = (doc, ids[take:], start + take, total)
            self.number += 1
        self.held = n - path[-1]


def pack(docs: DataFrame, path: str, pattern: str, *, end_id: int = 1, window: int = 2048, digest: bool = False) -> DataFrame:
    """One row for each piece of each document: ``SCHEMA``; with ``digest``, ids_crc32 long stands in place of ids.

    A document is its text's ids and then ``end_id``; a null or empty text is ``end_id`` alone. A document longer than
    a window takes several. Repeated rows are packed each by itself, a null doc_id stays null; an empty table gives no row.
    Only doc_id and text are read, so other columns can't clash. sequence_id is the partition's number and the window's
    within it, the same whenever a lost task is run again.
    """

    def run(batches):
        encoder = file_encoder(path, pattern)
        first, stop, rows = TaskContext.get().partitionId() << 33, np.array([end_id], "<u4").tobytes(), []
        packer = Packer(encoder.ends, window)

        def out():
            doc, start, length, ids, total, number, offset = zip(*rows, strict=True)
            ids = pa.array(map(zlib.crc32, ids), pa.int64()) if digest else pa.array(ids, pa.binary())
            long = lambda x: pa.array(x, pa.int64())
            rows.clear()
            return pa.RecordBatch.from_arrays([long(doc), long(start), long(length), ids, long(total), long([first + x for x in number]), long(offset)], names)

        for b in slices(batches):
            for doc, ids in zip(b.column("doc_id").to_pylist(), encoder.encode(texts_of(b, "text")), strict=True):
                rows.extend(packer.add(doc, np.frombuffer(ids + stop, "<u4")))
            if len(rows) >= 2000:
                yield out()
        rows.extend(packer.finish())
        if rows:
            yield out()

    schema = SCHEMA.replace("ids binary", "ids_crc32 long") if digest else SCHEMA
    names = [x.split()[0] for x in schema.split(", ")]
    return docs.select("doc_id", "text").mapInArrow(run, schema)
