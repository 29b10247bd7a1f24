"""Cross-entropy difference of two word bigram models with one vocabulary.

The background model counts all documents, the target model those named as targets; both over whole texts, with the same order, smoothing
and vocabulary. Every word (lower-cased in A-Z, split at white space) and every pair of words has a count of its own, under a key of 63
bits, so the tables grow with the corpus. With c the counts and N their sum over the V distinct words of the corpus,

    p(w) = (c(w) + 1) / (N + V)        p(w | v) = (c(v, w) + prior p(w)) / (c(v) + prior)

where v is the word before, or the start of the text. A document's score is the mean over its words of the target model's loss minus the
background model's, in bits: below zero where it reads more like the target than the corpus does.

Documents are packed in chunks. A chunk gives each of its keys once with its counts, by ranges of keys; the number of ranges grows with
the corpus, so a range holds about ``KEYS`` of them. A range adds up the counts of all chunks and answers each chunk in the order of its
keys; the chunk meets its answers and scores its documents. Only sums are gathered,
and only the places of targets broadcast, up to a checked count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _ODD, materialize, mix, slices, word_hashes

PRIOR = 50.0
CHUNK_BYTES, CHUNK_ROWS, HASHED_CHARS, KEYS = 4_000_000, 100_000, 500_000, 4_000_000
#: Places of targets that are broadcast at most (four bytes each); more are joined by a shuffle of the chunks.
BROADCAST_TARGETS = 4_000_000
#: Keys of words and of the start are odd, those of pairs even.
START, ODD = np.uint64(1), np.uint64(1)
PACKED = "chunk long, ids array<long>, sizes binary, bytes long, texts binary"
GIVEN = "bucket int, chunk long, keys binary, background binary, target binary"
ANSWER = "chunk long, bucket int, background binary, target binary, vocabulary long, n_background long, n_target long"
SCORES = "doc_id long, n_words long, target_loss double, background_loss double, score double"


def events(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys of the words, keys of the words before, keys of the pairs, words of each text)."""
    parts, at, size = [], 0, 0
    for k, t in enumerate(texts, 1):  # hashing takes many times the bytes of its texts
        size += len(t)
        if size >= HASHED_CHARS or k == len(texts):
            parts.append(word_hashes(texts[at:k]))
            at, size = k, 0
    w, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    w |= ODD
    v = np.empty_like(w)
    v[1:] = w[:-1]
    some = counts[counts > 0]
    v[np.cumsum(some) - some] = START
    return w, v, mix(v * _ODD + w) & ~ODD, counts


def planes(x: np.ndarray) -> bytes:
    """64-bit integers byte by byte, compressed: the bytes that are mostly 0 stand together."""
    return len(x).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T.tobytes(), "zstd", asbytes=True)


def from_planes(x: bytes, kind=np.int64) -> np.ndarray:
    raw = pa.decompress(x[8:], 8 * int.from_bytes(x[:8], "little"), "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(kind).ravel()


def packed(docs: DataFrame) -> DataFrame:
    """Rows of (doc_id, text) in chunks."""

    def run(batches):
        ids, texts, size, made, codec = [], [], 0, 0, pa.Codec("zstd", compression_level=9)

        def chunk():
            raw = b"".join(texts)
            row = ((TaskContext.get().partitionId() << 32) + made, ids, np.array([len(t) for t in texts], np.int64).tobytes(), len(raw), codec.compress(raw, asbytes=True))
            types = (pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], [x.split()[0] for x in PACKED.split(", ")])

        for b in slices(batches, 1024, 4_000_000):
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids.append(i)
                texts.append((t or "").encode("utf-8", "surrogatepass"))
                size += len(texts[-1])
                if size >= CHUNK_BYTES or len(ids) >= CHUNK_ROWS:
                    yield chunk()
                    ids, texts, size, made = [], [], 0, made + 1
        if ids:
            yield chunk()

    return materialize(docs.mapInArrow(run, PACKED), "chunks")


def unpacked(sizes: bytes, n: int, texts: bytes) -> list[str]:
    raw = pa.decompress(texts, n, "zstd", asbytes=True) if n else b""
    end = np.cumsum(np.frombuffer(sizes, np.int64)).tolist()
    return [raw[a:z].decode("utf-8", "surrogatepass") for a, z in zip([0, *end], end, strict=False)]


def counted(chunks: DataFrame, named: DataFrame) -> DataFrame:
    """For each chunk and range of keys, the counts of its keys in the whole corpus; sums of the range in one row of it."""
    total = chunks.agg(F.sum("bytes")).first()[0] or 0
    bits = max(4, int(np.ceil(np.log2(max(1, total / 3 / KEYS)))))  # a word and a pair in six bytes, about
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    flags = chunks.select("chunk", F.posexplode("ids").alias("at", "doc_id")).join(named.hint("shuffle_hash"), "doc_id").groupBy("chunk").agg(F.collect_list("at").alias("targets"))
    flags = materialize(flags, "flags")
    few = (flags.agg(F.sum(F.size("targets"))).first()[0] or 0) <= BROADCAST_TARGETS
    whole = chunks.join(F.broadcast(flags) if few else flags.hint("shuffle_hash"), "chunk", "left").select("chunk", "sizes", "bytes", "texts", "targets")

    def give(batches):
        for b in batches:
            for k in range(b.num_rows):
                chunk, sizes, n, texts, targets = (b.column(i)[k].as_py() for i in range(5))
                w, v, pair, counts = events(unpacked(sizes, n, texts))
                if not len(w):
                    continue
                is_target = np.zeros(len(counts), bool)
                is_target[targets or []] = True
                of = np.repeat(is_target, counts)
                start = v == START
                keys, at = np.unique(np.concatenate([w, pair, v[start]]), return_inverse=True)
                both = np.bincount(at, minlength=len(keys)), np.bincount(at[np.concatenate([of, of, of[start]])], minlength=len(keys))
                cut = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
                rows = [(i, chunk, planes(np.diff(keys[a:z], prepend=np.uint64(0))), *(planes(c[a:z]) for c in both)) for i, (a, z) in enumerate(zip(cut, cut[1:], strict=False)) if a < z]
                types = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], [x.split()[0] for x in GIVEN.split(", ")])

    def answer(t: pa.Table) -> pa.Table:
        held = [np.cumsum(from_planes(x, np.uint64), dtype=np.uint64) for x in t.column("keys").to_pylist()]
        cut = np.cumsum([0, *map(len, held)]).tolist()
        keys, at = np.unique(np.concatenate(held), return_inverse=True)
        out, sums, words = [], [], (keys & ODD).astype(bool) & (keys != START)
        for which in ("background", "target"):
            c = np.zeros(len(keys), np.int64)
            np.add.at(c, at, np.concatenate([from_planes(x) for x in t.column(which).to_pylist()]))
            sums.append(int(c[words].sum()))
            c = c[at]
            out.append(pa.array([planes(c[a:z]) for a, z in zip(cut, cut[1:], strict=False)], pa.binary()))
        once = lambda x: pa.array([x] + [0] * (t.num_rows - 1), pa.int64())
        return pa.Table.from_arrays([t.column("chunk"), t.column("bucket"), *out, once(int(words.sum())), once(sums[0]), once(sums[1])], [x.split()[0] for x in ANSWER.split(", ")])

    return materialize(whole.mapInArrow(give, GIVEN).groupBy("bucket").applyInArrow(answer, ANSWER), "counts")


def loss_difference(docs: DataFrame, targets: DataFrame, *, words: int | None = None, pairs: int | None = None, prior: float = PRIOR) -> DataFrame:
    """doc_id, n_words, target_loss, background_loss and score (their difference, bits a word) for each row of ``docs``.

    ``targets`` (doc_id) names the target documents; ids that repeat count once. A text without words, empty or null, has 0 words and
    null losses and score. Repeated rows count as often as they stand there. Rows without a doc_id count in the background. Without targets both
    models still give losses: the target model's is that of its prior. An empty table gives an empty result. Other columns aren't read.
    ``words`` is the size of the vocabulary in p(w), by default the number of distinct words. ``pairs`` once bounded the table of pairs; it
    is still taken, and bounds nothing.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    named = targets.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    chunks = packed(docs)
    counts = counted(chunks, named)
    vocabulary, *total = (x or 0 for x in counts.agg(F.sum("vocabulary"), F.sum("n_background"), F.sum("n_target")).first())
    size = words or vocabulary

    def run(t: pa.Table, answers: pa.Table) -> pa.Table:
        (ids,), (sizes,), (length,), (texts,) = (t.column(c).to_pylist() for c in ("ids", "sizes", "bytes", "texts"))
        w, v, pair, n = events(unpacked(sizes, length, texts))
        some = np.flatnonzero(n)
        start = np.cumsum(n[some]) - n[some]
        at = np.unique(np.concatenate([w, pair, v[start]]), return_inverse=True)[1]
        answers, out = answers.sort_by("bucket"), []
        for which in ("target", "background"):
            mean = np.zeros(len(n))
            if len(some):
                c = np.concatenate([from_planes(x) for x in answers.column(which).to_pylist()])[at]
                of_word, of_pair = c[: len(w)], c[len(w) : 2 * len(w)]
                before = np.empty_like(of_word)
                before[1:] = of_word[:-1]
                before[start] = c[2 * len(w) :]
                p = (of_word + 1.0) / (total[which == "target"] + size)
                mean[some] = np.add.reduceat(-np.log2((of_pair + prior * p) / (before + prior)), start) / n[some]
            out.append(mean)
        columns = [pa.array(x, pa.float64(), mask=n == 0) for x in (*out, out[0] - out[1])]
        return pa.Table.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), *columns], [x.split()[0] for x in SCORES.split(", ")])

    return chunks.groupBy("chunk").cogroup(counts.select("chunk", "bucket", "background", "target").groupBy("chunk")).applyInArrow(run, SCORES)
