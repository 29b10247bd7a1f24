"""Document quality: random-indexing word vectors, pooled, and a small calibrated network.

1. **Words** are runs of one character class (small letters, capitals, digits, blanks apart, each mark by its own), hashed into
   ``buckets`` rows. Every document counts, over its whole text.
2. **Random indexing.** Each bucket has a fixed sparse random index vector of -1 and 1. A word's vector is the sum of the index
   vectors of the words up to two places beside it, summed over the corpus: each partition adds up integers and gives
   out blocks of rows; the blocks are added up in two rounds with a salt, each row by row in bounded memory.
3. **Pooling.** A document is the mean and the spread of its unit word vectors, the mean product of neighbouring ones and the
   logarithm of its length.
4. **Network.** One hidden layer in numpy, trained on the driver on at most ``sample`` labelled rows of the least hashes;
   a tenth of them sets the temperature of the probabilities and takes no part in the training.

Word vectors (``buckets`` x ``dims`` integers) and the network have a fixed size, whatever the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined, least_hashed, run_hashes, slices, texts_of

BUCKETS, DIMS, NONZERO, BESIDE = 1 << 13, 32, 4, 2
BLOCK = 64
#: Words whose vectors or contexts are held at a time; characters of a slice of texts.
WORDS, CHARS = 1 << 16, 2_000_000
SAMPLE = 20_000


def _classes() -> np.ndarray:
    out = np.arange(256, dtype=np.uint16) + 8
    out[[32, 9, 10, 11, 12, 13]] = 0
    out[97:123] = out[128:256] = 1
    out[65:91] = 2
    out[48:58] = 3
    return out


_CLASS = _classes()


def class_words(texts: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every word in order, number of words of each text); words are runs of one character class."""
    raw, begin = joined(texts, "replace")
    start, hashes = run_hashes(raw, _CLASS)
    return (hashes % np.uint64(buckets)).astype(np.int32), np.diff(np.searchsorted(start, begin))


def index_vectors(buckets: int, dims: int, nonzero: int = NONZERO, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """(places, signs) of the non-zero entries of each bucket's index vector."""
    rng = np.random.default_rng(seed)
    places = np.argsort(rng.random((buckets, dims)), 1)[:, :nonzero]
    return places, rng.choice([-1, 1], (buckets, nonzero))


def add_contexts(sums: np.ndarray, words: np.ndarray, counts: np.ndarray, places: np.ndarray, signs: np.ndarray, beside: int = BESIDE) -> None:
    """Add to each word's row of ``sums`` the index vectors of the words beside it in the same text, ``WORDS`` words at a time."""
    buckets, dims = sums.shape
    stop = np.cumsum(counts)
    for at in range(0, len(words), WORDS):
        w = words[at : at + WORDS + beside].astype(np.int64)
        left = np.arange(at, min(at + WORDS, len(words)))
        left = stop[np.searchsorted(stop, left, "right")] - left  # words from here to the text's end
        flat = np.zeros(buckets * dims)
        for gap in range(1, beside + 1):
            i = np.flatnonzero(left > gap)
            for a, b in ((w[i], w[i + gap]), (w[i + gap], w[i])):
                for k in range(places.shape[1]):
                    flat += np.bincount(a * dims + places[b, k], signs[b, k], buckets * dims)
        sums += flat.reshape(buckets, dims).astype(np.int64)


def word_vectors(docs: DataFrame, buckets: int = BUCKETS, dims: int = DIMS) -> np.ndarray:
    """Unit vectors of all buckets, from every row of ``docs``; buckets that never occur are zero."""

    def count(batches):
        sums, (places, signs) = np.zeros((buckets, dims), np.int64), index_vectors(buckets, dims)
        for b in slices(batches, 4096, CHARS):
            words, counts = class_words(texts_of(b, "text"), buckets)
            if len(words):
                add_contexts(sums, words, counts, places, signs)
        part = TaskContext.get().partitionId()
        n = buckets // BLOCK
        yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array([part] * n, pa.int64()), pa.array([sums[i * BLOCK : (i + 1) * BLOCK].astype(np.int32 if abs(sums).max() < 2**31 else np.int64).tobytes() for i in range(n)], pa.binary())], ["block", "part", "sums"])

    def add_up(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for block, blob in zip(b.column("block").to_pylist(), b.column("sums").to_pylist(), strict=True):
                x = np.frombuffer(blob, np.int32 if len(blob) == BLOCK * dims * 4 else np.int64).astype(np.int64)
                held[block] = held[block] + x if block in held else x
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array([-1] * len(held), pa.int64()), pa.array([x.tobytes() for x in held.values()], pa.binary())], ["block", "part", "sums"])

    schema = "block long, part long, sums binary"
    parts = docs.select("text").mapInArrow(count, schema)
    some = parts.repartition("block", F.expr("part % 16")).mapInArrow(add_up, schema)
    total = np.zeros((buckets, dims))
    for row in some.repartition("block").mapInArrow(add_up, schema).toLocalIterator():  # a row for each block: buckets x dims numbers in all
        total[row.block * BLOCK : (row.block + 1) * BLOCK] = np.frombuffer(row.sums, np.int64).reshape(BLOCK, dims)
    size = np.linalg.norm(total, axis=1, keepdims=True)
    return (total / np.where(size > 0, size, 1)).astype(np.float32)


def pool(texts: list[str], vectors: np.ndarray) -> np.ndarray:
    """A row of features for each text; an empty text gives zeros.

    Texts are cut into parts of at most ``WORDS`` words, and about so many words' vectors are held at a time. Parts are counted from each
    text's own start, so a text's features don't depend on its neighbours.
    """
    words, counts = class_words(texts, len(vectors))
    dims, stop = vectors.shape[1], np.cumsum(counts)
    sums = np.zeros((len(texts), 3 * dims))
    parts = -(-counts // WORDS)
    of = np.repeat(np.arange(len(texts)), parts)
    first = (stop - counts)[of] + WORDS * (np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts))
    last = np.minimum(first + WORDS, stop[of])
    at = 0
    while at < len(of):
        end = max(at + 1, int(np.searchsorted(last, first[at] + WORDS, "right")))
        a, z = first[at], last[end - 1]
        v = vectors[words[a : min(z + 1, len(words))]]
        beside = v[: z - a].copy()
        beside[: len(v) - 1] *= v[1 : z - a + 1]
        beside[stop[of[at:end]][stop[of[at:end]] <= z] - 1 - a] = 0  # no neighbour across texts
        v = v[: z - a]
        start = first[at:end] - a
        np.add.at(sums, of[at:end], np.concatenate([np.add.reduceat(v, start), np.add.reduceat(v * v, start), np.add.reduceat(beside, start)], 1))
        at = end
    out = np.zeros((len(texts), 3 * dims + 1), np.float32)
    some = np.flatnonzero(counts)
    n, scale = counts[some][:, None], np.sqrt(dims)
    mean, square, beside = (sums[some, i * dims : (i + 1) * dims] / n for i in range(3))
    out[some] = np.concatenate([mean * scale, np.sqrt(np.maximum(square - mean**2, 0)) * scale, beside * scale**2, np.log1p(n) / 4], 1)
    return out


class Network:
    """standardised input -> tanh layer -> logit / temperature."""

    def __init__(self, hidden: int = 32, rounds: int = 60, batch: int = 256, rate: float = 3e-3, decay: float = 1e-4, seed: int = 5):
        self.hidden, self.rounds, self.batch, self.rate, self.decay, self.seed = hidden, rounds, batch, rate, decay, seed
        self.temperature = 1.0

    def fit(self, x: np.ndarray, y: np.ndarray, held: np.ndarray) -> Network:
        """Adam on log loss over the rows not ``held``; then the temperature that gives the ``held`` rows the least log loss."""
        rng = np.random.default_rng(self.seed)
        train = np.flatnonzero(~held)
        self.mean, self.std = x[train].mean(0), x[train].std(0) + 1e-6
        z, d = (x - self.mean) / self.std, x.shape[1]
        p = [rng.normal(0, d**-0.5, (d, self.hidden)), np.zeros(self.hidden), rng.normal(0, self.hidden**-0.5, self.hidden), np.zeros(1)]
        m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        for _ in range(self.rounds):
            for at in np.array_split(rng.permutation(train), max(1, len(train) // self.batch)):
                h = np.tanh(z[at] @ p[0] + p[1])
                e = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3][0], -30, 30))) - y[at]) / len(at)
                back = np.outer(e, p[2]) * (1 - h**2)
                t += 1
                for i, g in enumerate((z[at].T @ back + self.decay * p[0], back.sum(0), h.T @ e + self.decay * p[2], np.array([e.sum()]))):
                    m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g**2
                    p[i] = p[i] - self.rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        self.p = p
        if held.any():
            logit, label = self._logit(x[held]), y[held]
            loss = lambda c: np.logaddexp(0, np.where(label == 1, -logit, logit) / c).mean()
            self.temperature = min(np.geomspace(0.25, 8, 61), key=loss)
        return self

    def _logit(self, x: np.ndarray) -> np.ndarray:
        w, b, u, c = self.p
        return np.tanh((x - self.mean) / self.std @ w + b) @ u + c[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._logit(x.astype(np.float64)) / self.temperature, -500, 500)))


def score_quality(docs: DataFrame, labels: DataFrame, *, learn_from: str = "true", sample: int = SAMPLE, threshold: float = 0.7, buckets: int = BUCKETS, dims: int = DIMS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, score double and predicted int for each row of ``docs``.

    ``labels`` has doc_id and quality (0 or 1); only labels of rows for which the SQL expression ``learn_from`` over doc_id
    holds are learned from, at most ``sample`` label rows, those of the least hash of doc_id. The text alone is scored: other columns
    are read only to be kept. Null and empty texts are scored as a document without words. Rows whose label is null are not
    learned from; where a doc_id has several labels or texts each pair counts. Without labels of both kinds every score is
    the share of label 1 (0.5 without any). Repeated rows get the same score; an empty table gives an empty result.
    """
    vectors = word_vectors(docs, buckets, dims)
    known = labels.where(f"quality is not null and doc_id is not null and ({learn_from})").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = least_hashed(known, "doc_id", sample).orderBy("__hash", "doc_id", "quality").limit(sample)  # at most ``sample`` short rows
    handle = docs.sparkSession.sparkContext.broadcast(vectors)  # buckets x dims floats: 1 MB

    def features(batches):
        for b in slices(batches, 1024, CHARS):
            x = pool(texts_of(b, "text"), handle.value)
            yield pa.RecordBatch.from_arrays([b.column("quality"), b.column("__hash"), pa.array([r.tobytes() for r in x], pa.binary())], ["quality", "hash", "features"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id").select("text", "quality", "__hash")
    rows = texts.mapInArrow(features, "quality int, hash long, features binary").orderBy("hash", "quality", "features").collect()
    x = np.array([np.frombuffer(r.features, np.float32) for r in rows], np.float64)
    y = np.array([r.quality for r in rows], float)
    if 0 < y.sum() < len(y):
        network, rate = Network().fit(x, y, np.array([r.hash % 10 == 0 for r in rows])), None
    else:
        network, rate = None, float(y.mean()) if len(y) else 0.5
    model = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches):
        for b in slices(batches, 1024, CHARS):
            x = pool(texts_of(b, "text"), handle.value)
            s = np.full(b.num_rows, rate) if rate is not None else model.value.score(x)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], [*keep, "score", "predicted"])

    fields = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    return docs.select(*dict.fromkeys((*keep, "text"))).mapInArrow(run, f"{fields}, score double, predicted int")
