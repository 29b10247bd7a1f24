"""What the corpus operators share: reading tables, shipping code and byte-level words."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialize, release, shared_dir  # noqa: F401

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable on every executor, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="tessera-")) / "tessera_code.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)


def unused(name: str, columns: list[str]) -> str:
    """``name``, with marks added until no column has it, whatever the case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Rows of an Arrow batch: Spark's own number suits numbers, not texts of some thousand bytes, of which each task then holds several batches.
BATCH = 2_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of ``sf_dir``; the session's Arrow batches become ``BATCH`` rows, unless another number than Spark's is set."""
    ship(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def least_hashed(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """At most about 1.2 n + 100 rows, those whose hash of ``key`` is least, with the hash in ``__hash``: a bound on what later limits have to gather."""
    df = df.withColumn("__hash", F.xxhash64(key, F.lit(seed)))
    total = df.count()
    share = (1.2 * n + 100) / max(total, 1)
    return df if share >= 1 else df.where(F.col("__hash") <= int(-(2**63) + share * 2**64))


def texts_of(batch: pa.RecordBatch, name: str) -> list[str]:
    """The batch's texts, null as empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


def slices(batches, rows: int = 256, chars: int = 1_000_000):
    """Cut record batches into pieces of at most ``rows`` rows and about ``chars`` bytes of the buffers, so that memory stays bounded."""
    for batch in batches:
        if not batch.num_rows:
            continue
        step = max(1, min(rows, int(batch.num_rows * chars / max(batch.nbytes, 1)) or 1))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


# ---------------------------------------------------------------- words as hashes
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64): a bijection that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


#: Bytes of a text that are held as numbers at a time.
PIECE = 1 << 18
_BASE = np.uint64(0xD1342543DE82EF95)
_POWERS = np.full(PIECE, _BASE, np.uint64)
_POWERS[0] = 1
_POWERS = np.multiply.accumulate(_POWERS)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_LOWERED = _BYTE.copy()
_LOWERED[65:91] = _BYTE[97:123]
_WORD = (~_SPACE).astype(np.uint16)


def run_hashes(raw: bytes, kind: np.ndarray, value: np.ndarray = _BYTE) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, hash) of every run of bytes of one ``kind``, those of kind 0 apart.

    The hash is a polynomial over ``value`` of the bytes, aligned to the run's start, and finished by ``mix`` with its length. Bytes are read
    ``PIECE`` at a time, a run that is cut goes on in the next piece: besides the runs, memory doesn't grow with the text.
    """
    starts, sums, lengths, held = [], [], [], None
    for at in range(0, len(raw), PIECE):
        b = np.frombuffer(raw, np.uint8, min(PIECE, len(raw) - at), at)
        of = kind[b]
        start = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        length = np.diff(np.append(start, len(b)))
        total = np.add.reduceat(value[b] * _POWERS[np.arange(len(b)) - np.repeat(start, length)], start)
        of, start = of[start], start + at
        if held is not None:
            if held[0] == of[0]:
                total[:1] = total[:1] * np.uint64(pow(int(_BASE), int(held[3]), 1 << 64)) + held[2]
                start[0], length[0] = held[1], length[0] + held[3]
            elif held[0]:
                starts.append(np.array([held[1]]))
                sums.append(np.array([held[2]], np.uint64))
                lengths.append(np.array([held[3]]))
        held = (of[-1], start[-1], total[-1], length[-1])
        word = np.flatnonzero(of[:-1])
        starts.append(start[word])
        sums.append(total[word])
        lengths.append(length[word])
    if held is not None and held[0]:
        starts.append(np.array([held[1]]))
        sums.append(np.array([held[2]], np.uint64))
        lengths.append(np.array([held[3]]))
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), mix(np.concatenate(sums) + np.concatenate(lengths).astype(np.uint64) * _ODD)


def joined(texts: list[str], errors: str = "surrogatepass") -> tuple[bytes, np.ndarray]:
    """The texts in UTF-8 with newlines between, and where each begins, with the end of all."""
    parts = [t.encode("utf-8", errors) for t in texts]
    return b"\n".join(parts), np.cumsum([0, *(len(p) + 1 for p in parts)])


def word_hashes(texts: list[str], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts): a 64-bit hash for every word of every text in order, and the number of words of each text.

    A word is a run without space, tab, newline, vertical tab, form feed and carriage return.
    """
    raw, begin = joined(texts)
    start, hashes = run_hashes(raw, _WORD, _LOWERED if lower else _BYTE)
    return hashes, np.diff(np.searchsorted(start, begin))
