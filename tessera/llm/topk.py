"""Exact top-k by inner product with block-at-a-time pruning.

The index is a table of blocks: each row holds a range of the vectors table in its own order, with a forward
index (the block's integer vectors) and each term's greatest and least value. A term is a dimension. For a query, a block's
bound is the sum over terms of the query's weight times the greatest value, or the least where the weight is negative.

1. **Threshold.** Every query scores its own block where it stands; its k-th score there is a floor under its final k-th score.
2. **Summaries.** Queries go in chunks of ``queries_per_cell``. Chunks meet the blocks' summaries, two vectors a block, and give (chunk, block) for
   every block whose bound reaches the threshold of a query of the chunk. Blocks that no query of a chunk can use aren't sent to it.
3. **Search.** Blocks that are left meet the chunk in cells of about ``blocks_per_cell`` blocks; there they are visited in order of bounds, and a
   query stops at the first block whose bound is below its k-th score so far.

So a task holds a bounded number of queries and blocks, no side is broadcast, and each cell gives at most k rows for each query to the
final ranking. On vectors without structure bounds prune little: then every chunk meets every block, as an exact search has to.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .vectors import dimension, top, usable

BLOCK, BLOCKS_PER_CELL, QUERIES_PER_CELL, SUMMARIES = 512, 16, 4096, 1024
BLOCKS = "block long, n int, ids binary, terms binary, greatest binary, least binary, asked binary, floors binary"
CHUNKS = "chunk long, n int, ids binary, terms binary, floors binary"
LOWEST = -(2**63)


def quantize(x: np.ndarray, scale: int = 256) -> np.ndarray:
    """floor(scale * x) as integers; beyond 62 bits they stay at the largest that fits."""
    return np.clip(np.floor(scale * x), -(2.0**62), 2.0**62).astype(np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of integers, exact: in doubles where those hold every sum, else in unbounded integers, kept within 63 bits."""
    a, b = a.astype(np.int64), b.astype(np.int64)
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def bounds(queries: np.ndarray, greatest: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Upper bound of each query (row) in each block (column), as doubles rounded up."""
    q = queries.astype(np.float64)
    up = np.maximum(q, 0) @ greatest.astype(np.float64).T + np.minimum(q, 0) @ least.astype(np.float64).T
    return up + np.abs(up) * 1e-9 + 1


def packed(x: np.ndarray) -> bytes:
    """Integers in as few bytes as hold them all: 2, 4 or 8 each."""
    most = max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0))))
    return x.astype(np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.int64).tobytes()


def unpacked(b: bytes, n: int, dim: int) -> np.ndarray:
    size = len(b) // max(1, n * dim)
    return np.frombuffer(b, {2: np.int16, 4: np.int32}.get(size, np.int64)).reshape(n, dim)


def make_blocks(vectors: DataFrame, k: int, dim: int, block: int) -> DataFrame:
    """``BLOCKS`` of (id, v, asked): ranges of ``block`` vectors in the order of the table's partitions; which of them are queries, and their floors. No shuffle."""
    names = [f.split()[0] for f in BLOCKS.split(", ")]

    def pack(batches):
        part, number, ids, rows, marks = TaskContext.get().partitionId() << 32, 0, [], [], []

        def give(number, ids, x, asked):
            floors = np.full(int(asked.sum()), LOWEST, np.int64)
            for i, (own, scores) in enumerate(zip(ids[asked], products(x[asked], x), strict=True)):
                other = scores[ids != own]
                if len(other) >= k:
                    floors[i] = np.partition(other, len(other) - k)[len(other) - k]
            held = [ids.tobytes(), packed(x), packed(x.max(0)), packed(x.min(0)), asked.tobytes(), floors.tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([part + number]), pa.array([len(ids)], pa.int32()), *(pa.array([v], pa.binary()) for v in held)], names)

        for b in batches:
            good, x = usable(b.column("v"), dim, zero=True)
            if not len(good):
                continue
            ids.append(np.asarray(b.column("id"), np.int64)[good])
            rows.append(quantize(x))
            marks.append(np.asarray(b.column("asked").to_numpy(zero_copy_only=False), bool)[good])
            if sum(map(len, ids)) >= block:
                a, r, m = (np.concatenate(v) for v in (ids, rows, marks))
                whole = len(a) // block * block
                for at in range(0, whole, block):
                    some = slice(at, at + block)
                    yield give(number, a[some], r[some], m[some])
                    number += 1
                ids, rows, marks = [a[whole:]], [r[whole:]], [m[whole:]]
        if sum(map(len, ids)):
            yield give(number, *(np.concatenate(v) for v in (ids, rows, marks)))

    return vectors.mapInArrow(pack, BLOCKS)


def make_chunks(index: DataFrame, dim: int, size: int) -> DataFrame:
    """``CHUNKS`` of at most ``size`` queries: those of each partition's blocks, then those of several partitions together."""

    def give(number, ids, x, f):
        return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([len(ids)], pa.int32()), *(pa.array([v], pa.binary()) for v in (ids.tobytes(), packed(x), f.tobytes()))], ["chunk", "n", "ids", "terms", "floors"])

    def pack(parts):
        """Of (ids, terms, floors) as many as come, in chunks."""
        number, held = TaskContext.get().partitionId() << 32, []
        for part in parts:
            held.append(part)
            while sum(len(p[0]) for p in held) >= size:
                whole = [np.concatenate(v) for v in zip(*held, strict=True)]
                yield give(number, *(v[:size] for v in whole))
                number, held = number + 1, [[v[size:] for v in whole]]
        if sum(len(p[0]) for p in held):
            yield give(number, *(np.concatenate(v) for v in zip(*held, strict=True)))

    def own(batches):
        for b in batches:
            for n, i, t, a, f in zip(*(b.column(c).to_pylist() for c in ("n", "ids", "terms", "asked", "floors")), strict=True):
                asked = np.frombuffer(a, bool)
                if asked.any():
                    yield np.frombuffer(i, np.int64)[asked], unpacked(t, n, dim)[asked].astype(np.int64), np.frombuffer(f, np.int64)

    def again(batches):
        for b in batches:
            for n, i, t, f in zip(*(b.column(c).to_pylist() for c in ("n", "ids", "terms", "floors")), strict=True):
                yield np.frombuffer(i, np.int64), unpacked(t, n, dim).astype(np.int64), np.frombuffer(f, np.int64)

    few = materialize(index.select("n", "ids", "terms", "asked", "floors").mapInArrow(lambda b: pack(own(b)), CHUNKS), "queries")
    wanted = max(1, -(-(few.agg(F.sum("n")).first()[0] or 0) // size))
    return few.coalesce(wanted).mapInArrow(lambda b: pack(again(b)), CHUNKS)


def search_cell(blocks: pd.DataFrame, asked: pd.DataFrame, k: int, dim: int) -> pd.DataFrame:
    """The k best of a cell's blocks for each query of the cell's chunk, as far as they reach its floor."""
    many = lambda df, column: np.concatenate([unpacked(b, n, dim) for b, n in zip(df[column], df["n"], strict=True)])
    ids = [np.frombuffer(b, np.int64) for b in blocks["ids"]]
    terms = [unpacked(b, n, dim) for b, n in zip(blocks["terms"], blocks["n"], strict=True)]
    q_ids, q = np.concatenate([np.frombuffer(b, np.int64) for b in asked["ids"]]), many(asked, "terms")
    floors = np.concatenate([np.frombuffer(b, np.int64) for b in asked["floors"]])
    limit = bounds(q, *(np.concatenate([unpacked(b, 1, dim) for b in blocks[c]]) for c in ("greatest", "least")))
    order = np.argsort(-limit, 1, kind="stable")
    best_s, best_i = [np.zeros(0, np.int64)] * len(q), [np.zeros(0, np.int64)] * len(q)
    live = np.arange(len(q))
    for step in range(len(ids)):
        at = order[live, step]
        kth = np.array([max(floors[i], best_s[i][k - 1]) if len(best_s[i]) >= k else floors[i] for i in live], np.float64)
        go = limit[live, at] >= kth  # equal bounds may still win a tie
        live, at = live[go], at[go]
        if not len(live):
            break
        for b in np.unique(at):  # the queries whose next block this is
            rows = live[at == b]
            scores = products(q[rows], terms[b])
            for r, s in zip(rows, scores, strict=True):
                other = (ids[b] != q_ids[r]) & (s >= floors[r])
                if other.any():
                    keep = top(s[other], ids[b][other], k)
                    s, i = np.concatenate([best_s[r], s[other][keep]]), np.concatenate([best_i[r], ids[b][other][keep]])
                    keep = top(s, i, k)
                    best_s[r], best_i[r] = s[keep], i[keep]
    return pd.DataFrame({"query_id": np.repeat(q_ids, [len(s) for s in best_s]), "vec_id": np.concatenate(best_i), "score": np.concatenate(best_s)})


def top_k(vectors: DataFrame, queries: str, k: int = 5, *, key: str = "vec_id", column: str = "embedding", block: int = BLOCK, blocks_per_cell: int = BLOCKS_PER_CELL, queries_per_cell: int = QUERIES_PER_CELL) -> DataFrame:
    """query_id, rank from 1, vec_id and score of the ``k`` best of all vectors for each row where ``queries`` holds.

    Scores are integer inner products of floor(256 * component). A query's own id is no candidate; ties go to the smaller id.
    Vectors that are null, hold null or non-finite components or have another length than most take no part, nor do rows
    without an id. Rows of one id are separate candidates; a query that is there twice gets the ranks of its rows merged.
    An empty table gives an empty result. Other columns are read by ``queries`` alone.
    """
    dim = dimension(vectors, column)
    rows = vectors.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(column).alias("v"), F.coalesce(F.expr(queries), F.lit(False)).alias("asked"))
    index = materialize(make_blocks(rows, k, dim, block), "blocks")
    chunks = materialize(make_chunks(index, dim, queries_per_cell), "chunks")
    size = index.agg(F.count("*").alias("blocks"), F.sum("n").alias("n")).first()
    groups = max(1, -(-size.blocks // SUMMARIES))
    cells = max(1, -(-(size.n or 0) // (block * blocks_per_cell)))
    every = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    summaries = index.select("block", "greatest", "least").withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int"))

    def reach(blocks: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out: tuple[list, list] = ([], [])
        if len(blocks):
            high, low = (np.concatenate([unpacked(b, 1, dim) for b in blocks[c]]) for c in ("greatest", "least"))
            names = blocks["block"].to_numpy()
            for chunk, n, t, f in zip(asked["chunk"], asked["n"], asked["terms"], asked["floors"], strict=True):
                q, floors, can = unpacked(t, n, dim), np.frombuffer(f, np.int64), np.zeros(len(names), bool)
                for a in range(0, n, 512):
                    can |= (bounds(q[a : a + 512], high, low) >= floors[a : a + 512, None]).any(0)
                out[0].append(np.full(int(can.sum()), chunk))
                out[1].append(names[can])
        cat = lambda v: np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64)
        return pd.DataFrame({"chunk": cat(out[0]), "block": cat(out[1])})

    # a chunk meets each group of summaries; groups of the key are chunk and group, so each has one chunk
    dealt = chunks.select("chunk", "n", "terms", "floors", every.alias("group"))
    met = summaries.join(dealt.select(F.col("chunk").alias("to"), "group"), "group").select("to", "group", "block", "greatest", "least")
    pairs = met.groupBy("to", "group").cogroup(dealt.groupBy("chunk", "group")).applyInPandas(reach, "chunk long, block long")
    sent = pairs.join(index.select("block", "n", "ids", "terms", "greatest", "least"), "block").withColumn("cell", F.pmod(F.xxhash64("block"), F.lit(cells)).cast("int"))
    asked = chunks.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
    keys = ("chunk", "cell")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if len(left) and len(right):
            return search_cell(left, right, k, dim)
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")

    found = sent.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
