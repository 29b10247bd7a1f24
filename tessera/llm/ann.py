"""Approximate nearest neighbours by inner product: a hierarchical k-means tree searched best bin first.

**Fit.** At most ``sample`` vectors, those of the least hashes of their ids, are split by k-means into ``branch`` children, level by
level, until a leaf holds at most ``leaf`` of them. This trunk has a bounded size; so has what is broadcast.

**Growth.** A leaf of the trunk that gets more than ``most`` vectors is grown where it lies: a tree of its own, fitted on at most
about ``sample`` of its vectors, splits it. Such trees are rows of a table, joined by leaf and never broadcast, so leaves stay small
while the table grows.

**Index.** Every vector walks down to the leaf of the nearest centres. Leaves are stored as blocks of at most ``block`` vectors, and neighbouring
leaves of the trunk share a cell of about ``most`` vectors; a grown leaf is a cell.

**Search.** A query walks a tree with a priority queue that always opens the node of largest inner product with its centre, so it meets
leaves best first. It reads ``visits`` leaves of the trunk, and of each of them that is grown so many leaves of its own tree. Both numbers are
calibrated: for ``calibrate`` queries the exact neighbours over all vectors are found, and visits widen until the neighbours lie in
visited leaves for the recall asked for. A query goes to a cell once, with the list of its leaves there. Cells with many vectors (equal ones
can't be split) are dealt into pieces, those that many queries visit into chunks of queries, so a task holds a bounded part of both.

On vectors without structure any tree has to visit a fixed share of the leaves, so the work grows with the square of the rows.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import least_hashed, materialize, release
from .vectors import dimension, top, usable

SAMPLE, BRANCH, LEAF, BLOCK, MOST, CALIBRATE = 16_384, 8, 128, 2048, 8192, 128
BLOCKS = "cell long, leaf long, block long, n int, ids binary, rows binary"
ROUTES = "cell long, id long, v binary, leaves binary"


class Tree:
    """Nodes in arrays: ``centre``, ``first`` child and number of ``children``; ``leaf`` is the leaf's number, else -1."""

    def __init__(self, x: np.ndarray, branch: int = BRANCH, leaf: int = LEAF, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.centre, self.first, self.children, self.leaf, self.leaves = [x.mean(0) if len(x) else np.zeros(x.shape[1])], [0], [0], [-1], 0
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            parts = self._split(x[rows], branch, rng) if len(rows) > leaf else None
            if parts is None:
                self.leaf[node], self.leaves = self.leaves, self.leaves + 1
                continue
            self.first[node], self.children[node] = len(self.centre), len(parts[0])
            for c, group in enumerate(parts[0]):
                self.centre.append(group)
                self.first.append(0)
                self.children.append(0)
                self.leaf.append(-1)
                todo.append((self.first[node] + c, rows[parts[1] == c]))
        self.centre = np.array(self.centre)

    @staticmethod
    def _split(x: np.ndarray, branch: int, rng) -> tuple[np.ndarray, np.ndarray] | None:
        """(centres, child of each row); None where all rows are equal."""
        different = np.unique(x, axis=0)
        if len(different) < 2:
            return None
        centre = different[rng.choice(len(different), min(branch, len(different)), replace=False)]
        for _ in range(12):
            part = Tree.near(x, centre).argmin(1)
            used = np.unique(part)
            part = np.searchsorted(used, part)
            new = np.array([x[part == c].mean(0) for c in range(len(used))])
            if new.shape == centre.shape and np.allclose(new, centre):
                break
            centre = new
        part = Tree.near(x, centre).argmin(1)
        used = np.unique(part)
        return (centre[used], np.searchsorted(used, part)) if len(used) > 1 else None

    @staticmethod
    def near(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
        """Squared distances up to a constant for each row."""
        return (centre**2).sum(1) - 2 * x @ centre.T

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row."""
        node, out = np.zeros(len(x), np.int64), np.full(len(x), -1)
        open_ = np.arange(len(x))
        while len(open_):
            for p in np.unique(node[open_]):
                rows = open_[node[open_] == p]
                if self.leaf[p] >= 0:
                    out[rows] = self.leaf[p]
                else:
                    a = self.first[p]
                    node[rows] = a + self.near(x[rows], self.centre[a : a + self.children[p]]).argmin(1)
            open_ = open_[out[open_] < 0]
        return out

    def visit(self, product: np.ndarray, most: int) -> list[int]:
        """The first ``most`` leaves, best bin first; ``product``: the query's inner product with each centre."""
        queue, found = [(-product[0], 0)], []
        while queue and len(found) < most:
            node = heapq.heappop(queue)[1]
            if self.leaf[node] >= 0:
                found.append(self.leaf[node])
            for c in range(self.first[node], self.first[node] + self.children[node]):
                heapq.heappush(queue, (-product[c], c))
        return found


def dots(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows with rows, added up from the first component to the last, so equal vectors get equal scores wherever they stand."""
    total = np.zeros(len(q))
    for d in range(q.shape[1]):
        total += q[:, d] * x[:, d]
    return total


def search_cell(rows: np.ndarray, ids: np.ndarray, leaf: np.ndarray, q: np.ndarray, q_ids: np.ndarray, visited: list[np.ndarray], k: int, chunk: int = 128) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, ids, scores): for each query the k best rows of the leaves it visits, but its own; ties to the smaller id."""
    names, column = np.unique(leaf, return_inverse=True)
    out: tuple[list, list, list] = ([], [], [])
    for a in range(0, len(q), chunk):
        some = visited[a : a + chunk]
        seen = np.zeros((len(some), len(names)), bool)
        at = np.concatenate(some)
        place = np.minimum(np.searchsorted(names, at), len(names) - 1)
        hit = names[place] == at
        seen[np.repeat(np.arange(len(some)), [len(v) for v in some])[hit], place[hit]] = True
        rough = q[a : a + chunk] @ rows.T
        slack = 1e-9 * max(1.0, np.abs(rough).max(initial=0))
        rough[~seen[:, column]] = -np.inf
        rough[q_ids[a : a + chunk, None] == ids] = -np.inf
        least = np.partition(rough, max(0, len(ids) - k), 1)[:, max(0, len(ids) - k)] - slack
        who, row = np.nonzero((rough >= least[:, None]) & (rough > -np.inf))
        score = dots(q[a + who], rows[row])
        order = np.lexsort((ids[row], -score, who))
        who, row, score = who[order], row[order], score[order]
        rank = np.arange(len(who)) - np.searchsorted(who, who)
        for column_of, v in zip(out, (q_ids[a + who], ids[row], score), strict=True):
            column_of.append(v[rank < k])
    cat = lambda v, kind: np.concatenate(v).astype(kind) if v else np.zeros(0, kind)
    return cat(out[0], np.int64), cat(out[1], np.int64), cat(out[2], np.float64)


def _blocks(cell: int, leaf: int, ids: np.ndarray, x: np.ndarray, block: int, first: int):
    """Record batches of at most ``block`` vectors."""
    for i, a in enumerate(range(0, len(ids), block)):
        some = slice(a, a + block)
        yield pa.RecordBatch.from_arrays([pa.array([cell], pa.int64()), pa.array([leaf], pa.int64()), pa.array([first + i], pa.int64()), pa.array([len(ids[some])], pa.int32()), pa.array([ids[some].tobytes()]), pa.array([x[some].tobytes()])], ["cell", "leaf", "block", "n", "ids", "rows"])


def _route(cell: int, i: int, v: bytes, leaves) -> tuple:
    return int(cell), int(i), v, np.asarray(leaves, np.int64).tobytes()


def _routes(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["cell", "id", "v", "leaves"])


def nearest(vectors: DataFrame, queries: str, k: int = 20, *, key: str = "vec_id", column: str = "embedding", recall: float = 0.95, sample: int = SAMPLE, leaf: int = LEAF, block: int = BLOCK, most: int = MOST, calibrate: int = CALIBRATE, queries_per_cell: int = 4096) -> DataFrame:
    """query_id, rank from 1, vec_id and score of the ``k`` nearest found for each row where ``queries`` holds.

    Nearness is the inner product in double precision. A query's own id is no candidate; ties go to the smaller id. Vectors
    that are null, zero, hold null or non-finite components or have another length than most take no part, nor do rows without an
    id. Rows of one id are separate candidates; a query whose id is there twice gets the ranks of its rows merged. An empty table gives an
    empty result. Other columns are read by ``queries`` alone.
    """
    spark, dim = vectors.sparkSession, dimension(vectors, column)
    usual = vectors.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(column).alias("v"), F.coalesce(F.expr(queries), F.lit(False)).alias("asked"))
    single = vectors.schema[column].dataType.elementType.simpleString() == "float"
    kind = np.float32 if single else np.float64  # components as they are stored: nothing is lost
    rows = least_hashed(usual.where(F.size("v") == dim), "id", sample).orderBy("__hash", "id").limit(sample).select("id", "v").toArrow()
    _, x = usable(rows.column("v"), dim, zero=False) if dim and rows.num_rows else (None, np.zeros((0, max(dim, 1))))
    trunk = spark.sparkContext.broadcast(Tree(x, leaf=leaf))  # nodes: at most a few for each ``leaf`` of the sample
    leaves = trunk.value.leaves

    def store(batches):
        number = TaskContext.get().partitionId() << 40
        for b in batches:
            good, x = usable(b.column("v"), dim, zero=False)
            if not len(good):
                continue
            at, ids = trunk.value.assign(x), np.asarray(b.column("id"), np.int64)[good]
            for n in np.unique(at):
                for out in _blocks(int(n), int(n) << 32, ids[at == n], x[at == n].astype(kind), block, number):
                    yield out
                    number += 1

    index = materialize(usual.select("id", "v").mapInArrow(store, BLOCKS), "leaves")
    size = {r.cell: r.n for r in index.groupBy("cell").agg(F.sum("n").alias("n")).collect()}  # as many as the trunk has leaves
    grown = sorted(n for n in size if size[n] > most)
    subtrees = materialize(_grow(index, {n: size[n] for n in grown}, sample, leaf, dim, kind), "subtrees") if grown else None
    cell_of, full = {}, 0
    for n in range(leaves):  # neighbouring leaves share a cell
        if n not in grown:
            cell_of[n] = full // most
            full += size.get(n, 0)
    if grown:
        index = materialize(_regrown(index.where(F.col("cell").isin(grown)), subtrees, block, kind, dim).union(index.where(~F.col("cell").isin(grown))), "grown")
    own = F.element_at(F.array(*[F.lit(cell_of.get(n, 0)) for n in range(leaves)]), (F.shiftright("leaf", 32) + 1).cast("int")).cast("long")  # a number for each leaf of the trunk
    # a grown leaf's cells are numbered from 2^32 on, and so are apart from shared cells
    cell = F.when(F.shiftright("leaf", 32).isin(grown), F.col("leaf") + (1 << 32)).otherwise(own) if grown else own
    index = index.withColumn("cell", cell)
    asked = usual.where("asked").select("id", "v")
    first, second = _calibrate(index, asked, trunk.value, subtrees, k, recall, calibrate, dim, kind)
    is_grown = set(grown)

    def walk(batches):
        for b in batches:
            good, x = usable(b.column("v"), dim, zero=False)
            ids, product, out = np.asarray(b.column("id"), np.int64)[good], x @ trunk.value.centre.T, []
            for i, p in enumerate(product):
                to: dict[int, list[int]] = {}
                for n in trunk.value.visit(p, first):
                    to.setdefault(-1 - n if n in is_grown else cell_of[n], []).append(n << 32)
                out += [_route(c, ids[i], x[i].astype(kind).tobytes(), held) for c, held in to.items()]
                if len(out) > 4096:
                    yield _routes(out)
                    out = []
            yield _routes(out)

    routes = materialize(asked.mapInArrow(walk, ROUTES), "routes")
    if grown:

        def deeper(batches):
            for b in batches:
                out, tree, last = [], None, None
                for c, i, v, blob in zip(*(b.column(n).to_pylist() for n in ("cell", "id", "v", "tree")), strict=True):
                    if blob != last:
                        tree, last = pickle.loads(blob), blob
                    x = np.frombuffer(v, kind).astype(np.float64)
                    out += [_route((-1 - c << 32) + s + (1 << 32), i, v, [(-1 - c << 32) + s]) for s in tree.visit(tree.centre @ x, second)]
                yield _routes(out)

        below = routes.where("cell < 0").join(subtrees.select((-1 - F.col("leaf")).alias("cell"), "tree"), "cell")
        routes = routes.where("cell >= 0").union(below.select("cell", "id", "v", "tree").sortWithinPartitions("cell").mapInArrow(deeper, ROUTES))
    # how many pieces of vectors and chunks of queries each cell is dealt into
    load = index.groupBy("cell").agg(F.sum("n").alias("n")).join(routes.groupBy("cell").agg(F.count("*").alias("q")), "cell")
    load = materialize(load.select("cell", F.ceil(F.col("n") / (2 * most)).cast("int").alias("pieces"), F.ceil(F.col("q") / queries_per_cell).cast("int").alias("chunks")), "cells")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    keys = ("cell", "piece", "chunk")
    left = index.join(load, "cell").withColumn("piece", F.pmod(F.xxhash64("block"), F.col("pieces")).cast("int")).withColumn("chunk", every("chunks")).select(*keys, "leaf", "n", "ids", "rows")
    right = routes.join(load, "cell").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")).withColumn("piece", every("pieces")).select(*keys, "id", "v", "leaves")

    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        if len(a) and len(b):
            ids = np.concatenate([np.frombuffer(v, np.int64) for v in a["ids"]])
            x = np.frombuffer(b"".join(a["rows"]), kind).astype(np.float64).reshape(len(ids), -1)
            q = np.frombuffer(b"".join(b["v"]), kind).astype(np.float64).reshape(len(b), -1)
            out = search_cell(x, ids, np.repeat(a["leaf"].to_numpy(), a["n"].to_numpy()), q, b["id"].to_numpy(), [np.frombuffer(v, np.int64) for v in b["leaves"]], k)
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), out, strict=True)))

    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _vectors(b, kind, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, vectors, leaf of each) of a batch of blocks."""
    n = np.asarray(b.column("n"))
    x = np.frombuffer(b"".join(b.column("rows").to_pylist()), kind).astype(np.float64).reshape(-1, dim)
    return np.frombuffer(b"".join(b.column("ids").to_pylist()), np.int64), x, np.repeat(np.asarray(b.column("leaf")), n)


def _grow(index: DataFrame, size: dict[int, int], sample: int, leaf: int, dim: int, kind) -> DataFrame:
    """(leaf, tree): a tree for each leaf of ``size``, fitted on about ``sample`` of its vectors, those of the least hashes."""

    def choose(batches):
        for b in batches:
            for cell, i, x in zip(b.column("cell").to_pylist(), b.column("ids").to_pylist(), b.column("rows").to_pylist(), strict=True):
                ids = np.frombuffer(i, np.int64)
                lot = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
                lot = (lot ^ (lot >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
                keep = (lot >> np.uint64(11)).astype(np.float64) / 2.0**53 < sample / size[cell]
                yield pa.RecordBatch.from_arrays([pa.array([cell], pa.int64()), pa.array([np.frombuffer(x, kind).reshape(-1, dim)[keep].tobytes()])], ["leaf", "rows"])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.frombuffer(b"".join(pdf["rows"]), kind).astype(np.float64).reshape(-1, dim)
        return pd.DataFrame({"leaf": [pdf["leaf"].iloc[0]], "tree": [pickle.dumps(Tree(x, leaf=leaf))]})

    some = index.where(F.col("cell").isin(list(size))).select("cell", "n", "ids", "rows").mapInArrow(choose, "leaf long, rows binary")
    return some.groupBy("leaf").applyInPandas(fit, "leaf long, tree binary")


def _regrown(index: DataFrame, subtrees: DataFrame, block: int, kind, dim: int) -> DataFrame:
    """The blocks of grown leaves, split by their trees."""

    def split(batches):
        number = (1 << 62) + (TaskContext.get().partitionId() << 40)
        for b in batches:
            for at in range(b.num_rows):
                one = b.slice(at, 1)
                cell, tree = one.column("cell")[0].as_py(), pickle.loads(one.column("tree")[0].as_py())
                ids, x, _ = _vectors(one, kind, dim)
                part = tree.assign(x)
                for s in np.unique(part):
                    for out in _blocks(cell, (cell << 32) + int(s), ids[part == s], x[part == s].astype(kind), block, number):
                        yield out
                        number += 1

    joined = index.join(subtrees.withColumnRenamed("leaf", "cell"), "cell").select("cell", "leaf", "n", "ids", "rows", "tree")
    return joined.mapInArrow(split, BLOCKS)


def _calibrate(index: DataFrame, asked: DataFrame, trunk: Tree, subtrees: DataFrame | None, k: int, recall: float, sample: int, dim: int, kind) -> tuple[int, int]:
    """Leaves to visit of the trunk and of a grown leaf's tree: the least with which the true neighbours of ``sample`` queries lie in visited leaves at ``recall``."""
    rows = least_hashed(asked.where(F.size("v") == dim), "id", sample, 1).orderBy("__hash", "id").limit(sample).select("id", "v").toArrow() if dim else None
    good, q = usable(rows.column("v"), dim, zero=False) if rows is not None and rows.num_rows else ([], None)
    if not len(good):
        return trunk.leaves, 1 << 30
    q_ids = np.asarray(rows.column("id").combine_chunks(), np.int64)[good]

    def exact(batches):
        for b in batches:
            ids, x, leaf = _vectors(b, kind, dim)
            score = q @ x.T
            score[q_ids[:, None] == ids] = -np.inf
            at = np.argpartition(-score, min(k, score.shape[1] - 1), 1)[:, :k]
            who = np.repeat(np.arange(len(q)), at.shape[1])
            at = at.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(leaf[at]), pa.array(ids[at]), pa.array(score[who, at])], ["who", "leaf", "id", "score"])

    near = index.select("n", "ids", "rows", "leaf").mapInArrow(exact, "who long, leaf long, id long, score double")
    rank = F.row_number().over(Window.partitionBy("who").orderBy(F.desc("score"), "id"))
    truth = near.withColumn("rank", rank).where((F.col("rank") <= k) & (F.col("score") > float("-inf"))).select("who", "leaf")
    share = recall if subtrees is None else recall**0.5
    truth = materialize(truth.withColumn("top", F.shiftright("leaf", 32)), "truth")
    found = truth.select("who", "top").collect()  # sample x k rows
    place = [{n: i for i, n in enumerate(trunk.visit(p, trunk.leaves))} for p in q @ trunk.centre.T]
    first = _quantile([place[r.who][r.top] + 1 for r in found], share, trunk.leaves)
    if subtrees is None:
        release(truth)
        return first, 1 << 30

    def places(batches):
        for b in batches:
            out = []
            for who, leaf, blob in zip(b.column("who").to_pylist(), b.column("leaf").to_pylist(), b.column("tree").to_pylist(), strict=True):
                tree = pickle.loads(blob)
                out.append(tree.visit(tree.centre @ q[who], tree.leaves).index(leaf & 0xFFFFFFFF) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], ["place"])

    deep = truth.join(subtrees.withColumnRenamed("leaf", "top"), "top").select("who", "leaf", "tree").mapInArrow(places, "place long").collect()  # at most sample x k numbers
    return first, _quantile([r.place for r in deep], share, 1 << 30)


def _quantile(needed: list[int], share: float, most: int) -> int:
    needed = np.sort(needed)
    return int(needed[min(len(needed) - 1, int(np.ceil(share * len(needed))) - 1)]) if len(needed) else most
