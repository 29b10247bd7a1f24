"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize, release


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): root is the smallest node that links lead to.

    Each round points the larger neighbours of a node, then its smaller ones, at the smallest neighbour; long chains halve,
    so rounds grow with the logarithm of the longest chain. A hub's neighbours are aggregated before the shuffle and joined back, so its rows can
    be split; what its larger neighbours then hold are few different roots. Rounds end in Parquet in the shared folder.
    """
    links = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    near = Window.partitionBy("a")
    for _ in range(most_rounds):
        if _stars(links):
            break
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        small = large.withColumn("m", F.min("b").over(near)).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*")
        before, links = links, materialize(small.where("a <> b").distinct(), "links")
        release(before)
    else:
        raise RuntimeError("components did not settle")
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


#: Links of a graph that one task settles: some ten MB.
SMALL = 200_000


def _settled(batches):
    """(node, root) of all links of one task: each node's smallest neighbour, until nothing changes."""
    import pyarrow as pa

    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    names = pa.chunked_array([*table.column("a").chunks, *table.column("b").chunks]).combine_chunks().dictionary_encode()
    at = names.indices.to_numpy().astype(np.int64)
    a, b, root = at[: table.num_rows], at[table.num_rows :], np.arange(len(names.dictionary))
    while True:
        before = root.copy()
        least = np.minimum(root[a], root[b])
        for end in (root[a], root[b], a, b):
            np.minimum.at(root, end, least)
        while (shorter := root[root]).tobytes() != root.tobytes():
            root = shorter
        if (root == before).all():
            break
    yield pa.RecordBatch.from_arrays([names.dictionary, names.dictionary.take(pa.array(root))], ["node", "root"])


def contracted(links: DataFrame, small: int = SMALL) -> DataFrame:
    """(node, root) as from ``components``, for links of many nodes ``a`` with few links each to hubs ``b``; a node that is missing is its own root, and
    a root is any one node of its component.

    Links are counted first: up to ``small`` of them are settled in one task. Beyond, every ``a`` points at its smallest hub. Hubs that share an ``a``
    are linked, each pair once, and only they go through ``components``: a hub's own links are aggregated and joined by ``a``, and never meet in one task.
    """
    links = materialize(links.where("a <> b").select("a", "b"), "links")
    if links.count() <= small:
        kind = links.schema["a"].dataType.simpleString()
        return links.coalesce(1).mapInArrow(_settled, f"node {kind}, root {kind}")
    links = links.distinct()
    best = links.groupBy("a").agg(F.min("b").alias("m"))
    pointed = links.join(best.hint("merge"), "a")
    hubs = links.select(F.col("b").alias("a")).distinct()
    among = pointed.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(best.select("a", F.col("m").alias("b")).join(hubs.hint("merge"), "a", "left_semi"))
    roots = materialize(components(among), "hubs")
    leaves = best.join(hubs.hint("merge"), "a", "left_anti").join(roots.select(F.col("node").alias("m"), "root").hint("merge"), "m", "left")
    return leaves.select(F.col("a").alias("node"), F.coalesce("root", "m").alias("root")).union(roots.select("node", "root"))


def _stars(links: DataFrame) -> bool:
    """Whether every node points at one smaller node and none that points is pointed at: each component is a star about its smallest node."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in")).union(links.select("b", F.lit(0), F.lit(1)))
    seen = ends.groupBy("node").agg(F.sum("out").alias("out"), F.sum("in").alias("in"))
    return not seen.where("out > 1 or (out > 0 and in > 0)").limit(1).count()
