"""Folds, feature filters, clustering quality, components and odds ratios."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize
from .windows import keyed_rank


def fold(ids: Column, k: int, seed: int = 0) -> Column:
    """A fold 0..k-1 by the row's hash: the same for all rows of an id, without a shuffle."""
    return F.pmod(F.xxhash64(ids, F.lit(seed)), F.lit(k)).cast("int")


def stratified_fold(df: DataFrame, label: str, ids: Sequence[str], k: int) -> DataFrame:
    """Folds dealt out in turn within each class, in the order of ``ids``, the first of which is a number. Rows without it are left out."""
    return keyed_rank(df, [label], ids[0], ids[1:], "fold").withColumn("fold", ((F.col("fold") - 1) % k).cast("int"))


def feature_report(df: DataFrame, features: Sequence[str], max_missing: float = 0.5, min_variance: float = 0.0) -> DataFrame:
    """(feature, n, missing, variance, distinct, usable) in one pass over the rows."""
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features]))
    long = df.select(rows.alias("r")).select("r.*")
    out = long.groupBy("feature").agg(F.count("value").alias("n"), F.avg(F.col("value").isNull().cast("double")).alias("missing"), F.var_samp("value").alias("variance"), F.count_distinct("value").alias("n_distinct"))
    return out.withColumn("usable", (F.col("missing") <= max_missing) & F.coalesce(F.col("variance") > min_variance, F.lit(False)))


def correlation(x: Column, y: Column) -> Column:
    """Pearson's correlation on complete pairs; NULL where either doesn't vary, by its least and greatest value: merged partial deviations of a constant may round to more than 0."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    varies = (F.min(a) < F.max(a)) & (F.min(b) < F.max(b))
    return F.when(varies, F.try_divide(F.covar_pop(a, b), F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))))


def correlations(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(a, b, r, n) of all pairs a < b on complete pairs, as one aggregate over the rows."""
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1 :]]
    both = lambda a, b: F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull())
    row = df.agg(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), correlation(F.col(a), F.col(b)).alias("r"), both(a, b).alias("n")).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    return row.select(F.explode(F.array(*row.columns)).alias("p")).select("p.*")


def drop_redundant(relevance: dict[str, float], pairs: Sequence[tuple[str, str, float]], limit: float) -> tuple[list[str], list[tuple[str, str]]]:
    """(kept, [(dropped, because of)]): features by falling relevance, each dropped if it correlates at ``limit`` or more with a kept one."""
    strength = {frozenset(p[:2]): abs(p[2]) if p[2] is not None else 0.0 for p in pairs}
    kept: list[str] = []
    dropped: list[tuple[str, str]] = []
    for f in sorted(relevance, key=lambda f: (-relevance[f], f)):
        hit = next((k for k in kept if strength.get(frozenset((f, k)), 0.0) >= limit), None)
        if hit is None:
            kept.append(f)
        else:
            dropped.append((f, hit))
    return kept, dropped


def covariance_components(df: DataFrame, features: Sequence[str], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(means, loadings as columns, variance shares) of standardised features; the matrix comes from one aggregate, signs make the largest loading positive."""
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i:]]
    row = df.agg(*[F.avg(f).alias(f"m{i}") for i, f in enumerate(features)], *[correlation(F.col(a), F.col(b)).alias(f"c{i}") for i, (a, b) in enumerate(pairs)]).first()
    p = len(features)
    c = np.eye(p)
    for i, (a, b) in enumerate(pairs):
        x, y = features.index(a), features.index(b)
        c[x, y] = c[y, x] = 1.0 if a == b else row[f"c{i}"] or 0.0
    w, v = np.linalg.eigh(c)
    order = np.argsort(-w)[:n]
    v = v[:, order]
    v = v * np.sign(v[np.abs(v).argmax(0), np.arange(v.shape[1])])
    return np.array([row[f"m{i}"] for i in range(p)]), v, w[order] / w.sum()


class _Points:
    """Rows of one length, equal vectors once: ``x``, each row's place ``at`` in it, and the weights of the places by label column."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, width: int):
        rows = np.ascontiguousarray(rows) + 0.0
        first, self.at = np.zeros(min(len(rows), 1), int), np.zeros(len(rows), int)
        if rows.size:
            _, first, at = np.unique(rows.view(f"V{8 * rows.shape[1]}").ravel(), return_index=True, return_inverse=True)
            self.at = at.ravel()
        self.x, self.columns = rows[first], columns
        self.weights = self.weigh(np.ones(len(rows), bool), width)

    def weigh(self, taken: np.ndarray, width: int) -> np.ndarray:
        w = np.zeros((len(self.x), width))
        for c in self.columns.T:
            some = taken & (c >= 0)
            np.add.at(w, (self.at[some], c[some]), 1.0)
        return w


def _weighted(d: np.ndarray, w: np.ndarray) -> np.ndarray:
    """``d @ w``; where that isn't finite, each column from the rows alone that weigh in it."""
    out = d @ w
    if not np.isfinite(out).all():
        for c in range(w.shape[1]):
            out[:, c] = d[:, w[:, c] > 0] @ w[w[:, c] > 0, c]
    return out


def _sums(x: np.ndarray, y: np.ndarray, wx: np.ndarray, wy: np.ndarray, both: bool = True, strip: int = 256, tile: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Distances from the rows of ``x`` to those of ``y``, summed by the weights ``wy``; and with ``both`` those from ``y`` to ``x`` by ``wx``.

    Squared distances are products of matrices. Those that are small beside the rounding errors of a product, or not finite, are taken from differences.
    """
    to_x, to_y = np.zeros((len(x), wy.shape[1])), np.zeros((len(y), wx.shape[1]))
    with np.errstate(invalid="ignore", over="ignore"):
        usual = y[np.isfinite(y).all(1)]
        middle = usual.mean(0) if len(usual) else np.zeros(y.shape[1])
        u, v = x - middle, y - middle
        nu, nv = (u * u).sum(1), (v * v).sum(1)
        p, q = np.argsort(nu), np.argsort(nv)  # by length, so that one bound fits a tile
        left, right = np.column_stack([-2 * u, nu, np.ones(len(u))])[p], np.column_stack([v, np.ones(len(v)), nv])[q].T.copy()
        for i in range(0, len(p), strip):
            rows = p[i : i + strip]
            for j in range(0, len(q), tile):
                columns = q[j : j + tile]
                d = left[i : i + strip] @ right[:, j : j + tile]
                least = 1e-6 * (nu[rows[-1]] + nv[columns[-1]])
                if not (d.min() > least and d.max() < np.inf):
                    near = np.nonzero(~((d > least) & (d < np.inf)))
                    for k in range(0, len(near[0]), 32768):
                        a, b = near[0][k : k + 32768], near[1][k : k + 32768]
                        d[a, b] = ((x[rows[a]] - y[columns[b]]) ** 2).sum(1)
                np.sqrt(d, out=d)
                to_x[rows] += _weighted(d, wy[columns])
                if both:
                    to_y[columns] += _weighted(d.T, wx[rows])
    return to_x, to_y


def _within(points: _Points, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, counts) for each row and label column over the rows of other names."""
    w, width = points.weights, points.weights.shape[1]
    sums, counts = _sums(points.x, points.x, w, w, False)[0][points.at], np.repeat(w.sum(0)[None], len(names), 0)
    for c in points.columns.T:
        counts[np.flatnonzero(c >= 0), c[c >= 0]] -= 1
    _, code, size = np.unique(names, return_inverse=True, return_counts=True)
    for r in np.flatnonzero(size[code] > 1):
        w = points.weigh(code != code[r], width)
        some = w.any(1)
        sums[r], counts[r] = _sums(points.x[points.at[r]][None], points.x[some], np.zeros((1, 0)), w[some], False)[0][0], w.sum(0)
    return sums, counts


def _meet(t):
    """Sums of distances and their number, by row and label, of the rows of two blocks or within one: columns own, side, i, v and c to i, g, ci, cj, total and n."""
    import pyarrow as pa

    v, i, labels = (t.column(c).combine_chunks() for c in ("v", "i", "c"))
    flat, length = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64), v.value_lengths().to_numpy(zero_copy_only=False)
    start, names = np.cumsum(length) - length, i.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    labels = labels.flatten().dictionary_encode()
    values, code = labels.dictionary, labels.indices.fill_null(-1).to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
    width = code.shape[1] * len(values)
    columns = np.where(code >= 0, code + np.arange(code.shape[1]) * len(values), -1)
    side, out = t.column("side").to_numpy(), []

    def give(rows: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> None:
        a, b = np.nonzero(counts)
        known = code[rows[a], b // len(values)] >= 0
        a, b = a[known], b[known]
        g = b // len(values)
        out.append([i.take(pa.array(rows[a])), pa.array(g, pa.int32()), values.take(pa.array(code[rows[a], g])), values.take(pa.array(b % len(values))), pa.array(sums[a, b]), pa.array(counts[a, b].astype(np.int64))])

    for dim in np.unique(length):
        parts = [np.flatnonzero((length == dim) & (side == s)) for s in (0, 1)]
        x, y = (_Points(flat[start[r][:, None] + np.arange(dim)], columns[r], width) for r in parts)
        if t.column("own")[0].as_py():
            give(parts[0], *_within(x, names[parts[0]]))
        elif len(x.x) and len(y.x):
            to_x, to_y = _sums(x.x, y.x, x.weights, y.weights)
            for rows, points, sums, other in ((parts[0], x, to_x, y), (parts[1], y, to_y, x)):
                give(rows, sums[points.at], np.repeat(other.weights.sum(0)[None], len(rows), 0))
    types = [i.type, pa.int32(), values.type, values.type, pa.float64(), pa.int64()]
    return pa.Table.from_arrays([pa.chunked_array(list(c), k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 6, types, strict=True)], ["i", "g", "ci", "cj", "total", "n"])


def silhouettes(df: DataFrame, ids: str, vector: str, clusters: Sequence[str], block: int = 16384) -> DataFrame:
    """(id, labelling from 0, cluster, s): exact Euclidean silhouettes of labellings of one type, all from one pass over the pairs; 0 for a cluster of one, NaN where own and next cluster are at distance 0.

    Rows are dealt by their id's hash to blocks of about ``block`` rows, fewer with many clusters. Each two blocks meet in one task, which returns sums of
    distances by row and cluster; pairs are never rows. Work grows with the square of the rows, the shuffle with rows times blocks.
    Rows of one id aren't compared, and a table of one id has no result; rows without an id are left out. Vectors that are null or hold nulls have no
    distance, nor do two of different lengths. A row without a cluster has s 0 and counts in none.
    """
    kind, name = df.schema[clusters[0]].dataType.simpleString(), df.schema[ids].dataType.simpleString()
    real = df.schema[vector].dataType.simpleString() in ("array<float>", "array<double>")
    v = F.col(vector) if real else F.col(vector).cast("array<double>")
    rows = df.where(F.col(ids).isNotNull()).select(F.col(ids).alias("i"), v.alias("v"), F.array(*[F.col(c).cast(kind) for c in clusters]).alias("c"))
    rows = materialize(rows, "silhouettes")
    seen = rows.agg(F.count("*").alias("n"), F.min("i").alias("a"), F.max("i").alias("b")).first()
    named = rows.select("i", F.posexplode("c").alias("g", "ci")).where(F.lit(seen.n > 0 and seen.a != seen.b)).distinct()
    most = named.groupBy("g").agg(F.count_distinct("ci").alias("k")).agg(F.sum("k")).first()[0] or 1
    size = max(256, min(block, 2**23 // most))
    blocks = max(1, -(-seen.n // size), min(8, -(-seen.n // 256)))
    cells = blocks * (blocks + 1) // 2

    there = rows.where(F.col("v").isNotNull() & ~F.exists("v", F.isnull) & F.exists("c", F.isnotnull)).withColumn("b", F.pmod(F.xxhash64("i"), F.lit(blocks)))
    dealt = there.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    cell = F.least("b", "o") * blocks + F.greatest("b", "o")
    dealt = dealt.select(cell.alias("cell"), (F.col("b") == F.col("o")).alias("own"), (F.col("b") > F.col("o")).cast("int").alias("side"), "i", "v", "c").repartition(min(cells, 1000), "cell")
    met = dealt.groupBy("cell").applyInArrow(_meet, f"i {name}, g int, ci {kind}, cj {kind}, total double, n long")
    means = met.groupBy("g", "i", "ci", "cj").agg((F.sum("total") / F.sum("n")).alias("m"))
    every = means.unionByName(named.select("g", "i", "ci", F.lit(None).cast(kind).alias("cj"), F.lit(None).cast("double").alias("m")))  # rows without a distance, too
    own = F.max(F.when(F.col("ci") == F.col("cj"), F.col("m")))
    other = F.min(F.when(F.col("ci") != F.col("cj"), F.col("m")))
    s = every.groupBy("g", "i", "ci").agg(own.alias("a"), other.alias("b"))
    ratio = F.when((F.col("a") == 0) & (F.col("b") == 0), float("nan")).otherwise(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")))
    return s.select(F.col("i").alias("id"), F.col("g").alias("labelling"), F.col("ci").alias("cluster"), F.when(F.col("a").isNull(), 0.0).otherwise(ratio).alias("s"))


def silhouette(df: DataFrame, ids: str, vector: str, cluster: str) -> DataFrame:
    """(id, cluster, s): ``silhouettes`` of one labelling."""
    return silhouettes(df, ids, vector, [cluster]).select(F.col("id").alias(ids), F.col("cluster").alias(cluster), "s")


def two_by_two(df: DataFrame, keys: Sequence[str], exposed: Column, event: Column) -> DataFrame:
    """Odds ratio with its log's standard error, half added to each cell where one is empty."""
    n = [F.count_if(exposed & event), F.count_if(exposed & ~event), F.count_if(~exposed & event), F.count_if(~exposed & ~event)]
    t = df.groupBy(*keys).agg(*[c.alias(x) for c, x in zip(n, "abcd", strict=True)])
    add = F.when(F.least("a", "b", "c", "d") == 0, 0.5).otherwise(0.0)
    a, b, c, d = (F.col(x) + add for x in "abcd")
    return t.select(*keys, "a", "b", "c", "d", (a * d / (b * c)).alias("odds_ratio"), F.sqrt(1 / a + 1 / b + 1 / c + 1 / d).alias("se"))


def logistic(df: DataFrame, features: Sequence[str], label: str):
    """Binomial GLM; coefficients with standard errors and p-values are in the model's summary."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    rows = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip").transform(df)
    return GeneralizedLinearRegression(family="binomial", link="logit", labelCol=label, maxIter=50).fit(rows)


def elastic_net(df: DataFrame, features: Sequence[str], label: str, c: float = 1.0, ratio: float = 0.5, least: float = 1e-10) -> dict[str, float]:
    """Weights above ``least`` of a standardised logistic elastic net; ``c`` weighs the summed loss."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip").transform(df)
    n = max(1, rows.count())
    model = LogisticRegression(labelCol=label, elasticNetParam=ratio, regParam=1 / (c * n), standardization=True, maxIter=100).fit(rows)
    w = np.abs(model.coefficientMatrix.toArray()).max(0)
    return {f: float(x) for f, x in zip(features, w, strict=True) if x > least}


def kmeans_grid(df: DataFrame, vector: str, ks: Sequence[int], seed: int = 7) -> DataFrame:
    """(k, cost) for each k."""
    from pyspark.ml.clustering import KMeans

    rows = [(k, float(KMeans(featuresCol=vector, k=k, seed=seed, maxIter=20).fit(df).summary.trainingCost)) for k in ks]
    return df.sparkSession.createDataFrame(rows, "k int, cost double")


def stability(df: DataFrame, ids: str, features: Sequence[str], label: str, rounds: int, share: float, top: int) -> DataFrame:
    """(feature, probability): how often a feature is among the ``top`` by absolute mean difference over hashed resamples.

    All resamples are one job: each row is dealt to the rounds whose hash takes it.
    """
    taken = F.filter(F.sequence(F.lit(0), F.lit(rounds - 1)), lambda r: F.pmod(F.xxhash64(F.col(ids), r), F.lit(1000)) < int(share * 1000))
    long = df.withColumn("round", F.explode(taken)).select("round", F.col(label).alias("y"), F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])).alias("r")).select("round", "y", "r.*")
    e = F.col("y") == 1
    effect = F.abs(F.avg(F.when(e, F.col("value"))) - F.avg(F.when(~e, F.col("value")))) / F.nullif(F.stddev_samp("value"), F.lit(0.0))
    ranked = long.groupBy("round", "feature").agg(effect.alias("effect")).withColumn("k", F.row_number().over(Window.partitionBy("round").orderBy(F.desc_nulls_last("effect"), "feature")))
    return ranked.groupBy("feature").agg((F.count_if(F.col("k") <= top) / F.lit(rounds)).alias("probability"))
