"""Models of many groups at once, cross-fitted scores and feature selection by folds.

A Newton step needs sums over rows only, so every step is one aggregate by group: all models of a grid take a step in one job, rows combine before
the shuffle, and no group is gathered in a task. Coefficients are broadcast: a row a model.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clean as C
from . import ml as M
from . import stats as S


def _total(columns: Sequence[Column]) -> Column:
    return sum(columns[1:], columns[0])


def _within(x: Column, most: float) -> Column:
    """-most..most; NULL stays NULL, which least and greatest would skip."""
    return F.when(x.isNotNull(), F.greatest(F.lit(-most), F.least(F.lit(most), x)))


def _upper_tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _steps(df: DataFrame, keys: Sequence[str], terms: int, sums, ridge: float, rounds: int, tolerance: float) -> dict[tuple, tuple[np.ndarray, np.ndarray, int]]:
    """Newton's method by group: ``sums(df, beta)`` gives gradient and information columns g0.., h0_0.. by ``keys``, and n. (coefficients, covariance, n) by group."""
    spark = df.sparkSession
    found: dict[tuple, tuple[np.ndarray, np.ndarray, int]] = {}
    groups = [tuple(r) for r in df.select(*keys).distinct().collect()]  # a row a model
    open_ = {g: np.zeros(terms) for g in groups}
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    for _ in range(rounds):
        if not open_:
            break
        beta = spark.createDataFrame([(*g, b.tolist()) for g, b in open_.items()], f"{kinds}, beta array<double>")
        for r in sums(df.join(F.broadcast(beta), list(keys)) if keys else df.crossJoin(F.broadcast(beta)), keys).collect():
            g = tuple(r[k] for k in keys)
            info = np.array([[r[f"h{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(terms)] for i in range(terms)]) + ridge * np.eye(terms)
            slope = np.array([r[f"g{i}"] or 0.0 for i in range(terms)]) - ridge * open_[g]
            if not (np.isfinite(info).all() and np.isfinite(slope).all()):  # beyond what doubles hold: separated classes
                del open_[g]
                continue
            step = np.linalg.pinv(info) @ slope
            size = np.abs(step).max()
            open_[g] = open_[g] + step * min(1.0, 5.0 / max(size, 1e-300))
            found[g] = (open_[g], np.linalg.pinv(info), r["n"])
            if size < tolerance or np.abs(open_[g]).max() > 1e3:  # settled, or without end: separated classes
                del open_[g]
    return found


def logits(df: DataFrame, keys: Sequence[str], features: Sequence[str], label: str, *, ridge: float = 0.0, rounds: int = 30, tolerance: float = 1e-9) -> dict[tuple, tuple[np.ndarray, np.ndarray, int]]:
    """A logistic model for each group of ``keys`` on rows without missing values: intercept and one coefficient a feature."""
    rows = df.where(_all_there([*features, label])).select(*keys, F.col(label).cast("double").alias("y"), F.array(F.lit(1.0), *[F.col(f).cast("double") for f in features]).alias("x"))

    def sums(j: DataFrame, by: Sequence[str]) -> DataFrame:
        k = len(features) + 1
        eta = F.aggregate(F.zip_with("x", "beta", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        j = j.withColumn("p", 1 / (1 + F.exp(-_within(eta, 30.0))))
        w, x = F.col("p") * (1 - F.col("p")), [F.col("x")[i] for i in range(k)]
        return j.groupBy(*by).agg(F.count("*").alias("n"), *[F.sum((F.col("y") - F.col("p")) * x[i]).alias(f"g{i}") for i in range(k)], *[F.sum(w * x[i] * x[m]).alias(f"h{i}_{m}") for i in range(k) for m in range(i, k)])

    return _steps(rows, keys, len(features) + 1, sums, ridge, rounds, tolerance)


def hazards(df: DataFrame, keys: Sequence[str], features: Sequence[str], time: str, event: str, *, ridge: float = 0.0, rounds: int = 30, tolerance: float = 1e-9) -> dict[tuple, tuple[np.ndarray, np.ndarray, int]]:
    """A proportional hazards model for each group, ties by Breslow: risk sets are running sums over the group's distinct times, after rows of a time are added up."""
    rows = df.where(_all_there([*features, time, event])).select(*keys, F.col(time).cast("double").alias("t"), F.col(event).cast("double").alias("e"), F.array(*[F.col(f).cast("double") for f in features]).alias("x"))
    k = len(features)

    def sums(j: DataFrame, by: Sequence[str]) -> DataFrame:
        r = F.exp(F.aggregate(F.zip_with("x", "beta", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))
        x = [F.col("x")[i] for i in range(k)]
        at = j.groupBy(*by, "t").agg(F.count("*").alias("n"), F.sum("e").alias("d"), F.sum(r).alias("s"), *[F.sum(F.col("e") * x[i]).alias(f"d{i}") for i in range(k)], *[F.sum(r * x[i]).alias(f"s{i}") for i in range(k)], *[F.sum(r * x[i] * x[m]).alias(f"s{i}_{m}") for i in range(k) for m in range(i, k)])
        later = Window.partitionBy(*by).orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, 0)
        names = ["s", *[f"s{i}" for i in range(k)], *[f"s{i}_{m}" for i in range(k) for m in range(i, k)]]
        at = at.select(*by, "n", "d", *[f"d{i}" for i in range(k)], *[F.sum(c).over(later).alias(c) for c in names])
        mean = [F.col(f"s{i}") / F.col("s") for i in range(k)]
        return at.groupBy(*by).agg(F.sum("n").alias("n"), *[F.sum(F.col(f"d{i}") - F.col("d") * mean[i]).alias(f"g{i}") for i in range(k)], *[F.sum(F.col("d") * (F.col(f"s{i}_{m}") / F.col("s") - mean[i] * mean[m])).alias(f"h{i}_{m}") for i in range(k) for m in range(i, k)])

    return _steps(rows, keys, k, sums, ridge, rounds, tolerance)


def _all_there(columns: Sequence[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    return out


def effects(spark, models: Mapping[tuple, tuple[np.ndarray, np.ndarray, int]], keys: str, terms: Sequence[str]) -> DataFrame:
    """A row for each model and term: ratio exp(b), its 95 % bounds, two-sided p and n. ``keys``: the key columns with their types."""
    rows = []
    for g, (b, cov, n) in models.items():
        for i, term in enumerate(terms):
            se = math.sqrt(max(cov[i, i], 0.0))
            bound = lambda z: math.exp(max(-700.0, min(700.0, b[i] + z * se)))  # noqa: B023, E731
            rows.append((*g, term, bound(0), bound(-1.959963984540054), bound(1.959963984540054), _upper_tail(b[i] / se) if se else None, int(n)))
    return spark.createDataFrame(rows, ", ".join([*([keys] if keys else []), "term string", "ratio double", "low double", "high double", "p double", "n long"]))


def screen(df: DataFrame, ids: str, features: Sequence[str], outcomes: Sequence[str], adjust: Sequence[str] = ()) -> DataFrame:
    """(feature, outcome, ratio, low, high, p, q, n): one logistic model for each pair, features standardised; q by Benjamini and Hochberg within an outcome.

    Rows are unpivoted once, the models are groups of it.
    """
    stats = df.agg(*[f(x).alias(f"{n}{i}") for i, x in enumerate(features) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    z = [F.struct(F.lit(f).alias("feature"), ((F.col(f) - stats[f"m{i}"]) / (stats[f"s{i}"] or 1.0)).alias("x")) for i, f in enumerate(features)]
    y = [F.struct(F.lit(o).alias("outcome"), F.col(o).cast("double").alias("y")) for o in outcomes]
    long = df.select(*adjust, F.explode(F.array(*z)).alias("f"), F.array(*y).alias("o")).select(*adjust, "f.*", F.explode("o").alias("o")).select(*adjust, "feature", "x", "o.*")
    out = effects(df.sparkSession, logits(long, ["feature", "outcome"], ["x", *adjust], "y"), "feature string, outcome string", ["(intercept)", "x", *adjust]).where("term = 'x'").drop("term")
    w = Window.partitionBy("outcome")
    rank = F.row_number().over(w.orderBy("p", "feature"))
    raw = F.col("p") * F.count("p").over(w) / rank  # a row a model
    return out.withColumn("raw", raw).withColumn("q", F.least(F.lit(1.0), F.min("raw").over(w.orderBy(F.desc("p"), F.desc("feature"))))).drop("raw")


def dummies(df: DataFrame, column: str, levels: Sequence[str], reference: str) -> tuple[DataFrame, list[str]]:
    """0/1 columns for each level but the reference; rows of other levels are left out."""
    names = [f"{column}={v}" for v in levels if v != reference]
    return df.where(F.col(column).isin(*levels)).withColumns({n: (F.col(column) == n.split("=", 1)[1]).cast("double") for n in names}), names


def against_reference(df: DataFrame, column: str, levels: Sequence[str], reference: str, outcome: str, adjust: Sequence[str] = ()) -> DataFrame:
    """Odds ratios of each level against the reference, with ``adjust`` in the model."""
    rows, names = dummies(df, column, levels, reference)
    model = logits(rows.withColumn("_all", F.lit(1)), ["_all"], [*names, *adjust], outcome)
    return effects(df.sparkSession, model, "_all int", ["(intercept)", *names, *adjust]).where(F.col("term").isin(*names)).drop("_all")


def _applied(df: DataFrame, fold: str, models: Mapping[tuple, tuple[np.ndarray, np.ndarray, int]], features: Sequence[str]) -> DataFrame:
    """``df`` with score, the probability by the model of the row's own fold."""
    kind = df.schema[fold].dataType.simpleString()
    beta = df.sparkSession.createDataFrame([(g[0], b.tolist()) for g, (b, _, _) in models.items()], f"`{fold}` {kind}, beta array<double>")
    eta = F.col("beta")[0] + _total([F.col(f) * F.col("beta")[i] for i, f in enumerate(features, 1)])
    return df.join(F.broadcast(beta), fold, "left").withColumn("score", 1 / (1 + F.exp(-_within(eta, 30.0)))).drop("beta")  # a row a fold


def _others(df: DataFrame, fold: str, k: int) -> DataFrame:
    """Each row once for every fold whose training rows it belongs to, ``fold`` set to that one."""
    return df.withColumn(fold, F.explode(F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda f: f != F.col(fold))))


def out_of_fold(df: DataFrame, fold: str, k: int, features: Sequence[str], label: str, ridge: float = 1e-3) -> DataFrame:
    """``df`` with score: the probability by a logistic model of all other folds' rows."""
    return _applied(df, fold, logits(_others(df, fold, k), [fold], features, label, ridge=ridge), features)


def recalibrated(df: DataFrame, fold: str, k: int, score: str, label: str) -> DataFrame:
    """``df`` with recalibrated: a logistic model on the score's logit, fitted on the other folds."""
    held = df.withColumnRenamed(score, "_kept").withColumn("_logit", C.logit(F.col("_kept")))
    out = out_of_fold(held, fold, k, ["_logit"], label, 1e-6).drop("_logit")
    return out.withColumnRenamed("score", "recalibrated").withColumnRenamed("_kept", score)


def cross_validated_auc(df: DataFrame, fold: str, k: int, features: Sequence[str], label: str, ridge: float = 1e-3) -> DataFrame:
    """One row: n, events and the area under the curve of out-of-fold scores."""
    scored = out_of_fold(df, fold, k, features, label, ridge).withColumn("_all", F.lit(1))
    return S.rank_auc(scored, ["_all"], "score", label).drop("_all")


def fold_statistics(df: DataFrame, fold: str, k: int, features: Sequence[str], label: str) -> DataFrame:
    """(fold, feature, n, mean, sd, effect, sign, rank) of the rows outside each fold: standardised difference of means, ranked by its size, then by name."""
    long = _others(df, fold, k).select(fold, F.col(label).cast("boolean").alias("e"), F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])).alias("r")).select(fold, "e", "r.*")
    g = long.groupBy(fold, "feature").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"), S.standardized_difference(F.col("x"), F.col("e")).alias("effect"))
    rank = F.row_number().over(Window.partitionBy(fold).orderBy(F.desc_nulls_last(F.abs("effect")), "feature"))  # a row a feature
    return g.withColumn("sign", F.signum("effect")).withColumn("rank", rank)


def signed_scores(df: DataFrame, ids: Sequence[str], fold: str, statistics: DataFrame, features: Sequence[str], top: int, most: float = 8.0) -> DataFrame:
    """(ids, fold, score): mean of sign * z over the ``top`` features of the row's fold, z within -most..most; missing values don't count.

    Statistics come as one row a fold (maps by feature), so a score is an expression of the row: no unpivot, no shuffle.
    """
    chosen = statistics.where(F.col("rank") <= top)
    maps = chosen.groupBy(fold).agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("mean", "sd", "sign")))).alias("_by"))
    z = []
    for f in features:
        s = F.col("_by")[f]
        z.append(F.when(s.isNotNull() & (s["sd"] > 0), s["sign"] * _within((F.col(f) - s["mean"]) / s["sd"], most)))
    there = F.filter(F.array(*z), lambda v: v.isNotNull())
    mean = F.try_divide(F.aggregate(there, F.lit(0.0), lambda a, v: a + v), F.size(there).cast("double"))
    return df.join(F.broadcast(maps), fold).select(*ids, fold, mean.alias("score"))


def fold_selection(df: DataFrame, fold: str, k: int, groups: Mapping[str, Sequence[str]], label: str, top: int, redundant: float = 0.9, max_missing: float = 0.5) -> DataFrame:
    """(modality, fold, feature, place, auc): features chosen on the rows outside each fold, and the area under the curve of their model on the fold.

    Per modality and fold, on training rows alone: usable features, ranked by effect, less those that correlate with a better one, the first ``top``.
    The number of features bounds what reaches the driver.
    """
    rows = []
    for modality, features in groups.items():
        ranked: dict[int, list] = {}
        for r in fold_statistics(df, fold, k, features, label).collect():  # a row for each fold and feature
            ranked.setdefault(r[fold], []).append(r)
        for f in sorted(ranked):
            train, test = df.where(F.col(fold) != f), df.where(F.col(fold) == f)
            usable = {r.feature for r in M.feature_report(train, features, max_missing).where("usable").collect()}
            relevance = {r.feature: abs(r.effect or 0.0) for r in ranked[f] if r.feature in usable}
            pairs = [(r.a, r.b, r.r) for r in M.correlations(train, sorted(relevance)).collect()] if len(relevance) > 1 else []
            chosen = M.drop_redundant(relevance, pairs, redundant)[0][:top]
            auc = None
            if chosen:
                model = logits(train.withColumn("_all", F.lit(1)), ["_all"], chosen, label, ridge=1e-3)
                scored = _applied(test.withColumn("_all", F.lit(1)), "_all", model, chosen)
                auc = S.rank_auc(scored, ["_all"], "score", label).first()["auc"]
            rows += [(modality, int(f), c, i, auc) for i, c in enumerate(chosen, 1)]
    return df.sparkSession.createDataFrame(rows, "modality string, fold int, feature string, place int, auc double")


def signature(selected: DataFrame, folds: int, least: float) -> DataFrame:
    """(modality, feature, frequency) of features chosen in at least the share ``least`` of the folds."""
    return selected.groupBy("modality", "feature").agg((F.count_distinct("fold") / F.lit(folds)).alias("frequency")).where(F.col("frequency") >= least)


def tuned(df: DataFrame, fold: str, k: int, features: Sequence[str], label: str, cs: Sequence[float], ratios: Sequence[float]) -> DataFrame:
    """(c, ratio, auc, features, best): mean area over inner folds of each elastic net; best is the largest, then the fewest features, the smaller c, the larger ratio."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    whole = VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid="skip").transform(df)
    rows = []
    for c in cs:
        for ratio in ratios:
            areas, used = [], []
            for f in range(k):
                train = whole.where(F.col(fold) != f)
                model = LogisticRegression(featuresCol="_x", labelCol=label, elasticNetParam=ratio, regParam=1 / (c * max(1, train.count())), maxIter=50).fit(train)
                scored = model.transform(whole.where(F.col(fold) == f)).select(label, vector_to_array("probability")[1].alias("score"), F.lit(1).alias("_all"))
                areas.append(S.rank_auc(scored, ["_all"], "score", label).first()["auc"])
                used.append(int((np.abs(model.coefficients.toArray()) > 1e-10).sum()))
            there = [a for a in areas if a is not None]
            rows.append((float(c), float(ratio), float(np.mean(there)) if there else None, float(np.mean(used))))
    top = max(rows, key=lambda r: (-1.0 if r[2] is None else round(r[2], 12), -r[3], -r[0], r[1]))
    return df.sparkSession.createDataFrame([(*r, r == top) for r in rows], "c double, ratio double, auc double, features double, best boolean")


def mutual_information(df: DataFrame, features: Sequence[str], label: str, bins: int = 16) -> DataFrame:
    """(feature, mi) in nats between a feature's quantile bin and the label. Counts by bin, so it holds for any number of rows."""
    edges = {f: sorted(set(df.approxQuantile(f, [i / bins for i in range(1, bins)], 0.0))) for f in features}
    bin_ = lambda f: F.size(F.filter(F.array(*[F.lit(e) for e in edges[f]]), lambda e: e < F.col(f)))
    long = df.where(F.col(label).isNotNull()).select(F.col(label).alias("y"), F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.when(F.col(f).isNotNull(), bin_(f)).alias("b")) for f in features])).alias("r")).select("y", "r.*")
    n = long.where("b is not null").groupBy("feature", "b", "y").agg(F.count("*").alias("n"))
    part = lambda *by: F.sum("n").over(Window.partitionBy("feature", *by))  # noqa: E731  a row for each bin
    each = n.withColumns({"all": part(), "by_b": part("b"), "by_y": part("y")})
    return each.groupBy("feature").agg(F.sum(F.col("n") / F.col("all") * F.log(F.col("n") * F.col("all") / (F.col("by_b") * F.col("by_y")))).alias("mi"))


def prepared(df: DataFrame, ids: Sequence[str], features: Sequence[str], max_missing: float = 0.5, min_variance: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(matrix, report): usable features with missing values at the median, standardised by the population's deviation; and the report of all features."""
    report = M.feature_report(df, features, max_missing, min_variance)
    kept = [r.feature for r in report.where("usable").orderBy("feature").collect()]  # a row a feature
    if not kept:
        return df.select(*ids), report
    median = df.agg(*[F.median(f).alias(f) for f in kept]).first()
    filled = df.select(*ids, *[F.coalesce(F.col(f).cast("double"), F.lit(median[f])).alias(f) for f in kept])
    stats = filled.agg(*[f(c).alias(f"{n}_{c}") for c in kept for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return filled.select(*ids, *[((F.col(c) - stats[f"m_{c}"]) / (stats[f"s_{c}"] or 1.0)).alias(c) for c in kept]), report


def domain_components(matrix: DataFrame, ids: Sequence[str], groups: Mapping[str, Sequence[str]], n: int, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """(scores, loadings) of the first components of each group with ``least`` features or more: columns group_1.. and rows (domain, component, feature, loading, share)."""
    columns, rows = [], []
    for name, features in groups.items():
        features = [f for f in features if f in matrix.columns]
        if len(features) < least:
            continue
        mean, loadings, share = M.covariance_components(matrix, features, min(n, len(features)))
        for j in range(loadings.shape[1]):
            columns.append(_total([(F.col(f) - float(mean[i])) * float(loadings[i, j]) for i, f in enumerate(features)]).alias(f"{name}_{j + 1}"))
            rows += [(name, j + 1, f, float(loadings[i, j]), float(share[j])) for i, f in enumerate(features)]
    return matrix.select(*ids, *columns), matrix.sparkSession.createDataFrame(rows, "domain string, component int, feature string, loading double, share double")


def domain_ranking(loadings: DataFrame) -> DataFrame:
    """(domain, feature, importance, place): sum over components of |loading| times the component's share."""
    g = loadings.groupBy("domain", "feature").agg(F.sum(F.abs("loading") * F.col("share")).alias("importance"))
    return g.withColumn("place", F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("importance"), "feature")))


def block_weighted(matrix: DataFrame, ids: Sequence[str], blocks: Sequence[Sequence[str]]) -> DataFrame:
    """(ids, vector): each block scaled by sqrt(1 / (blocks * its features)), so that every block weighs the same in a distance."""
    parts = [F.col(f) * math.sqrt(1 / (len(blocks) * len(block))) for block in blocks for f in block]
    return matrix.select(*ids, F.array(*parts).alias("vector"))


def alternating_choice(ranking: Mapping[str, Sequence[str]], pairs: Sequence[tuple[str, str, float]], quality: Mapping[str, float], per_group: int, pool: int, penalty: float) -> list[tuple[str, str, float]]:
    """(group, feature, gain) in the order chosen: group by group in turn, of its first ``pool`` features the one of most quality less ``penalty`` times its mean |correlation| with those chosen."""
    strength = {frozenset(p[:2]): abs(p[2] or 0.0) for p in pairs}
    chosen: list[tuple[str, str, float]] = []
    for _ in range(per_group):
        for name in sorted(ranking):
            taken = [f for _, f, _ in chosen]
            left = [f for f in ranking[name][:pool] if f not in taken]
            if left:
                cost = lambda f: sum(strength.get(frozenset((f, t)), 0.0) for t in taken) / max(1, len(taken))  # noqa: B023, E731
                gain, feature = min((-(quality.get(f, 0.0) - penalty * cost(f)), f) for f in left)
                chosen.append((name, feature, -gain))
    return chosen
