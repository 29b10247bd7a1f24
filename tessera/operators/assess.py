"""Validation splits, selectors, relevance by task, stability over resamples, performance tables and threshold models.

Rows are never gathered: what reaches the driver are statistics by feature, fold or model.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clean as C
from ..storage import materialize
from . import evaluate as E
from . import fits as T
from . import ml as M
from . import stats as S
from . import windows as W
from .reshape import wide_to_long


# ---------------------------------------------------------------- splits
def splits(df: DataFrame, ids: Sequence[str], k: int, *, label: str | None = None, group: str | None = None) -> DataFrame:
    """``df`` with fold 0..k-1: whole groups, dealt out by falling size back and forth; else classes of ``label`` in turn; else rows in turn, in the order of the number ``ids[0]``.

    At most as many folds as there are groups, or rows of the rarest class; fewer than two of either are an error.
    """
    if group is not None:
        sizes = df.groupBy(F.col(group).cast("string").alias("_g")).agg(F.count("*").alias("_n"))
        k = min(k, sizes.count())
        if k < 2:
            raise ValueError(f"{group} has fewer than 2 groups")
        ranked = W.global_rank(sizes.withColumn("_s", -F.col("_n")), "_s", ["_g"], "_r", "_t")
        lap = F.pmod(F.col("_r") - 1, F.lit(2 * k))
        fold = F.when(lap < k, lap).otherwise(2 * k - 1 - lap).cast("int")
        named = df.withColumn("_g", F.col(group).cast("string")).alias("d")
        return named.join(ranked.select("_g", fold.alias("fold")).alias("s"), F.col("d._g").eqNullSafe(F.col("s._g"))).drop("_g")
    if label is not None:
        counts = df.groupBy(label).agg(F.count("*").alias("n")).agg(F.count("*").alias("classes"), F.min("n").alias("least")).first()
        if counts.classes < 2 or counts.least < 2:
            raise ValueError("classes need at least 2, of 2 rows each")
        return M.stratified_fold(df, label, ids, min(k, counts.least))
    ranked = W.global_rank(df, ids[0], ids[1:], "_r", "_t").drop("__b", "_t")
    return ranked.withColumn("fold", F.pmod(F.col("_r") - 1, F.lit(k)).cast("int")).drop("_r")


# ---------------------------------------------------------------- relevance and selection
def relevance(df: DataFrame, features: Sequence[str], target: str, task: str, *, event: str | None = None) -> DataFrame:
    """(feature, relevance, sign): |area - 0.5| for classes 0 and 1, F for several, |rank correlation| for numbers, |concordance - 0.5| for times with ``event``; 0 where it isn't defined."""
    if task == "survival":
        rows = []
        for f in features:  # a row a feature
            c = S.concordance(df.where(F.col(f).isNotNull()), target, f, event).first().c_index
            rows.append((f, abs(c - 0.5) if c is not None else 0.0, 0 if c is None else 1 if c >= 0.5 else -1))
        return df.sparkSession.createDataFrame(rows, "feature string, relevance double, sign int")
    long = wide_to_long(df.select(F.col(target).alias("_y"), *features), ["_y"], list(features))
    if task == "binary":
        raw = S.rank_auc(long, ["feature"], "value", "_y").select("feature", (F.col("auc") - 0.5).alias("r"))
    elif task == "multiclass":
        raw = S.anova_f(long, ["feature"], "value", "_y").select("feature", F.col("f").alias("r"))
    else:
        raw = S.spearman(long, ["feature"], "value", "_y").select("feature", F.col("rho").alias("r"))
    size = F.coalesce(F.abs("r"), F.lit(0.0))
    return raw.select("feature", size.alias("relevance"), F.when(F.col("r").isNull(), 0).when(F.col("r") >= 0, 1).otherwise(-1).alias("sign"))


def median_filled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Missing values at the feature's median."""
    m = df.agg(*[F.median(f).alias(f) for f in features]).first()
    return df.withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(m[f])) for f in features})


def fit_selector(train: DataFrame, features: Sequence[str], label: str, *, top: int, redundant: float = 0.9, max_missing: float = 0.5, c: float = 1.0, ratio: float = 0.5, fallback: int = 3) -> list[tuple[str, float, float]]:
    """(feature, relevance, weight) chosen on training rows alone: usable features, ranked by relevance, less redundant ones, the first ``top``, those that an elastic net keeps; where it keeps none the first ``fallback`` of them with weight 0."""
    usable = sorted(r.feature for r in M.feature_report(train, features, max_missing).where("usable").collect())  # a row a feature
    if not usable:
        return []
    score = {r.feature: r.relevance for r in relevance(train, usable, label, "binary").collect()}
    pairs = [(r.a, r.b, r.r) for r in M.correlations(train, usable).collect()] if len(usable) > 1 else []
    ranked = M.drop_redundant(score, pairs, redundant)[0][:top]
    kept = M.elastic_net(median_filled(train, ranked), ranked, label, c, ratio)
    return [(f, score[f], kept[f]) for f in ranked if f in kept] or [(f, score[f], 0.0) for f in ranked[:fallback]]


def pairwise_correlation(df: DataFrame, pairs: Sequence[tuple[str, str]], least: int = 3) -> DataFrame:
    """(a, b, r, n) on rows where both are there; NULL below ``least`` rows or where either doesn't vary. One aggregate for all pairs."""
    parts = []
    for i, (a, b) in enumerate(pairs):
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        x, y = F.when(both, F.col(a).cast("double")), F.when(both, F.col(b).cast("double"))
        r = F.when(F.count(x) >= least, M.correlation(x, y))
        parts.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), r.alias("r"), F.count(x).alias("n")).alias(f"p{i}"))
    row = df.agg(*parts)
    return row.select(F.explode(F.array(*row.columns)).alias("p")).select("p.*")


def most_correlated(df: DataFrame, candidate: str, chosen: Sequence[str]) -> float:
    """The greatest |correlation| of a candidate with the chosen features; 0 without any."""
    rows = pairwise_correlation(df, [(candidate, c) for c in chosen if c != candidate]).collect() if chosen else []  # a row a feature
    return max((abs(r.r) for r in rows if r.r is not None), default=0.0)


def uncorrelated(df: DataFrame, ranking: Sequence[str], top: int, limit: float, least: int = 3) -> tuple[list[str], list[tuple[str, str, float]]]:
    """(kept, [(dropped, because of, r)]): in the order of the ranking, each feature unless it correlates at ``limit`` or more with a kept one, until ``top`` are kept."""
    pairs = [(a, b) for i, a in enumerate(ranking) for b in ranking[i + 1 :]]
    r = {frozenset((x.a, x.b)): abs(x.r) for x in pairwise_correlation(df, pairs, least).collect() if x.r is not None} if pairs else {}
    kept, dropped = [], []
    for f in ranking:
        if len(kept) == top:
            break
        hit = next(((k, r[frozenset((f, k))]) for k in kept if r.get(frozenset((f, k)), 0.0) >= limit), None)
        if hit:
            dropped.append((f, *hit))
        else:
            kept.append(f)
    return kept, dropped


def resampled(df: DataFrame, unit: str, rounds: int, share: float, seed: int = 0) -> DataFrame:
    """``df`` with round: each row once for every round that takes its ``unit`` (a row's id, or its group's), by hash; all rows of a unit go together."""
    taken = F.filter(F.sequence(F.lit(0), F.lit(rounds - 1)), lambda r: F.pmod(F.xxhash64(F.col(unit), r, F.lit(seed)), F.lit(10_000)) < int(share * 10_000))
    return df.withColumn("round", F.explode(taken))


def stability(df: DataFrame, unit: str, features: Sequence[str], label: str, rounds: int, share: float, top: int, limit: float, *, every: bool = True) -> DataFrame:
    """(feature, selected, eligible, probability, stable): how often a feature is among the ``top`` by area under the curve in resamples of units.

    A resample where a feature's area isn't defined isn't eligible for it. ``every`` gives a row, of probability 0, also to features never selected,
    over all resamples; without it probability is over the eligible ones, and only selected features have a row. All resamples are one job.
    """
    long = wide_to_long(resampled(df, unit, rounds, share).select("round", F.col(label).alias("_y"), *features), ["round", "_y"], list(features))
    area = S.rank_auc(long, ["round", "feature"], "value", "_y").withColumn("effect", F.abs(F.col("auc") - 0.5))
    placed = area.withColumn("place", F.row_number().over(Window.partitionBy("round").orderBy(F.desc_nulls_last("effect"), "feature")))  # a row a feature
    hit = F.col("effect").isNotNull() & (F.col("place") <= top)
    g = placed.groupBy("feature").agg(F.count_if(hit).alias("selected"), F.count("effect").alias("eligible"))
    whole = F.lit(rounds) if every else F.nullif(F.col("eligible"), F.lit(0))
    out = g.withColumn("probability", F.coalesce(F.col("selected") / whole, F.lit(0.0))).withColumn("stable", F.col("probability") >= limit)
    return out if every else out.where("selected > 0")


def survival_score(train: DataFrame, test: DataFrame, features: Sequence[str], time: str, event: str) -> tuple[float | None, str]:
    """(concordance on the test rows, how): of a proportional hazards model's risk; where that isn't finite, of the mean signed z over sqrt(p), z and signs from training."""
    model = T.hazards(train.withColumn("_all", F.lit(1)), ["_all"], features, time, event, ridge=1e-6).get((1,))
    if model is not None and np.isfinite(model[0]).all() and np.abs(model[0]).max() < 50:
        risk, how = sum((F.col(f) * float(b) for f, b in zip(features, model[0], strict=True)), F.lit(0.0)), "hazards"
    else:
        sign = {r.feature: r.sign for r in relevance(train, features, time, "survival", event=event).collect()}
        st = train.agg(*[g(f).alias(f"{n}_{f}") for f in features for n, g in (("m", F.avg), ("s", F.stddev_samp))]).first()
        parts = [sign[f] * F.coalesce((F.col(f) - st[f"m_{f}"]) / (st[f"s_{f}"] or 1.0), F.lit(0.0)) for f in features]
        risk, how = sum(parts[1:], parts[0]) / len(features) ** 0.5, "signed z"
    return S.concordance(test.withColumn("_risk", risk), time, "_risk", event).first().c_index, how


# ---------------------------------------------------------------- performance
def performance(df: DataFrame, scores: Sequence[str], label: str) -> DataFrame:
    """(score, n, events, auc, auc_directional, average_precision, low_rate, high_rate): rates of events in the lowest and highest quarter, bounds included."""
    e = F.col(label).cast("boolean")
    long = wide_to_long(df.where(e.isNotNull()).select(e.alias("_e"), *scores), ["_e"], list(scores), "score").where("value is not null")
    auc = S.rank_auc(long, ["score"], "value", "_e")
    ap = E.average_precision(long, ["score"], "value", "_e")
    cut = long.groupBy("score").agg(F.percentile("value", 0.25).alias("_l"), F.percentile("value", 0.75).alias("_h"))
    y = F.col("_e").cast("double")
    rates = long.join(F.broadcast(cut), "score").groupBy("score").agg(F.avg(F.when(F.col("value") <= F.col("_l"), y)).alias("low_rate"), F.avg(F.when(F.col("value") >= F.col("_h"), y)).alias("high_rate"))
    return auc.join(ap, "score").join(rates, "score").withColumn("auc_directional", F.greatest("auc", 1 - F.col("auc")))


def calibration_summary(df: DataFrame, score: str, label: str, bins: int = 10) -> DataFrame:
    """One row: n, events, rate, mean probability, Brier score, expected calibration error, and intercept and slope of a logistic model on the logit (NULL with one class)."""
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.when(F.col(score).isNotNull(), F.col(score).cast("double"))))
    rows = df.where(F.col(score).isNotNull() & F.col(label).isin(0, 1)).select(p.alias("_p"), F.col(label).cast("int").alias("_y"), F.lit(1).alias("_all"))
    e = F.col("_y") == 1
    out = rows.agg(F.count("*").alias("n"), F.sum("_y").alias("events"), F.avg("_y").alias("rate"), F.avg("_p").alias("mean_p"), F.avg((F.col("_p") - F.col("_y")) ** 2).alias("brier"))
    ece = E.expected_calibration_error(rows, ["_all"], F.col("_p"), e, bins).select("ece")
    counts = rows.agg(F.min("_y").alias("a"), F.max("_y").alias("b")).first()
    fit = T.logits(rows.withColumn("_x", C.logit(F.col("_p"))), ["_all"], ["_x"], "_y") if counts.a != counts.b else {}
    intercept, slope = map(float, fit[1,][0]) if fit else (None, None)
    return out.join(ece, F.lit(True), "left").withColumns({"intercept": F.lit(intercept).cast("double"), "slope": F.lit(slope).cast("double")})  # one row each


def threshold_odds(df: DataFrame, features: Sequence[str], outcome: str, quantiles: Mapping[str, float], adjust: Sequence[str] = ()) -> DataFrame:
    """(feature, threshold, cut, ratio, low, high, p, n): odds ratios of values above a quantile, alone or with ``adjust`` in the model. All models are one run."""
    cuts = df.agg(*[F.percentile(f, q).alias(f"{f}|{n}") for f in features for n, q in quantiles.items()]).first()
    arms = [F.struct(F.lit(f).alias("feature"), F.lit(n).alias("threshold"), F.when(F.col(f).isNotNull(), (F.col(f) > cuts[f"{f}|{n}"]).cast("double")).alias("high")) for f in features for n in quantiles]
    long = df.select(outcome, *adjust, F.explode(F.array(*arms)).alias("a")).select(outcome, *adjust, "a.*")
    fit = T.logits(long, ["feature", "threshold"], ["high", *adjust], outcome)
    named = df.sparkSession.createDataFrame([(f, n, float(cuts[f"{f}|{n}"])) for f in features for n in quantiles if cuts[f"{f}|{n}"] is not None], "feature string, threshold string, cut double")
    out = T.effects(df.sparkSession, fit, "feature string, threshold string", ["(intercept)", "high", *adjust]).where("term = 'high'").drop("term")
    return named.join(out, ["feature", "threshold"])


def spread_odds(df: DataFrame, features: Sequence[str], outcomes: Mapping[str, Column], adjust: Sequence[str] = ()) -> DataFrame:
    """(feature, outcome, iqr, ratio, low, high, p, n): odds ratios for one interquartile range of log(1 + x); features without such a range are left out."""
    q = df.agg(*[(F.percentile(F.log1p(f), 0.75) - F.percentile(F.log1p(f), 0.25)).alias(f) for f in features]).first()
    used = [f for f in features if q[f] is not None and np.isfinite(q[f]) and q[f] > 0]
    arms = [F.struct(F.lit(f).alias("feature"), (F.log1p(f) / q[f]).alias("x")) for f in used]
    ys = [F.struct(F.lit(n).alias("outcome"), c.cast("double").alias("y")) for n, c in outcomes.items()]
    long = df.select(*adjust, F.explode(F.array(*arms)).alias("a"), F.array(*ys).alias("o")).select(*adjust, "a.*", F.explode("o").alias("o")).select(*adjust, "feature", "x", "o.*")
    fit = T.logits(long, ["feature", "outcome"], ["x", *adjust], "y")
    out = T.effects(df.sparkSession, fit, "feature string, outcome string", ["(intercept)", "x", *adjust]).where("term = 'x'").drop("term")
    return out.join(df.sparkSession.createDataFrame([(f, float(q[f])) for f in used], "feature string, iqr double"), "feature")


# ---------------------------------------------------------------- clusters
def cluster_grid(df: DataFrame, ids: str, vector: str, ks: Sequence[int], seed: int = 7, restarts: int = 1) -> DataFrame:
    """(k, cost, silhouette, best): k-means of least cost over restarts for each k, the exact mean silhouette, and the k where it is greatest (the smallest of ties).

    The pairs of rows are gone through once for all k.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    held = materialize(df.select(ids, vector), "clusters").withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    dealt, costs = held, []
    for i, k in enumerate(ks):
        fits = [KMeans(featuresCol="_v", predictionCol=f"_c{i}", k=k, seed=seed + r, maxIter=20).fit(held) for r in range(restarts)]
        model = min(fits, key=lambda m: m.summary.trainingCost)
        dealt = model.transform(dealt)
        costs.append(float(model.summary.trainingCost))
    s = M.silhouettes(dealt, ids, vector, [f"_c{i}" for i in range(len(ks))]).groupBy("labelling").agg(F.avg("s").alias("s")).collect()  # a row a k
    s = {r.labelling: r.s for r in s}
    rows = [(k, c, float(s[i])) for i, (k, c) in enumerate(zip(ks, costs, strict=True))]
    best = max(rows, key=lambda r: (round(r[2], 12), -r[0]))
    return df.sparkSession.createDataFrame([(*r, r == best) for r in rows], "k int, cost double, silhouette double, best boolean")


def distances(df: DataFrame, ids: str, vector: str) -> DataFrame:
    """(i, j, distance) of all pairs i < j: a result of that size, for cohorts."""
    a, b = df.select(F.col(ids).alias("i"), F.col(vector).alias("u")), df.select(F.col(ids).alias("j"), F.col(vector).alias("v"))
    d = F.sqrt(F.aggregate(F.zip_with("u", "v", lambda p, q: (p.cast("double") - q.cast("double")) * (p.cast("double") - q.cast("double"))), F.lit(0.0), lambda s, x: s + x))
    return a.join(b, F.expr("i < j")).select("i", "j", d.alias("distance"))
