"""Splits, selectors, stability, performance and threshold models against numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import assess as A
from tessera.operators import ml as M

from .test_fits import auc, plain_logit


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(240, 3))
    x[:, 2] = x[:, 0] * 0.99 + 0.05 * x[:, 2]
    y = (rng.random(240) < 1 / (1 + np.exp(-1.5 * x[:, 0]))).astype(int)
    g = np.arange(240) // np.array([7, 20, 3, 11] * 60) % 9
    t = rng.integers(1, 30, 240)
    df = spark.createDataFrame([(i, int(g[i]), int(y[i]), int(t[i]), *map(float, x[i])) for i in range(240)], "id int, g int, y int, t int, a double, b double, c double").repartition(3).cache()
    return df, x, y, g, t


def test_splits(data):
    df, _, y, g, _ = data
    by_group = {r.id: r.fold for r in A.splits(df, ["id"], 4, group="g").collect()}
    assert len(by_group) == 240 and all(len({by_group[i] for i in range(240) if g[i] == k}) == 1 for k in set(g.tolist())) and set(by_group.values()) == {0, 1, 2, 3}
    strata = {r.id: r.fold for r in A.splits(df, ["id"], 5, label="y").collect()}
    for k in (0, 1):
        n = np.bincount([strata[i] for i in range(240) if y[i] == k])
        assert n.max() - n.min() <= 1 and len(n) == 5
    plain = np.bincount([r.fold for r in A.splits(df, ["id"], 7).collect()])
    assert plain.sum() == 240 and plain.max() - plain.min() <= 1
    with pytest.raises(ValueError):
        A.splits(df.where("g = 1"), ["id"], 3, group="g")
    with pytest.raises(ValueError):
        A.splits(df.where("y = 1"), ["id"], 3, label="y")


def test_relevance_by_task(data):
    df, x, y, g, t = data
    rank = lambda v: np.array([(v < u).sum() + ((v == u).sum() + 1) / 2 for u in v])
    got = {task: {r.feature: (r.relevance, r.sign) for r in A.relevance(df, ["a", "b"], target, task, event="y" if task == "survival" else None).collect()} for task, target in (("binary", "y"), ("multiclass", "g"), ("regression", "t"), ("survival", "t"))}
    for i, f in enumerate("ab"):
        v = x[:, i]
        area = auc(v, y)
        assert got["binary"][f] == (pytest.approx(abs(area - 0.5)), 1 if area >= 0.5 else -1)
        rho = np.corrcoef(rank(v), rank(t))[0, 1]
        assert got["regression"][f] == (pytest.approx(abs(rho)), 1 if rho >= 0 else -1)
        groups = [v[g == k] for k in set(g.tolist())]
        between = sum(len(u) * (u.mean() - v.mean()) ** 2 for u in groups) / (len(groups) - 1)
        within = sum(((u - u.mean()) ** 2).sum() for u in groups) / (240 - len(groups))
        assert got["multiclass"][f][0] == pytest.approx(between / within)
        pairs = [1.0 if v[p] > v[q] else 0.5 if v[p] == v[q] else 0.0 for p in range(240) if y[p] for q in range(240) if t[p] < t[q]]
        assert got["survival"][f] == (pytest.approx(abs(np.mean(pairs) - 0.5)), 1 if np.mean(pairs) >= 0.5 else -1)


def test_selector(data):
    df = data[0]
    chosen = A.fit_selector(df.withColumn("flat", F.lit(1.0)), ["a", "b", "c", "flat"], "y", top=3)
    names = [f for f, _, _ in chosen]
    assert ("a" in names) != ("c" in names) and "flat" not in names and all(w > 0 for _, _, w in chosen)
    none = A.fit_selector(df, ["a", "b", "c"], "y", top=3, c=1e-6)
    assert [w for _, _, w in none] == [0.0, 0.0] and none[0][1] >= none[1][1]
    assert A.fit_selector(df.withColumn("flat", F.lit(1.0)), ["flat"], "y", top=3) == []


def test_correlations(data):
    df, x, *_ = data
    holes = df.withColumn("b", F.when(F.col("id") % 3 > 0, F.col("b"))).withColumn("flat", F.lit(2.0))
    got = {(r.a, r.b): (r.r, r.n) for r in A.pairwise_correlation(holes, [("a", "b"), ("a", "flat"), ("a", "c")]).collect()}
    some = np.arange(240) % 3 > 0
    assert got["a", "b"] == (pytest.approx(np.corrcoef(x[some, 0], x[some, 1])[0, 1]), 160) and got["a", "flat"] == (None, 240)
    assert A.pairwise_correlation(holes.where("id < 3"), [("a", "b")], 3).first().r is None
    assert A.most_correlated(df, "a", ["b", "c"]) == pytest.approx(abs(np.corrcoef(x[:, 0], x[:, 2])[0, 1])) and A.most_correlated(df, "a", []) == 0.0
    kept, dropped = A.uncorrelated(df, ["c", "a", "b"], 2, 0.9)
    assert kept == ["c", "b"] and [d[:2] for d in dropped] == [("a", "c")]


def test_constants_over_many_partitions(spark):
    df = spark.range(0, 1000, 1, 13).select(F.sqrt("id").alias("x"), F.lit(0.1).alias("flat"))
    assert [r.r for r in A.pairwise_correlation(df, [("x", "flat"), ("flat", "x"), ("flat", "flat")]).collect()] == [None] * 3
    assert M.correlations(df, ["flat", "x"]).first().r is None


def test_stability_by_unit(data):
    df, x, y, g, _ = data
    took = {}
    for r in A.resampled(df, "g", 20, 0.5).collect():
        took.setdefault(r.round, set()).add(r.id)
    for ids in took.values():
        assert all((i in ids) == any(j in ids for j in range(240) if g[j] == g[i]) for i in range(240))
    got = {r.feature: r for r in A.stability(df, "g", ["a", "b"], "y", 20, 0.5, 1, 0.6).collect()}
    won = {"a": 0, "b": 0}
    for ids in took.values():
        at = sorted(ids)
        if 0 < y[at].sum() < len(at):
            won["ab"[int(np.argmax([abs(auc(x[at, i], y[at]) - 0.5) for i in (0, 1)]))]] += 1
    assert {f: r.selected for f, r in got.items()} == won and got["a"].stable and set(got) == {"a", "b"}
    assert {r.feature for r in A.stability(df, "g", ["a", "b"], "y", 20, 0.5, 1, 0.6, every=False).collect()} == {f for f in won if won[f]}


def test_performance_and_calibration(data):
    df, x, y, *_ = data
    scored = df.withColumn("p", 1 / (1 + F.exp(-F.col("a"))))
    p = 1 / (1 + np.exp(-x[:, 0]))
    r = {r.score: r for r in A.performance(scored, ["p", "b"], "y").collect()}["p"]
    order = np.argsort(-p)
    hits = np.cumsum(y[order])
    lo, hi = np.quantile(p, [0.25, 0.75])
    assert r.auc == pytest.approx(auc(p, y)) and r.average_precision == pytest.approx((y[order] * hits / np.arange(1, 241)).sum() / y.sum())
    assert r.low_rate == pytest.approx(y[p <= lo].mean()) and r.high_rate == pytest.approx(y[p >= hi].mean())
    s = A.calibration_summary(scored, "p", "y").first()
    b, _ = plain_logit(x[:, :1], y)
    bins = np.minimum(9, np.floor(p * 10)).astype(int)
    ece = sum(abs(p[bins == k].mean() - y[bins == k].mean()) * (bins == k).sum() for k in set(bins.tolist())) / 240
    assert (s.n, s.events) == (240, y.sum()) and s.brier == pytest.approx(((p - y) ** 2).mean()) and s.ece == pytest.approx(ece)
    assert (s.intercept, s.slope) == (pytest.approx(b[0], abs=1e-6), pytest.approx(b[1], abs=1e-6))
    assert A.calibration_summary(scored.where("y = 1"), "p", "y").first().slope is None


def test_odds(data):
    df, x, y, *_ = data
    got = {(r.feature, r.threshold): r for r in A.threshold_odds(df, ["a", "b"], "y", {"median": 0.5, "top": 0.75}, ["c"]).collect()}
    for i, f in enumerate("ab"):
        for n, q in (("median", 0.5), ("top", 0.75)):
            high = x[:, i] > np.quantile(x[:, i], q)
            b, _ = plain_logit(np.column_stack([high, x[:, 2]]), y)
            assert got[f, n].ratio == pytest.approx(math.exp(b[1]), rel=1e-6) and got[f, n].cut == pytest.approx(np.quantile(x[:, i], q))
    pos = df.withColumns({"a": F.abs("a"), "flat": F.lit(0.0)})
    one = A.spread_odds(pos, ["a", "flat"], {"y": F.col("y"), "not": 1 - F.col("y")}).collect()
    v = np.log1p(np.abs(x[:, 0]))
    iqr = np.quantile(v, 0.75) - np.quantile(v, 0.25)
    b, _ = plain_logit((v / iqr)[:, None], y)
    assert {(r.feature, r.outcome): (pytest.approx(r.ratio, rel=1e-6), pytest.approx(r.iqr)) for r in one} == {("a", "y"): (math.exp(b[1]), iqr), ("a", "not"): (math.exp(-b[1]), iqr)}


def test_survival_fallback(data):
    df = data[0]
    c, how = A.survival_score(df, df, ["a", "b"], "t", "y")
    assert how == "hazards" and 0.4 < c < 1
    parted = df.withColumns({"sep": F.when(F.col("y") == 1, 100.0 - F.col("t")).otherwise(-1000.0)})
    c, how = A.survival_score(parted, parted, ["sep"], "t", "y")
    assert c is not None and how in ("hazards", "signed z")


def plain_silhouettes(rows):
    """(id, cluster): s by all pairs, as the query's SQL has it."""
    out = {}
    for i, c in {r[:2] for r in rows if r[0] is not None}:
        mean = {}
        for k in {r[1] for r in rows if r[1] is not None}:
            pairs = [(p[2], q[2]) for p in rows if p[:2] == (i, c) for q in rows if q[0] not in (i, None) and q[1] == k]
            d = [math.dist(u, v) for u, v in pairs if u is not None and v is not None and len(u) == len(v) and None not in u and None not in v]
            if d:
                mean[k] = math.fsum(d) / len(d)
        a, b = mean.get(c), min((m for k, m in mean.items() if k != c and c is not None), default=None)
        out[i, c] = 0.0 if a is None else None if b is None else math.nan if a == b == 0 else (b - a) / max(a, b)
    return out


@pytest.mark.parametrize("block", [16, 4096])
def test_silhouettes_by_blocks(spark, block):
    rng = np.random.default_rng(5)
    rows = [(i, f"k{i % 3}", (1e3 + rng.normal(i % 3, 1, 4)).tolist()) for i in range(60)]
    rows += [(60 + i, "copies", rows[7][2]) for i in range(5)] + [(70 + i, f"k{i}", [x + 1e-7 for x in rows[7][2]]) for i in range(3)]
    rows += [(80, "alone", [0.0] * 4), (81, "k0", [1.0, 2.0]), (82, "k1", [2.0, 2.0]), (83, "k0", None), (84, "k1", [1.0, None, 3.0, 4.0]), (85, None, [1.0] * 4), (None, "k0", [5.0] * 4)]
    rows += [(3, "k0", [2.0] * 4), (3, "k1", [3.0] * 4), (3, "k1", [4.0] * 4)]  # rows of one id
    df = spark.createDataFrame(rows, "id int, c string, v array<double>")
    want = plain_silhouettes(rows)
    got = M.silhouettes(df.withColumn("d", F.lit("one")), "id", "v", ["c", "d"], block).collect()
    assert {(r.id, r.cluster): r.s for r in got if r.labelling == 0} == pytest.approx(want, abs=1e-12)
    assert all(r.s in (0.0, None) for r in got if r.labelling == 1)


def test_silhouette_edges(spark):
    df = spark.createDataFrame([(i, i % 2, [1.0, 2.0]) for i in range(6)], "id int, c int, v array<float>")
    out = M.silhouette(df, "id", "v", "c")
    assert out.columns == ["id", "c", "s"] and all(math.isnan(r.s) for r in out.collect())
    assert M.silhouette(df.where("id = 1"), "id", "v", "c").count() == M.silhouette(df.limit(0), "id", "v", "c").count() == 0
    far = spark.createDataFrame([(0, 0, [0.0]), (1, 0, [1.0]), (2, 1, [5.0]), (3, 1, [math.nan])], "id int, c int, v array<double>")
    assert {r.id: r.s for r in M.silhouette(far.where("id < 3"), "id", "v", "c").collect()} == pytest.approx({0: 0.8, 1: 0.75, 2: 0.0})
    assert all(math.isnan(r.s) for r in M.silhouette(far, "id", "v", "c").where("id < 3").collect())


def test_silhouette_forms_no_rows_of_pairs(spark):
    df = spark.range(3000).select("id", (F.col("id") % 3).alias("c"), F.array(F.rand(1), F.rand(2)).alias("v"))
    plan = M.silhouette(df, "id", "v", "c")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_clusters_and_distances(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.1, (12, 2)) for c in (0, 5, 10)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>")
    got = A.cluster_grid(df, "id", "v", [2, 3, 5], restarts=3).collect()
    assert [r.k for r in got if r.best] == [3]
    cost = sum(((x[k * 12 : k * 12 + 12] - x[k * 12 : k * 12 + 12].mean(0)) ** 2).sum() for k in range(3))
    assert next(r for r in got if r.k == 3).cost == pytest.approx(cost)
    d = {(r.i, r.j): r.distance for r in A.distances(df, "id", "v").collect()}
    assert len(d) == 36 * 35 / 2 and d[0, 20] == pytest.approx(np.linalg.norm(x[0] - x[20]))


def test_cluster_grid_goes_over_the_pairs_once(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.1, (12, 2)) for c in (0, 5, 10)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>")
    calls, silhouettes = [], M.silhouettes
    monkeypatch.setattr(M, "silhouettes", lambda *a: calls.append(a[3]) or silhouettes(*a))
    got = {r.k: r for r in A.cluster_grid(df, "id", "v", [2, 3], restarts=3).collect()}
    assert len(calls) == 1 and len(calls[0]) == 2
    want = plain_silhouettes([(i, i // 12, v.tolist()) for i, v in enumerate(x)])
    assert got[3].best and got[3].silhouette == pytest.approx(sum(want.values()) / 36)
