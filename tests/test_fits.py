"""Grouped models, cross-fitting and selection against plain numpy."""

import math

import numpy as np
import pytest

from tessera.operators import fits as T
from tessera.plans.registry import selection as Q

from .conftest import DATA


def plain_logit(x, y, ridge=0.0):
    x = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ b))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b))
        b = b + np.linalg.solve(h, x.T @ (y - p) - ridge * b)
    return b, np.linalg.inv(h)


def plain_hazard(x, t, e):
    b = np.zeros(x.shape[1])
    for _ in range(100):
        r = np.exp(x @ b)
        g, h = np.zeros(len(b)), np.zeros((len(b), len(b)))
        for i in np.flatnonzero(e):
            at = t >= t[i]
            m = (r[at, None] * x[at]).sum(0) / r[at].sum()
            g += x[i] - m
            h += (r[at, None] * x[at]).T @ x[at] / r[at].sum() - np.outer(m, m)
        b = b + np.linalg.solve(h, g)
    return b, np.linalg.inv(h)


def auc(s, y):
    a, b = s[y == 1], s[y == 0]
    return ((a[:, None] > b).sum() + 0.5 * (a[:, None] == b).sum()) / (len(a) * len(b))


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 2))
    g = np.arange(300) % 2
    y = (rng.random(300) < 1 / (1 + np.exp(-(x[:, 0] - 0.5 * x[:, 1] * g)))).astype(int)
    t = rng.integers(1, 40, 300)
    held = [(int(i), int(g[i]), int(i % 3), int(y[i]), int(t[i]), float(x[i, 0]), None if i % 50 == 7 else float(x[i, 1])) for i in range(300)]
    df = spark.createDataFrame(held, "id int, g int, fold int, y int, t int, a double, b double").repartition(3).cache()
    there = np.array([h[6] is not None for h in held])
    return df, x, g, y, t, there


def test_logits_by_group(rows):
    df, x, g, y, _, there = rows
    got = T.logits(df, ["g"], ["a", "b"], "y")
    assert set(got) == {(0,), (1,)}
    for k in (0, 1):
        some = there & (g == k)
        b, cov = plain_logit(x[some], y[some])
        assert np.allclose(got[k,][0], b, atol=1e-7) and np.allclose(got[k,][1], cov, atol=1e-7) and got[k,][2] == some.sum()


def test_hazards(rows):
    df, x, g, y, t, there = rows
    got = T.hazards(df, ["g"], ["a", "b"], "t", "y")
    for k in (0, 1):
        some = there & (g == k)
        b, cov = plain_hazard(x[some], t[some], y[some])
        assert np.allclose(got[k,][0], b, atol=1e-6) and np.allclose(got[k,][1], cov, atol=1e-6)


def test_separated_classes_end(spark):
    df = spark.createDataFrame([(float(i), int(i > 5), 1) for i in range(12)], "a double, y int, g int")
    assert np.isfinite(T.logits(df, ["g"], ["a"], "y")[1,][0]).all()


def test_out_of_fold_and_recalibration(rows):
    df, x, _, y, _, there = rows
    fold = np.arange(300) % 3
    got = {r.id: r.score for r in T.out_of_fold(df, "fold", 3, ["a", "b"], "y", 1e-3).collect()}
    want = np.full(300, np.nan)
    for f in range(3):
        train = there & (fold != f)
        b, _ = plain_logit(x[train], y[train], 1e-3)
        want[fold == f] = 1 / (1 + np.exp(-(b[0] + x[fold == f] @ b[1:])))
    assert len(got) == 300 and all((got[i] is None) if not there[i] else abs(got[i] - want[i]) < 1e-6 for i in range(300))
    row = T.cross_validated_auc(df.where("b is not null"), "fold", 3, ["a", "b"], "y").first()
    assert row.auc == pytest.approx(auc(want[there], y[there]), abs=1e-9)
    scored = df.selectExpr("*", "0.2 + 0.6 / (1 + exp(-a)) as score")
    p = 0.2 + 0.6 / (1 + np.exp(-x[:, 0]))
    z = np.log(p / (1 - p))
    for r in T.recalibrated(scored, "fold", 3, "score", "y").collect():
        b, _ = plain_logit(z[fold != r.fold][:, None], y[fold != r.fold], 1e-6)
        assert r.recalibrated == pytest.approx(1 / (1 + math.exp(-(b[0] + b[1] * z[r.id]))), abs=1e-6) and r.score == pytest.approx(p[r.id])


def test_screen_and_reference(rows):
    df, x, g, y, _, there = rows
    got = {r.feature: r for r in T.screen(df.where("b is not null"), "id", ["a", "b"], ["y"]).collect()}
    ps = {}
    for i, f in enumerate("ab"):
        v = x[there, i]
        b, cov = plain_logit(((v - v.mean()) / v.std())[:, None], y[there])
        assert got[f].ratio == pytest.approx(math.exp(b[1]), rel=1e-6) and got[f].low == pytest.approx(math.exp(b[1] - 1.959963984540054 * cov[1, 1] ** 0.5), rel=1e-6)
        ps[f] = got[f].p
    first, second = sorted(ps, key=ps.get)
    assert got[second].q == pytest.approx(ps[second]) and got[first].q == pytest.approx(min(2 * ps[first], ps[second]))
    one = T.against_reference(df.selectExpr("*", "cast(g as string) as level"), "level", ["0", "1"], "0", "y", ["a"]).collect()
    b, _ = plain_logit(np.column_stack([g, x[:, 0]]), y)
    assert len(one) == 1 and one[0].term == "level=1" and one[0].ratio == pytest.approx(math.exp(b[1]), rel=1e-6)


def test_mutual_information(rows):
    df, x, _, y, _, there = rows
    got = {r.feature: r.mi for r in T.mutual_information(df, ["a", "b"], "y", 4).collect()}
    for i, f in enumerate("ab"):
        v, e = (x[there, i], y[there]) if f == "b" else (x[:, i], y)
        edges = sorted(set(df.approxQuantile(f, [0.25, 0.5, 0.75], 0.0)))
        b = (v[:, None] > edges).sum(1)
        want = sum(n / len(v) * math.log(n * len(v) / ((b == p).sum() * (e == q).sum())) for p in set(b.tolist()) for q in (0, 1) if (n := ((b == p) & (e == q)).sum()))
        assert got[f] == pytest.approx(want, abs=1e-9)


def test_prepared_and_components(rows):
    df, x, *_ = rows
    matrix, report = T.prepared(df.selectExpr("id", "a", "b", "1.0 as flat"), ["id"], ["a", "b", "flat"])
    assert matrix.columns == ["id", "a", "b"] and {r.feature for r in report.collect() if not r.usable} == {"flat"}
    held = {r.id: (r.a, r.b) for r in matrix.collect()}
    b = np.array([held[i][1] for i in range(300)])
    raw = x[:, 1].copy()
    gap = np.arange(300) % 50 == 7
    raw[gap] = np.median(raw[~gap])
    assert np.allclose(b, (raw - raw.mean()) / raw.std())
    scores, loadings = T.domain_components(matrix, ["id"], {"d": ["a", "b"], "small": ["a"]}, 1)
    m = np.array([held[i] for i in range(300)])
    w, v = np.linalg.eigh(np.corrcoef(m.T))
    v = v[:, -1] * np.sign(v[np.abs(v[:, -1]).argmax(), -1])
    assert scores.columns == ["id", "d_1"] and np.allclose([r.d_1 for r in scores.orderBy("id").collect()], m @ v, atol=1e-9)
    assert [r.share for r in loadings.collect()] == [pytest.approx(w[-1] / 2)] * 2
    assert [r.feature for r in T.domain_ranking(loadings).orderBy("place").collect()] == ["a", "b"]


def test_selection_uses_training_rows_alone(spark):
    """Turning the labels of one fold about changes nothing in what is chosen for it."""
    df = Q.whole(spark, str(DATA)).cache()
    pick = lambda rows: {(r.modality, r.feature, r.place) for r in T.fold_selection(rows, "fold", Q.FOLDS, {"size": Q.GROUPS["size"]}, "y", 2).collect() if r.fold == 1}
    from pyspark.sql import functions as F

    assert pick(df) == pick(df.withColumn("y", F.when(F.col("fold") == 1, 1 - F.col("y")).otherwise(F.col("y"))))


def test_alternating_choice():
    got = T.alternating_choice({"m": ["a", "b"], "n": ["c", "d"]}, [("a", "c", 1.0), ("a", "d", 0.0)], {"a": 1.0, "b": 0.1, "c": 0.9, "d": 0.8}, 1, 2, 0.5)
    assert [(g, f) for g, f, _ in got] == [("m", "a"), ("n", "d")]


def test_tuning_prefers_the_better_net(rows):
    df = rows[0].where("b is not null")
    got = T.tuned(df, "fold", 3, ["a", "b"], "y", [1e-4, 10.0], [0.5]).collect()
    assert sum(r.best for r in got) == 1 and next(r for r in got if r.best).c == 10.0
