"""Models, resamples and branches that SQL can't state, against numpy and literal cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import evaluate as E
from tessera.operators import geometry as G
from tessera.operators import ml as M
from tessera.operators import score as S
from tessera.operators import stats as ST
from tessera.plans import registry

from .conftest import DATA
from .test_fits import plain_logit


def table(spark, name):
    return spark.read.parquet(str(DATA / f"{name}.parquet"))


def test_principal_components(spark):
    got = {(r.feature, r.component): (r.loading, r.share) for r in registry.QUERIES["principal_components"](spark, str(DATA)).collect()}
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    w, v = np.linalg.eigh(np.corrcoef(table(spark, "lineitem").select(*names).toPandas().to_numpy().T))
    for c, k in enumerate(np.argsort(-w)[:3], 1):
        load = v[:, k] * np.sign(v[np.abs(v[:, k]).argmax(), k])
        for i, f in enumerate(names):
            assert got[f, c] == (pytest.approx(load[i], abs=2e-5), pytest.approx(w[k] / 4, abs=2e-6))


def test_logistic_odds(spark):
    row = registry.QUERIES["logistic_odds"](spark, str(DATA)).first()
    j = table(spark, "documents").join(table(spark, "labels"), "doc_id").where("n_chars is not null").toPandas()
    b, cov = plain_logit(j.n_chars.to_numpy()[:, None] / 1000, j.quality.to_numpy())
    assert row.log_odds == pytest.approx(b[1], rel=1e-3) and row.se == pytest.approx(cov[1, 1] ** 0.5, rel=1e-3)
    assert row.p == pytest.approx(math.erfc(abs(b[1]) / cov[1, 1] ** 0.5 / math.sqrt(2)), abs=1e-3)


def test_kmeans_costs(spark):
    from pyspark.ml.functions import array_to_vector

    df = table(spark, "embeddings").select(array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    costs = {r.k: r.cost for r in M.kmeans_grid(df, "v", [2, 4, 8]).collect()}
    x = np.array([list(r.embedding) for r in table(spark, "embeddings").collect()], float)
    alone = ((x - x.mean(0)) ** 2).sum()
    assert alone > costs[2] > costs[4] > costs[8] > 0
    assert costs == {r.k: r.cost for r in registry.QUERIES["kmeans_costs"](spark, str(DATA)).collect()}


def test_stability(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 3))
    y = (x[:, 0] + 0.8 * rng.normal(size=200) > 0).astype(int)
    df = spark.createDataFrame([(i, *map(float, x[i]), int(y[i])) for i in range(200)], "id int, a double, b double, c double, y int").repartition(3)
    got = {r.feature: r.probability for r in M.stability(df, "id", ["a", "b", "c"], "y", 30, 0.2, 1).collect()}
    taken = {r.id: r.t for r in df.select("id", F.transform(F.sequence(F.lit(0), F.lit(29)), lambda r: F.pmod(F.xxhash64("id", r), F.lit(1000)) < 200).alias("t")).collect()}
    wins = [0, 0, 0]
    for r in range(30):
        some = np.array([taken[i][r] for i in range(200)])
        a, b = x[some & (y == 1)], x[some & (y == 0)]
        wins[np.argmax(np.abs(a.mean(0) - b.mean(0)) / x[some].std(0, ddof=1))] += 1
    assert [got[f] for f in "abc"] == [pytest.approx(w / 30) for w in wins]


def test_bootstrap_interval(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(3, 2, 3000)
    df = spark.createDataFrame([(i, i % 2, float(v)) for i, v in enumerate(x)], "id int, g int, x double")
    for r in E.bootstrap_mean(df, ["g"], "x", "id", 400).collect():
        v = x[r.g :: 2]
        half = 1.96 * v.std() / math.sqrt(len(v))
        assert r.n == 1500 and r.mean == pytest.approx(v.mean()) and r.low == pytest.approx(v.mean() - half, abs=half / 4) and r.high == pytest.approx(v.mean() + half, abs=half / 4)
    means = df.select(F.transform(F.sequence(F.lit(0), F.lit(0)), lambda r: r)).count()
    assert means == 3000


def test_branches(spark):
    rows = [(0, 0, 1, 5.0, 5.0), (0, 1, 1, 5.0, 4.0), (0, 1, 2, 5.0, 7.0), (0, 2, 1, 5.0, 8.0), (0, 2, 2, 5.0, 3.0), (0, 3, 1, 50.0, 50.0), (1, 9, 1, 5.0, 5.0)]
    got = G.link_branches(spark.createDataFrame(rows, "case_id int, z int, component int, cy double, cx double"), 3.0).collect()
    assert {(r.case_id, r.z, r.component): r.branch for r in got} == {(0, 0, 1): 1, (0, 1, 1): 1, (0, 1, 2): 2, (0, 2, 1): 2, (0, 2, 2): 1, (0, 3, 1): 3, (1, 9, 1): 1}


def test_scores_keep_every_row_of_a_key(spark):
    par = spark.createDataFrame([("a", 1.0, 1.0, 2.0, 3.0), ("b", 0.0, 0.0, 0.0, 1.0), ("z", 0.0, 0.0, 1.0, 9.0)], "feature string, median double, mean double, std double, weight double")
    rows = spark.createDataFrame([(1, 3.0, 5.0), (1, 5.0, None), (2, None, 1.0), (None, 1.0, 1.0)], "id int, a double, b double")
    assert sorted((r.id or 0, r.score) for r in S.apply_parameters(rows, par, "id", ["a", "b"]).collect()) == [(0, 0.0), (1, 0.75), (1, 1.5), (2, 0.0)]


def test_concordance_of_ties(spark):
    rng = np.random.default_rng(8)
    t, r, e = rng.integers(0, 12, 300), rng.integers(0, 9, 300), rng.random(300) < 0.4
    df = spark.createDataFrame([(float(a), float(b), bool(c)) for a, b, c in zip(t, r, e, strict=True)] + [(None, 1.0, True)], "t double, r double, e boolean").repartition(3)
    pairs = [(1.0 if r[i] > r[j] else 0.5 if r[i] == r[j] else 0.0) for i in range(300) if e[i] for j in range(300) if t[i] < t[j]]
    got = ST.concordance(df, "t", "r", "e").first()
    assert got.pairs == len(pairs) and got.c_index == pytest.approx(np.mean(pairs))
    assert ST.concordance(df.where("t = 3"), "t", "r", "e").first().c_index is None


def test_distances_between_surfaces(spark):
    cube = [(0, z, y, x) for z in range(5) for y in range(5) for x in range(5)]
    one = spark.createDataFrame([*cube, (1, 0, 0, 0)], "case_id int, z int, y int, x int")
    two = spark.createDataFrame([(c, z, y, x + 1) for c, z, y, x in cube] + [(2, 0, 0, 0)], "case_id int, z int, y int, x int")
    got = {r.case_id: r for r in G.surface_distances(one, two, (1.0, 1.0, 1.0), 1.0).collect()}
    assert got[0].hd95 == 1.0 and got[0].surface_dice == 1.0
    assert all(got[c].hd95 == math.inf and got[c].surface_dice == 0 for c in (1, 2))
