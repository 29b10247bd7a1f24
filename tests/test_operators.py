"""Small literal tables for each operator, as its definition says."""

import math
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import clean as C
from tessera.functions import predicates as P
from tessera.operators import joins as J
from tessera.operators import masks as K
from tessera.operators import ml as M
from tessera.operators import reshape as R
from tessera.operators import score as S
from tessera.operators import stats as ST
from tessera.operators import voxel as V
from tessera.operators import windows as W


def values(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "x string").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize("text,want", [("1.5", 1.5), (" nan ", None), ("inf", None), ("", None), ("x", None), ("-2e3", -2000.0), (None, None)])
def test_to_number(spark, text, want):
    assert one(spark, C.to_number, text) == want


@pytest.mark.parametrize("text,strict,lenient", [("Yes ", True, True), ("drop", False, False), ("robust", None, True), (None, None, False)])
def test_flags(spark, text, strict, lenient):
    assert one(spark, C.parse_bool, text) is strict
    assert one(spark, C.parse_boolish, text) is lenient


def test_dates(spark):
    assert one(spark, C.parse_date, "2024-02-03 04:05") == datetime(2024, 2, 3, 4, 5)
    assert one(spark, C.parse_date, "2024-02-03") == datetime(2024, 2, 3)
    assert one(spark, C.parse_date, "03.02.2024") is None
    df = spark.createDataFrame([("2024-01-01 12:00", "2024-01-03 11:00")], "a string, b string")
    assert df.select(C.days_between(C.parse_date(F.col("a")), C.parse_date(F.col("b")))).first()[0] == 1


def test_text(spark):
    assert one(spark, C.slug, "__Wall  thickness (mm)") == "wall_thickness_mm"
    assert one(spark, C.case_id, "/a/sub-012_ct.nii.gz") == "sub-012"
    assert one(spark, C.case_id, "/a/scan7.nii.gz") == "scan7"
    assert one(spark, C.case_id, "") == "unknown"
    assert one(spark, lambda x: C.matched_terms(x, ["ct", "neck"]), "Necklace act") == ["neck"]
    assert one(spark, lambda x: C.any_flag(), "x") is False


def test_steps(spark):
    df = spark.createDataFrame([(x,) for x in (None, 129.9, 130.0, 400.0, math.nan)], "x double")
    assert [r[0] for r in df.select(C.density_factor(F.col("x"))).collect()] == [0, 0, 1, 4, 0]
    df = spark.createDataFrame([(x,) for x in (0.0, 1.9, 2.0, 5.0)], "x double")
    assert [r[0] for r in df.select(C.thickness_class(F.col("x"))).collect()] == [0, 1, 2, 5]


def test_predicates(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None), (None, 3.0)], "Name string, v double")
    assert df.where(P.predicate(df, "name != a")).count() == 2  # a missing value differs
    assert df.where(P.predicate(df, "name=a,b")).count() == 2
    assert df.where(P.predicate(df, "v>=1")).count() == 2
    with pytest.raises(ValueError, match="no column"):
        P.predicate(df, "w=1")
    with pytest.raises(ValueError, match="not a predicate"):
        P.predicate(df, "name")


def test_reshape_round_trip(spark):
    wide = spark.createDataFrame([(1, 2.0, None), (2, None, 4.0)], "id int, a double, b double")
    long = R.wide_to_long(wide, ["id"]).withColumn("o", F.lit(0))
    assert values(R.long_to_wide(long, ["id"], "feature", "value", "o", ["a", "b"]), "id") == values(wide, "id")
    first = spark.createDataFrame([(1, "a", None, 0), (1, "a", 7.0, 1), (1, "a", 8.0, 2)], "id int, feature string, value double, o int")
    assert values(R.long_to_wide(first, ["id"], "feature", "value", "o", ["a"]), "id") == [(1, 7.0)]
    assert R.reorder(wide, ["b", "x"]).columns == ["b", "a", "id"]
    assert values(R.union_all(wide.select("id"), wide.select("a").limit(1)), "id")[0] == (None, 2.0)


def test_joins(spark):
    a = spark.createDataFrame([(1, "x"), (None, "y"), (3, "z")], "k int, v string")
    b = spark.createDataFrame([(1, "p"), (None, "q")], "k int, v string")
    assert values(J.left_indicator(a, b, ["k"]), "v") == [(1, "x", "p", True), (None, "y", "q", True), (3, "z", None, False)]
    assert tuple(J.match_audit(a.where("k is not null"), b.where("k is not null"), ["k"]).first()) == (1, 1, 0)
    spans = spark.createDataFrame([(1, 0.0, 10.0), (2, 9.0, 31.0)], "id int, low double, high double")
    points = spark.createDataFrame([(0.0,), (9.5,), (10.0,), (31.0,)], "x double")
    assert values(J.interval_join(points, spans, "x", "low", "high", 4.0).select("x", "id"), "x", "id") == [(0.0, 1), (9.5, 1), (9.5, 2), (10.0, 2)]


def test_statistics(spark):
    x = [1.0, 2.0, 2.0, 5.0, 9.0, 30.0, 31.0]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    s, k = df.agg(ST.population_skewness(F.col("x")), ST.population_kurtosis(F.col("x"))).first()
    a = np.array(x) - np.mean(x)
    assert s == pytest.approx((a**3).mean() / (a**2).mean() ** 1.5) and k == pytest.approx((a**4).mean() / (a**2).mean() ** 2)
    flat = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    assert flat.agg(ST.population_skewness(F.col("x"))).first()[0] == 0.0
    rows = [(float(i % 7), i % 3 == 0) for i in range(50)]
    got = ST.rank_auc(spark.createDataFrame(rows, "x double, e boolean"), [], "x", "e").first().auc
    p, n = [x for x, e in rows if e], [x for x, e in rows if not e]
    assert got == pytest.approx(np.mean([(a > b) + 0.5 * (a == b) for a in p for b in n]))
    one_kind = ST.rank_auc(spark.createDataFrame([(1.0, True)], "x double, e boolean"), [], "x", "e").first()
    assert one_kind.auc is None


def test_windows(spark):
    p = [0.01, 0.04, 0.03, 0.5, 0.04]
    df = spark.createDataFrame(list(enumerate(p)), "id int, p double")
    q = {r.id: r.q for r in W.benjamini_hochberg(df, "p", ["id"]).collect()}
    assert [round(q[i], 6) for i in range(5)] == [0.05, 0.05, 0.05, 0.5, 0.05]
    ranks = W.global_rank(spark.createDataFrame([(i, float(i * 37 % 100)) for i in range(500)], "id int, x double"), "x", ["id"]).orderBy("rank").collect()
    assert [r.rank for r in ranks] == list(range(1, 501)) and [(r.x, r.id) for r in ranks] == sorted((r.x, r.id) for r in ranks)
    bins = spark.range(1, 8).select(W.quantile_bin(F.col("id"), F.lit(7), 3)).collect()
    assert [b[0] for b in bins] == [0, 0, 0, 1, 1, 2, 2]
    log = spark.createDataFrame([(1, i, v) for i, v in enumerate([1, 2, 3, 1, 2, 0])], "k int, o int, v int")
    assert [r["pass"] for r in W.passes(log, ["k"], "o", "v").orderBy("o").collect()] == [0, 0, 0, 1, 1, 2]


def test_scores_use_training_rows_alone(spark):
    train = spark.createDataFrame([(1, 1.0), (2, 3.0), (3, None)], "id int, a double")
    par = S.fit_parameters(train, ["a"], {"a": 2.0})
    assert values(par.select("median", "mean"), "median") == [(2.0, 2.0)]
    new = spark.createDataFrame([(9, None), (8, 2.0)], "id int, a double")
    assert values(S.apply_parameters(new, par, "id", ["a"]), "id") == [(8, 0.0), (9, 0.0)]


def test_redundancy():
    kept, dropped = M.drop_redundant({"a": 0.9, "b": 0.8, "c": 0.8}, [("a", "b", -0.95), ("b", "c", 0.99), ("a", "c", 0.1)], 0.9)
    assert kept == ["a", "c"] and dropped == [("b", "a")]


def test_volumes(spark):
    v = spark.range(64).select(F.lit(0).alias("case_id"), (F.col("id") / 16).cast("int").alias("z"), (F.col("id") / 4 % 4).cast("int").alias("y"), (F.col("id") % 4).cast("int").alias("x"), F.when(F.col("id").isin(0, 1, 63), 350.0).otherwise(0.0).alias("hu"))
    r = V.threshold_summary(v, [300], (1.0, 2.0, 3.0)).first()
    assert (r.n, r.volume_mm3, r.max_hu) == (3, 18.0, 350.0)
    assert V.threshold_summary(v, [500], (1.0, 1.0, 1.0)).first().max_hu is None
    c = K.components(v.where("hu > 0"))
    assert values(c.groupBy("component").count(), "component") == [(1, 2), (2, 1)]
    assert values(V.largest_component(c).select("x"), "x") == [(0,), (1,)]
    d = V.distance_within(v.where("hu > 0"), 1.0, (1.0, 1.0, 1.0))
    assert d.count() == 16 and d.agg(F.max("distance")).first()[0] == 1.0  # 10 about the pair, 6 about the single voxel


def test_nearest_along_an_axis(spark, duck):
    far = float("inf")
    rng = np.random.default_rng(9)
    targets = [(int(i), int(k), float(x)) for i, k, x in zip(rng.permutation(60), rng.integers(0, 3, 60), rng.integers(-40, 40, 60) / 4, strict=True)]
    targets += [(60, 0, None), (-1, 1, None), (61, 3, None), (62, 3, None), (63, 4, math.nan), (64, 4, None), (65, None, 1.0), (66, 5, far), (67, 5, 2.0), (69, 6, 1e-20), (68, 6, 2e-20), (70, 6, 3e-20)]
    points = [(int(i), int(i) % 3, float(x)) for i, x in enumerate(rng.integers(-60, 60, 40) / 8)]
    points += [(50, 0, None), (51, 3, 1.0), (52, 4, 1.0), (53, 9, 1.0), (54, None, 1.0), (55, 5, far), (56, 5, math.nan), (57, 5, 3.0), (58, 6, 1.0), (59, 6, 2.1e-20), (60, 1, -far)]
    p, t = spark.createDataFrame(points, "id int, k int, a double"), spark.createDataFrame(targets, "target int, k int, a double")
    plain = lambda rows: sorted([(r[0], r[1], str(r[2])) for r in rows])
    cells = lambda rows: ", ".join("(" + ", ".join("NULL" if c is None else f"'{c}'::DOUBLE" if isinstance(c, float) else str(c) for c in r) + ")" for r in rows)
    want = duck.sql(f"""WITH p(id, k, a) AS (VALUES {cells(points)}), t(target, k, a) AS (VALUES {cells(targets)}), d AS (SELECT p.id, t.target, abs(p.a - t.a) AS distance FROM p JOIN t USING (k))
        SELECT id, arg_min(target, struct_pack(a := distance, b := target)), min(distance) FROM d GROUP BY 1""").fetchall()
    got = plain(J.nearest(p, t, "k", ["a"], "target").select("id", "target", "distance").collect())
    assert got == plain(want)
    assert plain(J._nearest_of_all(p, t, "k", ["a"], "target").select("id", "target", "distance").collect())[-5:] == got[-5:]
    assert J.nearest(p, t, "k", ["a"], "target").columns == ["id", "k", "a", "target", "distance"]


def test_nearest_along_an_axis_forms_no_pairs(spark):
    p = spark.range(20_000).select("id", F.lit(1).alias("k"), F.sin("id").alias("a"))
    t = spark.range(20_000).select(F.col("id").alias("target"), F.lit(1).alias("k"), F.cos("id").alias("a"))
    out = J.nearest(p, t, "k", ["a"], "target")
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString() and out.count() == 20_000
