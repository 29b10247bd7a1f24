"""Centrelines, cross-sections, slabs, arcs, layers, runs, cleaning and fusion against plain Python over arrays."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.clean import DENSITY_LIMITS
from tessera.operators import regions as R
from tessera.operators import voxel as V

from .test_masks import SIZE, SPACING, plain_components, volume  # noqa: F401

BALL = "(z - 6) * (z - 6) + (y - 6) * (y - 6) + (x - 6) * (x - 6) <= 9"


def mask_df(spark, arrays):
    return spark.createDataFrame([(c, *map(int, p)) for c, a in enumerate(arrays) for p in np.argwhere(a)], "case_id int, z int, y int, x int").repartition(3)


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(7)
    arrays = [rng.random((6, 9, 10)) < 0.5 for _ in range(2)]
    return mask_df(spark, arrays), arrays


def rows(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def test_smoothing(spark):
    rng = np.random.default_rng(1)
    for n in (1, 3, 20):
        v = rng.normal(size=n)
        df = spark.createDataFrame([(0, i, float(x)) for i, x in enumerate(v)], "k int, o int, v double")
        got = np.array([r.v for r in R.smoothed(df, ["k"], "o", ["v"], 1.5).orderBy("o").collect()])
        m = int(4 * 1.5 + 0.5)
        w = np.exp(-0.5 * (np.arange(-m, m + 1) / 1.5) ** 2)
        padded = np.pad(v, m, mode="edge")
        assert np.allclose(got, [(padded[i : i + 2 * m + 1] * w / w.sum()).sum() for i in range(n)])


def test_centreline(spark):
    rng = np.random.default_rng(2)
    arrays = [rng.random((7, 8, 9)) < 0.4, np.zeros((7, 8, 9), bool)]
    arrays[1][3, 2, 5] = arrays[1][4, 6, 1] = True
    got = rows(R.centreline(mask_df(spark, arrays), SPACING, 1.0, (1.0, 2.0, 3.0)), "case_id", "z_index")
    for c, a in enumerate(arrays):
        z = [k for k in range(7) if a[k].any()]
        yx = np.array([np.argwhere(a[k]).mean(0) for k in z])
        if len(z) >= 3:
            w = np.exp(-0.5 * np.arange(-4, 5) ** 2.0)
            yx = np.stack([[(np.pad(yx[:, j], 4, mode="edge")[i : i + 9] * w / w.sum()).sum() for i in range(len(z))] for j in (0, 1)], 1)
        p = np.array([[1 + np.rint(x) * 1.0, 2 + np.rint(y) * 2.0, 3 + k * 3.0] for k, (y, x) in zip(z, yx, strict=True)])
        first = np.gradient(p, axis=0)
        unit = first / np.maximum(np.linalg.norm(first, axis=1), 1e-300)[:, None]
        second = np.gradient(first, axis=0)
        curve = np.linalg.norm(np.cross(first, second), axis=1) / np.linalg.norm(first, axis=1) ** 3 if len(z) >= 3 else np.zeros(len(z))
        for i, k in enumerate(z):
            r = got[c, k]
            assert (r.x, r.y, r.z) == tuple(map(pytest.approx, p[i])) and (r.tangent_x, r.tangent_y, r.tangent_z) == tuple(pytest.approx(v) for v in unit[i]) and r.curvature == pytest.approx(curve[i])
    assert len(got) == sum(a.any((1, 2)).sum() for a in arrays)


def test_sections(blobs):
    df, arrays = blobs
    parts = R.slice_components(df)
    labels = [np.stack([plain_components(p) for p in a]) for a in arrays]
    assert {(r.case_id, r.z, r.y, r.x): r.component for r in parts.collect()} == {(c, *map(int, p)): int(labels[c][tuple(p)]) for c in (0, 1) for p in np.argwhere(arrays[c])}
    got = rows(R.section_features(parts, SPACING, 3), "case_id", "z", "component")
    n = 0
    for c in (0, 1):
        for z in range(6):
            for k in range(1, labels[c][z].max() + 1):
                m = labels[c][z] == k
                at = np.argwhere(m)
                if len(at) < 3:
                    continue
                n += 1
                r = got[c, z, k]
                pad = np.pad(m, 1)
                mm = sum(np.where(m & ~np.roll(pad, s, ax)[1:-1, 1:-1], size, 0.0) for ax, size in ((0, 1.0), (1, 2.0)) for s in (1, -1))
                centre = at.mean(0)
                edge = np.argwhere(mm > 0)
                radii = np.sqrt((((edge - centre) * [2.0, 1.0]) ** 2).sum(1))
                w = np.sort(np.linalg.eigvalsh(np.cov((at * [2.0, 1.0]).T, bias=True)))
                area = len(at) * 2.0
                assert (r.n, r.area, r.perimeter) == (len(at), area, pytest.approx(mm.sum())) and r.equivalent_diameter == pytest.approx(2 * math.sqrt(area / math.pi))
                assert (r.r_mean, r.r_sd, r.max_diameter, r.min_diameter) == (pytest.approx(radii.mean()), pytest.approx(radii.std()), pytest.approx(2 * radii.max()), pytest.approx(2 * radii.min()))
                assert r.r_mad == pytest.approx(np.median(abs(radii - np.median(radii)))) and r.circularity == pytest.approx(min(1, 4 * math.pi * area / mm.sum() ** 2))
                assert r.eccentricity == pytest.approx(math.sqrt(max(0, 1 - w[0] / w[1])), abs=1e-6)
    assert len(got) == n


def test_tube_and_slabs(spark, blobs):
    df, arrays = blobs
    tube = {r.case_id: r for r in R.tube_features(df, SPACING).collect()}
    for c, a in enumerate(arrays):
        area = a.sum((1, 2)) * 2.0
        z = int(area.argmin())
        ys, xs = np.nonzero(a[z])
        sides = sorted([np.ptp(xs) + 1.0, (np.ptp(ys) + 1) * 2.0])
        r = tube[c]
        assert (r.length_mm, r.min_area, r.z_min) == (18.0, area.min(), z) and r.volume_ml == pytest.approx(a.sum() * 6 / 1000)
        assert [r.p05, r.p10, r.p25, r.p50] == [pytest.approx(np.percentile(area, p)) for p in (5, 10, 25, 50)] and r.eccentricity == pytest.approx(math.sqrt(1 - (sides[0] / sides[1]) ** 2))
    levels = spark.createDataFrame([(0, "palate", 2), (0, "tongue", 4), (0, "other", 1), (0, "far", 90)], "case_id int, name string, z int")
    bounds = R.slabs(df, levels, ["palate", "tongue", "low"], {"palate": (3, 1), "tongue": (1, 9), "far": (1, 1)})
    assert {(r.case_id, r.slab): (r.low, r.high) for r in bounds.collect()} == {(0, "palate"): (0, 3), (0, "tongue"): (3, 5), (1, "palate"): (0, 1), (1, "tongue"): (2, 3), (1, "low"): (4, 5)}
    got = rows(R.slab_features(df, bounds, ["palate", "tongue", "low"], SPACING), "case_id", "slab")
    spans = {(r.case_id, r.slab): (r.low, r.high) for r in bounds.collect()}
    for (c, s), (lo, hi) in spans.items():
        area = arrays[c].sum((1, 2)) * 2.0
        z = int(area.argmin())
        first = next(n for n in ("palate", "tongue", "low") if (c, n) in spans and spans[c, n][0] <= z <= spans[c, n][1])
        r = got[c, s]
        assert (r.n_slices, r.min_area, r.narrowest) == (hi - lo + 1, area[lo : hi + 1].min(), s == first) and r.volume_ml == pytest.approx(area[lo : hi + 1].sum() * 3 / 1000)


def test_arcs_and_thresholds(spark, volume):  # noqa: F811
    df, hu, ball = volume
    tube, lesions = df.where(BALL), df.where(f"{BALL} and hu >= 300 and case_id = 0")
    got = {r.case_id: r for r in R.wall_arcs(lesions, tube, 12).collect()}
    inside = ball <= 9
    arcs, front, n = [], 0, 0
    for z in range(SIZE):
        ys, xs = np.nonzero(inside[z] & (hu[0][z] >= 300))
        if len(ys):
            cy, cx = np.argwhere(inside[z]).mean(0)
            turn = np.mod(np.arctan2(ys - cy, xs - cx), 2 * math.pi)
            arcs.append(len(set(np.minimum(11, np.floor(turn / (2 * math.pi) * 12)).tolist())) * 30.0)
            front, n = front + int((ys < cy).sum()), n + len(ys)
    assert (got[0].arc_mean, got[0].arc_max, got[0].anterior, got[0].posterior) == (pytest.approx(np.mean(arcs)), max(arcs), pytest.approx(front / n), pytest.approx(1 - front / n))
    assert (got[1].arc_mean, got[1].arc_max, got[1].anterior, got[1].posterior) == (0, 0, 0, 0)
    by = rows(R.lesions_by_threshold(df, tube, [200, 470, 900], SPACING), "case_id", "threshold")
    for c in (0, 1):
        for t in (200, 470, 900):
            m = inside & (hu[c] >= t)
            label = plain_components(m)
            score = sum((label == k).sum() * 6.0 * sum(hu[c][label == k].max() >= d for d in DENSITY_LIMITS) for k in range(1, label.max() + 1))
            assert (by[c, float(t)].n, by[c, float(t)].score) == (m.sum(), pytest.approx(score))


def test_layers_and_runs(volume):  # noqa: F811
    from .test_masks import distance

    df, hu, ball = volume
    got = rows(R.layered_fat(df, df.where(BALL), [(0.0, 2.0), (2.0, 3.5)], -100, 100, 4, SPACING), "case_id", "part")
    far = distance(ball > 9, ball <= 9)
    z, y, x = np.indices(ball.shape)
    sector = np.minimum(3, np.floor((np.arctan2(y - 6.0, x - 6.0) + math.pi) / (2 * math.pi) * 4))
    for c in (0, 1):
        fat = (ball > 9) & (far <= 3.5) & (hu[c] >= -100) & (hu[c] <= 100)
        for part, m in {"all": fat, "layer_1": fat & (far <= 2), "layer_2": fat & (far > 2), **{f"sector_{s}": fat & (sector == s) for s in range(4)}}.items():
            v = hu[c][m]
            r = got[c, part]
            assert r.n == len(v) and r.mean_hu == pytest.approx(v.mean()) and r.sd_hu == pytest.approx(v.std()) and r.skewness == pytest.approx(((v - v.mean()) ** 3).mean() / v.std() ** 3)
    runs = {r.case_id: r for r in R.run_features(V.quantize(df, 4)).collect()}
    for c in (0, 1):
        level = np.minimum(3, np.floor((hu[c] - hu[c].min()) / (hu[c].max() - hu[c].min()) * 4))
        sizes = []
        for axis in range(3):
            for line in np.moveaxis(level, axis, -1).reshape(-1, SIZE):
                cut = np.flatnonzero(np.diff(line)) + 1
                sizes += np.diff([0, *cut, SIZE]).tolist()
        sizes = np.array(sizes, float)
        assert runs[c].runs == len(sizes) and runs[c].short_run_emphasis == pytest.approx((1 / sizes**2).mean()) and runs[c].long_run_emphasis == pytest.approx((sizes**2).mean())


def test_thickness_share(spark):
    df = spark.createDataFrame([(0, 4.0), (0, 4.5), (0, 1.0), (1, 3.0)], "case_id int, thickness double")
    assert {(r.case_id, r.n, r.volume_mm3, r.fraction) for r in R.above_thickness(df, 4.0, SPACING).collect()} == {(0, 1, 6.0, 1 / 3), (1, 0, 0.0, 0.0)}
    assert R.above_thickness(df, 4.0, SPACING, strict=False).where("case_id = 0").first().n == 2


def test_cleaning_and_quality(spark):
    rng = np.random.default_rng(3)
    arrays = [rng.random((6, 7, 8)) < 0.62 for _ in range(2)]
    shell = np.zeros((6, 7, 8), bool)
    shell[1:5, 1:6, 1:7] = True
    shell[2:4, 2:5, 2:6] = False
    arrays.append(shell)
    df = mask_df(spark, arrays)
    for kw in ({}, {"largest": False, "least": 4}, {"fill": False}):
        got = np.zeros((3, 6, 7, 8), bool)
        out = R.cleaned(df, (6, 7, 8), **kw)
        for r in out.collect():
            got[r.case_id, r.z, r.y, r.x] = True
        assert out.count() == got.sum()
        for c, a in enumerate(arrays):
            label = plain_components(a, 6)
            sizes = np.bincount(label.ravel())
            sizes[0] = 0
            keep = label == sizes.argmax() if kw.get("largest", True) else (sizes >= 4)[label] & (label > 0)
            if kw.get("fill", True):
                air = plain_components(~keep, 6)
                face = np.ones(a.shape, bool)
                face[1:-1, 1:-1, 1:-1] = False
                keep = keep | ((air > 0) & ~np.isin(air, list(set(air[face].tolist()))))
            assert (got[c] == keep).all()
    cases = spark.createDataFrame([(0,), (2,), (9,)], "case_id int")
    hu = df.withColumn("hu", F.col("x").cast("double"))
    q = {r.case_id: r for r in R.mask_quality(hu, df, cases, SPACING, 700.0, 900.0).collect()}
    assert set(q) == {0, 2, 9} and q[9].warnings == "empty_mask" and q[9].volume_mm3 == 0
    for c in (0, 2):
        n, parts = arrays[c].sum() * 6.0, plain_components(arrays[c], 6).max()
        want = ["mask_volume_below_configured_threshold"] * int(n < 700) + ["mask_volume_above_configured_threshold"] * int(n > 900) + ["multiple_components_after_cleaning"] * int(parts > 1)
        assert q[c].warnings == ";".join(want) and q[c].components == parts and q[c].mean_hu == pytest.approx(np.argwhere(arrays[c])[:, 2].mean())
    box = R.expanded(V.bounding_box(mask_df(spark, [shell])), 2.5, SPACING, (6, 7, 8)).first()
    assert (box.z_min, box.z_max, box.y_min, box.y_max, box.x_min, box.x_max) == (0, 5, 0, 6, 0, 7)


def test_fusion(spark):
    m = lambda *p: spark.createDataFrame([(c, 0, 0, x) for c, x in p], "case_id int, z int, y int, x int")
    pos, neg = R.fused([("one", m((0, 1), (0, 2))), ("two", m((0, 2), (1, 5)))], {"bone": [m((0, 2), (0, 3)), m((0, 9), (1, 4))], "air": [m((0, 3), (1, 5))]})
    assert {(r.case_id, r.x): r.sources for r in pos.collect()} == {(0, 1): "one", (0, 2): "one,two", (1, 5): "two"}
    assert {(r.case_id, r.x): r.structure for r in neg.collect()} == {(0, 3): "air", (1, 4): "bone"}
