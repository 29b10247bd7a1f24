"""Masks, components and polar grids against plain Python over arrays."""

import math
from collections import Counter

import numpy as np
import pytest

from tessera.functions.clean import DENSITY_LIMITS
from tessera.operators import masks as K
from tessera.plans.registry import voxels as Q

SIZE, SPACING = 12, (1.0, 2.0, 3.0)


@pytest.fixture(scope="module")
def volume(spark):
    from tessera.operators import voxel as V

    df = V.grid(spark, 2, SIZE).cache()
    z, y, x = np.meshgrid(*[np.arange(SIZE)] * 3, indexing="ij")
    return df, [((z * 37 + y * 101 + x * 53 + c * 17 + x * y * 7) % 600 - 100).astype(float) for c in (0, 1)], (z - 6) ** 2 + (y - 6) ** 2 + (x - 6) ** 2


def plain_components(mask, connectivity=26, wrap=None):
    """Numbered by their first voxel; ``wrap``: the last axis is a ring."""
    out, n = np.zeros(mask.shape, int), 0
    for start in zip(*np.nonzero(mask), strict=True):
        if out[start]:
            continue
        n += 1
        out[start], todo = n, [start]
        while todo:
            at = todo.pop()
            for step in np.ndindex(*[3] * mask.ndim):
                d = np.array(step) - 1
                if not d.any() or (connectivity == 6 and np.abs(d).sum() > 1):
                    continue
                to = np.array(at) + d
                if wrap:
                    to[-1] %= mask.shape[-1]
                if (to < 0).any() or (to >= mask.shape).any():
                    continue
                to = tuple(to)
                if mask[to] and not out[to]:
                    out[to] = n
                    todo.append(to)
    return out


def array(df, column=None, kind=int):
    out = np.zeros((2, SIZE, SIZE, SIZE), kind)
    for r in df.collect():
        out[r.case_id, r.z, r.y, r.x] = r[column] if column else 1
    return out


def steps(mask, n, plane=False):
    out = mask.copy()
    for _ in range(n):
        grown = out.copy()
        for axis in (1, 2) if plane else (0, 1, 2):
            for d in (1, -1):
                grown |= np.roll(np.pad(out, 1), d, axis)[1:-1, 1:-1, 1:-1]
        out = grown
    return out


@pytest.mark.parametrize("connectivity", [6, 26])
def test_components(volume, connectivity):
    df, hu, _ = volume
    got = array(K.components(df.where("hu >= 380"), connectivity), "component")
    for c in (0, 1):
        assert (got[c] == plain_components(hu[c] >= 380, connectivity)).all()


def test_components_of_nothing_and_of_one_case(spark, volume):
    df, _, ball = volume
    assert K.components(df.where("false")).count() == 0
    got = array(K.components(df.where("case_id = 1 and hu > -1000")), "component")
    assert not got[0].any() and (got[1] == 1).all()


def test_lesion_scores(volume):
    df, hu, _ = volume
    got = {r.case_id: r for r in K.lesion_scores(df, df.where("hu >= 130"), SPACING).collect()}
    for c in (0, 1):
        label = plain_components(hu[c] >= 130)
        sizes = [((label == k).sum() * 6.0, hu[c][label == k].max()) for k in range(1, label.max() + 1)]
        score = sum(v * sum(peak >= limit for limit in DENSITY_LIMITS) for v, peak in sizes)
        r = got[c]
        assert (r.lesions, r.volume_mm3, r.largest_mm3) == (len(sizes), sum(v for v, _ in sizes), max(v for v, _ in sizes))
        assert r.score == pytest.approx(score) and r.log_score == pytest.approx(math.log1p(score)) and r.mass == pytest.approx(hu[c][hu[c] >= 130].sum() * 6)


def test_zones(volume):
    df, hu, _ = volume
    from tessera.operators import voxel as V

    got = {r.case_id: r for r in K.zones(V.quantize(df, 4)).collect()}
    for c in (0, 1):
        lo, hi = hu[c].min(), hu[c].max()
        level = np.minimum(3, np.floor((hu[c] - lo) / (hi - lo) * 4))
        sizes = [n for k in range(4) for n in Counter(plain_components(level == k).ravel().tolist()).items() if n[0]]
        sizes = np.array([n for _, n in sizes], float)
        assert got[c].zones == len(sizes) and got[c].small_zone_emphasis == pytest.approx((1 / sizes**2).mean()) and got[c].large_zone_emphasis == pytest.approx((sizes**2).mean())


def test_body_and_vessels(volume):
    df, hu, _ = volume
    body, vessels = array(K.body(df, (SIZE,) * 3, 300.0)), array(K.vessels(df, (SIZE,) * 3, -100, 470, 480, 20, 1))
    face = np.ones((SIZE,) * 3, bool)
    face[1:-1, 1:-1, 1:-1] = False
    for c in (0, 1):
        air = plain_components(~(hu[c] > 300), 6)
        outer = set(air[face].tolist())
        filled = (hu[c] > 300) | ((air > 0) & ~np.isin(air, list(outer)))
        label = plain_components(filled, 6)
        sizes = np.bincount(label.ravel())[1:]
        assert (body[c].astype(bool) == (label == sizes.argmax() + 1)).all()
        bone = plain_components(hu[c] >= 480)
        gone = np.isin(bone, [k for k in set(bone[face].tolist()) if k])
        label = plain_components((hu[c] >= -100) & (hu[c] <= 470) & ~gone)
        band = np.isin(label, [k for k, n in enumerate(np.bincount(label.ravel())) if k and n >= 20])
        cut = ~steps(~np.pad(band, 1), 1)[1:-1, 1:-1, 1:-1]
        assert (vessels[c].astype(bool) == (steps(cut, 1) if cut.any() else cut)).all() and vessels[c].any()


def test_seeds(volume):
    df, hu, _ = volume
    for drop in (False, True):
        got = array(K.by_seeds(df.where("hu >= 400"), df.where("hu >= 490"), df.where("hu between 400 and 402"), drop))
        for c in (0, 1):
            label = plain_components(hu[c] >= 400)
            keep = set(label[hu[c] >= 490].tolist())
            keep -= set(label[(hu[c] >= 400) & (hu[c] <= 402)].tolist()) if drop else set()
            assert (got[c].astype(bool) == np.isin(label, [k for k in keep if k])).all()


def test_artifact_components(volume):
    df, hu, ball = volume
    kinds = K.artifacts(df, df, SPACING, 470, 1.0, 3.0, 400, -50)
    got = {r.case_id: r for r in K.artifact_burden(kinds, df.where("x < 3"), SPACING).collect()}
    for c in (0, 1):
        assert got[c].metal_components == plain_components(hu[c] >= 470, 6).max() and got[c].roi_voxels == 3 * SIZE * SIZE
    assert {r.case_id for r in K.artifact_burden(kinds.where("case_id = 0"), df.where("x < 3"), SPACING).collect() if r.artifact_ml == 0} == {1}


def distance(mask, to):
    at = np.argwhere(to)
    out = np.full(mask.shape, np.inf)
    for p in np.argwhere(mask):
        out[tuple(p)] = np.sqrt((((at - p) * np.array(SPACING[::-1])) ** 2).sum(1)).min()
    return out


def test_wall_lesions(volume):
    df, hu, ball = volume
    tube = df.where(Q.BALL)
    kw = {"core_mm": 2.0, "inner_mm": 2.0, "outer_mm": 2.0, "least_hu": 200, "seed_hu": 350, "contrast_hu": 20}
    got = array(K.wall_lesions(df, tube, SPACING, **kw))
    inside = ball <= 9
    deep, out = distance(inside, ~inside), distance(~inside, inside)
    for c in (0, 1):
        z = [k for k in range(SIZE) if inside[k].any()]
        core = {k: np.median(hu[c][k][inside[k] & (deep[k] > 2)]) if (inside[k] & (deep[k] > 2)).any() else np.median(hu[c][k][inside[k]]) for k in z}
        ref = {k: np.mean([core[j] for j in (k - 1, k, k + 1) if j in core]) for k in z}
        want, seed, like = (np.zeros(ball.shape, bool) for _ in range(3))
        for k in z:
            roi = (inside[k] & (deep[k] <= 2)) | (~inside[k] & (out[k] <= 2))
            limit = max(ref[k] + 75, 200)
            want[k] = roi & (hu[c][k] >= limit)
            seed[k] = want[k] & (hu[c][k] >= max(limit, 350))
            like[k] = ~inside[k] & (abs(hu[c][k] - ref[k]) <= 20)
        label = plain_components(want)
        keep = [k for k in range(1, label.max() + 1) if seed[label == k].any() and not like[label == k].any()]
        assert (got[c].astype(bool) == np.isin(label, keep)).all() and keep


def test_wall_thickness_and_closing(volume):
    df, _, ball = volume
    lumen, wall = ball <= 9, (ball > 9) & (ball <= 20)
    got = array(K.wall_thickness(df.where(Q.BALL), df.where(Q.BALL.replace("<= 9", "<= 20")), 9.0, SPACING), "thickness", float)
    inner = steps(lumen, 1) & wall
    outer = steps(~(lumen | wall), 1) & wall
    want = np.where(wall, distance(wall, inner) + distance(wall, outer) + 1.0, 0)
    assert np.allclose(got[0], want) and np.allclose(got[1], want)
    fat = (ball >= 17) & (ball <= 30)
    both = lumen | fat
    grown = steps(np.pad(both, 2), 1)
    shut = ~steps(~grown, 1)[2:-2, 2:-2, 2:-2]
    closed = array(K.closed_wall(df.where(Q.BALL), df.where(Q.BALL.replace("<= 9", "BETWEEN 17 AND 30")), 1))
    assert (closed[0].astype(bool) == (shut & ~both)).all() and closed.any()


def test_ring_components_and_protrusions(spark):
    rng = np.random.default_rng(5)
    grid = rng.random((9, 8)) < 0.35
    radius = 3 + rng.integers(1, 9, grid.shape) / 4
    df = spark.createDataFrame([(0, int(z), int(a), float(radius[z, a])) for z, a in np.argwhere(grid)], "case_id int, z int, angle int, radius double").repartition(2)
    label = plain_components(grid, wrap=True)
    rings = K.ring_components(df, 8)
    assert {(r.z, r.angle): r.component for r in rings.collect()} == {(int(z), int(a)): int(label[z, a]) for z, a in np.argwhere(grid)}
    cells = df.join(rings, ["case_id", "z", "angle"]).selectExpr("*", "3.0D as expected")
    got = {r.component: r for r in K.protrusions(cells, 8, 2.0, (0, 360), (0, 99), 0.1).collect()}
    for k in range(1, label.max() + 1):
        at = np.argwhere(label == k)
        depth = radius[label == k] - 3
        prominence = depth.max() - np.median(depth)
        if prominence < 0.1:
            assert k not in got
            continue
        used = sorted(set(at[:, 1].tolist()))
        gaps = [(b - a) % 8 or 8 for a, b in zip(used, used[1:] + used[:1], strict=True)]
        r = got[k]
        assert r.width_deg == pytest.approx((8 - max(gaps) + 1) * 45) and r.length_mm == (np.ptp(at[:, 0]) + 1) * 2
        assert r.max_depth == pytest.approx(depth.max()) and r.median_depth == pytest.approx(np.median(depth)) and (r.peak_z, r.peak_angle) == tuple(at[depth.argmax()].tolist())
        areas = [sum(radius[z, a] ** 2 - 9 for zz, a in at if zz == z) * math.pi / 8 for z in set(at[:, 0].tolist())]
        assert r.max_area == pytest.approx(max(areas))
