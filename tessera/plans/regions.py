"""Queries for shells, artifacts, lesions, regions and polar grids over the synthetic volumes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import masks as K
from ..operators import regions as M
from ..operators import voxel as V
from .aggregates import rounded
from .registry import query
from .voxels import BALL, GRID, SIZE, SPACING, ball, grid

SHAPE = (SIZE, SIZE, SIZE)
WITHIN = " AND ".join(f"{c} BETWEEN 0 AND {SIZE - 1}" for c in "zyx")
MM = "sqrt(power(3.0 * (a.z - b.z), 2) + power(2.0 * (a.y - b.y), 2) + power(1.0 * (a.x - b.x), 2))"
CITY = "abs(a.z - b.z) + abs(a.y - b.y) + abs(a.x - b.x)"
#: Voxels in and outside the ball with their distance to the other side.
NEAR = f"""{GRID}, m AS (SELECT *, {BALL} AS inside FROM v), far AS (SELECT a.case_id, a.z, a.y, a.x, a.inside, any_value(a.hu) AS hu, min({MM}) AS d FROM m a JOIN m b ON a.case_id = b.case_id AND a.inside <> b.inside AND abs(a.z - b.z) < 3 AND abs(a.y - b.y) < 4 AND abs(a.x - b.x) < 6 GROUP BY ALL)"""


@query(f"""{NEAR}, w AS (SELECT case_id, CASE WHEN inside THEN 'internal' ELSE 'external' END AS band FROM far WHERE (inside AND d <= 2.5) OR (NOT inside AND d <= 4.5))
SELECT case_id, band, count(*) AS n FROM (SELECT * FROM w UNION ALL SELECT case_id, 'wall' FROM w) GROUP BY 1, 2""")
def wall_bands(spark, d):
    return K.bands(ball(spark, d), 2.5, 4.5, SPACING).where(WITHIN).groupBy("case_id", "band").agg(F.count("*").alias("n"))


@query(f"{NEAR} SELECT case_id, count(*) AS n FROM far WHERE NOT inside AND d <= 4.5 AND x > 6 GROUP BY 1")
def local_shells(spark, d):
    return K.local_shell(ball(spark, d), grid(spark, d).where("x <= 6"), 4.5, SPACING).where(WITHIN).groupBy("case_id").agg(F.count("*").alias("n"))


NEAR_METAL = f"""{GRID}, m AS (SELECT * FROM v WHERE hu >= 480), k AS (SELECT a.case_id, a.z, a.y, a.x, any_value(a.hu) AS hu, min({CITY}) AS c, min(CASE WHEN a.z = b.z THEN {CITY} END) AS flat FROM v a JOIN m b USING (case_id) GROUP BY ALL),
kinds AS (SELECT *, CASE WHEN hu >= 480 THEN 'metal' WHEN c <= 1 THEN 'bloom' WHEN flat <= 3 AND (hu >= 400 OR hu <= -50) THEN 'streak' END AS kind FROM k)"""


@query(f"""{NEAR_METAL}, t AS (SELECT case_id, count(*) FILTER (WHERE kind = 'metal') * 0.006::DOUBLE AS metal_ml, count(*) FILTER (WHERE kind = 'bloom') * 0.006::DOUBLE AS bloom_ml, count(*) FILTER (WHERE kind = 'streak') * 0.006::DOUBLE AS streak_ml, count(*) FILTER (WHERE kind IN ('metal', 'bloom')) * 0.006::DOUBLE AS core_ml, count(kind) * 0.006::DOUBLE AS artifact_ml, count(DISTINCT z) FILTER (WHERE kind = 'metal') AS metal_slices FROM kinds GROUP BY 1),
r AS (SELECT case_id, count(*) AS roi_voxels, round(count(kind) / count(*), 6) AS roi_artifact_fraction, round(count(*) FILTER (WHERE kind IN ('metal', 'bloom')) / count(*), 6) AS roi_core_fraction FROM v LEFT JOIN kinds USING (case_id, z, y, x) WHERE {BALL} GROUP BY 1)
SELECT case_id, round(metal_ml, 6) AS metal_ml, round(bloom_ml, 6) AS bloom_ml, round(streak_ml, 6) AS streak_ml, round(core_ml, 6) AS core_ml, round(artifact_ml, 6) AS artifact_ml, metal_slices, roi_voxels, roi_artifact_fraction, roi_core_fraction FROM t JOIN r USING (case_id)""")
def artifact_burden(spark, d):
    v = grid(spark, d)
    kinds = K.artifacts(v, v, SPACING, 480, 1.0, 3.0, 400, -50)
    return rounded(K.artifact_burden(kinds, ball(spark, d), SPACING), ("metal_ml", "bloom_ml", "streak_ml", "core_ml", "artifact_ml", "roi_artifact_fraction", "roi_core_fraction")).drop("metal_components")


@query()
def lesion_scores(spark, d):
    v = grid(spark, d)
    return rounded(K.lesion_scores(v, v.where("hu >= 430"), SPACING), ("log_score",))


@query()
def zone_features(spark, d):
    return rounded(K.zones(V.quantize(grid(spark, d), 4)), ("small_zone_emphasis", "large_zone_emphasis"))


@query()
def body_masks(spark, d):
    return K.body(grid(spark, d), SHAPE, -60.0).groupBy("case_id").agg(F.count("*").alias("n"))


@query()
def vessel_masks(spark, d):
    return K.vessels(grid(spark, d), SHAPE, 0, 400, 480, 20, 1).groupBy("case_id").agg(F.count("*").alias("n"))


@query()
def seeded_components(spark, d):
    v = grid(spark, d)
    return K.by_seeds(v.where("hu >= 400"), v.where("hu >= 490"), v.where("hu between 400 and 402"), True).groupBy("case_id").agg(F.count("*").alias("n"), F.count_distinct("component").alias("n_components"))


@query()
def wall_lesions(spark, d):
    out = K.wall_lesions(grid(spark, d), ball(spark, d), SPACING, core_mm=2.0, inner_mm=2.0, outer_mm=2.0, least_hu=300, seed_hu=450, contrast_hu=20)
    return out.groupBy("case_id").agg(F.count("*").alias("n"), F.count_distinct("component").alias("lesions"), F.max("hu").alias("peak"))


@query()
def wall_thickness(spark, d):
    wall = ball(spark, d, BALL.replace("<= 9", "<= 20")).exceptAll(ball(spark, d))
    return rounded(K.wall_thickness(ball(spark, d), wall, 6.0, SPACING).groupBy("case_id").agg(F.count("*").alias("n"), F.avg("thickness").alias("mean"), F.max("thickness").alias("most")), ("mean", "most"))


@query()
def closed_walls(spark, d):
    fat = ball(spark, d, BALL.replace("<= 9", "BETWEEN 17 AND 30"))
    return K.closed_wall(ball(spark, d), fat, 1).groupBy("case_id").agg(F.count("*").alias("n"))


@query(f"""{GRID}, l AS (SELECT *, z // 4 AS label FROM v WHERE hu > 450), n AS (SELECT a.case_id, a.z, a.y, a.x, arg_min(b.label, struct_pack(d := {MM}, l := b.label)) FILTER (WHERE {MM} <= 4) AS label FROM v a JOIN l b USING (case_id) WHERE {BALL.replace('z', 'a.z').replace('y', 'a.y').replace('x', 'a.x')} GROUP BY ALL)
SELECT case_id, CAST(label AS INTEGER) AS label, count(*) AS n FROM n GROUP BY 1, 2""")
def nearest_labels(spark, d):
    labels = grid(spark, d).where("hu > 450").withColumn("label", F.floor(F.col("z") / 4).cast("int"))
    return K.nearest_labels(ball(spark, d), labels, 4.0, SPACING).groupBy("case_id", "label").agg(F.count("*").alias("n"))


@query(f"{GRID} SELECT case_id, z, y, x, 10 - 2.0::DOUBLE * y AS x_mm, 20 + 1.0::DOUBLE * x AS y_mm, -5 + 3.0::DOUBLE * z AS z_mm FROM v WHERE hu > 480")
def physical_points(spark, d):
    turned = ((10.0, 20.0, -5.0), SPACING, (0, -1, 0, 1, 0, 0, 0, 0, 1))
    points = K.physical(grid(spark, d).where("hu > 480").select(*V.AT), *turned)
    back = K.to_index(points.select("case_id", "x_mm", "y_mm", "z_mm"), *turned)
    return back.select("case_id", "z", "y", "x", "x_mm", "y_mm", "z_mm")


@query(f"""{GRID}, e AS (SELECT case_id, min(y) AS a, max(y) AS b FROM v WHERE {BALL} GROUP BY 1), p AS (SELECT v.*, y > b - (b - a + 1) / 3.0 AS back FROM v JOIN e USING (case_id) WHERE {BALL}), u AS (SELECT 'all' AS part, * FROM p UNION ALL SELECT 'posterior', * FROM p WHERE back)
SELECT case_id, part, round(count(*) * 0.006::DOUBLE, 6) AS volume_ml, round(avg(hu), 6) AS mean_hu, round(stddev_pop(hu), 6) AS sd_hu, round(quantile_cont(hu, 0.1), 6) AS p10, round(quantile_cont(hu, 0.9), 6) AS p90, round(avg(CASE WHEN hu < 0 THEN 1 ELSE 0 END), 6) AS low_fraction FROM u GROUP BY 1, 2""")
def region_features(spark, d):
    return rounded(K.region_features(grid(spark, d), ball(spark, d), SPACING, 0), ("volume_ml", "mean_hu", "sd_hu", "p10", "p90", "low_fraction"))


@query(f"""{GRID}, m AS (SELECT *, CASE WHEN x < 6 THEN 'left' ELSE 'right' END AS side FROM v WHERE {BALL}), s AS (SELECT b.side, a.case_id, a.z, a.y, a.x, any_value(a.hu) AS hu, min({CITY}) AS c FROM v a JOIN m b USING (case_id) GROUP BY ALL), f AS (SELECT * FROM s WHERE c BETWEEN 1 AND 2 AND hu BETWEEN -100 AND 0)
SELECT case_id, count(*) FILTER (WHERE side = 'left') AS left_n, round(avg(hu) FILTER (WHERE side = 'left'), 6) AS left_hu, round(count(*) FILTER (WHERE side = 'left') * 0.006::DOUBLE, 6) AS left_ml, count(*) FILTER (WHERE side = 'right') AS right_n, round(avg(hu) FILTER (WHERE side = 'right'), 6) AS right_hu, round(count(*) FILTER (WHERE side = 'right') * 0.006::DOUBLE, 6) AS right_ml,
round((count(*) FILTER (WHERE side = 'right') - count(*) FILTER (WHERE side = 'left')) / count(*), 6) AS asymmetry FROM f GROUP BY 1""")
def sided_fat(spark, d):
    out = K.sided_shell_fat(grid(spark, d), ball(spark, d), 6, 2, -100, 0, SPACING)
    return rounded(out, ("left_hu", "left_ml", "right_hu", "right_ml", "asymmetry"))


@query(f"""{GRID}, e AS (SELECT case_id, z, min(y) AS ay, max(y) AS bw, min(x) AS ax, max(x) AS bx FROM v WHERE {BALL} GROUP BY 1, 2), s AS (SELECT case_id, 'left' AS side, hu FROM v JOIN e USING (case_id, z) WHERE y BETWEEN ay - 1 AND bw + 1 AND x BETWEEN ax - 2 AND ax - 1 UNION ALL SELECT case_id, 'right', hu FROM v JOIN e USING (case_id, z) WHERE y BETWEEN ay - 1 AND bw + 1 AND x BETWEEN bx + 1 AND bx + 2)
SELECT case_id, side AS region, round(count(*) FILTER (WHERE hu BETWEEN -100 AND 100) * 0.006::DOUBLE, 6) AS fat_ml, round(avg(hu) FILTER (WHERE hu BETWEEN -100 AND 100), 6) AS mean_hu FROM s GROUP BY 1, 2""")
def lateral_fat(spark, d):
    bands = K.lateral_bands(ball(spark, d), 2, 1).withColumnRenamed("side", "region")
    return rounded(K.optional_fat(grid(spark, d), bands, -100, 100, SPACING), ("fat_ml", "mean_hu"))


@query(f"""{GRID}, m AS (SELECT * FROM v WHERE {BALL}), c AS (SELECT case_id, max(t) * 2.0::DOUBLE AS thickness_mm, round(avg(t) * 2, 6) AS mean_thickness_mm FROM (SELECT case_id, z, x, max(y) - min(y) + 1 AS t FROM m GROUP BY ALL) GROUP BY 1)
SELECT case_id, (max(x) - min(x) + 1) * 1.0::DOUBLE AS x_mm, (max(y) - min(y) + 1) * 2.0::DOUBLE AS y_mm, (max(z) - min(z) + 1) * 3.0::DOUBLE AS z_mm, round(count(*) * 0.006::DOUBLE, 6) AS volume_ml, any_value(thickness_mm) AS thickness_mm, any_value(mean_thickness_mm) AS mean_thickness_mm FROM m JOIN c USING (case_id) GROUP BY 1""")
def region_extents(spark, d):
    return rounded(K.extents(ball(spark, d), SPACING), ("volume_ml", "mean_thickness_mm"))


POINTS = "SELECT case_id, 1.0 * x AS x_mm, 2.0 * y AS y_mm, 3.0 * z AS z_mm FROM v WHERE "


def points(spark, d):
    """Named points of each case: fixed voxels, moved a little with the case."""
    g = grid(spark, d).where("x = (case_id % 5) and y = 2 * z").where("z < 4").select(*V.AT)
    return K.physical(g, (0, 0, 0), SPACING).withColumn("name", F.concat(F.lit("p"), F.col("z").cast("string")))


@query("SELECT CAST(case_id AS INTEGER) AS case_id, a, b, CASE WHEN b <> 'q' THEN 5.0::DOUBLE * abs(CAST(substr(a, 2) AS INTEGER) - CAST(substr(b, 2) AS INTEGER)) END AS mm FROM (SELECT unnest(range(1 + count(*) // 10)) AS case_id FROM supplier), (VALUES ('p0', 'p1'), ('p1', 'p3'), ('p0', 'q')) t(a, b)")
def landmark_distances(spark, d):
    return K.landmark_distances(points(spark, d), [("p0", "p1"), ("p1", "p3"), ("p0", "q")])


@query("SELECT CAST(unnest(range(1 + count(*) // 10)) AS INTEGER) AS case_id, 7.0::DOUBLE AS mm FROM supplier")
def plane_distances(spark, d):
    at = points(spark, d).select("case_id").distinct()
    named = at.select("case_id", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), *[F.lit(float(v)).alias(f"{c}_mm") for c, v in zip("xyz", p, strict=True)]) for n, p in (("a", (0, 0, 2)), ("b", (3, 0, 2)), ("c", (0, 5, 2)), ("q", (8, 8, 9)))])).alias("r")).select("case_id", "r.*")
    return K.point_to_plane(named, ["a", "b", "c"], "q")


@query(f"""{GRID}, k AS (SELECT * FROM v WHERE z BETWEEN 2 AND 8), e AS (SELECT case_id, min(y) AS a, max(y) AS b FROM k WHERE hu >= 400 GROUP BY 1), s AS (SELECT case_id, z, x, min(y) AS f FROM k WHERE hu >= 400 GROUP BY ALL)
SELECT k.case_id, count(*) AS n FROM k JOIN e USING (case_id) LEFT JOIN s USING (case_id, z, x) WHERE y < a + (b - a + 1) * 0.25 AND (f IS NULL OR y <= f) GROUP BY 1""")
def face_regions(spark, d):
    return K.face_region(grid(spark, d), 2, 8, 400, 0.25).groupBy("case_id").agg(F.count("*").alias("n"))


@query(f"""{GRID}, r AS (SELECT c.case_id, c.z, t.angle, i, CAST(round(6 + i * 0.5 * sin(t.angle * 2 * pi() / 8)) AS INTEGER) AS y, CAST(round(6 + i * 0.5 * cos(t.angle * 2 * pi() / 8)) AS INTEGER) AS x FROM (SELECT DISTINCT case_id, z FROM v WHERE x = 0) c, (SELECT unnest(range(8)) AS angle) t, (SELECT unnest(range(17)) AS i)),
f AS (SELECT r.case_id, r.z, angle, min(i) FILTER (WHERE m.x IS NULL) AS i FROM r LEFT JOIN (SELECT * FROM v WHERE {BALL}) m ON m.case_id = r.case_id AND m.z = r.z AND m.y = r.y AND m.x = r.x GROUP BY ALL)
SELECT case_id, z, CAST(angle AS INTEGER) AS angle, CASE WHEN i > 0 THEN (i - 1) * 0.5::DOUBLE WHEN i = 0 THEN 0 END AS radius FROM f""")
def boundary_radii(spark, d):
    line = grid(spark, d).select("case_id", "z").distinct().withColumns({"cy": F.lit(6.0), "cx": F.lit(6.0)})
    return K.boundary_radii(ball(spark, d), line, 8, 8.0, 0.5)


def cells(spark, d):
    """Cells (slice, angle) with a made-up radius, those well over their expected radius."""
    return grid(spark, d).where("y = 3").select("case_id", "z", F.col("x").alias("angle"), ((F.col("hu") + 100) / 100).alias("radius"), F.lit(3.0).alias("expected")).where("radius > 4")


@query()
def ring_components(spark, d):
    return K.ring_components(cells(spark, d), 12).groupBy("case_id", "component").agg(F.count("*").alias("n"))


@query(f"""{GRID} SELECT case_id, z, 0 AS component, round(pi() / 12 * coalesce(sum(CASE WHEN r > 3 THEN r * r - 9 END), 0), 6) AS area FROM (SELECT *, (hu + 100) / 100 AS r FROM v WHERE y = 3) WHERE r > 4 GROUP BY 1, 2""")
def area_deltas(spark, d):
    return rounded(K.area_deltas(cells(spark, d).withColumn("component", F.lit(0)), 12), ("area",))


@query()
def protrusions(spark, d):
    c = cells(spark, d)
    labelled = c.join(K.ring_components(c, 12), ["case_id", "z", "angle"])
    return rounded(K.protrusions(labelled, 12, 2.0, (30.0, 180.0), (2.0, 10.0)), ("max_depth", "median_depth", "prominence", "max_area"))


@query(f"""{GRID}, a AS (SELECT case_id, z, count(*) * 2.0::DOUBLE AS area, (max(x) - min(x) + 1) * 1.0::DOUBLE AS lat, (max(y) - min(y) + 1) * 2.0::DOUBLE AS ap FROM v WHERE {BALL} GROUP BY 1, 2), gg AS (SELECT case_id, count(*) * 3.0::DOUBLE AS length_mm, round(sum(area) * 3 / 1000, 6) AS volume_ml, min(area) AS min_area, arg_min(z, struct_pack(a := area, z := z)) AS z, round(quantile_cont(area, 0.05), 6) AS p05, round(quantile_cont(area, 0.1), 6) AS p10, round(quantile_cont(area, 0.25), 6) AS p25, round(quantile_cont(area, 0.5), 6) AS p50 FROM a GROUP BY 1)
SELECT case_id, length_mm, volume_ml, min_area, z AS z_min, p05, p10, p25, p50, lat AS lateral_mm, ap AS ap_mm, round(sqrt(1 - power(least(lat, ap) / greatest(lat, ap), 2)), 6) AS eccentricity FROM gg JOIN a USING (case_id, z)""")
def tube_sections(spark, d):
    return rounded(M.tube_features(ball(spark, d), SPACING), ("volume_ml", "p05", "p10", "p25", "p50", "eccentricity"))


@query(f"""{GRID}, c AS (SELECT case_id, z, avg(y) AS cy, avg(x) AS cx FROM v WHERE {BALL} GROUP BY 1, 2), l AS (SELECT v.case_id, v.z, y < cy AS f, floor((CASE WHEN atan2(y - cy, x - cx) < 0 THEN atan2(y - cy, x - cx) + 2 * pi() ELSE atan2(y - cy, x - cx) END) / (2 * pi()) * 12) AS s FROM v JOIN c ON c.case_id = v.case_id AND c.z = v.z WHERE {BALL.replace('(z', '(v.z')} AND hu >= 300), r AS (SELECT case_id, z, count(DISTINCT s) * 30.0::DOUBLE AS arc, count(*) AS n, count(*) FILTER (WHERE f) AS f FROM l GROUP BY 1, 2)
SELECT case_id, round(avg(arc), 6) AS arc_mean, max(arc) AS arc_max, round(sum(f) / sum(n), 6) AS anterior, round(1 - sum(f) / sum(n), 6) AS posterior, round(2 * sum(f) / sum(n) - 1, 6) AS difference FROM r GROUP BY 1""")
def lesion_arcs(spark, d):
    out = M.wall_arcs(grid(spark, d).where(BALL).where("hu >= 300"), ball(spark, d), 12)
    return rounded(out, ("arc_mean", "anterior", "posterior", "difference"))


@query(f"""{NEAR}, s AS (SELECT *, least(3, floor((atan2(y - 6.0, x - 6.0) + pi()) / (2 * pi()) * 4)) AS sector FROM far WHERE NOT inside AND d <= 3.5 AND hu BETWEEN -100 AND 100), p AS (SELECT case_id, hu, 'all' AS part FROM s UNION ALL SELECT case_id, hu, CASE WHEN d <= 2 THEN 'layer_1' ELSE 'layer_2' END FROM s UNION ALL SELECT case_id, hu, 'sector_' || CAST(sector AS INTEGER) FROM s)
SELECT case_id, part, count(*) AS n, round(count(*) * 0.006::DOUBLE, 6) AS volume_ml, round(avg(hu), 6) AS mean_hu, round(stddev_pop(hu), 6) AS sd_hu FROM p GROUP BY 1, 2""")
def layered_fat(spark, d):
    out = M.layered_fat(grid(spark, d), ball(spark, d), [(0.0, 2.0), (2.0, 3.5)], -100, 100, 4, SPACING)
    return rounded(out.drop("skewness"), ("volume_ml", "mean_hu", "sd_hu"))


ISLANDS = " UNION ALL ".join(f"SELECT case_id, count(*) AS n FROM (SELECT *, {a} - row_number() OVER (PARTITION BY case_id, {b}, {c}, level ORDER BY {a}) AS i FROM q) GROUP BY case_id, {b}, {c}, level, i" for a, b, c in ("zyx", "yzx", "xzy"))


@query(f"""{GRID}, q AS (SELECT *, CAST(least(3, floor((hu - lo) / (hi - lo) * 4)) AS INTEGER) AS level FROM (SELECT *, min(hu) OVER (PARTITION BY case_id) AS lo, max(hu) OVER (PARTITION BY case_id) AS hi FROM v)), r AS ({ISLANDS})
SELECT case_id, round(avg(1.0 / (n * n)), 6) AS short_run_emphasis, round(avg(n * n), 6) AS long_run_emphasis, count(*) AS runs FROM r GROUP BY 1""")
def run_emphasis(spark, d):
    return rounded(M.run_features(V.quantize(grid(spark, d), 4)), ("short_run_emphasis", "long_run_emphasis"))


@query(f"{GRID} SELECT case_id, greatest(min(z) - 1, 0) AS z_min, least(max(z) + 1, 11) AS z_max, greatest(min(y) - 2, 0) AS y_min, least(max(y) + 2, 11) AS y_max, greatest(min(x) - 3, 0) AS x_min, least(max(x) + 3, 11) AS x_max, count(*) AS n FROM v WHERE {BALL} GROUP BY 1")
def expanded_boxes(spark, d):
    return M.expanded(V.bounding_box(ball(spark, d)), 3.0, SPACING, SHAPE)


@query(f"{GRID} SELECT case_id, count(*) AS n FROM v WHERE {BALL} AND x BETWEEN 4 AND 8 GROUP BY 1")
def cropped_voxels(spark, d):
    inner = ball(spark, d).where("x between 5 and 7")
    return V.crop(grid(spark, d).where(BALL), V.bounding_box(inner), 1.0, SPACING).groupBy("case_id").agg(F.count("*").alias("n"))


@query()
def section_shapes(spark, d):
    parts = M.slice_components(grid(spark, d).where("hu >= 300"))
    return rounded(M.section_features(parts, SPACING, 3).select("case_id", "z", "component", "area", "perimeter", "circularity", "eccentricity"), ("circularity", "eccentricity"))


@query()
def tube_lines(spark, d):
    return rounded(M.centreline(ball(spark, d), SPACING), ("tangent_x", "tangent_y", "tangent_z", "curvature"))


@query()
def cleaned_masks(spark, d):
    return M.cleaned(grid(spark, d).where("hu >= 150").select(*V.AT), SHAPE).groupBy("case_id").agg(F.count("*").alias("n"))


@query()
def mask_quality(spark, d):
    v = grid(spark, d)
    return M.mask_quality(v, v.where("hu >= 450 and case_id <> 1"), v, SPACING, 700.0, 900.0).select("case_id", "voxels", "components", "volume_mm3", "warnings")


@query(f"{GRID} SELECT 'positive' AS side, CASE WHEN {BALL} AND hu > 400 THEN 'ball,bright' WHEN {BALL} THEN 'ball' ELSE 'bright' END AS name, count(*) AS n FROM v WHERE {BALL} OR hu > 400 GROUP BY 2 UNION ALL SELECT 'negative', 'slab', count(*) FROM v WHERE x < 3 AND case_id % 2 = 0 AND NOT ({BALL}) AND hu <= 400 UNION ALL SELECT 'negative', 'slab', count(*) FROM v WHERE x > 8 AND case_id % 2 = 1 AND NOT ({BALL}) AND hu <= 400")
def fused_priors(spark, d):
    v = grid(spark, d)
    positive, negative = M.fused([("ball", ball(spark, d)), ("bright", v.where("hu > 400"))], {"slab": [v.where("x < 3 and case_id % 2 = 0"), v.where("x > 8")]})
    side = negative.groupBy(F.col("structure").alias("name"), (F.col("case_id") % 2).alias("_p")).agg(F.count("*").alias("n"))
    return positive.groupBy(F.col("sources").alias("name")).agg(F.count("*").alias("n")).select(F.lit("positive").alias("side"), "name", "n").union(side.select(F.lit("negative"), "name", "n"))


@query(f"{GRID}, s AS (SELECT * FROM (VALUES ('upper', 0, 5), ('lower', 4, 9)) t(slab, low, high)), a AS (SELECT case_id, z, count(*) * 2.0::DOUBLE AS area FROM v WHERE {BALL} GROUP BY 1, 2), k AS (SELECT case_id, arg_min(z, struct_pack(a := area, z := z)) AS z FROM a GROUP BY 1) SELECT a.case_id, slab, round(sum(area) * 3 / 1000, 6) AS volume_ml, min(area) AS min_area, count(*) AS n_slices, any_value(slab = (SELECT min(slab) FILTER (WHERE slab = 'upper') FROM s WHERE k.z BETWEEN low AND high)) IS TRUE AS narrowest FROM a JOIN s ON z BETWEEN low AND high JOIN k ON k.case_id = a.case_id GROUP BY 1, 2")
def slab_sections(spark, d):
    tube = ball(spark, d)
    levels = tube.select("case_id").distinct().select("case_id", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(z).alias("z")) for n, z in (("upper", 4), ("lower", 6))])).alias("l")).select("case_id", "l.*")
    bounds = M.slabs(tube, levels, ["upper", "lower"], {"upper": (4, 1), "lower": (2, 3)})
    return rounded(M.slab_features(tube, bounds, ["upper", "lower"], SPACING), ("volume_ml",))
