"""Queries over synthetic volumes, as many as the supplier table tells; the SQL makes the same volumes from ranges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import masks as K
from ..operators import voxel as V
from .aggregates import rounded
from .registry import query, read

SIZE = 12
SPACING = (1.0, 2.0, 3.0)
GRID = f"""WITH g AS (SELECT CAST(i // {SIZE**3} AS INTEGER) AS case_id, CAST(i % {SIZE**3} // {SIZE**2} AS INTEGER) AS z, CAST(i % {SIZE**2} // {SIZE} AS INTEGER) AS y, CAST(i % {SIZE} AS INTEGER) AS x FROM (SELECT unnest(range({SIZE**3} * (1 + count(*) // 10))) AS i FROM supplier)),
v AS (SELECT *, CAST((z * 37 + y * 101 + x * 53 + case_id * 17 + x * y * 7) % 600 - 100 AS DOUBLE) AS hu FROM g)"""
BALL = "(z - 6) * (z - 6) + (y - 6) * (y - 6) + (x - 6) * (x - 6) <= 9"


def grid(spark, d):
    """A case of 12 x 12 x 12 voxels for every ten suppliers."""
    return V.grid(spark, 1 + read(spark, d, "supplier").count() // 10, SIZE)


def ball(spark, d, rule=BALL):
    return grid(spark, d).where(rule).select(*V.AT)


@query(f"{GRID} SELECT case_id, CAST(t AS DOUBLE) AS threshold, count(*) FILTER (WHERE hu >= t) AS n, max(hu) FILTER (WHERE hu >= t) AS max_hu, round(avg(hu) FILTER (WHERE hu >= t), 6) AS mean_hu, count(*) FILTER (WHERE hu >= t) * 6.0::DOUBLE AS volume_mm3 FROM v, (SELECT unnest([130, 300, 490]) AS t) GROUP BY 1, 2")
def threshold_volumes(spark, d):
    return rounded(V.threshold_summary(grid(spark, d), [130, 300, 490], SPACING), ("mean_hu",))


@query(f"{GRID} SELECT case_id, min(z) AS z_min, max(z) AS z_max, min(y) AS y_min, max(y) AS y_max, min(x) AS x_min, max(x) AS x_max, count(*) AS n FROM v WHERE {BALL} GROUP BY 1")
def bounding_boxes(spark, d):
    return V.bounding_box(ball(spark, d))


@query(f"{GRID}, a AS (SELECT case_id, z, count(*) * 2.0 AS area FROM v WHERE {BALL} GROUP BY 1, 2) SELECT case_id, min(area)::DOUBLE AS min_area, min(z) FILTER (WHERE area = m) AS z_min, round(avg(area), 6) AS mean_area, round(quantile_cont(area::DOUBLE, 0.1), 6) AS p10 FROM (SELECT *, min(area) OVER (PARTITION BY case_id) AS m FROM a) GROUP BY 1")
def slice_areas(spark, d):
    return rounded(V.narrowest(V.slice_areas(ball(spark, d), SPACING)), ("mean_area", "p10"))


@query(f"{GRID}, q AS (SELECT *, CAST(least(7, floor((hu - lo) / (hi - lo) * 8)) AS INTEGER) AS level FROM (SELECT *, min(hu) OVER (PARTITION BY case_id) AS lo, max(hu) OVER (PARTITION BY case_id) AS hi FROM v)), p AS (SELECT a.case_id, a.level AS a, b.level AS b FROM q a JOIN q b ON a.case_id = b.case_id AND ((b.z = a.z + 1 AND b.y = a.y AND b.x = a.x) OR (b.z = a.z AND b.y = a.y + 1 AND b.x = a.x) OR (b.z = a.z AND b.y = a.y AND b.x = a.x + 1))), s AS (SELECT case_id, a, b FROM p UNION ALL SELECT case_id, b, a FROM p), c AS (SELECT case_id, a, b, count(*) / sum(count(*)) OVER (PARTITION BY case_id) AS p FROM s GROUP BY 1, 2, 3) SELECT case_id, round(sum(p * (a - b) * (a - b)), 6) AS contrast, round(sum(p / (1 + abs(a - b))), 6) AS homogeneity, round(sum(p * p), 6) AS energy, round(-sum(p * log2(p)), 6) AS entropy FROM c GROUP BY 1")
def cooccurrence(spark, d):
    return rounded(V.cooccurrence_features(V.cooccurrence(V.quantize(grid(spark, d), 8))), ("contrast", "homogeneity", "energy", "entropy"))


@query(f"{GRID}, q AS (SELECT *, CAST(least(3, floor((hu - lo) / (hi - lo) * 4)) AS INTEGER) AS level FROM (SELECT *, min(hu) OVER (PARTITION BY case_id) AS lo, max(hu) OVER (PARTITION BY case_id) AS hi FROM v)), i AS (SELECT case_id, z, y, level, x - row_number() OVER (PARTITION BY case_id, z, y, level ORDER BY x) AS g FROM q), r AS (SELECT case_id, level, count(*) AS length FROM i GROUP BY case_id, z, y, level, g) SELECT case_id, level, length, count(*) AS n FROM r GROUP BY ALL")
def run_lengths(spark, d):
    return V.run_lengths(V.quantize(grid(spark, d), 4), "x")


MOVED = "(z - 7) * (z - 7) + (y - 6) * (y - 6) + (x - 6) * (x - 6) <= 9"


@query(f"{GRID}, c AS (SELECT case_id, count(*) FILTER (WHERE {BALL}) AS a, count(*) FILTER (WHERE {MOVED}) AS b, count(*) FILTER (WHERE {BALL} AND {MOVED}) AS i FROM v GROUP BY 1) SELECT case_id, a AS n_old, b AS n_new, i AS n_both, round(2 * i / (a + b), 9) AS dice, round(i / (a + b - i), 9) AS jaccard, b - i AS added, a - i AS removed, round(100.0 * (b - a) / a, 6) AS percent_change FROM c")
def overlap_measures(spark, d):
    return rounded(rounded(V.overlap(ball(spark, d), ball(spark, d, MOVED)), ("dice", "jaccard"), 9), ("percent_change",))


@query(f"{GRID} SELECT CASE WHEN {BALL} AND {MOVED} THEN 1 WHEN {MOVED} THEN 2 ELSE 3 END AS label, count(*) AS n FROM v WHERE {BALL} OR {MOVED} GROUP BY 1")
def change_labels(spark, d):
    return V.change_labels(ball(spark, d), ball(spark, d, MOVED)).groupBy("label").agg(F.count("*").alias("n"))


@query(f"{GRID}, m AS (SELECT * FROM v WHERE {BALL}), d AS (SELECT v.case_id, v.z, v.y, v.x, any_value(v.hu) AS hu, min(sqrt(power(3.0 * (v.z - m.z), 2) + power(2.0 * (v.y - m.y), 2) + power(1.0 * (v.x - m.x), 2))) AS dist FROM v JOIN m USING (case_id) WHERE NOT ((v.z - 6) * (v.z - 6) + (v.y - 6) * (v.y - 6) + (v.x - 6) * (v.x - 6) <= 9) GROUP BY 1, 2, 3, 4), s AS (SELECT *, CASE WHEN dist > 0 AND dist <= 2 THEN 1 WHEN dist > 2 AND dist <= 4.5 THEN 2 END AS shell FROM d) SELECT case_id, shell, count(*) AS n_shell, count(*) FILTER (WHERE hu BETWEEN -50 AND 200) AS n_fat, round(avg(hu) FILTER (WHERE hu BETWEEN -50 AND 200), 6) AS mean_hu, count(*) FILTER (WHERE hu BETWEEN -50 AND 200) * 6.0::DOUBLE AS fat_mm3 FROM s WHERE shell IS NOT NULL GROUP BY 1, 2")
def shell_fat(spark, d):
    far = V.shells(V.distance_within(ball(spark, d), 4.5, SPACING), [(0.0, 2.0), (2.0, 4.5)])
    return rounded(V.window_fat(grid(spark, d), far, -50, 200, SPACING), ("mean_hu",))


@query(f"{GRID} SELECT case_id, CAST(least(5, floor((atan2(y - 5.5, x - 5.5) + pi()) / (2 * pi()) * 6)) AS INTEGER) AS sector, count(*) AS n, round(avg(hu), 6) AS mean_hu FROM v GROUP BY 1, 2")
def angular_sectors(spark, d):
    s = V.angle_sector(F.col("y") - 5.5, F.col("x") - 5.5, 6)
    return grid(spark, d).groupBy("case_id", s.alias("sector")).agg(F.count("*").alias("n"), F.round(F.avg("hu"), 6).alias("mean_hu"))


@query()
def lesion_components(spark, d):
    labelled = K.components(grid(spark, d).where("hu >= 430"))
    return labelled.groupBy("case_id", "component").agg(F.count("*").alias("n"), F.min("z").alias("z_min"), F.max("z").alias("z_max"))


@query(f"{GRID}, l AS (SELECT case_id, z, y, x, 'ball' AS label, 2 AS p FROM v WHERE {BALL} UNION ALL SELECT case_id, z, y, x, 'bright', 1 FROM v WHERE hu > 300) SELECT label, count(*) AS n FROM (SELECT case_id, z, y, x, arg_min(label, p) AS label FROM l GROUP BY 1, 2, 3, 4) GROUP BY 1")
def label_precedence(spark, d):
    a = ball(spark, d).withColumn("label", F.lit("ball")).withColumn("priority", F.lit(2))
    b = grid(spark, d).where("hu > 300").select(*V.AT, F.lit("bright").alias("label"), F.lit(1).alias("priority"))
    return V.merge_labels(a.union(b)).groupBy("label").agg(F.count("*").alias("n"))
