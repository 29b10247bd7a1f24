"""Volumes as tables: voxel (case_id, z, y, x, hu) and sparse masks (case_id, z, y, x). Every measure is grouped by case, so cases spread over tasks.

Joins are on coordinates; neighbourhoods are equi-joins on shifted coordinates and distances up to a bound are joins on listed offsets, so no
pair of far voxels is ever formed.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

AT = ["case_id", "z", "y", "x"]


def grid(spark: SparkSession, cases: int, size: int) -> DataFrame:
    """A synthetic volume: ``cases`` cubes of ``size`` with hu from a mixed index."""
    n = size**3
    df = spark.range(cases * n)
    i = F.col("id") % n
    case = (F.col("id") / n).cast("int")
    z, y, x = (F.floor(i / (size * size))).cast("int"), (F.floor(i / size) % size).cast("int"), (i % size).cast("int")
    out = df.select(case.alias("case_id"), z.alias("z"), y.alias("y"), x.alias("x"))
    return out.withColumn("hu", ((F.col("z") * 37 + F.col("y") * 101 + F.col("x") * 53 + F.col("case_id") * 17 + F.col("x") * F.col("y") * 7) % 600 - 100).cast("double"))


def volume_mm3(spacing: Sequence[float]) -> float:
    return math.prod(spacing)


def threshold_summary(voxels: DataFrame, thresholds: Sequence[float], spacing: Sequence[float]) -> DataFrame:
    """Voxels at or above each threshold by case: count, volume, greatest and mean hu. Every case has every threshold; 0 and nulls without voxels."""
    t = F.explode(F.array(*[F.lit(float(v)) for v in thresholds]))
    hit = F.col("hu") >= F.col("threshold")
    rows = voxels.withColumn("threshold", t).groupBy("case_id", "threshold")
    return rows.agg(F.count_if(hit).alias("n"), F.max(F.when(hit, F.col("hu"))).alias("max_hu"), F.avg(F.when(hit, F.col("hu"))).alias("mean_hu")).withColumn("volume_mm3", F.col("n") * F.lit(volume_mm3(spacing)))


def bounding_box(mask: DataFrame) -> DataFrame:
    return mask.groupBy("case_id").agg(*[f(c).alias(f"{c}_{n}") for c in ("z", "y", "x") for n, f in (("min", F.min), ("max", F.max))], F.count("*").alias("n"))


def crop(voxels: DataFrame, box: DataFrame, margin_mm: float, spacing: Sequence[float]) -> DataFrame:
    """Voxels within the box and a margin in mm; spacing in x, y, z."""
    by = dict(zip("xyz", (math.ceil(margin_mm / s) for s in spacing), strict=True))
    inside = F.lit(True)
    for c in "zyx":
        inside = inside & F.col(c).between(F.col(f"{c}_min") - by[c], F.col(f"{c}_max") + by[c])
    return voxels.join(box, "case_id").where(inside).select(*voxels.columns)


def slice_areas(mask: DataFrame, spacing: Sequence[float]) -> DataFrame:
    """Area, centroid and equivalent radius by slice; spacing in x, y, z."""
    area = F.count("*") * F.lit(float(spacing[0] * spacing[1]))
    return mask.groupBy("case_id", "z").agg(area.alias("area_mm2"), F.avg("y").alias("cy"), F.avg("x").alias("cx")).withColumn("radius_mm", F.sqrt(F.col("area_mm2") / F.lit(math.pi)))


def narrowest(areas: DataFrame) -> DataFrame:
    """Least and mean area by case and the first slice that has the least."""
    return areas.groupBy("case_id").agg(F.min("area_mm2").alias("min_area"), F.min_by("z", F.struct("area_mm2", "z")).alias("z_min"), F.avg("area_mm2").alias("mean_area"), F.percentile("area_mm2", 0.1).alias("p10"))


def slab_summary(areas: DataFrame, slabs: DataFrame) -> DataFrame:
    """Least area and slices in each slab (case_id, slab, low, high), bounds included; slabs may overlap."""
    j = areas.join(slabs, "case_id").where(F.col("z").between(F.col("low"), F.col("high")))
    return j.groupBy("case_id", "slab").agg(F.min("area_mm2").alias("min_area"), F.count("*").alias("n_slices"))


def cooccurrence(levels: DataFrame, axes: Sequence[str] = ("z", "y", "x")) -> DataFrame:
    """(case_id, a, b, n): symmetric counts of levels of neighbours along the axes."""
    out = None
    for axis in axes:
        near = levels.select("case_id", *[(F.col(c) - 1).alias(c) if c == axis else F.col(c) for c in ("z", "y", "x")], F.col("level").alias("b"))
        one = levels.join(near, AT).groupBy("case_id", F.col("level").alias("a"), "b").agg(F.count("*").alias("n"))
        out = one if out is None else out.union(one)
    both = out.select(F.col("case_id"), F.explode(F.array(F.struct("a", "b", "n"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "n"))).alias("p")).select("case_id", "p.*")
    return both.groupBy("case_id", "a", "b").agg(F.sum("n").alias("n"))


def cooccurrence_features(counts: DataFrame) -> DataFrame:
    p = F.col("n") / F.sum("n").over(Window.partitionBy("case_id"))
    c = counts.withColumn("p", p)
    d = F.col("a") - F.col("b")
    return c.groupBy("case_id").agg(F.sum(F.col("p") * d * d).alias("contrast"), F.sum(F.col("p") / (1 + F.abs(d))).alias("homogeneity"), F.sum(F.col("p") * F.col("p")).alias("energy"), (-F.sum(F.col("p") * F.log2("p"))).alias("entropy"))


def run_lengths(levels: DataFrame, axis: str) -> DataFrame:
    """(case_id, level, length, n): runs of equal level along an axis, by gaps and islands."""
    others = [c for c in AT if c != axis]
    island = F.col(axis) - F.row_number().over(Window.partitionBy(*others, "level").orderBy(axis))
    runs = levels.withColumn("island", island).groupBy(*others, "level", "island").agg(F.count("*").alias("length"))
    return runs.groupBy("case_id", "level", "length").agg(F.count("*").alias("n"))


def quantize(voxels: DataFrame, levels: int) -> DataFrame:
    """Linear levels 0..levels-1 between the case's least and greatest value."""
    span = voxels.groupBy("case_id").agg(F.min("hu").alias("lo"), F.max("hu").alias("hi"))
    x = F.floor((F.col("hu") - F.col("lo")) / (F.col("hi") - F.col("lo")) * levels)
    return voxels.join(span, "case_id").select(*AT, F.when(F.col("hi") > F.col("lo"), F.least(F.lit(levels - 1), x)).otherwise(0).cast("int").alias("level"))


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Dice, Jaccard, added, removed and percent change by case of two masks; both empty counts as equal."""
    both = a.select(*AT).withColumn("a", F.lit(1)).join(b.select(*AT).withColumn("b", F.lit(1)), AT, "full")
    n = both.groupBy("case_id").agg(F.count("a").alias("n_old"), F.count("b").alias("n_new"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("n_both"))
    union = F.col("n_old") + F.col("n_new") - F.col("n_both")
    return n.select("case_id", "n_old", "n_new", "n_both", (2 * F.col("n_both") / (F.col("n_old") + F.col("n_new"))).alias("dice"), (F.col("n_both") / union).alias("jaccard"), (F.col("n_new") - F.col("n_both")).alias("added"), (F.col("n_old") - F.col("n_both")).alias("removed"), F.try_divide(100.0 * (F.col("n_new") - F.col("n_old")), F.col("n_old")).alias("percent_change"))


def change_labels(old: DataFrame, new: DataFrame) -> DataFrame:
    """1 in both, 2 only new, 3 only old."""
    both = old.select(*AT).withColumn("a", F.lit(1)).join(new.select(*AT).withColumn("b", F.lit(1)), AT, "full")
    return both.select(*AT, F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1).when(F.col("b").isNotNull(), 2).otherwise(3).alias("label"))


def offsets(radius_mm: float, spacing: Sequence[float]) -> list[tuple[int, int, int, float]]:
    """(dz, dy, dx, distance) of all grid offsets within the radius; spacing in x, y, z."""
    sx, sy, sz = spacing
    out = []
    for dz in range(-int(radius_mm // sz), int(radius_mm // sz) + 1):
        for dy in range(-int(radius_mm // sy), int(radius_mm // sy) + 1):
            for dx in range(-int(radius_mm // sx), int(radius_mm // sx) + 1):
                d = math.sqrt((dz * sz) ** 2 + (dy * sy) ** 2 + (dx * sx) ** 2)
                if d <= radius_mm:
                    out.append((dz, dy, dx, d))
    return out


def boundary(mask: DataFrame) -> DataFrame:
    """Mask voxels that lack one of their six neighbours: distances to the mask are distances to these."""
    six = F.array(*[F.struct(F.lit(a).alias("dz"), F.lit(b).alias("dy"), F.lit(c).alias("dx")) for a, b, c in ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))])
    near = mask.select(*AT, F.explode(six).alias("o")).select("case_id", *[(F.col(c) + F.col(f"o.d{c}")).alias(c) for c in "zyx"])
    inner = near.groupBy(*AT).agg(F.count("*").alias("n")).where("n = 6").select(*AT)
    return mask.select(*AT).join(inner, AT, "left_anti")


def distance_within(mask: DataFrame, radius_mm: float, spacing: Sequence[float]) -> DataFrame:
    """(case_id, z, y, x, distance) of voxels outside the mask at most ``radius_mm`` from it."""
    near = F.explode(F.array(*[F.struct(F.lit(a).alias("dz"), F.lit(b).alias("dy"), F.lit(c).alias("dx"), F.lit(d).alias("d")) for a, b, c, d in offsets(radius_mm, spacing)]))
    reach = boundary(mask).select(*AT, near.alias("o")).select("case_id", *[(F.col(c) + F.col(f"o.d{c}")).alias(c) for c in "zyx"], F.col("o.d").alias("d"))
    return reach.groupBy(*AT).agg(F.min("d").alias("distance")).join(mask.select(*AT), AT, "left_anti")


def shells(distances: DataFrame, bounds: Sequence[tuple[float, float]]) -> DataFrame:
    """Shell number from 1 with low < distance <= high; voxels of no shell are left out."""
    out = None
    for i, (lo, hi) in enumerate(bounds, 1):
        hit = (F.col("distance") > lo) & (F.col("distance") <= hi)
        out = F.when(hit, i) if out is None else out.when(hit, i)
    return distances.withColumn("shell", out).where("shell is not null")


def window_fat(voxels: DataFrame, shelled: DataFrame, low: float, high: float, spacing: Sequence[float]) -> DataFrame:
    """Voxels of each shell in the hu window: count, volume and mean."""
    hit = F.col("hu").between(low, high)
    return voxels.join(shelled, AT).groupBy("case_id", "shell").agg(F.count("*").alias("n_shell"), F.count_if(hit).alias("n_fat"), F.avg(F.when(hit, F.col("hu"))).alias("mean_hu")).withColumn("fat_mm3", F.col("n_fat") * F.lit(volume_mm3(spacing)))


def angle_sector(dy: Column, dx: Column, sectors: int) -> Column:
    """Sector 0..sectors-1 of the angle around a centre."""
    return F.least(F.lit(sectors - 1), F.floor((F.atan2(dy, dx) + math.pi) / (2 * math.pi) * sectors).cast("int"))


def largest_component(labelled: DataFrame) -> DataFrame:
    """Voxels of each case's largest component, ties to the smaller number."""
    sizes = labelled.groupBy("case_id", "component").agg(F.count("*").alias("n"))
    top = sizes.groupBy("case_id").agg(F.max_by("component", F.struct("n", -F.col("component"))).alias("component"))
    return labelled.join(top, ["case_id", "component"])


def merge_labels(layers: DataFrame) -> DataFrame:
    """Of several labels on a voxel the one of least ``priority``: (case_id, z, y, x, label, priority)."""
    return layers.groupBy(*AT).agg(F.min_by("label", F.struct("priority", "label")).alias("label"))
