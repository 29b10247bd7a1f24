"""Measures of tubes and regions of volumes: centrelines, cross-sections, slabs, arcs, layers, texture, cleaning and quality.

Like ``voxel`` and ``masks``: one row a voxel, groups by case and slice, so cases and slices spread over tasks. Spacing is in x, y, z.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import geometry as G
from . import masks as K
from . import voxel as V
from .voxel import AT


# ---------------------------------------------------------------- centrelines
def smoothed(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], sigma: float, reach: float = 4.0) -> DataFrame:
    """Columns averaged over the rows before and behind with Gaussian weights, out to ``reach`` sigmas; beyond the ends the end values go on."""
    n = int(reach * sigma + 0.5)
    weights = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(-n, n + 1)]
    w = Window.partitionBy(*keys).orderBy(order)
    ends = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def at(c: str, d: int) -> Column:
        moved = F.lag(c, -d).over(w) if d < 0 else F.lead(c, d).over(w) if d > 0 else F.col(c)
        return F.coalesce(F.lag(c, -d).over(w), F.first(c).over(ends)) if d < 0 else F.coalesce(moved, F.last(c).over(ends))

    return df.withColumns({c: sum((at(c, d) * (v / sum(weights)) for d, v in zip(range(-n, n + 1), weights, strict=True)), F.lit(0.0)) for c in columns})


def centreline(mask: DataFrame, spacing: Sequence[float], sigma: float = 1.0, origin: Sequence[float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """(case_id, z_index, x, y, z, tangent_x, tangent_y, tangent_z, curvature): centroids of slices, smoothed, at the nearest voxel, in mm; lines of fewer than three points aren't smoothed and have no curvature."""
    c = mask.groupBy("case_id", "z").agg(F.avg("y").alias("cy"), F.avg("x").alias("cx"))
    whole = Window.partitionBy("case_id")  # a row a slice
    c = c.withColumn("_n", F.count("*").over(whole))
    soft = smoothed(c, ["case_id"], "z", ["cy", "cx"], sigma) if sigma > 0 else c
    used = soft.join(c.select("case_id", "z", F.col("cy").alias("_y"), F.col("cx").alias("_x")), ["case_id", "z"])
    pick = lambda a, b: F.rint(F.when(F.col("_n") >= 3, F.col(a)).otherwise(F.col(b)))
    points = used.select("case_id", F.col("z").alias("z_index"), "_n", (F.lit(float(origin[0])) + pick("cx", "_x") * spacing[0]).alias("x"), (F.lit(float(origin[1])) + pick("cy", "_y") * spacing[1]).alias("y"), (F.lit(float(origin[2])) + F.col("z") * float(spacing[2])).alias("z"))
    w = Window.partitionBy("case_id").orderBy("z_index")
    first = {c: G.gradient(F.col(c), w) for c in "xyz"}
    steps = points.withColumns({f"_{c}1": v for c, v in first.items()})
    size = F.sqrt(sum((F.col(f"_{c}1") ** 2 for c in "xyz"), F.lit(0.0)))
    unit = {f"tangent_{c}": F.when(F.col("_n") > 1, F.coalesce(F.try_divide(F.col(f"_{c}1"), F.nullif(size, F.lit(0.0))), F.lit(0.0))).otherwise(0.0) for c in "xyz"}
    curved = G.curvature(points, ["case_id"], "z_index").select("case_id", "z_index", F.when(F.col("_n") >= 3, F.col("curvature")).otherwise(0.0).alias("curvature"))
    return steps.withColumns(unit).join(curved, ["case_id", "z_index"]).select("case_id", "z_index", *"xyz", *unit, "curvature")


# ---------------------------------------------------------------- cross-sections
def slice_components(mask: DataFrame) -> DataFrame:
    """(case_id, z, y, x, component): 8-connected parts within each slice, numbered in it from 1 by their first voxel. Slices are told apart by doubling z."""
    apart = mask.select("case_id", (F.col("z") * 2).alias("z"), "y", "x")
    labelled = K.components(apart, 26).select("case_id", (F.col("z") / 2).cast("int").alias("z"), "y", "x", F.col("component").alias("_c"))
    numbers = labelled.select("case_id", "z", "_c").distinct().withColumn("component", F.row_number().over(Window.partitionBy("case_id", "z").orderBy("_c")))
    return labelled.join(numbers, ["case_id", "z", "_c"]).drop("_c")


def section_features(parts: DataFrame, spacing: Sequence[float], least: int = 1) -> DataFrame:
    """By part of a slice (case_id, z, component): area, equivalent diameter, centroid, radii of the boundary from it (mean, deviation, variation, median deviation, least and greatest
    diameter), perimeter by open voxel sides, circularity within 0..1, and eccentricity of the moments.
    """
    keys = ["case_id", "z", "component"]
    sx, sy = float(spacing[0]), float(spacing[1])
    g = parts.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("y").alias("cy"), F.avg("x").alias("cx"), F.var_pop(F.col("x") * sx).alias("_xx"), F.var_pop(F.col("y") * sy).alias("_yy"), F.covar_pop(F.col("x") * sx, F.col("y") * sy).alias("_xy")).where(F.col("n") >= least)
    side = F.explode(F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx"), F.lit(mm).alias("mm")) for a, b, mm in ((0, 1, sy), (0, -1, sy), (1, 0, sx), (-1, 0, sx))]))
    steps = parts.select(*keys, "y", "x", side.alias("s")).select(*keys, "y", "x", (F.col("y") + F.col("s.dy")).alias("ny"), (F.col("x") + F.col("s.dx")).alias("nx"), "s.mm")
    there = parts.select(*keys, F.col("y").alias("ny"), F.col("x").alias("nx"))
    open_ = steps.join(there, [*keys, "ny", "nx"], "left_anti").groupBy(*keys, "y", "x").agg(F.sum("mm").alias("mm"))
    r = F.sqrt(((F.col("y") - F.col("cy")) * sy) ** 2 + ((F.col("x") - F.col("cx")) * sx) ** 2)
    edge = open_.join(g.select(*keys, "cy", "cx"), keys).withColumn("r", r)
    radii = edge.groupBy(*keys).agg(F.sum("mm").alias("perimeter"), F.avg("r").alias("r_mean"), F.stddev_pop("r").alias("r_sd"), F.median("r").alias("_m"), (2 * F.min("r")).alias("min_diameter"), (2 * F.max("r")).alias("max_diameter"))
    spread = edge.join(radii.select(*keys, "_m"), keys).groupBy(*keys).agg(F.median(F.abs(F.col("r") - F.col("_m"))).alias("r_mad"))
    half, diff = (F.col("_xx") + F.col("_yy")) / 2, F.sqrt(((F.col("_xx") - F.col("_yy")) / 2) ** 2 + F.col("_xy") ** 2)
    area = F.col("n") * (sx * sy)
    out = g.join(radii, keys).join(spread, keys).withColumn("area", area)
    return out.select(*keys, "n", "area", (2 * F.sqrt(F.col("area") / math.pi)).alias("equivalent_diameter"), "cy", "cx", "r_mean", "r_sd", F.coalesce(F.try_divide(F.col("r_sd"), F.nullif(F.col("r_mean"), F.lit(0.0))), F.lit(0.0)).alias("r_cv"), "r_mad", "min_diameter", "max_diameter", "perimeter", F.least(F.lit(1.0), 4 * math.pi * F.col("area") / F.col("perimeter") ** 2).alias("circularity"), F.when(half + diff > 0, F.sqrt(F.greatest(F.lit(0.0), 1 - (half - diff) / (half + diff)))).otherwise(0.0).alias("eccentricity"))


def tube_features(mask: DataFrame, spacing: Sequence[float]) -> DataFrame:
    """By case: length of slices that hold the tube, volume, least cross-section with the first slice that has it, percentiles of the cross-sections, and the box's sides and eccentricity in that slice."""
    sections = V.slice_areas(mask, spacing)
    box = mask.groupBy("case_id", "z").agg(((F.max("x") - F.min("x") + 1) * float(spacing[0])).alias("lateral_mm"), ((F.max("y") - F.min("y") + 1) * float(spacing[1])).alias("ap_mm"))
    g = sections.groupBy("case_id").agg((F.count("*") * float(spacing[2])).alias("length_mm"), (F.sum("area_mm2") * float(spacing[2]) / 1000).alias("volume_ml"), F.min("area_mm2").alias("min_area"), F.min_by("z", F.struct("area_mm2", "z")).alias("z"), *[F.percentile("area_mm2", p / 100).alias(f"p{p:02d}") for p in (5, 10, 25, 50)])
    out = g.join(box, ["case_id", "z"])
    small, large = F.least("lateral_mm", "ap_mm"), F.greatest("lateral_mm", "ap_mm")
    return out.withColumn("eccentricity", F.sqrt(1 - (small / large) ** 2)).withColumnRenamed("z", "z_min")


def slabs(mask: DataFrame, levels: DataFrame, order: Sequence[str], margins: Mapping[str, tuple[int, int]]) -> DataFrame:
    """(case_id, slab, low, high): about each named level (case_id, name, z) from so many slices below to so many above, within the tube; thirds named by the first three of ``order`` where a case has no level.

    Slabs may overlap; slabs that lie outside the tube are left out.
    """
    extent = mask.groupBy("case_id").agg(F.min("z").alias("a"), F.max("z").alias("b"))
    below = F.create_map(*[x for n, (lo, _) in margins.items() for x in (F.lit(n), F.lit(lo))])
    above = F.create_map(*[x for n, (_, hi) in margins.items() for x in (F.lit(n), F.lit(hi))])
    named = levels.where(F.col("name").isin(*margins)).join(extent, "case_id")
    own = named.select("case_id", F.col("name").alias("slab"), F.greatest(F.col("z") - below[F.col("name")], F.col("a")).alias("low"), F.least(F.col("z") + above[F.col("name")], F.col("b")).alias("high")).where("low <= high")
    n = F.col("b") - F.col("a") + 1
    cut = lambda i: (F.col("a") + F.floor(n * i / 3)).cast("int")
    thirds = F.explode(F.array(*[F.struct(F.lit(s).alias("slab"), cut(i).alias("low"), (cut(i + 1) - 1).alias("high")) for i, s in enumerate(order[:3])]))
    bare = extent.join(own.select("case_id").distinct(), "case_id", "left_anti").select("case_id", thirds.alias("t")).select("case_id", "t.*").where("low <= high")
    return own.union(bare)


def slab_features(mask: DataFrame, bounds: DataFrame, order: Sequence[str], spacing: Sequence[float]) -> DataFrame:
    """(case_id, slab, volume_ml, min_area, n_slices, narrowest): ``narrowest`` marks the slab that holds the tube's narrowest slice, the first by ``order`` of several."""
    areas = V.slice_areas(mask, spacing)
    j = areas.join(bounds, "case_id").where(F.col("z").between(F.col("low"), F.col("high")))
    g = j.groupBy("case_id", "slab").agg((F.sum("area_mm2") * float(spacing[2]) / 1000).alias("volume_ml"), F.min("area_mm2").alias("min_area"), F.count("*").alias("n_slices"))
    least = areas.groupBy("case_id").agg(F.min_by("z", F.struct("area_mm2", "z")).alias("_z"))
    place = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("slab"))
    holds = least.join(bounds, "case_id").where(F.col("_z").between(F.col("low"), F.col("high"))).groupBy("case_id").agg(F.min_by("slab", place).alias("_s"))
    return g.join(holds, "case_id", "left").withColumn("narrowest", F.coalesce(F.col("_s") == F.col("slab"), F.lit(False))).drop("_s")


# ---------------------------------------------------------------- lesions, layers, texture
def wall_arcs(lesions: DataFrame, tube: DataFrame, sectors: int = 36) -> DataFrame:
    """By case: mean and greatest arc in degrees of occupied sectors about the tube's centroid by slice, and the shares of lesion voxels before and behind it; 0 for cases without lesions."""
    centre = tube.groupBy("case_id", "z").agg(F.avg("y").alias("cy"), F.avg("x").alias("cx"))
    turn = F.pmod(F.atan2(F.col("y") - F.col("cy"), F.col("x") - F.col("cx")), F.lit(2 * math.pi))
    rows = lesions.select(*AT).join(centre, ["case_id", "z"]).withColumn("sector", F.least(F.floor(turn / (2 * math.pi) * sectors), F.lit(sectors - 1)))
    by_slice = rows.groupBy("case_id", "z").agg((F.count_distinct("sector") * (360.0 / sectors)).alias("arc"), F.count("*").alias("n"), F.count_if(F.col("y") < F.col("cy")).alias("front"))
    g = by_slice.groupBy("case_id").agg(F.avg("arc").alias("arc_mean"), F.max("arc").alias("arc_max"), (F.sum("front") / F.sum("n")).alias("anterior"))
    out = tube.select("case_id").distinct().join(g, "case_id", "left")
    return out.withColumn("posterior", 1 - F.col("anterior")).fillna(0.0, ["arc_mean", "arc_max", "anterior", "posterior"]).withColumn("difference", F.col("anterior") - F.col("posterior"))


def lesions_by_threshold(voxels: DataFrame, roi: DataFrame, thresholds: Sequence[float], spacing: Sequence[float]) -> DataFrame:
    """(case_id, threshold, n, volume_mm3, max_hu, mean_hu, score): voxels of the region at or above each threshold, and the sum over their components of area-weighted density, as ``masks.lesion_scores``; 0 where there are none."""
    held = voxels.join(roi.select(*AT), AT, "left_semi")
    out = V.threshold_summary(held, thresholds, spacing)
    scores = None
    for t in thresholds:
        s = K.lesion_scores(held, held.where(F.col("hu") >= t).select(*AT), spacing).select("case_id", F.lit(float(t)).alias("threshold"), "score")
        scores = s if scores is None else scores.union(s)
    return out.join(scores, ["case_id", "threshold"], "left").fillna(0.0, ["score"])


def layered_fat(voxels: DataFrame, mask: DataFrame, layers: Sequence[tuple[float, float]], low: float, high: float, sectors: int, spacing: Sequence[float]) -> DataFrame:
    """(case_id, part, n, volume_ml, mean_hu, sd_hu, skewness): fat about a mask in the whole shell, in each layer low < distance <= high and in each sector about the mask's centroid."""
    far = V.shells(V.distance_within(mask, max(b for _, b in layers), spacing), layers)
    centre = mask.groupBy("case_id").agg(F.avg("y").alias("cy"), F.avg("x").alias("cx"))
    fat = voxels.where(F.col("hu").between(low, high)).join(far, AT).join(F.broadcast(centre), "case_id")  # a row a case
    parts = F.array(F.lit("all"), F.concat(F.lit("layer_"), F.col("shell").cast("string")), F.concat(F.lit("sector_"), V.angle_sector(F.col("y") - F.col("cy"), F.col("x") - F.col("cx"), sectors).cast("string")))
    g = fat.withColumn("part", F.explode(parts)).groupBy("case_id", "part")
    return g.agg(F.count("*").alias("n"), (F.count("*") * V.volume_mm3(spacing) / 1000).alias("volume_ml"), F.avg("hu").alias("mean_hu"), F.stddev_pop("hu").alias("sd_hu"), F.when(F.stddev_pop("hu") > 0, F.skewness("hu")).otherwise(0.0).alias("skewness"))


def run_features(levels: DataFrame) -> DataFrame:
    """(case_id, short_run_emphasis, long_run_emphasis, runs): mean of 1 / length² and of length² over runs of equal level along each of the three axes."""
    runs = None
    for axis in "zyx":
        one = V.run_lengths(levels, axis)
        runs = one if runs is None else runs.union(one)
    n, size = F.sum("n"), F.col("length")
    return runs.groupBy("case_id").agg((F.sum(F.col("n") / (size * size)) / n).alias("short_run_emphasis"), (F.sum(F.col("n") * size * size) / n).alias("long_run_emphasis"), n.alias("runs"))


def above_thickness(thickness: DataFrame, limit_mm: float, spacing: Sequence[float], strict: bool = True) -> DataFrame:
    """By case: wall voxels thicker than a limit (or as thick, if not ``strict``), their volume and their share of the wall."""
    hit = F.col("thickness") > limit_mm if strict else F.col("thickness") >= limit_mm
    return thickness.groupBy("case_id").agg(F.count_if(hit).alias("n"), (F.count_if(hit) * V.volume_mm3(spacing)).alias("volume_mm3"), (F.count_if(hit) / F.count("*")).alias("fraction"))


# ---------------------------------------------------------------- cleaning and quality
def cleaned(mask: DataFrame, shape: Sequence[int], *, largest: bool = True, fill: bool = True, least: int = 0, connectivity: int = 6) -> DataFrame:
    """A mask's largest component, or its components of ``least`` voxels or more, with holes filled: what no path outside the mask joins to the volume's border."""
    labelled = K.components(mask, connectivity)
    kept = (V.largest_component(labelled) if largest else K.large_enough(labelled, least)).select(*AT)
    if not fill:
        return kept
    box = V.bounding_box(kept).drop("n")
    # outside voxels of the box and one voxel about it: all else is joined to the border
    rows = box
    for c, n in zip("zyx", shape, strict=True):
        rows = rows.withColumn(c, F.explode(F.sequence(F.greatest(F.col(f"{c}_min") - 1, F.lit(0)), F.least(F.col(f"{c}_max") + 1, F.lit(n - 1)))))
    air = K.components(rows.select(*AT).join(kept, AT, "left_anti"), 6)
    edge = F.lit(False)
    for c, n in zip("zyx", shape, strict=True):
        edge = edge | (F.col(c) == F.greatest(F.col(f"{c}_min") - 1, F.lit(0))) | (F.col(c) == F.least(F.col(f"{c}_max") + 1, F.lit(n - 1)))
    outer = air.join(box, "case_id").where(edge).select(*AT)
    return kept.union(K.touching(air, outer, keep=False).select(*AT))


def mask_quality(voxels: DataFrame, mask: DataFrame, cases: DataFrame, spacing: Sequence[float], small_mm3: float = 1000.0, large_mm3: float = 500_000.0, connectivity: int = 6) -> DataFrame:
    """By case: voxels, volume, components, box, mean hu and warnings: empty_mask, volume below or above the limits, several components."""
    parts = K.components(mask, connectivity).groupBy("case_id").agg(F.max("component").alias("components"))
    inside = voxels.join(mask.select(*AT), AT, "left_semi").groupBy("case_id").agg(F.avg("hu").alias("mean_hu"))
    out = cases.select("case_id").distinct().join(V.bounding_box(mask).withColumnRenamed("n", "voxels"), "case_id", "left").join(parts, "case_id", "left").join(inside, "case_id", "left").fillna(0, ["voxels", "components"])
    volume = F.col("voxels") * V.volume_mm3(spacing)
    warn = [F.when(F.col("voxels") == 0, "empty_mask"), F.when((volume > 0) & (volume < small_mm3), "mask_volume_below_configured_threshold"), F.when(volume > large_mm3, "mask_volume_above_configured_threshold"), F.when(F.col("components") > 1, "multiple_components_after_cleaning")]
    return out.withColumn("volume_mm3", volume).withColumn("warnings", F.concat_ws(";", *warn))


def expanded(box: DataFrame, margin_mm: float, spacing: Sequence[float], shape: Sequence[int] | None = None) -> DataFrame:
    """Boxes wider by a margin, in whole voxels rounded up, within the volume if its shape z, y, x is given."""
    by = dict(zip("xyz", (math.ceil(margin_mm / s) for s in spacing), strict=True))
    out = {}
    for c, n in zip("zyx", shape or (None, None, None), strict=True):
        low, high = F.col(f"{c}_min") - by[c], F.col(f"{c}_max") + by[c]
        out[f"{c}_min"], out[f"{c}_max"] = (F.greatest(low, F.lit(0)), F.least(high, F.lit(n - 1))) if n is not None else (low, high)
    return box.withColumns(out)


def fused(sources: Sequence[tuple[str, DataFrame]], structures: Mapping[str, Sequence[DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """(positive, negative): voxels of any source with the names of the sources that have them, in order; and voxels of other structures, each by the first of its masks that
    has the case, that are not positive, with the structure's name (the first by name of several).
    """
    rows = None
    for i, (name, m) in enumerate(sources):
        one = m.select(*AT, F.struct(F.lit(i).alias("i"), F.lit(name).alias("name")).alias("s"))
        rows = one if rows is None else rows.union(one)
    positive = rows.groupBy(*AT).agg(F.array_join(F.transform(F.array_sort(F.collect_set("s")), lambda s: s["name"]), ",").alias("sources"))
    other = None
    for name, ranked in structures.items():
        taken = None
        for m in ranked:
            one = m.select(*AT) if taken is None else m.select(*AT).join(taken.select("case_id").distinct(), "case_id", "left_anti")
            taken = one if taken is None else taken.union(one)
        named = taken.withColumn("structure", F.lit(name))
        other = named if other is None else other.union(named)
    negative = other.groupBy(*AT).agg(F.min("structure").alias("structure")).join(positive, AT, "left_anti")
    return positive, negative
