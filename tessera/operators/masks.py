"""Masks derived from masks and volumes: shells, morphology, body and artifacts, seeds, zones, regions, polar grids.

Like ``voxel``: sparse masks (case_id, z, y, x), joins on coordinates and listed offsets; a voxel is never held against all others. Steps of
morphology are 6-neighbourhoods, so n steps reach the offsets of a city-block distance of at most n.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clean as C
from . import voxel as V
from .graph import components as linked
from .voxel import AT


def _moved(mask: DataFrame, steps: Sequence[tuple], extra: bool = False) -> DataFrame:
    """Every voxel at every offset (dz, dy, dx[, distance])."""
    near = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("dz", "dy", "dx", "d"), s)]) for s in steps]))
    moved = mask.select(*AT, near.alias("o")).select("case_id", *[(F.col(c) + F.col(f"o.d{c}")).alias(c) for c in "zyx"], *([F.col("o.d").alias("d")] if extra else []))
    return moved


SIX = ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))


def diamond(steps: int, plane: bool = False) -> list[tuple[int, int, int]]:
    """Offsets that ``steps`` moves reach, in a plane of constant z if ``plane``."""
    span = range(-steps, steps + 1)
    return [(a, b, c) for a in ((0,) if plane else span) for b in span for c in span if abs(a) + abs(b) + abs(c) <= steps]


def dilated(mask: DataFrame, steps: int, plane: bool = False) -> DataFrame:
    return _moved(mask, diamond(steps, plane)).distinct()


def eroded(mask: DataFrame, steps: int) -> DataFrame:
    """Voxels all of whose reach is mask; outside the volume counts as no mask."""
    size = len(diamond(steps))
    return _moved(mask.select(*AT).distinct(), diamond(steps)).groupBy(*AT).agg(F.count("*").alias("n")).where(F.col("n") == size).select(*AT).join(mask.select(*AT), AT, "left_semi")


def opened(mask: DataFrame, steps: int) -> DataFrame:
    return dilated(eroded(mask, steps), steps)


def closed(mask: DataFrame, steps: int) -> DataFrame:
    return eroded(dilated(mask, steps), steps)


def rim(mask: DataFrame) -> DataFrame:
    """Voxels outside the mask beside it: the nearest voxel outside is always one of them."""
    return _moved(mask, SIX).distinct().join(mask.select(*AT), AT, "left_anti")


def inner_shell(mask: DataFrame, depth_mm: float, spacing: Sequence[float]) -> DataFrame:
    """(case_id, z, y, x, distance) of mask voxels at most ``depth_mm`` from the nearest voxel outside."""
    near = _moved(rim(mask), V.offsets(depth_mm, spacing), extra=True).groupBy(*AT).agg(F.min("d").alias("distance"))
    return near.join(mask.select(*AT), AT, "left_semi")


def bands(mask: DataFrame, inner_mm: float, outer_mm: float, spacing: Sequence[float]) -> DataFrame:
    """(case_id, z, y, x, band): "internal" and "external" shells, and "wall", both together."""
    inner = inner_shell(mask, inner_mm, spacing).select(*AT, F.lit("internal").alias("band"))
    both = inner.union(V.distance_within(mask, outer_mm, spacing).select(*AT, F.lit("external")))
    return both.union(both.select(*AT, F.lit("wall")))


def local_shell(seed: DataFrame, exclude: DataFrame, outer_mm: float, spacing: Sequence[float]) -> DataFrame:
    """Voxels near the seed, but neither in it nor in ``exclude``."""
    return V.distance_within(seed, outer_mm, spacing).select(*AT).join(exclude.select(*AT), AT, "left_anti")


# ---------------------------------------------------------------- components
def _packed(*c: Column) -> Column:
    """Case and coordinates in one long: 16 bits each."""
    out = c[0].cast("long")
    for x in c[1:]:
        out = F.shiftleft(out, 16) + x
    return out


def components(mask: DataFrame, connectivity: int = 26) -> DataFrame:
    """(case_id, z, y, x, component): connected components of each case, numbered from 1 by their first voxel in the order z, y, x.

    Runs along x are the nodes, runs that touch in a neighbouring row the links; components come from ``graph``. So a case of any size is
    spread over tasks. Coordinates and cases are below 32,768.
    """
    rows = ["case_id", "z", "y"]
    island = F.col("x") - F.row_number().over(Window.partitionBy(*rows).orderBy("x"))
    runs = mask.select(*AT).distinct().withColumn("island", island).groupBy(*rows, "island").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    runs = runs.withColumn("run", _packed(F.col("case_id"), F.col("z"), F.col("y"), F.col("low"))).drop("island")
    reach, steps = (1, ((0, 1), (1, -1), (1, 0), (1, 1))) if connectivity == 26 else (0, ((0, 1), (1, 0)))
    step = F.explode(F.array(*[F.struct(F.lit(a).alias("dz"), F.lit(b).alias("dy")) for a, b in steps]))
    ahead = runs.select("case_id", "z", "y", "low", "high", "run", step.alias("s")).select("case_id", (F.col("z") + F.col("s.dz")).alias("z"), (F.col("y") + F.col("s.dy")).alias("y"), F.col("low").alias("a_low"), F.col("high").alias("a_high"), F.col("run").alias("a"))
    links = ahead.join(runs, rows).where((F.col("low") <= F.col("a_high") + reach) & (F.col("a_low") <= F.col("high") + reach)).select("a", F.col("run").alias("b"))
    roots = linked(links)
    named = runs.join(roots.withColumnRenamed("node", "run"), "run", "left").withColumn("root", F.coalesce("root", "run"))
    number = F.row_number().over(Window.partitionBy("case_id").orderBy("root")).cast("int")
    numbers = named.select("case_id", "root").distinct().withColumn("component", number)  # a row a component
    out = named.join(numbers, ["case_id", "root"])
    return out.select("case_id", "z", "y", F.explode(F.sequence("low", "high")).alias("x"), "component")


def touching(labelled: DataFrame, seeds: DataFrame, keep: bool = True) -> DataFrame:
    """Components that hold a seed voxel, or, without ``keep``, those that hold none."""
    hit = labelled.join(seeds.select(*AT), AT, "left_semi").select("case_id", "component").distinct()
    return labelled.join(hit, ["case_id", "component"], "left_semi" if keep else "left_anti").select(*labelled.columns)


def by_seeds(mask: DataFrame, wanted: DataFrame, unwanted: DataFrame, drop: bool) -> DataFrame:
    """Components with a wanted seed; with ``drop`` those that also hold an unwanted one are left out."""
    out = touching(components(mask), wanted)
    return touching(out, unwanted, keep=False) if drop else out


def large_enough(labelled: DataFrame, least: int) -> DataFrame:
    big = labelled.groupBy("case_id", "component").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("case_id", "component")
    return labelled.join(big, ["case_id", "component"], "left_semi").select(*labelled.columns)


def at_border(mask: DataFrame, shape: Sequence[int]) -> DataFrame:
    """Mask voxels on the faces of a volume of ``shape`` z, y, x."""
    edge = F.lit(False)
    for c, n in zip("zyx", shape, strict=True):
        edge = edge | (F.col(c) == 0) | (F.col(c) == n - 1)
    return mask.where(edge)


def body(voxels: DataFrame, shape: Sequence[int], air_hu: float = -300.0) -> DataFrame:
    """The largest component above air, after holes are filled: what no path through air joins to the volume's border."""
    solid = voxels.where(F.col("hu") > air_hu).select(*AT)
    air = components(voxels.where(~(F.col("hu") > air_hu)), 6)
    holes = touching(air, at_border(air, shape), keep=False).select(*AT)
    return V.largest_component(components(solid.union(holes), 6)).select(*AT)


def vessels(voxels: DataFrame, shape: Sequence[int], low: float, high: float, bone_hu: float, least: int, steps: int) -> DataFrame:
    """The band low..high less bone components at the volume's border, small components left out, then opened by ``steps``."""
    bone = components(voxels.where(F.col("hu") >= bone_hu))
    outer = touching(bone, at_border(bone, shape)).select(*AT)
    band = voxels.where(F.col("hu").between(low, high)).select(*AT).join(outer, AT, "left_anti")
    return opened(large_enough(components(band), least).select(*AT), steps)


# ---------------------------------------------------------------- artifacts
def artifacts(voxels: DataFrame, inside: DataFrame, spacing: Sequence[float], metal_hu: float, bloom_mm: float, streak_mm: float, bright_hu: float, dark_hu: float) -> DataFrame:
    """(case_id, z, y, x, kind): metal; bloom, near it; streak, bright or dark voxels near it in slices that hold metal. All inside ``inside``; spacing in x, y, z."""
    held = voxels.join(inside.select(*AT), AT, "left_semi")
    metal = held.where(F.col("hu") >= metal_hu).select(*AT)
    bloom_steps, plane_steps = max(1, round(bloom_mm / min(spacing))), max(1, round(streak_mm / min(spacing[:2])))
    near = dilated(metal, bloom_steps).withColumn("rank", F.lit(1)).union(dilated(metal, plane_steps, plane=True).withColumn("rank", F.lit(2))).union(metal.withColumn("rank", F.lit(0)))
    first = near.groupBy(*AT).agg(F.min("rank").alias("rank"))
    odd = (F.col("hu") >= bright_hu) | (F.col("hu") <= dark_hu)
    kind = F.when(F.col("rank") == 0, "metal").when(F.col("rank") == 1, "bloom").when(odd, "streak")
    return held.join(first, AT).withColumn("kind", kind).where("kind is not null").select(*AT, "kind")


def artifact_burden(kinds: DataFrame, roi: DataFrame, spacing: Sequence[float]) -> DataFrame:
    """Volumes in ml by kind, slices and components of metal, and the shares of the region that are artifact or core (metal and bloom)."""
    ml = V.volume_mm3(spacing) / 1000
    n = lambda *k: F.count_if(F.col("kind").isin(*k))
    total = kinds.groupBy("case_id").agg((n("metal") * ml).alias("metal_ml"), (n("bloom") * ml).alias("bloom_ml"), (n("streak") * ml).alias("streak_ml"), (n("metal", "bloom") * ml).alias("core_ml"), (F.count("*") * ml).alias("artifact_ml"), F.count_distinct(F.when(F.col("kind") == "metal", F.col("z"))).alias("metal_slices"))
    lumps = components(kinds.where("kind = 'metal'"), 6).groupBy("case_id").agg(F.max("component").cast("long").alias("metal_components"))
    hit = roi.select(*AT).join(kinds, AT, "left").groupBy("case_id").agg(F.count("*").alias("roi_voxels"), (F.count("kind") / F.count("*")).alias("roi_artifact_fraction"), (n("metal", "bloom") / F.count("*")).alias("roi_core_fraction"))
    out = hit.join(total, "case_id", "full").join(lumps, "case_id", "left")
    return out.fillna(0, [c for c in out.columns if c != "case_id"])


# ---------------------------------------------------------------- lesions, zones, labels
def lesion_scores(voxels: DataFrame, lesions: DataFrame, spacing: Sequence[float]) -> DataFrame:
    """Burden by case: volume, mass (sum of hu x mm3), lesions, the modified score (sum over lesions of volume x density factor of the greatest hu) and its logarithm."""
    mm3 = V.volume_mm3(spacing)
    each = components(lesions).join(voxels, AT).groupBy("case_id", "component").agg(F.count("*").alias("n"), F.max("hu").alias("peak"), F.sum("hu").alias("sum"))
    score = F.sum(F.col("n") * mm3 * C.density_factor(F.col("peak")))
    return each.groupBy("case_id").agg((F.sum("n") * mm3).alias("volume_mm3"), (F.sum("sum") * mm3).alias("mass"), F.count("*").alias("lesions"), score.alias("score"), F.log1p(score).alias("log_score"), F.max(F.col("n") * mm3).alias("largest_mm3"))


def wall_lesions(voxels: DataFrame, tube: DataFrame, spacing: Sequence[float], *, core_mm: float, inner_mm: float, outer_mm: float, margin_hu: float = 75.0, least_hu: float = 300.0, seed_hu: float = 500.0, beside: int = 1, contrast_hu: float = 75.0) -> DataFrame:
    """Voxels of a tube's wall brighter than its slice's content, in components that hold a seed.

    Reference of a slice: median hu of the tube's core (deeper than ``core_mm``; of the tube where a slice has no core), averaged over
    ``beside`` slices to each side. Candidate: within the wall's search bands, at least reference + margin and ``least_hu``; seed: also
    ``seed_hu``. Candidates joined to contrast outside the tube (hu within ``contrast_hu`` of the reference) go.
    """
    held = voxels.join(tube.select(*AT), AT, "left_semi").join(inner_shell(tube, core_mm, spacing).withColumnRenamed("distance", "depth"), AT, "left")
    slices = held.groupBy("case_id", "z").agg(F.median(F.when(F.col("depth").isNull(), F.col("hu"))).alias("core"), F.median("hu").alias("all")).withColumn("r", F.coalesce("core", "all"))
    near = Window.partitionBy("case_id").orderBy("z").rangeBetween(-beside, beside)  # a row a slice
    slices = slices.select("case_id", "z", F.avg("r").over(near).alias("reference"))
    wall = inner_shell(tube, inner_mm, spacing).select(*AT, F.lit(True).alias("inside")).union(V.distance_within(tube, outer_mm, spacing).select(*AT, F.lit(False)))
    bright = voxels.join(wall, AT).join(slices, ["case_id", "z"]).withColumn("limit", F.greatest(F.col("reference") + margin_hu, F.lit(least_hu))).where("hu >= limit")
    labelled = components(bright).join(bright.select(*AT, "hu", "limit", "inside", "reference"), AT)
    like = F.abs(F.col("hu") - F.col("reference")) <= contrast_hu
    by = labelled.groupBy("case_id", "component").agg(F.max(F.col("hu") >= F.greatest("limit", F.lit(seed_hu))).alias("seeded"), F.max(~F.col("inside") & like).alias("contrast"))
    kept = by.where("seeded and not contrast").select("case_id", "component")
    return labelled.join(kept, ["case_id", "component"], "left_semi").select(*AT, "hu", "component")


def zones(levels: DataFrame) -> DataFrame:
    """(case_id, small_zone_emphasis, large_zone_emphasis, zones) of 26-connected zones of equal level.

    Levels are numbered into the case, so all levels' zones are one run of ``components``.
    """
    top = 64
    parts = levels.select((F.col("case_id") * top + F.col("level")).cast("int").alias("case_id"), "z", "y", "x")
    size = components(parts).groupBy("case_id", "component").agg(F.count("*").alias("n"))
    return size.groupBy(F.floor(F.col("case_id") / top).cast("int").alias("case_id")).agg(F.avg(1 / (F.col("n") * F.col("n"))).alias("small_zone_emphasis"), F.avg(F.col("n") * F.col("n")).alias("large_zone_emphasis"), F.count("*").alias("zones"))


def nearest_labels(mask: DataFrame, labels: DataFrame, radius_mm: float, spacing: Sequence[float]) -> DataFrame:
    """(case_id, z, y, x, label) of each mask voxel's nearest labelled voxel within the radius, ties to the smaller label; NULL where there is none."""
    near = V.offsets(radius_mm, spacing)
    step = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("dz", "dy", "dx", "d"), s, strict=True)]) for s in near]))
    reach = labels.select(*AT, "label", step.alias("o")).select("case_id", *[(F.col(c) + F.col(f"o.d{c}")).alias(c) for c in "zyx"], F.col("o.d").alias("d"), "label")
    return mask.select(*AT).join(reach.groupBy(*AT).agg(F.min(F.struct("d", "label")).alias("m")), AT, "left").select(*AT, F.col("m.label").alias("label"))


def wall_thickness(lumen: DataFrame, wall: DataFrame, most_mm: float, spacing: Sequence[float]) -> DataFrame:
    """(case_id, z, y, x, thickness) of wall voxels off the lumen: distance to the inner plus that to the outer surface plus the least spacing.

    The inner surface are wall voxels beside the lumen, the outer those beside neither; a wall thicker than ``most_mm`` has none.
    """
    wall = wall.select(*AT).join(lumen.select(*AT), AT, "left_anti")
    inner = dilated(lumen, 1).join(wall, AT, "left_semi")
    outside = rim(wall.union(lumen.select(*AT)))
    outer = dilated(outside, 1).join(wall, AT, "left_semi")
    steps = V.offsets(most_mm, spacing)
    far = lambda surface, name: _moved(surface, steps, extra=True).groupBy(*AT).agg(F.min("d").alias(name))
    return wall.join(far(inner, "a"), AT).join(far(outer, "b"), AT).select(*AT, (F.col("a") + F.col("b") + min(spacing)).alias("thickness"))


def closed_wall(lumen: DataFrame, fat: DataFrame, steps: int) -> DataFrame:
    """The wall between a lumen and the fat about it: what closing their union adds."""
    both = lumen.select(*AT).union(fat.select(*AT)).distinct()
    return closed(both, steps).join(both, AT, "left_anti")


# ---------------------------------------------------------------- regions
def physical(voxels: DataFrame, origin: Sequence[float], spacing: Sequence[float], direction: Sequence[float] = (1, 0, 0, 0, 1, 0, 0, 0, 1)) -> DataFrame:
    """Positions in mm: origin + direction (by rows) x spacing x index, in x, y, z."""
    step = [F.col(c) * float(s) for c, s in zip("xyz", spacing, strict=True)]
    at = [F.lit(float(origin[i])) + sum((step[j] * float(direction[3 * i + j]) for j in range(3)), F.lit(0.0)) for i in range(3)]
    return voxels.withColumns({f"{c}_mm": v for c, v in zip("xyz", at, strict=True)})


def to_index(points: DataFrame, origin: Sequence[float], spacing: Sequence[float], direction: Sequence[float] = (1, 0, 0, 0, 1, 0, 0, 0, 1)) -> DataFrame:
    """The nearest voxels of positions in mm; the direction's inverse is its transpose."""
    off = [F.col(f"{c}_mm") - float(o) for c, o in zip("xyz", origin, strict=True)]
    at = {c: F.round(sum((off[i] * float(direction[3 * i + j]) for i in range(3)), F.lit(0.0)) / float(spacing[j])).cast("int") for j, c in enumerate("xyz")}
    return points.withColumns(at)


def region_features(voxels: DataFrame, mask: DataFrame, spacing: Sequence[float], low_hu: float) -> DataFrame:
    """Volume, hu moments (population deviation), tenths and the share below ``low_hu`` of a region, whole and in its last third by y: columns of "all" and "posterior"."""
    held = voxels.join(mask.select(*AT), AT, "left_semi")
    extent = mask.groupBy("case_id").agg(F.min("y").alias("a"), F.max("y").alias("b"))
    part = F.explode(F.when(F.col("y") > F.col("b") - (F.col("b") - F.col("a") + 1) / 3, F.array(F.lit("all"), F.lit("posterior"))).otherwise(F.array(F.lit("all"))))
    g = held.join(extent, "case_id").withColumn("part", part).groupBy("case_id", "part")
    return g.agg((F.count("*") * V.volume_mm3(spacing) / 1000).alias("volume_ml"), F.avg("hu").alias("mean_hu"), F.stddev_pop("hu").alias("sd_hu"), F.percentile("hu", 0.1).alias("p10"), F.percentile("hu", 0.9).alias("p90"), F.avg((F.col("hu") < low_hu).cast("int")).alias("low_fraction"))


def sided_shell_fat(voxels: DataFrame, mask: DataFrame, middle: int, steps: int, low: float, high: float, spacing: Sequence[float]) -> DataFrame:
    """Fat about the parts of a mask left and right of column ``middle``: voxels, ml and mean hu of each, and (right - left) / (right + left) of the volumes; NULL where a side has none."""
    side = F.when(F.col("x") < middle, "left").otherwise("right")
    parts = []
    for name in ("left", "right"):
        own = mask.select(*AT).where(side == name)
        parts.append(dilated(own, steps).join(own, AT, "left_anti").withColumn("side", F.lit(name)))
    fat = voxels.where(F.col("hu").between(low, high)).join(parts[0].union(parts[1]), AT)
    ml = V.volume_mm3(spacing) / 1000
    on = lambda s, c: F.when(F.col("side") == s, c)
    out = fat.groupBy("case_id").agg(*[a for s in ("left", "right") for a in (F.count(on(s, F.lit(1))).alias(f"{s}_n"), F.avg(on(s, F.col("hu"))).alias(f"{s}_hu"))])
    volumes = {f"{s}_ml": F.nullif(F.col(f"{s}_n"), F.lit(0)) * ml for s in ("left", "right")}
    out = mask.select("case_id").distinct().join(out, "case_id", "left").fillna(0, ["left_n", "right_n"]).withColumns(volumes)
    return out.withColumn("asymmetry", (F.col("right_ml") - F.col("left_ml")) / (F.col("right_ml") + F.col("left_ml")))


def lateral_bands(tube: DataFrame, width: int, window: int) -> DataFrame:
    """(case_id, z, y, x, side): beside a tube, in each slice, ``width`` columns left and right of its extent, over its rows widened by ``window``."""
    extent = tube.groupBy("case_id", "z").agg(*[f(c).alias(f"{n}{c}") for c in "yx" for n, f in (("a", F.min), ("b", F.max))])
    rows = extent.withColumn("y", F.explode(F.sequence(F.col("ay") - window, F.col("by") + window)))
    side = lambda name, low, high: rows.select("case_id", "z", "y", F.explode(F.sequence(low, high)).alias("x"), F.lit(name).alias("side"))
    return side("left", F.col("ax") - width, F.col("ax") - 1).union(side("right", F.col("bx") + 1, F.col("bx") + width))


def optional_fat(voxels: DataFrame, masks: DataFrame, low: float, high: float, spacing: Sequence[float]) -> DataFrame:
    """(case_id, region, fat_ml, mean_hu) of (case_id, region, z, y, x): a region without fat has a volume of 0 and no mean; one without a mask has no row."""
    hit = F.col("hu").between(low, high)
    return masks.join(voxels, AT, "left").groupBy("case_id", "region").agg((F.count_if(F.coalesce(hit, F.lit(False))) * V.volume_mm3(spacing) / 1000).alias("fat_ml"), F.avg(F.when(hit, F.col("hu"))).alias("mean_hu"))


def extents(mask: DataFrame, spacing: Sequence[float]) -> DataFrame:
    """Length in mm along each axis, volume in ml, and the greatest thickness along y in any column: extent of rows of one (z, x)."""
    columns = mask.groupBy("case_id", "z", "x").agg((F.max("y") - F.min("y") + 1).alias("t"))
    thick = columns.groupBy("case_id").agg((F.max("t") * float(spacing[1])).alias("thickness_mm"), (F.avg("t") * float(spacing[1])).alias("mean_thickness_mm"))
    size = mask.groupBy("case_id").agg(*[((F.max(c) - F.min(c) + 1) * float(s)).alias(f"{c}_mm") for c, s in zip("xyz", spacing, strict=True)], (F.count("*") * V.volume_mm3(spacing) / 1000).alias("volume_ml"))
    return size.join(thick, "case_id")


def landmark_distances(points: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(case_id, a, b, mm) between named points (case_id, name, x_mm, y_mm, z_mm); NULL where one is missing."""
    at = points.groupBy("case_id").agg(F.map_from_entries(F.collect_list(F.struct("name", F.struct("x_mm", "y_mm", "z_mm")))).alias("p"))  # a few points a case
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs]))
    j = at.select("case_id", "p", rows.alias("r")).select("case_id", "r.*", F.col("p")[F.col("r.a")].alias("u"), F.col("p")[F.col("r.b")].alias("v"))
    return j.select("case_id", "a", "b", F.sqrt(sum(((F.col(f"u.{c}") - F.col(f"v.{c}")) ** 2 for c in ("x_mm", "y_mm", "z_mm")), F.lit(0.0))).alias("mm"))


def point_to_plane(points: DataFrame, plane: Sequence[str], point: str) -> DataFrame:
    """(case_id, mm): distance of a named point from the plane through three others; NULL where one is missing or the three lie on a line."""
    at = points.groupBy("case_id").agg(F.map_from_entries(F.collect_list(F.struct("name", F.struct("x_mm", "y_mm", "z_mm")))).alias("p"))
    get = lambda name: [F.col("p")[name][f"{c}_mm"] for c in "xyz"]
    o, u, v, q = (get(n) for n in (*plane, point))
    a, b, w = ([x - y for x, y in zip(k, o, strict=True)] for k in (u, v, q))
    n = [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    size = F.sqrt(sum((x * x for x in n), F.lit(0.0)))
    return at.select("case_id", F.abs(F.try_divide(sum((x * y for x, y in zip(n, w, strict=True)), F.lit(0.0)), F.nullif(size, F.lit(0.0)))).alias("mm"))


def face_region(voxels: DataFrame, z_low: int, z_high: int, skull_hu: float, share: float) -> DataFrame:
    """Voxels before the skull in the front ``share`` of its rows (small y), between two slices: what has to go to hide a face."""
    front = voxels.where(F.col("z").between(z_low, z_high) & (F.col("hu") >= skull_hu)).groupBy("case_id").agg(F.min("y").alias("a"), F.max("y").alias("b"))
    skull = voxels.where(F.col("z").between(z_low, z_high) & (F.col("hu") >= skull_hu)).groupBy("case_id", "z", "x").agg(F.min("y").alias("first"))
    near = voxels.where(F.col("z").between(z_low, z_high)).join(front, "case_id").where(F.col("y") < F.col("a") + (F.col("b") - F.col("a") + 1) * share)
    return near.join(skull, ["case_id", "z", "x"], "left").where(F.col("first").isNull() | (F.col("y") <= F.col("first"))).select(*AT)


# ---------------------------------------------------------------- polar grids about a line
def boundary_radii(mask: DataFrame, line: DataFrame, angles: int, most: float, step: float) -> DataFrame:
    """(case_id, z, angle, radius): where a ray from the line's point in its slice first leaves the mask; NULL where it never does within ``most``. All in voxels.

    Rays are listed radii joined with the mask, so the first gap is a minimum.
    """
    n = int(most / step)
    at = line.withColumn("angle", F.explode(F.sequence(F.lit(0), F.lit(angles - 1)))).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n))))
    theta = F.col("angle") * (2 * math.pi / angles)
    at = at.withColumns({"y": F.round(F.col("cy") + F.col("i") * step * F.sin(theta)).cast("int"), "x": F.round(F.col("cx") + F.col("i") * step * F.cos(theta)).cast("int")})
    inside = mask.select(*AT).withColumn("inside", F.lit(True))
    first = at.join(inside, AT, "left").groupBy("case_id", "z", "angle").agg(F.min(F.when(F.col("inside").isNull(), F.col("i"))).alias("i"))
    return first.select("case_id", "z", "angle", F.when(F.col("i") > 0, (F.col("i") - 1) * step).when(F.col("i") == 0, 0.0).alias("radius"))


def ring_components(cells: DataFrame, angles: int) -> DataFrame:
    """(case_id, z, angle, component): 8-connected cells, the last angle beside the first; numbered from 1 by the first cell."""
    cell = _packed(F.col("case_id"), F.col("z"), F.col("angle"))
    nodes = cells.select("case_id", "z", "angle").distinct().withColumn("node", cell)
    step = F.explode(F.array(*[F.struct(F.lit(a).alias("dz"), F.lit(b).alias("da")) for a, b in ((0, 1), (1, -1), (1, 0), (1, 1))]))
    ahead = nodes.select("case_id", "z", "angle", "node", step.alias("s")).select("case_id", (F.col("z") + F.col("s.dz")).alias("z"), F.pmod(F.col("angle") + F.col("s.da"), F.lit(angles)).alias("angle"), F.col("node").alias("a"))
    roots = linked(ahead.join(nodes, ["case_id", "z", "angle"]).select("a", F.col("node").alias("b")))
    named = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    numbers = named.select("case_id", "root").distinct().withColumn("component", F.row_number().over(Window.partitionBy("case_id").orderBy("root")).cast("int"))  # a row a component
    return named.join(numbers, ["case_id", "root"]).select("case_id", "z", "angle", "component")


def area_deltas(cells: DataFrame, angles: int, outward: bool = True) -> DataFrame:
    """(case_id, component, z, area): half the sum of radius² less expected², over cells that go the direction's way."""
    r, e = F.col("radius"), F.col("expected")
    more = (r * r - e * e) if outward else (e * e - r * r)
    return cells.groupBy("case_id", "component", "z").agg(F.coalesce(F.sum(F.when(more > 0, more)), F.lit(0.0)).alias("s")).select("case_id", "component", "z", (F.col("s") * (math.pi / angles)).alias("area"))


def protrusions(cells: DataFrame, angles: int, interval: float, width: tuple[float, float], length: tuple[float, float], least_prominence: float = 0.0) -> DataFrame:
    """Candidates among components of (case_id, z, angle, component, radius, expected): width in degrees (the circle less its widest gap), length, greatest and
    median depth, prominence, the cell of the greatest depth (the first of ties) and the greatest area gained in a slice; limits included.
    """
    depth = F.abs(F.col("radius") - F.col("expected"))
    used = cells.select("case_id", "component", "angle").distinct()
    ring = Window.partitionBy("case_id", "component").orderBy("angle")  # as many rows as angles
    gap = used.withColumn("gap", F.lead("angle").over(ring) - F.col("angle")).groupBy("case_id", "component").agg(F.max("gap").alias("gap"), (F.min("angle") + angles - F.max("angle")).alias("wrap"))
    wide = gap.select("case_id", "component", ((angles - F.greatest(F.coalesce("gap", F.lit(0)), "wrap") + 1) * (360.0 / angles)).alias("width_deg"))
    g = cells.withColumn("depth", depth).groupBy("case_id", "component").agg(((F.max("z") - F.min("z") + 1) * float(interval)).alias("length_mm"), F.max("depth").alias("max_depth"), F.median("depth").alias("median_depth"), F.min_by(F.struct("z", "angle"), F.struct(-F.col("depth"), "z", "angle")).alias("peak"))
    area = area_deltas(cells, angles).groupBy("case_id", "component").agg(F.max("area").alias("max_area"))
    out = g.join(wide, ["case_id", "component"]).join(area, ["case_id", "component"]).withColumn("prominence", F.col("max_depth") - F.col("median_depth"))
    kept = out.where(F.col("width_deg").between(*width) & F.col("length_mm").between(*length) & (F.col("prominence") >= least_prominence))
    return kept.select("case_id", "component", "width_deg", "length_mm", "max_depth", "median_depth", "prominence", F.col("peak.z").alias("peak_z"), F.col("peak.angle").alias("peak_angle"), "max_area")
