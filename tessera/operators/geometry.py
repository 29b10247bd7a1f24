"""Lines and branches through ordered slices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .voxel import boundary


def gradient(x: Column, w: Window) -> Column:
    """Central differences, one-sided at the ends."""
    before, after = F.lag(x).over(w), F.lead(x).over(w)
    return F.when(before.isNull(), after - x).when(after.isNull(), x - before).otherwise((after - before) / 2)


def curvature(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """|r' x r''| / |r'|^3 of the curve z, y, x; 0 where it stands still."""
    w = Window.partitionBy(*keys).orderBy(order)
    first = df.select("*", *[gradient(F.col(c), w).alias(f"_{c}1") for c in "zyx"])
    second = first.select("*", *[gradient(F.col(f"_{c}1"), w).alias(f"_{c}2") for c in "zyx"])
    v = {c: (F.col(f"_{c}1"), F.col(f"_{c}2")) for c in "zyx"}
    cross = [v[a][0] * v[b][1] - v[b][0] * v[a][1] for a, b in (("y", "x"), ("x", "z"), ("z", "y"))]
    speed = F.sqrt(sum((v[c][0] ** 2 for c in "zyx"), F.lit(0.0)))
    k = F.when(speed > 0, F.sqrt(sum((c * c for c in cross), F.lit(0.0))) / speed**3).otherwise(0.0)
    return second.withColumn("curvature", k).drop(*[f"_{c}{i}" for c in "zyx" for i in (1, 2)])


def circular_median(df: DataFrame, keys: Sequence[str], angle: str, x: str, n: int, reach: int) -> DataFrame:
    """Median of x over angles within ``reach`` steps around the circle of ``n``; missing values are skipped.

    A value is dealt to the angles that it reaches, so the window is a group.
    """
    to = F.explode(F.transform(F.sequence(F.lit(-reach), F.lit(reach)), lambda d: F.pmod(F.col(angle) + d, F.lit(n))))
    return df.select(*keys, to.alias(angle), x).groupBy(*keys, angle).agg(F.median(x).alias("expected"))


def link_branches(components: DataFrame, most_mm: float) -> DataFrame:
    """(case_id, z, component, cy, cx) -> with ``branch``: slice by slice each component joins the nearest open branch within ``most_mm``, nearest pairs first.

    A scan with state: one task a case over its slices' components.
    """
    import pandas as pd

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["z", "component"], kind="stable").reset_index(drop=True)
        branch, open_, fresh = [0] * len(pdf), {}, 1
        for _, rows in pdf.groupby("z", sort=True):
            gaps = sorted((((r.cy - y) ** 2 + (r.cx - x) ** 2) ** 0.5, b, i) for i, r in zip(rows.index, rows.itertuples(), strict=True) for b, (y, x) in open_.items())
            taken: dict[int, int] = {}
            for d, b, i in gaps:
                if d <= most_mm and i not in taken and b not in taken.values():
                    taken[i] = b
            open_now = {}
            for i, r in zip(rows.index, rows.itertuples(), strict=True):
                if i not in taken:
                    taken[i], fresh = fresh, fresh + 1
                branch[i] = taken[i]
                open_now[taken[i]] = (r.cy, r.cx)
            open_ = open_now
        return pdf.assign(branch=pd.Series(branch, dtype="int32"))

    return components.groupBy("case_id").applyInPandas(scan, "case_id int, z int, component int, cy double, cx double, branch int")


def surface_distances(a: DataFrame, b: DataFrame, spacing: Sequence[float], tolerance: float) -> DataFrame:
    """(case_id, hd95, surface_dice) of two masks (case_id, z, y, x), between their surfaces: voxels that lack one of their six neighbours.

    Where exactly one mask of a case is empty the distance is infinite and the overlap 0; a case without either has no row. Every surface voxel is
    held against those of the other mask of its case: for the small structures that readers compare.
    """
    s = dict(zip("xyz", spacing, strict=True))
    p = boundary(a).withColumn("side", F.lit(0)).union(boundary(b).withColumn("side", F.lit(1)))
    q = p.select("case_id", (1 - F.col("side")).alias("side"), *[F.col(c).alias(f"_{c}") for c in "zyx"])
    d = F.sqrt(sum((((F.col(c) - F.col(f"_{c}")) * float(s[c])) ** 2 for c in "zyx"), F.lit(0.0)))
    near = p.join(q, ["case_id", "side"], "left").groupBy("case_id", "side", "z", "y", "x").agg(F.coalesce(F.min(d), F.lit(float("inf"))).alias("d"))
    by_side = near.groupBy("case_id", "side").agg(F.percentile("d", 0.95).alias("p95"), F.count_if(F.col("d") <= tolerance).alias("close"), F.count("*").alias("n"), F.max("d").alias("most"))
    by_side = by_side.withColumn("p95", F.when(F.col("most") == float("inf"), F.col("most")).otherwise(F.col("p95")))
    return by_side.groupBy("case_id").agg(F.max("p95").alias("hd95"), (F.sum("close") / F.sum("n")).alias("surface_dice"))
