"""Long and wide tables, fixed schemas and unions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def wide_to_long(df: DataFrame, ids: Sequence[str], values: Sequence[str] | None = None, name: str = "feature", value: str = "value") -> DataFrame:
    """Unpivot; values become doubles."""
    values = values or [c for c in df.columns if c not in ids]
    return df.select(*ids, *[F.col(v).cast("double").alias(v) for v in values]).unpivot(list(ids), list(values), name, value)


def long_to_wide(df: DataFrame, ids: Sequence[str], name: str, value: str, order: str, names: Sequence[str]) -> DataFrame:
    """Pivot to the given ``names``; of several values the first that isn't null by ``order``. One aggregate, no pivot scan."""
    first = lambda n: F.min_by(value, F.when((F.col(name) == n) & F.col(value).isNotNull(), F.col(order)))
    there = lambda n: F.max(F.when((F.col(name) == n) & F.col(value).isNotNull(), 1))
    return df.groupBy(*ids).agg(*[F.when(there(n) == 1, first(n)).alias(n) for n in names])


def composite_key(region: Column, name: Column, threshold: Column) -> Column:
    """``region__name``, with ``__thr_x`` only where there is a threshold."""
    t = F.nullif(F.trim(threshold), F.lit(""))
    return F.concat(region, F.lit("__"), name, F.coalesce(F.concat(F.lit("__thr_"), t), F.lit("")))


def conform(df: DataFrame, columns: Sequence[str], default: object = None) -> DataFrame:
    """Exactly ``columns`` in that order; those that are absent get ``default``."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(default).alias(c) for c in columns])


def reorder(df: DataFrame, known: Sequence[str]) -> DataFrame:
    """Known columns first in their order, the others behind by name."""
    return df.select(*[c for c in known if c in df.columns], *sorted(c for c in df.columns if c not in known))


def union_all(*frames: DataFrame) -> DataFrame:
    """Union by name; columns that a frame lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def combine_segments(df: DataFrame, key: str, segment: str, segments: Sequence[str], values: Sequence[str], order: str, complete: bool) -> DataFrame:
    """A row for each key with ``segment__value`` columns, of each segment's first row by ``order``; ``complete`` keeps keys that have all segments."""
    rank = F.struct(F.col(order))
    cols = [F.min_by(v, F.when(F.col(segment) == s, rank)).alias(f"{s}__{v}") for s in segments for v in values]
    out = df.where(F.col(segment).isin(*segments)).groupBy(key).agg(*cols, F.count_distinct(segment).alias("__n"))
    return (out.where(F.col("__n") == len(segments)) if complete else out).drop("__n")


def crosstab_share(df: DataFrame, row: str, column: str, values: Sequence[str], digits: int = 4) -> DataFrame:
    """Shares of ``values`` of ``column`` among the rows of each ``row`` value."""
    return df.groupBy(row).agg(*[F.round(F.count_if(F.col(column) == v) / F.count_if(F.col(column).isNotNull()), digits).alias(f"share_{v}") for v in values])
