"""Ranks, neighbours, bins, outliers and the latest row of a key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key by ``order``, as an aggregate: rows combine before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r")).select(*keys, "__r.*")


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each key; partial limits apply before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)


def tails(df: DataFrame, value: str, ids: Sequence[str], n: int) -> DataFrame:
    """The n lowest and n highest rows with ``tail``; a row may be in both."""
    low = df.where(F.col(value).isNotNull()).orderBy(F.col(value).asc(), *ids).limit(n).withColumn("tail", F.lit("lowest"))
    return low.union(df.where(F.col(value).isNotNull()).orderBy(F.col(value).desc(), *ids).limit(n).withColumn("tail", F.lit("highest")))


def neighbour_change(df: DataFrame, keys: Sequence[str], order: str, x: str) -> DataFrame:
    """|x - reference| / reference against the mean of the rows before and behind that are there; 0 where that isn't positive."""
    w = Window.partitionBy(*keys).orderBy(order)
    p, n = F.lag(x).over(w), F.lead(x).over(w)
    ref = F.coalesce((p + n) / 2, p, n)
    return df.withColumn("reference", ref).withColumn("change", F.when(F.col("reference") > 0, F.abs(F.col(x) - F.col("reference")) / F.col("reference")).otherwise(0.0))


def passes(df: DataFrame, keys: Sequence[str], order: str, index: str) -> DataFrame:
    """Numbers the passes of a log: an index below the one before starts a new pass."""
    w = Window.partitionBy(*keys).orderBy(order)
    starts = F.coalesce((F.lag(index).over(w) > F.col(index)).cast("int"), F.lit(0))
    return df.withColumn("__s", starts).withColumn("pass", F.sum("__s").over(w)).drop("__s")


def value_buckets(df: DataFrame, x: str, buckets: int = 64) -> DataFrame:
    """``__b``: ranges of x in ascending order, by approximate quantiles; a function of the value, so it is the same in every use."""
    edges = sorted(set(df.approxQuantile(x, [i / buckets for i in range(1, buckets)], 0.005)))
    b = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e < F.col(x))) if edges else F.lit(0)
    return df.withColumn("__b", b)


def global_rank(df: DataFrame, x: str, ids: Sequence[str], rank: str = "rank", total: str = "total") -> DataFrame:
    """Ranks 1.. of the whole table by x and ids, and its number of rows, without gathering it in one task.

    Rows are numbered within ranges of x; the counts of the ranges before, one row a range, are added.
    """
    parts = value_buckets(df.where(F.col(x).isNotNull()), x)
    counts = parts.groupBy("__b").agg(F.count("*").alias("__n"))
    before = counts.alias("a").join(counts.alias("b"), F.expr("b.__b < a.__b"), "left").groupBy("a.__b").agg(F.coalesce(F.sum("b.__n"), F.lit(0)).alias("__before"))
    held = before.join(F.broadcast(counts.agg(F.sum("__n").alias(total))))  # at most 64 rows
    local = F.row_number().over(Window.partitionBy("__b").orderBy(x, *ids))
    return parts.join(F.broadcast(held), "__b").withColumn(rank, local + F.col("__before")).drop("__before")


def keyed_rank(df: DataFrame, keys: Sequence[str], x: str, ids: Sequence[str], rank: str = "rank") -> DataFrame:
    """Ranks 1.. within each key by x and ids, for keys of any size: rows are numbered within ranges of x, and the counts of the key's ranges before are added."""
    parts = value_buckets(df.where(F.col(x).isNotNull()), x)
    counts = parts.groupBy(*keys, "__b").agg(F.count("*").alias("__n"))  # a row for each key and range
    before = counts.withColumn("__before", F.sum("__n").over(Window.partitionBy(*keys).orderBy("__b")) - F.col("__n")).drop("__n")
    same = [F.col(f"p.{k}").eqNullSafe(F.col(f"c.{k}")) for k in (*keys, "__b")]
    on = same[0]
    for c in same[1:]:
        on = on & c
    local = F.row_number().over(Window.partitionBy(*[f"p.{k}" for k in keys], "p.__b").orderBy(f"p.{x}", *[f"p.{i}" for i in ids]))
    out = parts.alias("p").join(before.alias("c"), on).withColumn(rank, local + F.col("c.__before"))
    return out.select(*[F.col(f"p.{c}") for c in df.columns], rank)


def benjamini_hochberg(df: DataFrame, p: str, ids: Sequence[str]) -> DataFrame:
    """q-values: p m / rank, running minimum from the largest, within 0..1. Rows without p go."""
    ranked = global_rank(df, p, ids, "__k", "__m").withColumn("__raw", F.col(p) * F.col("__m") / F.col("__k"))
    least = ranked.groupBy("__b").agg(F.min("__raw").alias("__least"))
    later = least.alias("a").join(least.alias("b"), F.expr("b.__b > a.__b"), "left").groupBy("a.__b").agg(F.min("b.__least").alias("__later"))
    back = Window.partitionBy("__b").orderBy("__k").rowsBetween(0, Window.unboundedFollowing)
    q = F.least(F.min("__raw").over(back), F.coalesce("__later", F.lit(1.0)))
    out = ranked.join(F.broadcast(later), "__b").withColumn("q", F.greatest(F.lit(0.0), F.least(F.lit(1.0), q)))  # at most 64 rows
    return out.drop("__b", "__k", "__m", "__raw", "__later")


def quantile_bin(rank: Column, n: Column, bins: int) -> Column:
    """Bin from 0 of rank 1..n with right-closed edges 1 + (n - 1) k / bins, the lowest included."""
    return F.when(n > 1, F.greatest(F.lit(0), F.ceil((rank - 1) * bins / (n - 1)) - 1)).otherwise(F.lit(0)).cast("int")


def states(x: Column, low: Column, high: Column, middle: Column) -> Column:
    """low, mid or high by cuts; where both cuts are equal the median decides; missing without a value."""
    one = F.when(x < middle, "low").when(x > middle, "high").otherwise("mid")
    return F.when(x.isNull(), "missing").when(low == high, one).when(x <= low, "low").when(x >= high, "high").otherwise("mid")


def zscore(df: DataFrame, values: Sequence[str], sample: bool, zero: float | None) -> DataFrame:
    """``z_`` columns by mean and sd of the table (sample sd or population sd); ``zero`` where the sd is 0. One aggregate row is joined back."""
    sd = F.stddev_samp if sample else F.stddev_pop
    stats = df.agg(*[e for v in values for e in (F.avg(v).alias(f"__m_{v}"), sd(v).alias(f"__s_{v}"))])
    out = df.join(F.broadcast(stats))  # one row
    z = lambda v: F.when(F.col(f"__s_{v}") == 0, F.lit(zero).cast("double")).otherwise((F.col(v) - F.col(f"__m_{v}")) / F.col(f"__s_{v}"))
    return out.select(*df.columns, *[z(v).alias(f"z_{v}") for v in values])


def robust_flags(long: DataFrame, feature: str, value: str, ids: Sequence[str], z: float = 3.5, fence: float = 1.5, n: int = 3) -> DataFrame:
    """Outliers of a long table: robust z from median and MAD, quartile fences, or among the n highest, with the reasons; ``rank`` where among the n highest.

    Statistics (a row a feature) and the n highest of each feature are broadcast, so the table itself isn't shuffled for them; row limits of the n highest apply
    before their shuffle.
    """
    base = long.where(F.col(value).isNotNull())
    stats = base.groupBy(feature).agg(F.median(value).alias("median"), F.percentile(value, 0.25).alias("q25"), F.percentile(value, 0.75).alias("q75"))
    with_median = base.join(F.broadcast(stats), feature)
    spread = with_median.groupBy(feature).agg(F.median(F.abs(F.col(value) - F.col("median"))).alias("mad"))
    highest = top_n(base.select(feature, *ids, value), [feature], [F.desc(value), *map(F.col, ids)], n).drop(value)
    scored = with_median.join(F.broadcast(spread), feature).join(F.broadcast(highest), [feature, *ids], "left")
    robust = F.when(F.col("mad") > 0, 0.6745 * (F.col(value) - F.col("median")) / F.col("mad"))
    iqr = F.col("q75") - F.col("q25")
    scored = scored.withColumn("robust_z", robust)
    reason = F.array_compact(F.array(F.when(F.abs("robust_z") >= z, "robust_z"), F.when((F.col(value) > F.col("q75") + fence * iqr) | (F.col(value) < F.col("q25") - fence * iqr), "iqr"), F.when(F.col("rank").isNotNull(), "top")))
    return scored.withColumn("reasons", F.array_join(reason, ";")).where("reasons <> ''")
