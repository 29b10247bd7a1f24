"""Aggregate statistics: moments, exact quantiles, effect sizes, correlations and tests, as aggregates that combine before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import global_rank


def summary(x: Column) -> list[Column]:
    """n, mean, median and quartiles (exact, linear)."""
    return [F.count(x).alias("n"), F.avg(x).alias("mean"), F.median(x).alias("median"), F.percentile(x, 0.25).alias("q25"), F.percentile(x, 0.75).alias("q75")]


def population_skewness(x: Column) -> Column:
    """0 where the values don't vary, NULL below two values."""
    return F.when(F.count(x) < 2, None).when(F.stddev_pop(x) == 0, 0.0).otherwise(F.skewness(x))


def population_kurtosis(x: Column) -> Column:
    """Not in excess of 3; 0 where the values don't vary."""
    return F.when(F.count(x) < 2, None).when(F.stddev_pop(x) == 0, 0.0).otherwise(F.kurtosis(x) + 3)


def slope(y: Column, x: Column) -> Column:
    """Least squares slope; 0 where x doesn't vary."""
    return F.when(F.var_pop(F.when(y.isNotNull(), x)) == 0, 0.0).otherwise(F.regr_slope(y, x))


def standardized_difference(x: Column, event: Column) -> Column:
    """(mean with event - mean without) / sqrt of the mean of both sample variances; 0 where that is 0."""
    a, b = F.when(event, x), F.when(~event, x)
    pooled = F.sqrt((F.var_samp(a) + F.var_samp(b)) / 2)
    return F.when(pooled > 0, (F.avg(a) - F.avg(b)) / pooled).otherwise(0.0)


def average_rank(w: Window, order: Window) -> Column:
    """Ranks from 1, ties share their mean; ``order``: partition and order, ``w``: partition and tied value."""
    return F.rank().over(order) + (F.count(F.lit(1)).over(w) - 1) / 2


def rank_auc(df: DataFrame, keys: Sequence[str], x: str, event: str) -> DataFrame:
    """Area under the curve by key, for any number of rows a key.

    Values are counted by (key, value) first, so the window runs over distinct values: rank sums need no more.
    """
    by_value = df.where(F.col(x).isNotNull() & F.col(event).isNotNull()).groupBy(*keys, x).agg(F.count("*").alias("n"), F.sum(F.col(event).cast("long")).alias("e"))
    before = Window.partitionBy(*keys).orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    ranked = by_value.withColumn("r", F.coalesce(F.sum("n").over(before), F.lit(0)) + (F.col("n") + 1) / 2)
    sums = ranked.groupBy(*keys).agg(F.sum(F.col("r") * F.col("e")).alias("s"), F.sum("e").alias("e"), F.sum("n").alias("n"))
    e, o = F.col("e"), F.col("n") - F.col("e")
    return sums.select(*keys, F.col("n"), F.col("e").alias("events"), F.when((e > 0) & (o > 0), (F.col("s") - e * (e + 1) / 2) / (e * o)).alias("auc"))


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Rank correlation on complete pairs. Values are counted by key first, so the windows run over distinct values."""
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, x, y).agg(F.count("*").alias("_n"))
    out = pairs
    for c, name in ((x, "rx"), (y, "ry")):
        n = pairs.groupBy(*keys, c).agg(F.sum("_n").alias("_m"))
        before = Window.partitionBy(*keys).orderBy(c).rowsBetween(Window.unboundedPreceding, -1)
        ranked = n.select(*keys, c, (F.coalesce(F.sum("_m").over(before), F.lit(0)) + (F.col("_m") + 1) / 2).alias(name))
        out = out.join(ranked, [*keys, c])
    w, a, b = F.col("_n"), F.col("rx"), F.col("ry")
    g = out.groupBy(*keys).agg(F.sum(w).alias("n"), *[F.sum(v).alias(f"_{k}") for k, v in (("a", w * a), ("b", w * b), ("aa", w * a * a), ("bb", w * b * b), ("ab", w * a * b))])
    n = F.col("n")
    cov = lambda p, q, pq: F.col(f"_{pq}") / n - F.col(f"_{p}") / n * F.col(f"_{q}") / n
    return g.select(*keys, "n", F.try_divide(cov("a", "b", "ab"), F.sqrt(cov("a", "a", "aa") * cov("b", "b", "bb"))).alias("rho"))


def anova_f(df: DataFrame, keys: Sequence[str], x: str, group: str) -> DataFrame:
    """One-way F from group sums, in two levels of aggregation."""
    g = df.where(F.col(x).isNotNull() & F.col(group).isNotNull()).groupBy(*keys, group).agg(F.count(x).alias("n"), F.avg(x).alias("m"), F.var_pop(x).alias("v"))
    t = g.groupBy(*keys).agg(F.sum("n").alias("n"), F.count("*").alias("k"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("mm"), F.sum(F.col("n") * F.col("v")).alias("within"))
    between = F.col("mm") - F.col("n") * F.col("grand") * F.col("grand")
    return t.select(*keys, "n", "k", F.try_divide(between / (F.col("k") - 1), F.col("within") / (F.col("n") - F.col("k"))).alias("f"))


def mad(df: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """Median and median absolute deviation by key, in two passes."""
    m = df.groupBy(*keys).agg(F.median(x).alias("median"))
    return df.join(m, list(keys)).groupBy(*keys).agg(F.first("median").alias("median"), F.median(F.abs(F.col(x) - F.col("median"))).alias("mad"))


def concordance(df: DataFrame, time: str, risk: str, event: str) -> DataFrame:
    """Harrell's index: over pairs with t_i < t_j and an event at i, the share where risk_i is larger; ties count half.

    Rows are counted by (time, risk) first. Risks get ranks; of two ranks the lower is told by the first bit, from the top, in which they differ, so the rows of smaller
    risk are those that share a prefix and have a 0 where the row has a 1. One running count over time for each level and prefix gives them
    all: n log n rows, and no pairs.
    """
    cells = df.where(F.col(time).isNotNull() & F.col(risk).isNotNull()).groupBy(F.col(time).cast("double").alias("t"), F.col(risk).cast("double").alias("r")).agg(F.count("*").alias("n"), F.sum(F.col(event).cast("long")).alias("e"))
    ranks = global_rank(cells.select("r").distinct(), "r", [], "k", "_n").select("r", (F.col("k") - 1).alias("k"))
    cells = cells.join(ranks, "r").select("t", "k", "n", "e")
    levels = max(1, ((ranks.agg(F.max("k")).first()[0] or 0)).bit_length())
    level = F.explode(F.sequence(F.lit(0), F.lit(levels)))  # the last: the whole rank, for ties
    deep = cells.withColumn("level", level).withColumn("bit", F.when(F.col("level") < levels, F.expr("shiftright(k, level) & 1")))
    deep = deep.withColumn("prefix", F.when(F.col("level") < levels, F.expr("shiftright(k, level + 1)")).otherwise(F.col("k")))
    tie = F.col("bit").isNull()
    at = deep.groupBy("level", "prefix", "t").agg(F.max(tie).alias("tie"), F.sum(F.when(tie | (F.col("bit") == 0), F.col("n"))).alias("low"), F.sum(F.when(tie | (F.col("bit") == 1), F.col("e"))).alias("e"))
    later = lambda *keys: Window.partitionBy(*keys).orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, -1)  # noqa: E731  a row a time
    at = at.withColumn("s", F.col("e") * F.sum("low").over(later("level", "prefix")))
    won = at.agg(F.coalesce(F.sum(F.when(F.col("tie"), F.col("s") / 2).otherwise(F.col("s"))), F.lit(0.0)).alias("won"))
    times = cells.groupBy("t").agg(F.sum("n").alias("n"), F.sum("e").alias("e")).withColumn("all", F.lit(0))
    pairs = times.withColumn("s", F.col("e") * F.sum("n").over(later("all"))).agg(F.nullif(F.sum("s"), F.lit(0)).alias("pairs"))
    return won.crossJoin(pairs).select("pairs", (F.col("won") / F.col("pairs")).alias("c_index"))  # one row each
