"""Quality of predictions: class and regression metrics, average precision, calibration error and bootstrap intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def class_metrics(df: DataFrame, keys: Sequence[str], score: Column, event: Column, cut: float = 0.5) -> DataFrame:
    """Accuracy, balanced accuracy and Brier score in one pass."""
    hit, e = score >= cut, event.cast("double")
    sens = F.avg(F.when(event, hit.cast("double")))
    spec = F.avg(F.when(~event, (~hit).cast("double")))
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg((hit == event).cast("double")).alias("accuracy"), ((sens + spec) / 2).alias("balanced_accuracy"), F.avg((score - e) ** 2).alias("brier"))


def regression_metrics(df: DataFrame, keys: Sequence[str], predicted: Column, actual: Column) -> DataFrame:
    """R squared, mean absolute and root mean squared error."""
    d = predicted - actual
    return df.groupBy(*keys).agg(F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"), (1 - F.try_divide(F.avg(d * d), F.var_pop(actual))).alias("r2"))


def expected_calibration_error(df: DataFrame, keys: Sequence[str], score: Column, event: Column, bins: int = 10) -> DataFrame:
    """Mean over rows of |mean score - rate| of their bin of equal width."""
    b = F.least(F.lit(bins - 1), F.floor(score * bins))
    g = df.groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("p"), F.avg(event.cast("double")).alias("r"))
    return g.groupBy(*keys).agg((F.sum(F.col("n") * F.abs(F.col("p") - F.col("r"))) / F.sum("n")).alias("ece"))


def average_precision(df: DataFrame, keys: Sequence[str], score: str, event: str) -> DataFrame:
    """Sum over score levels from the highest of the recall gained times the precision there. Rows are counted by score first."""
    g = df.groupBy(*keys, score).agg(F.count("*").alias("n"), F.sum(F.col(event).cast("long")).alias("e"))
    w = Window.partitionBy(*keys).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    g = g.withColumn("precision", F.sum("e").over(w) / F.sum("n").over(w))
    return g.groupBy(*keys).agg(F.try_divide(F.sum(F.col("e") * F.col("precision")), F.sum("e")).alias("average_precision"))


def bootstrap_mean(df: DataFrame, keys: Sequence[str], x: str, ids: str, rounds: int = 200, alpha: float = 0.05) -> DataFrame:
    """Mean with a percentile interval: each row has a Poisson weight in every round, from hashes, so one aggregate makes all rounds."""
    u = lambda r: F.pmod(F.xxhash64(F.col(ids), r), F.lit(1 << 30)) / float(1 << 30)
    # fixed values: the distribution function of a Poisson count of mean 1 at 0 to 6
    steps = (0.36787944117, 0.73575888234, 0.91969860293, 0.98101184312, 0.99634015317, 0.99940581518, 0.99991675885)
    weight = lambda r: F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda n, s: n + (u(r) >= s).cast("int"))
    rows = df.where(F.col(x).isNotNull()).select(*keys, F.col(x).alias("x"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(rounds - 1)), lambda r: F.struct(r.alias("round"), weight(r).alias("w")))).alias("s"))
    means = rows.groupBy(*keys, F.col("s.round").alias("round")).agg((F.sum(F.col("s.w") * F.col("x")) / F.sum("s.w")).alias("m"))
    interval = means.groupBy(*keys).agg(F.percentile("m", alpha / 2).alias("low"), F.percentile("m", 1 - alpha / 2).alias("high"))
    centre = df.groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("mean"))
    return centre.join(interval, list(keys))
