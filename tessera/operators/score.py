"""Scores from parameter tables: fit on training rows, apply to any."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .reshape import wide_to_long


def fit_parameters(train: DataFrame, features: Sequence[str], weights: dict[str, float]) -> DataFrame:
    """(feature, median, mean, std, weight): mean and population sd after the median fills in for missing values. Training rows alone count."""
    long = wide_to_long(train.select(*features), [], list(features))
    medians = long.groupBy("feature").agg(F.median("value").alias("median"))
    filled = long.join(F.broadcast(medians), "feature").withColumn("value", F.coalesce("value", "median"))  # a row a feature
    weight = F.create_map(*[F.lit(x) for f in features for x in (f, float(weights[f]))])
    return filled.groupBy("feature").agg(F.first("median").alias("median"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.first(weight[F.col("feature")]).alias("weight"))


def _parameters(parameters: DataFrame) -> DataFrame:
    """One row of arrays of structs, to be broadcast: a struct a feature and component."""
    return F.broadcast(parameters.agg(F.collect_list(F.struct(*parameters.columns)).alias("_p")))


def _z(p: Column, features: Sequence[str]) -> Column:
    """The row's z of the parameter's feature: a sd of 0 gives 0, a missing value counts as the median."""
    values = F.create_map(*[x for f in features for x in (F.lit(f), F.col(f).cast("double"))])
    return F.when(p["std"] > 0, (F.coalesce(values[p["feature"]], p["median"]) - p["mean"]) / p["std"]).otherwise(0.0)


def apply_parameters(rows: DataFrame, parameters: DataFrame, key: str, features: Sequence[str]) -> DataFrame:
    """(key, score) for each row: sum of weight * z over the sum of |weight|; a sd of 0 gives z = 0, a missing value the median. An expression of the row; nothing is shuffled."""
    known = F.filter("_p", lambda p: p["feature"].isin(*features))
    total = F.aggregate(F.transform(known, lambda p: p["weight"] * _z(p, features)), F.lit(0.0), lambda a, v: a + v)
    size = F.aggregate(F.transform(known, lambda p: F.abs(p["weight"])), F.lit(0.0), lambda a, v: a + v)
    return rows.crossJoin(_parameters(parameters)).select(key, F.try_divide(total, size).alias("score"))  # one row


def apply_projection(rows: DataFrame, parameters: DataFrame, key: str, features: Sequence[str], components: Sequence[int]) -> DataFrame:
    """(key, component_1, ...) for each row: sums of weight * z by component of (feature, component, median, mean, std, weight)."""
    part = lambda c: F.filter("_p", lambda p: (p["component"] == c) & p["feature"].isin(*features))
    total = lambda c: F.aggregate(F.transform(part(c), lambda p: p["weight"] * _z(p, features)), F.lit(0.0), lambda a, v: a + v)
    return rows.crossJoin(_parameters(parameters)).select(key, *[total(c).alias(f"component_{c}") for c in components])  # one row


def composite(long: DataFrame, key: str, stats: DataFrame) -> DataFrame:
    """(key, composite): mean of direction * z over (feature, mean, std, direction); NULL if a value is missing, features of unknown or zero sd don't count."""
    held = long.join(F.broadcast(stats), "feature")
    z = F.when(F.col("std") > 0, F.col("direction") * (F.col("value") - F.col("mean")) / F.col("std"))
    return held.groupBy(key).agg(F.when(F.count_if(F.col("value").isNull()) == 0, F.avg(z)).alias("composite"))


def calibration(scored: DataFrame, p: str, event: str, bin_: str) -> DataFrame:
    """Rows of a calibration table by bin."""
    return scored.groupBy(bin_).agg(F.count("*").alias("n"), F.sum(F.col(event).cast("long")).alias("events"), F.avg(p).alias("mean_p"), F.avg(F.col(event).cast("double")).alias("rate"), F.min(p).alias("low"), F.max(p).alias("high")).withColumn("error", F.abs(F.col("mean_p") - F.col("rate")))
