"""Summaries of a cohort: profiles and states of groups, frequencies of selections, outcomes, availability, progress and outliers by selectors.

Groups, features and states are few; their tables are aggregates, and what is joined back to rows is such a table, broadcast.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clean as C
from ..functions import outcomes as O
from . import stats as S
from . import windows as W
from .reshape import wide_to_long


def _long(df: DataFrame, ids: Sequence[str], features: Sequence[str]) -> DataFrame:
    return wide_to_long(df.select(*ids, *features), list(ids), list(features))


def profiles(df: DataFrame, group: str, features: Sequence[str]) -> DataFrame:
    """A row for each feature and group: rows, values, mean, median and quartiles beside the cohort's mean and median, and the difference of means in cohort deviations (NULL where those are 0 or of one value)."""
    long = _long(df, [group], features)
    own = long.groupBy(group, "feature").agg(F.count("*").alias("n_cases"), *S.summary(F.col("value")))
    cohort = long.groupBy("feature").agg(F.avg("value").alias("cohort_mean"), F.median("value").alias("cohort_median"), F.when(F.count("value") > 1, F.stddev_pop("value")).alias("_sd"))
    delta = F.col("mean") - F.col("cohort_mean")
    return own.join(F.broadcast(cohort), "feature").withColumn("delta", delta).withColumn("delta_z", F.when(F.col("_sd") > 0, F.col("delta") / F.col("_sd"))).drop("_sd")


def mix(df: DataFrame, keys: Sequence[str], value: str, name: str, most: int | None = None) -> DataFrame:
    """Counts of a value's levels as text "level:n; ...": by level, or the ``most`` commonest, commonest first and ties by level."""
    counts = df.groupBy(*keys, F.coalesce(F.col(value).cast("string"), F.lit("missing")).alias("_v")).agg(F.count("*").alias("_n"))
    if most:
        counts = W.top_n(counts, keys, [F.desc("_n"), F.col("_v")], most, "_k")
        entry = F.struct(F.col("_k").alias("k"), "_v", "_n")
    else:
        entry = F.struct(F.lit(0).alias("k"), "_v", "_n")
    held = F.sort_array(F.collect_list(entry))  # a few levels a group
    return counts.groupBy(*keys).agg(F.array_join(F.transform(held, lambda e: F.concat(e["_v"], F.lit(":"), e["_n"].cast("string"))), "; ").alias(name))


def state_summary(df: DataFrame, group: str, cluster: str, domains: Sequence[str]) -> DataFrame:
    """By group: rows, the mix of clusters, and for each domain the commonest ``_state`` (the first by name of ties) and mean and median ``_score``."""
    each = [a for d in domains for a in (F.mode(F.coalesce(f"{d}_state", F.lit("missing")), True).alias(f"{d}_state"), F.avg(f"{d}_score").alias(f"{d}_score_mean"), F.median(f"{d}_score").alias(f"{d}_score_median"))]
    return df.groupBy(group).agg(F.count("*").alias("n_cases"), *each).join(mix(df, [group], cluster, "clusters"), group)


def states_by_cluster(df: DataFrame, cluster: str, group: str, domains: Sequence[str]) -> DataFrame:
    """A row for each cluster and domain: how many are low, mid, high or missing, the commonest state with its share, and the three commonest groups of the cluster."""
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("domain"), F.coalesce(f"{d}_state", F.lit("missing")).alias("state")) for d in domains]))
    long = df.select(cluster, pairs.alias("p")).select(cluster, "p.*")
    counts = [F.count_if(F.col("state") == s).alias(s) for s in ("low", "mid", "high", "missing")]
    g = long.groupBy(cluster, "domain").agg(F.count("*").alias("n_cases"), *counts, F.mode("state", True).alias("top_state"))
    levels = long.groupBy(cluster, "domain", F.col("state").alias("top_state")).agg(F.count("*").alias("_n"))
    g = g.join(levels, [cluster, "domain", "top_state"]).withColumn("top_fraction", F.col("_n") / F.col("n_cases")).drop("_n")
    return g.join(mix(df, [cluster], group, "top_groups", 3), cluster)


def distribution(df: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """Median, quartiles, 95th and 99th percentile, interquartile range, median absolute deviation and greatest value by key."""
    q = {"median": 0.5, "q25": 0.25, "q75": 0.75, "q95": 0.95, "q99": 0.99}
    g = df.groupBy(*keys).agg(*[F.percentile(x, p).alias(n) for n, p in q.items()], F.max(x).alias("max"))
    g = g.withColumn("iqr", F.col("q75") - F.col("q25"))
    spread = S.mad(df, keys, x).select(*keys, "mad") if keys else S.mad(df.withColumn("_all", F.lit(1)), ["_all"], x).select("mad")
    return g.join(spread, list(keys)) if keys else g.crossJoin(spread)  # one row


def interval_summary(df: DataFrame, keys: Sequence[str], x: str, z: float = 1.959963984540054) -> DataFrame:
    """n, mean, median, sample deviation (0 for one value), least, greatest, quartiles, 5th and 95th percentile, and the mean's normal interval."""
    se = F.col("sd") / F.sqrt("n")
    g = df.groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.median(x).alias("median"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("sd"), F.min(x).alias("least"), F.max(x).alias("most"), *[F.percentile(x, p).alias(n) for n, p in (("q1", 0.25), ("q3", 0.75), ("p5", 0.05), ("p95", 0.95))])
    return g.withColumns({"iqr": F.col("q3") - F.col("q1"), "low": F.col("mean") - z * se, "high": F.col("mean") + z * se})


def label_summary(cases: DataFrame, key: str, label: str, found: DataFrame, count: str, reviewed: str) -> DataFrame:
    """By label over distinct (key, label): cases, those with a positive ``count`` and their percentage, its median and greatest value, and those reviewed. Cases that ``found`` lacks count 0."""
    j = cases.select(key, label).distinct().join(found.select(key, count, reviewed), key, "left").fillna(0, [count, reviewed])
    hit = F.col(count) > 0
    return j.groupBy(label).agg(F.count("*").alias("n_cases"), F.count_if(hit).alias("n_hit"), (100 * F.avg(hit.cast("double"))).alias("pct_hit"), F.median(count).alias("median_count"), F.max(count).alias("max_count"), F.count_if(F.col(reviewed) > 0).alias("n_reviewed"))


def selection_frequency(selected: DataFrame, stability: DataFrame) -> DataFrame:
    """(modality, feature): folds that selected it, mean |coefficient| and relevance, full-joined with selection_probability and stable; 0 folds and not stable where a side lacks it."""
    keys = ["modality", "feature"]
    g = selected.groupBy(*keys).agg(F.count_distinct("fold").alias("selected_folds"), F.avg(F.abs("coefficient")).alias("mean_abs_coefficient"), F.avg("relevance").alias("mean_relevance"))
    out = g.join(stability.select(*keys, "selection_probability", "stable"), keys, "full")
    return out.withColumns({"selected_folds": F.coalesce("selected_folds", F.lit(0)), "stable": F.coalesce("stable", F.lit(False))})


def redundancy_summary(audit: DataFrame) -> DataFrame:
    """By modality and fold: features dropped, decisions and the greatest |correlation|."""
    return audit.groupBy("modality", "fold").agg(F.count_distinct("dropped_feature").alias("redundant_features_dropped"), F.count("*").alias("decisions"), F.max("abs_correlation").alias("max_abs_correlation"))


def chosen_summary(selected: DataFrame, stability: DataFrame, domains: Sequence[str], method: str) -> DataFrame:
    """Of rows selected by a method in some domains, by feature: rows, mean rank, mean and mean |coefficient|, rows of either sign, with its stability."""
    rows = selected.where(F.col("base_domain").isin(*domains) & (F.col("selection_method") == method))
    c = F.col("coefficient")
    g = rows.groupBy("feature").agg(F.count("*").alias("selected_rows"), F.avg("rank").alias("mean_rank"), F.avg(c).alias("mean_coefficient"), F.avg(F.abs(c)).alias("mean_abs_coefficient"), F.count_if(c > 0).alias("positive_rows"), F.count_if(c < 0).alias("negative_rows"))
    return g.join(stability.select("feature", "selection_probability", "stable"), "feature", "left").withColumn("stable", F.coalesce("stable", F.lit(False)))


def domain_counts(candidates: DataFrame, selected: DataFrame, drops: DataFrame) -> DataFrame:
    """By domain: candidate features, distinct features selected by each of two methods, rows and distinct features dropped as collinear; 0 where there are none."""
    chosen = lambda m: F.count_distinct(F.when(F.col("selection_method") == m, F.col("feature")))
    a = candidates.groupBy("domain").agg(F.count_distinct("feature").alias("candidates"))
    b = selected.groupBy("domain").agg(chosen("relevance_collinearity").alias("selected"), chosen("elastic_net_nonzero").alias("selected_net"))
    c = drops.groupBy("domain").agg(F.count("*").alias("drop_decisions"), F.count_distinct("feature").alias("dropped"))
    out = a.join(b, "domain", "left").join(c, "domain", "left")
    return out.fillna(0, ["selected", "selected_net", "drop_decisions", "dropped"])


def class_counts(df: DataFrame, label: str) -> DataFrame:
    """(label, n) of the labels as text, missing ones as "missing"."""
    return df.groupBy(F.coalesce(F.col(label).cast("string"), F.lit("missing")).alias("label")).agg(F.count("*").alias("n"))


def moments(df: DataFrame, x: str) -> DataFrame:
    """One row: rows, values, mean, sample deviation, least and greatest."""
    v = C.to_number(F.col(x))
    return df.agg(F.count("*").alias("rows"), F.count(v).alias("non_missing"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))


def event_summary(df: DataFrame, time: str, event: str, numeric: bool, code: str | None = None) -> DataFrame:
    """One row: rows, least, median and greatest time, events and the rest; with a competing risk's ``code`` also competing and censored rows."""
    hit, out = O.event(F.col(event), numeric, code), O.censored(F.col(event), numeric)
    t = C.to_number(F.col(time))
    more = [F.count_if(~hit & ~out).alias("competing"), F.count_if(out).alias("censored_rows")] if code is not None else []
    return df.agg(F.count("*").alias("rows"), F.min(t).alias("time_min"), F.median(t).alias("time_median"), F.max(t).alias("time_max"), F.count_if(hit).alias("events"), F.count_if(~hit).alias("censored"), *more)


def availability(df: DataFrame, tiers: Mapping[str, Sequence[str]], aliases: Mapping[str, str] | None = None) -> DataFrame:
    """By tier: registered columns, those that the table has under their names or aliases, and the share of missing values over all registered ones; an absent column is all missing."""
    names = {c: c if c in df.columns else (aliases or {}).get(c) for cs in tiers.values() for c in cs}
    there = {c: n for c, n in names.items() if n in df.columns}
    row = df.agg(F.count("*").alias("_n"), *[F.count(F.col(f"`{n}`")).alias(f"_{i}") for i, n in enumerate(there.values())]).first()
    have = {c: row[f"_{i}"] for i, c in enumerate(there)}
    rows = [(t, len(cs), sum(c in there for c in cs), 1 - sum(have.get(c, 0) for c in cs) / (len(cs) * row["_n"]) if row["_n"] and cs else None) for t, cs in tiers.items()]
    return df.sparkSession.createDataFrame(rows, "tier string, registered int, available int, missing double")


def most_missing(df: DataFrame, n: int) -> DataFrame:
    """(column, missing) of the ``n`` columns with the most missing values, then by name; one pass."""
    counts = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    long = counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("missing")) for c in df.columns])).alias("r")).select("r.*")
    return long.orderBy(F.desc("missing"), "column").limit(n)


def remaining_seconds(stages: DataFrame, stage: str, expected: str, done: str, started: str, mean: str, now: Column) -> DataFrame:
    """(stage, eta): 0 where all is done; elapsed / done * rest, of one second at least, once some are done; else mean * rest; NULL without either."""
    rest = F.greatest(F.col(expected) - F.col(done), F.lit(0))
    elapsed = F.greatest((F.unix_micros(now) - F.unix_micros(F.col(started).cast("timestamp"))) / 1e6, F.lit(1.0))
    eta = F.when((F.coalesce(F.col(expected), F.lit(0)) == 0) | (rest == 0), 0.0).when(F.col(started).isNotNull() & (F.col(done) > 0), elapsed / F.col(done) * rest).otherwise(F.col(mean) * rest)
    return stages.select(stage, eta.alias("eta"))


def status_summary(rows: DataFrame, status: str, source: str, score: str, finished: str = "finalized", absent: str = "not staged") -> DataFrame:
    """One row: rows, finished, pending and absent ones, the mean score of the finished, and their sources as a mix."""
    is_done = F.col(status) == finished
    g = rows.agg(F.count("*").alias("n_rows"), F.count_if(is_done).alias("n_finished"), F.count_if(F.coalesce(~F.col(status).isin(finished, absent), F.lit(True))).alias("n_pending"), F.count_if(F.col(status) == absent).alias("n_absent"), F.avg(F.when(is_done, F.col(score))).alias("mean_score"))
    held = rows.where(is_done).withColumn("_all", F.lit(1)).withColumn("_s", F.coalesce(F.nullif(F.trim(source), F.lit("")), F.lit("(unrecorded)")))
    by = mix(held, ["_all"], "_s", "by_source").drop("_all")
    return g.join(by, F.lit(True), "left")  # one row each


def univariate_screen(df: DataFrame, features: Sequence[str], outcome: str, least: int) -> DataFrame:
    """(feature, n, n_events, n_missing, means, medians, smd, auc, auc_directional, place) of features with ``least`` pairs and both outcomes, best directional area first."""
    e = F.col("e")
    known = df.where(F.col(outcome).cast("string").isin("0", "1")).withColumn("e", F.col(outcome).cast("string") == "1")
    long = _long(known, ["e"], features).withColumn("value", C.finite(F.col("value")))
    g = long.groupBy("feature").agg(F.count("value").alias("n"), F.count_if(e & F.col("value").isNotNull()).alias("n_events"), F.count_if(F.col("value").isNull()).alias("n_missing"), *[f(F.when(c, F.col("value"))).alias(f"{n}_{m}") for n, c in (("event", e), ("nonevent", ~e)) for m, f in (("mean", F.avg), ("median", F.median))], S.standardized_difference(F.col("value"), e).alias("smd"))
    area = S.rank_auc(long, ["feature"], "value", "e").select("feature", "auc")
    out = g.join(area, "feature").where((F.col("n") >= least) & (F.col("n_events") > 0) & (F.col("n_events") < F.col("n"))).withColumn("auc_directional", F.greatest("auc", 1 - F.col("auc")))
    order = Window.orderBy(F.desc("auc_directional"), F.desc(F.abs("smd")), "feature")
    return out.withColumn("place", F.row_number().over(order))  # a row a feature


def best_features(df: DataFrame, features: Sequence[str], group: str, n: int) -> DataFrame:
    """(feature, f) of the ``n`` features with the largest one-way F over groups, then by name."""
    return S.anova_f(_long(df, [group], features), ["feature"], "value", group).select("feature", "f").orderBy(F.desc_nulls_last("f"), "feature").limit(n)


def usable_columns(df: DataFrame, columns: Sequence[str], coverage: float, distinct: int, least_sd: float = 0.0, excluded: Sequence[str] = (), most: int | None = None) -> list[str]:
    """Columns without an excluded part in their name, with enough values, distinct values and spread; by falling variance if only ``most`` are taken."""
    some = [c for c in columns if not any(x in c.lower() for x in excluded)]
    if not some:
        return []
    v = {c: C.to_number(F.col(f"`{c}`")) for c in some}
    r = df.agg(F.count("*").alias("n"), *[f(v[c]).alias(f"{k}{i}") for i, c in enumerate(some) for k, f in (("c", F.count), ("d", F.count_distinct), ("s", F.stddev_samp))]).first()
    fine = [(c, r[f"s{i}"]) for i, c in enumerate(some) if r["n"] and r[f"c{i}"] / r["n"] >= coverage and r[f"d{i}"] >= distinct and (r[f"s{i}"] or 0.0) > least_sd]
    if most is not None:
        fine = sorted(fine, key=lambda x: (-x[1], x[0]))[:most]
    return [c for c, _ in fine]


# ---------------------------------------------------------------- selectors and outliers
def selected_rows(features: DataFrame, selector: str) -> DataFrame:
    """Rows of ``region:feature[:threshold]``, or of an exact feature name, and only where there is none of names that contain the text, whatever the case."""
    parts = [p.strip() for p in selector.split(":")]
    if len(parts) == 1:
        exact = features.where(F.col("feature_name") == parts[0])
        return exact if exact.limit(1).count() else features.where(F.lower("feature_name").contains(parts[0].lower()))
    out = features.where((F.col("region") == parts[0]) & (F.col("feature_name") == parts[1]))
    return out.where(F.coalesce(F.col("threshold_if_applicable").cast("string"), F.lit("")) == parts[2]) if len(parts) > 2 else out


def outlier_cases(features: DataFrame, selectors: Sequence[str], method: str = "quantile", direction: str = "both", quantile: float = 0.95, z: float = 3.0, n: int = 10) -> DataFrame:
    """Distinct case_id of the outliers of any selector: the n lowest or highest, |z| by the population's deviation, or beyond a quantile; bounds included."""
    low, high, found = direction in ("low", "both"), direction in ("high", "both"), None
    for s in selectors:
        rows, v = selected_rows(features, s).where(F.col("feature_value").isNotNull()), F.col("feature_value")
        if method == "top-n":
            ends = [rows.orderBy(o, "case_id").limit(n) for use, o in ((low, v.asc()), (high, v.desc())) if use]
            hit = ends[0].union(ends[1]) if len(ends) > 1 else ends[0]
        else:
            if method == "zscore":
                stats = rows.agg(F.avg(v).alias("_m"), F.stddev_pop(v).alias("_s"))
                score = (v - F.col("_m")) / F.nullif(F.col("_s"), F.lit(0.0))
                below, above = score <= -z, score >= z
            elif method == "quantile":
                stats = rows.agg(F.percentile(v, 1 - quantile).alias("_l"), F.percentile(v, quantile).alias("_h"))
                below, above = v <= F.col("_l"), v >= F.col("_h")
            else:
                raise ValueError(f"unknown method {method!r}")
            beyond = (below & F.lit(low)) | (above & F.lit(high))
            hit = rows.crossJoin(F.broadcast(stats)).where(beyond)  # one row
        ids = hit.select(F.col("case_id").cast("string").alias("case_id"))
        found = ids if found is None else found.union(ids)
    return found.distinct() if found is not None else features.select(F.col("case_id").cast("string").alias("case_id")).limit(0)


def chosen(cases: DataFrame, ids: Sequence[str] = (), where: Sequence[Column] = (), outliers: DataFrame | None = None) -> DataFrame:
    """Cases among ``ids`` (all without them) that pass every predicate and are among the outliers, if those are given."""
    out = cases.where(F.col("case_id").cast("string").isin(*ids)) if ids else cases
    for w in where:
        out = out.where(w)
    return out.join(outliers, out["case_id"].cast("string") == outliers["case_id"], "left_semi") if outliers is not None else out


def latest_of_cases(rows: DataFrame, key: str, seq: str, index: str, cases: DataFrame, whole_history: bool) -> DataFrame:
    """The last row of each wanted case by ``seq``: of all history, or of the current pass alone, which starts at the last row whose index falls."""
    if not whole_history:
        start = rows.withColumn("_b", F.lag(index).over(Window.orderBy(seq))).where(F.col("_b") > F.col(index)).agg(F.max(seq).alias("_from"))  # a log of one run
        rows = rows.crossJoin(F.broadcast(start)).where(F.col("_from").isNull() | (F.col(seq) >= F.col("_from"))).drop("_from")
    return W.latest(rows.join(cases.select(key).distinct(), key, "left_semi"), [key], [seq])


def resumable(rows: DataFrame, key: str, seq: str, status: str, done: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(last row of each key, keys that are done): done are those whose last row has one of the statuses."""
    last = W.latest(rows, [key], [seq])
    return last, last.where(F.col(status).isin(*done)).select(key)


def composite_index(df: DataFrame, groups: Mapping[str, Sequence[str]], statistics: Mapping[str, tuple[float, float]] | None) -> DataFrame:
    """A mean z a group and ``combined``, their mean: NULL where a group lacks a value or a statistic, combined only where all groups are there; all NULL without statistics."""
    z = lambda f: (C.finite(F.col(f)) - statistics[f][0]) / statistics[f][1] if f in df.columns and f in statistics and statistics[f][1] > 0 else F.lit(None).cast("double")
    parts = {}
    for name, features in groups.items():
        each = [z(f) for f in features] if statistics else [F.lit(None).cast("double")]
        parts[name] = sum(each[1:], each[0]) / len(each)
    whole = list(parts.values())
    return df.withColumns(parts | {"combined": sum(whole[1:], whole[0]) / len(whole)})


def first_match(indicators: Sequence[str], other: str = "Other") -> Column:
    """The name of the first indicator that is 1."""
    return F.coalesce(*[F.when(F.col(i) == 1, F.lit(i)) for i in indicators], F.lit(other))


def any_positive(indicators: Sequence[str]) -> Column:
    """1 where the indicators, missing ones as 0, add up to more than 0."""
    total = F.lit(0.0)
    for i in indicators:
        total = total + F.coalesce(C.to_number(F.col(i)), F.lit(0.0))
    return (total > 0).cast("int")


def earliest(*dates: Column) -> Column:
    """The earliest of a row's dates that can be read."""
    return F.array_min(F.array(*[C.parse_date(d.cast("string")) for d in dates]))
