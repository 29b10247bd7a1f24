"""Outcome rules, ids and derived measures as column expressions.

Rules that depend on whether a whole column holds numbers take that as an argument; ``columns.numeric_usable`` tells it in one pass.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import clean as C

# Texts that mean an event or none, and limits of the enhancement pattern and of the contrast phase.
EVENT_WORDS = ("1", "true", "yes", "event")
CENSORED_WORDS = ("", "0", "false", "no", "none", "nan", "censor", "censored")
HIGH_HU, LOW_HU = 250.0, 150.0


def event(x: Column, numeric: bool, competing_code: str | None = None) -> Column:
    """Whether a row has the event: it has the competing code, or a positive whole number, or, in a column without numbers, a word for it."""
    text = x.cast("string")
    if competing_code is not None:
        hit = text == competing_code
    elif numeric:
        hit = F.coalesce(C.to_number(x), F.lit(0.0)).cast("long") > 0
    else:
        hit = F.lower(text).isin(*EVENT_WORDS)
    return F.coalesce(hit, F.lit(False))


def censored(x: Column, numeric: bool) -> Column:
    """Whether a row is censored: missing, a word for it, or, in a column with numbers, no number or 0."""
    word = F.coalesce(F.lower(F.trim(x.cast("string"))), F.lit("")).isin(*CENSORED_WORDS)
    return word | (F.coalesce(C.to_number(x), F.lit(0.0)) == 0) if numeric else word


def cardiovascular_death(cause: Column, cardiovascular: Column, died: Column, followed: Column) -> Column:
    """1, 0 or NULL by the first rule that holds: cause 2 or a mark of it; alive at follow-up; another death, or dead at follow-up."""
    has = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    status = F.trim(followed)
    return F.when((F.trim(cause) == "2") | has(cardiovascular), 1).when(status == "0", 0).when(has(died) | (status == "1"), 0)


def subject_id(case: Column) -> Column:
    """The part before the first underscore without "sub-"; digits alone lose their leading zeros."""
    token = F.replace(F.split(case, "_", 2)[0], F.lit("sub-"), F.lit(""))
    return F.when(token.rlike("^[0-9]+$"), F.regexp_replace(token, "^0+(?=[0-9])", "")).otherwise(token)


def aliased(x: Column, aliases: Mapping[str, str]) -> Column:
    """The alias of the trimmed text, whatever its case; itself where it has none."""
    t = F.trim(x.cast("string"))
    known = F.create_map(*[F.lit(v) for kv in aliases.items() for v in kv])
    return F.coalesce(known[F.lower(t)], t)


def normalized(df: DataFrame, renames: Mapping[str, Sequence[str]], aliases: Mapping[str, str], alias_column: str, status: str = "status", success: str = "success") -> DataFrame:
    """Columns renamed from the first candidate that is there, rows of other states than ``success`` left out, and names of regions unified."""
    for new, candidates in renames.items():
        found = next((c for c in candidates if c in df.columns), None)
        if found is None:
            raise ValueError(f"none of {', '.join(candidates)} is a column")
        df = df.withColumnRenamed(found, new)
    if status in df.columns:
        df = df.where(F.lower(F.col(status).cast("string")) == success)
    return df.withColumn(alias_column, aliased(F.col(alias_column), aliases))


def enhancement(mean: Column) -> Column:
    """Class of a mean attenuation, limits included in the outer classes."""
    return F.when(mean >= HIGH_HU, "high_hu_like_normal_opacification").when(mean <= LOW_HU, "low_hu_like_filling_defect").otherwise("intermediate_hu")


def contrast_phase(aorta_to_vein: Column, artery_to_aorta: Column, left_to_right: Column) -> Column:
    """The first phase whose rule holds."""
    return (
        F.when(artery_to_aorta > 1.5, "very_early_right_dominant")
        .when((aorta_to_vein > 1.5) & (left_to_right > 1.0), "arterial")
        .when(aorta_to_vein.between(0.8, 1.2), "mildly_delayed")
        .otherwise("unclassified")
    )


def derived(df: DataFrame, ratios: Mapping[str, tuple[str, str]], differences: Mapping[str, tuple[str, str]], scaled: Mapping[str, tuple[str, float]] | None = None) -> DataFrame:
    """Ratios (NULL where the divisor is 0 or missing), differences and scaled copies of columns; missing columns count as all NULL."""
    get = lambda c: C.finite(F.col(c)) if c in df.columns else F.lit(None).cast("double")
    new = {name: C.divide_nonzero(get(a), get(b)) for name, (a, b) in ratios.items()}
    new |= {name: get(a) - get(b) for name, (a, b) in differences.items()}
    new |= {name: get(a) / by for name, (a, by) in (scaled or {}).items()}
    return df.withColumns(new)


def proxy_scores(df: DataFrame, scores: Mapping[str, Sequence[tuple[str, str]]]) -> DataFrame:
    """Row means of z-scores over the table, each of the first of (preferred, fallback) that is there; columns without spread count as missing.

    One aggregate row of means and deviations is broadcast.
    """
    get = lambda c: C.finite(F.col(c)) if c in df.columns else F.lit(None).cast("double")
    parts = {(name, i): F.coalesce(get(a), get(b)) for name, pairs in scores.items() for i, (a, b) in enumerate(pairs)}
    stats = df.agg(*[f(x).alias(f"{n}_{name}_{i}") for (name, i), x in parts.items() for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    j = df.crossJoin(F.broadcast(stats))  # one row
    z = {k: F.when(F.col(f"s_{k[0]}_{k[1]}") > 0, (x - F.col(f"m_{k[0]}_{k[1]}")) / F.col(f"s_{k[0]}_{k[1]}")) for k, x in parts.items()}
    return j.withColumns({name: C.row_mean(*[z[name, i] for i in range(len(pairs))]) for name, pairs in scores.items()}).select(*df.columns, *scores)


def equivalent_radius(volume: Column, length: Column) -> Column:
    """Radius of the circle whose area is volume / length; NULL unless positive."""
    area = C.divide_nonzero(volume, length)
    return F.when(area > 0, F.sqrt(area / math.pi))


def size_ratios(df: DataFrame, measures: Sequence[str], volume: str | None, length: str | None, widths: Sequence[str] = ()) -> DataFrame:
    """Every measure per volume and per length, and every width per radius and diameter of the equivalent tube; ``length`` in units of 10 widths."""
    new = {}
    for c in measures:
        for by, suffix in ((volume, "per_volume"), (length, "per_length")):
            if by:
                new[f"ratio__{c}__{suffix}"] = C.divide_nonzero(F.col(c), F.col(by))
    if volume and length:
        radius = equivalent_radius(C.finite(F.col(volume)), C.finite(F.col(length)) * 10)
        for c in widths:
            new[f"ratio__{c}__per_radius"], new[f"ratio__{c}__per_diameter"] = C.divide_nonzero(F.col(c), radius), C.divide_nonzero(F.col(c), radius * 2)
    return df.withColumns(new) if new else df


def repeating_records(rows: DataFrame, record: str, instrument: str, instance: str, date: str, order: str, onset: str) -> DataFrame:
    """The last primary row (without instrument and instance) of each record with scan_first, the earliest date of all its rows, and index_date, the onset or that.

    ``order`` numbers the export's rows. Records without a primary row are left out, dates that aren't dates are skipped.
    """
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    day = C.parse_date(F.col(date).cast("string")).cast("date")
    grouped = rows.where(~blank(record)).groupBy(F.trim(record).alias(record))
    primary = blank(instrument) & blank(instance)
    kept = grouped.agg(F.max_by(F.when(primary, F.struct(*[F.col(c) for c in rows.columns if c != record])), F.when(primary, F.col(order))).alias("p"), F.min(day).alias("scan_first"))
    out = kept.where("p is not null").select(record, "p.*", "scan_first")
    started = C.parse_date(F.col(onset).cast("string")).cast("date")
    return out.withColumn("index_date", F.when(~blank(onset), started).otherwise(F.col("scan_first"))).withColumn("index_source", F.when(~blank(onset), onset).when(F.col("scan_first").isNotNull(), "scan").otherwise(""))


def first_pending(rows: DataFrame, order: str, key: str, done: DataFrame) -> DataFrame:
    """One row with the least ``order`` of a row whose key isn't among ``done``; the last one's where all are."""
    marked = rows.join(done.select(key).distinct().withColumn("done", F.lit(True)), key, "left")
    return marked.agg(F.coalesce(F.min(F.when(F.col("done").isNull(), F.col(order))), F.max(order)).alias("first_pending"))


def pending(rows: DataFrame, key: str, done: DataFrame) -> DataFrame:
    """Rows still to do: those whose key isn't among ``done``."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def chosen_cases(df: DataFrame, key: str, listed: Sequence, representatives: DataFrame | None, most: int) -> DataFrame:
    """At most ``most`` rows: those listed, in their order; without a list the representatives (key, rank); without either the first by key."""
    if listed:
        place = F.array_position(F.array(*[F.lit(v) for v in listed]), F.col(key))
        return df.where(place > 0).orderBy(place).limit(most)
    if representatives is not None:
        return df.join(representatives, key).orderBy("rank", key).limit(most)
    return df.orderBy(key).limit(most)


def representatives(df: DataFrame, key: str, cluster: str, features: Sequence[str], n: int) -> DataFrame:
    """(cluster, rank, key, distance) of the ``n`` rows nearest to each cluster's mean, ties by key. Centres are an aggregate, joined as broadcast: a row a cluster."""
    centre = df.groupBy(cluster).agg(*[F.avg(c).alias(f"_{c}") for c in features])
    d = F.sqrt(sum(((F.col(c) - F.col(f"_{c}")) ** 2 for c in features), F.lit(0.0)))
    near = df.join(F.broadcast(centre), cluster).select(cluster, key, d.alias("distance"))
    rank = F.row_number().over(Window.partitionBy(cluster).orderBy("distance", key))
    return near.withColumn("rank", rank).where(F.col("rank") <= n)


def spread_ranking(df: DataFrame, run: str, feature: str, value: str, n: int) -> DataFrame:
    """Of each run the ``n`` features of the widest range, then by feature: greatest and mean range, runs, and the run of the greatest."""
    ranges = df.groupBy(run, feature).agg((F.max(value) - F.min(value)).alias("range"))
    rank = F.row_number().over(Window.partitionBy(run).orderBy(F.desc("range"), feature))
    top = ranges.withColumn("rank", rank).where(F.col("rank") <= n)
    return top.groupBy(feature).agg(F.max("range").alias("max_range"), F.avg("range").alias("mean_range"), F.count("*").alias("n_runs"), F.max_by(run, F.struct("range", run)).alias("best_run"))


def flattened(df: DataFrame, keys: Sequence[str], document: str) -> DataFrame:
    """A row (keys, value) for each scalar anywhere in a JSON text, as text; nothing for texts that are no JSON.

    The text is parsed as VARIANT and opened level by level on the JVM; ``variant_explode`` gives the members of objects and arrays. Levels end when
    no value is an object or array any more; a document of depth n takes n steps.
    """
    rows = df.select(*keys, F.try_parse_json(document).alias("v")).where("v is not null")
    out = None
    while True:
        kind = F.schema_of_variant("v")
        deep = kind.startswith("OBJECT") | kind.startswith("ARRAY")
        flat = rows.where(~deep).select(*keys, F.col("v").cast("string").alias("value"))
        out = flat if out is None else out.union(flat)
        nested = rows.where(deep)
        if not nested.limit(1).count():
            return out.where("value is not null")
        rows = nested.select(*keys, "v").lateralJoin(df.sparkSession.tvf.variant_explode_outer(F.col("v").outer())).select(*keys, F.col("value").alias("v")).where("v is not null")
