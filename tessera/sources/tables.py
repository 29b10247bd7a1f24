"""Scans and sinks: CSV and JSON tables, manifests, unions of part files, append logs, fingerprints and image headers.

Schemas are given, never inferred; every path is opened by Spark's readers, so any file system that Spark knows will do.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clean import case_id, to_number
from ..operators.reshape import composite_key, long_to_wide
from ..operators.windows import latest


def read_text_csv(spark: SparkSession, path: str | list[str], columns: Sequence[str] | None = None) -> DataFrame:
    """CSV with a header, every cell a string; with ``columns`` only those, in that order."""
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE").option("multiLine", True).option("escape", '"')
    df = reader.csv(path)
    return df.select(*columns) if columns else df


def read_parts(spark: SparkSession, pattern: str) -> DataFrame:
    """All CSV files of a pattern by name of column, with the file each row came from; empty files add nothing."""
    df = spark.read.option("header", True).option("enforceSchema", False).csv(pattern)
    return df.select("*", F.col("_metadata.file_path").alias("source_file"))


def read_manifest(spark: SparkSession, path: str, required: Sequence[str] = ("case_id", "image_path"), only: Sequence[str] | None = None) -> DataFrame:
    """A manifest: required columns are checked, blank rows go, a blank case_id is taken from the image path, ``only`` keeps some cases."""
    df = read_text_csv(spark, path)
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"manifest {path} lacks {', '.join(missing)}")
    df = df.where(F.coalesce(F.nullif(F.trim("case_id"), F.lit("")), F.nullif(F.trim("image_path"), F.lit(""))).isNotNull())
    df = df.withColumn("case_id", F.coalesce(F.nullif(F.trim("case_id"), F.lit("")), case_id(F.col("image_path"))))
    return df.where(F.col("case_id").isin(*only)) if only else df


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents, one a file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def real_entries(entries, least: float):
    """How many entries of array<struct<status, volume>> have no status and more than ``least`` volume."""
    return F.size(F.filter(entries, lambda e: e["status"].isNull() & (e["volume"] > least)))


def write_table(df: DataFrame, path: str, form: str = "parquet", mode: str = "overwrite") -> None:
    writer = df.write.mode(mode).format(form)
    (writer.option("header", True) if form == "csv" else writer).save(path)


def append_log(df: DataFrame, path: str) -> None:
    """Append events as JSON lines."""
    df.write.mode("append").json(path)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new`` in place of those of ``old`` with the same keys."""
    both = old.withColumn("__v", F.lit(0)).unionByName(new.withColumn("__v", F.lit(1)), allowMissingColumns=True)
    return latest(both, keys, ["__v"]).drop("__v")


def file_manifest(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, bytes, sha256) of files."""
    return spark.read.format("binaryFile").load(pattern).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def nifti_headers(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, shape, spacing) of uncompressed little-endian NIfTI-1 files, decoded from the header's bytes."""
    import struct

    import pandas as pd

    def decode(batches):
        for b in batches:
            shape, spacing = [], []
            for c in b["content"]:
                n = struct.unpack_from("<h", c, 40)[0]
                shape.append(list(struct.unpack_from(f"<{n}h", c, 42)))
                spacing.append([float(x) for x in struct.unpack_from(f"<{n}f", c, 80)])
            yield pd.DataFrame({"path": b["path"], "shape": shape, "spacing": spacing})

    return spark.read.format("binaryFile").load(pattern).select("path", F.substring("content", 1, 352).alias("content")).mapInPandas(decode, "path string, shape array<int>, spacing array<double>")


def score_series(df: DataFrame, text: str, files: str, good: Sequence[tuple[str, int]], bad: Sequence[str], penalty: int = 80):
    """Weighted words in a text plus a twentieth of the files, at most 2000 of them; each bad word costs ``penalty``."""
    t = F.lower(F.coalesce(F.col(text), F.lit("")))
    out = F.floor(F.least(F.col(files), F.lit(2000)) / 20)
    for w, v in good:
        out = out + F.when(t.contains(w), v).otherwise(0)
    for w in bad:
        out = out - F.when(t.contains(w), penalty).otherwise(0)
    return df.withColumn("series_score", out)


# ---------------------------------------------------------------- features, cases, artifacts and activity
FEATURE_COLUMNS = ("region", "feature_group", "feature_name", "feature_value", "threshold_if_applicable", "mask_name")


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where))


def feature_tables(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(case_id, region, feature_group, feature_name, feature_value, threshold_if_applicable, mask_name, source_feature_file) of CSV files that are long, or wide and then unpivoted.

    Files that aren't there, are empty or lack case_id add nothing; values that are no numbers are NULL.
    """
    out = None
    for p in paths:
        if not _exists(spark, p):
            continue
        df = spark.read.option("header", True).csv(p)
        if "case_id" not in df.columns:
            continue
        if {"feature_name", "feature_value"} <= set(df.columns):
            rows = df.select("case_id", *[F.col(c) if c in df.columns else F.lit("").alias(c) for c in FEATURE_COLUMNS])
        else:
            names = [c for c in df.columns if c != "case_id"]
            long = df.select("case_id", *[F.col(f"`{c}`").cast("string").alias(c) for c in names]).unpivot("case_id", names, "feature_name", "feature_value")
            fixed = {"region": "", "feature_group": "wide_or_qc", "threshold_if_applicable": "", "mask_name": ""}
            rows = long.select("case_id", *[F.lit(fixed[c]).alias(c) if c in fixed else F.col(c) for c in FEATURE_COLUMNS])
        rows = rows.withColumn("feature_value", to_number(F.col("feature_value"))).withColumn("source_feature_file", F.lit(p))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return spark.createDataFrame([], "case_id string, region string, feature_group string, feature_name string, feature_value double, threshold_if_applicable string, mask_name string, source_feature_file string")
    return out


def modeling_wide(spark: SparkSession, folder: str, files: Sequence[str], names: Sequence[str] | None = None) -> DataFrame:
    """Long files of a folder that are there, by name, as one row a case with ``region__feature`` columns, NULL where a case lacks one; the first value of several."""
    long = feature_tables(spark, [f"{folder}/{f}" for f in files])
    long = long.withColumn("_name", composite_key(F.col("region"), F.col("feature_name"), F.col("threshold_if_applicable")))
    names = list(names) if names is not None else sorted(r[0] for r in long.select("_name").distinct().collect())  # as many as columns
    return long_to_wide(long, ["case_id"], "_name", "feature_value", "source_feature_file", names) if names else long.select("case_id").distinct()


def case_table(spark: SparkSession, manifest: str | None, clinical: str | None, outputs: str) -> DataFrame:
    """Cases of a manifest, or where there is none the folders of ``outputs``, with clinical columns joined by case_id; clinical names that clash get the suffix _clinical."""
    if manifest is not None:
        cases = read_manifest(spark, manifest)
    else:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(outputs).select(F.regexp_extract("path", rf"{outputs.rstrip('/').rsplit('/', 1)[-1]}/([^/]+)/", 1).alias("case_id"))
        cases = found.where("case_id <> ''").distinct()
    if clinical is None:
        return cases
    extra = read_text_csv(spark, clinical)
    renamed = {c: f"{c}_clinical" for c in extra.columns if c != "case_id" and c in cases.columns}
    return cases.join(extra.withColumnsRenamed(renamed), "case_id", "left")


def write_all(tables: dict[str, DataFrame], folder: str, form: str = "csv") -> list[str]:
    """Write named tables beneath a folder; the paths in order of names."""
    paths = []
    for name in sorted(tables):
        write_table(tables[name], f"{folder}/{name}", form)
        paths.append(f"{folder}/{name}")
    return paths


def artifact_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(artifact, files, bytes, rows, sha256) of the CSV tables beneath a folder: rows without headers, and a hash over the part files' hashes in order of name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(folder)
    name = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    lines = F.greatest(F.length(F.col("content").cast("string")) - F.length(F.replace(F.col("content").cast("string"), F.lit("\n"), F.lit(""))) - 1, F.lit(0))
    each = files.select(name.alias("artifact"), "path", F.col("length").alias("bytes"), lines.alias("rows"), F.sha2("content", 256).alias("hash"))
    parts = F.sort_array(F.collect_list(F.struct("path", "hash")))
    return each.groupBy("artifact").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"), F.sha2(F.array_join(F.transform(parts, lambda p: p["hash"]), ""), 256).alias("sha256"))


def fingerprint(spark: SparkSession, path: str, df: DataFrame) -> DataFrame:
    """One row (path, bytes, rows, columns, sha256) of an input file or folder and the table read from it."""
    files = file_manifest(spark, path)
    parts = F.sort_array(F.collect_list(F.struct("path", "sha256")))
    whole = files.agg(F.sum("bytes").alias("bytes"), F.sha2(F.array_join(F.transform(parts, lambda p: p["sha256"]), ""), 256).alias("sha256"))
    return whole.crossJoin(df.agg(F.count("*").alias("rows"))).select(F.lit(path).alias("path"), "bytes", "rows", F.lit(len(df.columns)).alias("columns"), "sha256")  # one row each


def latest_activity(spark: SparkSession, pattern: str, now=None, quiet_seconds: float = 0.0) -> DataFrame:
    """One row (latest, age_seconds, stalled): the newest change of any file, and whether it is older than ``quiet_seconds``; NULLs without files."""
    if not _exists(spark, pattern):
        return spark.createDataFrame([(None, None, None)], "latest timestamp, age_seconds double, stalled boolean")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(pattern)
    age = (F.unix_micros(now if now is not None else F.current_timestamp()) - F.unix_micros("latest")) / 1e6
    return files.agg(F.max("modificationTime").alias("latest")).withColumn("age_seconds", age).withColumn("stalled", F.col("age_seconds") > quiet_seconds)


def enumerated(images: DataFrame, masks: DataFrame, regions: dict[str, str], wanted: Sequence[str] | None = None) -> DataFrame:
    """(case_id, region, image_path, mask_path): images (path) with the masks (path) whose file name ends in a region's suffix, joined by case id."""
    named = images.select(case_id(F.col("path")).alias("case_id"), F.col("path").alias("image_path"))
    region = F.coalesce(*[F.when(F.col("path").endswith(s), F.lit(r)) for r, s in regions.items()])
    found = masks.select(case_id(F.col("path")).alias("case_id"), region.alias("region"), F.col("path").alias("mask_path")).where("region is not null")
    out = named.join(found, "case_id")
    return out.where(F.col("case_id").isin(*wanted)) if wanted else out


def complete_rows(df: DataFrame, prefixes: Sequence[str]) -> DataFrame:
    """Rows that have a value under each prefix: nothing is left to do for them."""
    out = df
    for p in prefixes:
        names = [c for c in df.columns if c.startswith(p)]
        out = out.where(F.coalesce(*[F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")) for c in names]).isNotNull()) if names else out.limit(0)
    return out


def first_provider(cases: DataFrame, key: str, value: str, providers: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """``cases`` with ``value`` of the first provider that has one for the case, and ``provider``, its name; NULL and "" without any."""
    out = cases
    for i, (_, df) in enumerate(providers):
        out = out.join(df.select(key, F.col(value).alias(f"_v{i}")), key, "left")
    names = F.coalesce(*[F.when(F.col(f"_v{i}").isNotNull(), F.lit(n)) for i, (n, _) in enumerate(providers)], F.lit(""))
    return out.select(*cases.columns, F.coalesce(*[F.col(f"_v{i}") for i in range(len(providers))]).alias(value), names.alias("provider"))
