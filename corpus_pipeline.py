"""The corpus pipeline: five stages, each over all rows that the one before kept.

Between stages the rows are written as Parquet in the shared folder and read again, so each stage starts from files.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialize, table
from tessera.llm.jaccard import near_duplicates
from tessera.llm.linededup import dedup_lines
from tessera.llm.packing import pack
from tessera.llm.quality import score_quality
from tessera.llm.surrogates import replace_personal

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _sized(docs: DataFrame) -> DataFrame:
    """The columns of documents, n_chars of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    scored = score_quality(docs, table(spark, sf_dir, "labels"), keep=COLUMNS)
    return scored.where("predicted = 1").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; a document of which nothing is left goes, too."""
    kept = dedup_lines(docs)
    return _sized(kept.where("n_dropped = 0 or text <> ''"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (sets of five words, similarity 0.8 at least) stays: that of the smallest doc_id.

    Rows are numbered in a table of their own first, so of rows that share a doc_id each stays or goes by its own text. Rows without words or
    without a doc_id are in no group and stay.
    """
    numbered = materialize(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), "numbered")
    others = near_duplicates(numbered, grams=5, num=4, den=5, row="row").where("not first").select("row")
    return numbered.join(others.hint("shuffle_hash"), "row", "left_anti").select(*COLUMNS)


def personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to surrogates."""
    return _sized(replace_personal(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 2048 tokens."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [("quality", quality), ("line dedup", lines), ("near duplicates", near), ("personal data", personal), ("packing", packing)]

#: The classifier, the surrogates and the packing have no form in SQL; tests hold each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
