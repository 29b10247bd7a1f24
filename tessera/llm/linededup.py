"""Line deduplication against levelled sorted runs of line hashes.

``LineRuns`` is a log-structured index: line key -> smallest doc_id that holds it. A batch's keys are aggregated, merge-anti-joined with
every run, and what is new becomes a run of level 0, sorted by key. When a level holds ``fanout`` runs, they are merged
into one run of the next level. Batches come in ascending doc_id, so the first owner of a key stays its owner.
Keys are 128-bit hashes: two different lines of a corpus of 10^13 lines share one with a chance of about 10^-13.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, shared_dir, slices, texts_of, unused

#: What is stripped at both ends of a line.
BLANKS = b" \t\n\r\x0b\x0c"
SHORTEST = 10


def line_keys(text: bytes, shortest: int = SHORTEST) -> list[bytes | None]:
    """A key for each line of a text in UTF-8; None for lines of fewer than ``shortest`` code points."""
    from xxhash import xxh3_128_digest

    out = []
    for line in text.split(b"\n"):
        line = line.strip(BLANKS).lower()  # of bytes: A-Z only
        n = len(line)
        out.append(xxh3_128_digest(line) if n >= 4 * shortest or (n >= shortest and len(line.decode("utf-8", "replace")) >= shortest) else None)
    return out


def keyed_lines(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """(doc_id, key): the distinct keys of each row of ``docs`` that has a doc_id."""

    def run(batches):
        for b in slices(batches, 1024, 4_000_000):
            ids, keys = [], []
            for doc, text in zip(b.column("doc_id").to_pylist(), texts_of(b, "text"), strict=True):
                found = set(line_keys(text.encode(), shortest))
                found.discard(None)
                keys += found
                ids += [doc] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], ["doc_id", "key"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null").mapInArrow(run, "doc_id long, key binary")


class LineRuns:
    """Runs of (key, owner) under ``folder``, by default a new one in the shared folder; ``LineRuns.open`` finds those of an earlier session."""

    def __init__(self, spark: SparkSession, folder: str | None = None, fanout: int = 3):
        self.spark, self.fanout, self.version = spark, fanout, 0
        self.folder = folder or f"{shared_dir(spark)}/tessera/lineruns-{uuid.uuid4().hex}"
        self.levels: list[list[str]] = [[]]

    @classmethod
    def open(cls, spark: SparkSession, folder: str, fanout: int = 3) -> LineRuns:
        runs = cls(spark, folder, fanout)
        found = spark.read.parquet(f"{folder}/manifest").collect()  # a few rows for each batch added
        runs.version = max(r.version for r in found)
        for r in sorted((r for r in found if r.version == runs.version), key=lambda r: (r.level, r.run)):
            while len(runs.levels) <= r.level:
                runs.levels.append([])
            runs.levels[r.level].append(r.run)
        return runs

    def read(self) -> DataFrame | None:
        paths = [p for level in self.levels for p in level]
        return self.spark.read.schema("key binary, owner long").parquet(*paths) if paths else None

    def _write(self, rows: DataFrame, level: int) -> None:
        path = f"{self.folder}/run-{level}-{uuid.uuid4().hex}"
        rows.sortWithinPartitions("key").write.parquet(path)
        self.levels[level].append(path)

    def add(self, lines: DataFrame) -> None:
        """Add a batch of (doc_id, key); its doc_ids are larger than those of all batches before."""
        fresh = lines.groupBy("key").agg(F.min("doc_id").alias("owner"))
        if (known := self.read()) is not None:
            fresh = fresh.join(known.hint("merge"), "key", "left_anti")
        self._write(fresh, 0)
        stale: list[str] = []
        for level in range(64):
            if len(self.levels[level]) < self.fanout:
                break
            if level + 1 == len(self.levels):
                self.levels.append([])
            runs, self.levels[level] = self.levels[level], []
            merged = self.spark.read.schema("key binary, owner long").parquet(*runs).repartition("key")
            self._write(merged, level + 1)
            stale += runs
        self.version += 1
        rows = [(self.version, level, p) for level, paths in enumerate(self.levels) for p in paths]
        self.spark.createDataFrame(rows, "version long, level int, run string").coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest")
        for p in stale:  # only once the manifest no longer names them
            where = self.spark._jvm.org.apache.hadoop.fs.Path(p)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def repeated(self, lines: DataFrame) -> DataFrame:
        """Those (doc_id, key) whose key a smaller doc_id owns; a hot key's rows are split by adaptive skew joins."""
        known = self.read()
        return lines.limit(0) if known is None else lines.join(known.hint("merge"), "key").where("doc_id > owner").select("doc_id", "key")


def dedup_lines(docs: DataFrame, *, shortest: int = SHORTEST, batches: int = 4, runs: LineRuns | None = None) -> DataFrame:
    """``docs`` with repeated lines dropped from text, and n_lines, n_dropped long.

    Lines end at newlines; a line's key is the line stripped of blanks at both ends, A-Z lower-cased. A key of at least
    ``shortest`` code points that several documents hold loses all its lines but those of the smallest doc_id; lines that repeat within
    that document stay. What stays is joined by newlines. A null or empty text is one empty line and becomes empty.
    Rows of one doc_id count as one document. Rows without a doc_id own nothing and lose nothing. An empty table gives an
    empty result. All columns of ``docs`` stay; n_lines and n_dropped replace columns of those names, whatever their case.
    """
    spark = docs.sparkSession
    clash = [c for c in docs.columns if c.lower() in ("n_lines", "n_dropped")]
    docs = docs.drop(*clash)
    lines = materialize(keyed_lines(docs, shortest), "lines")
    edges = lines.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
    edges = sorted({int(e) for e in edges})
    index = runs or LineRuns(spark)
    for low, high in zip([None, *edges], [*edges, None], strict=True):
        part = lines
        if low is not None:
            part = part.where(F.col("doc_id") > low)
        if high is not None:
            part = part.where(F.col("doc_id") <= high)
        index.add(part)
    names = docs.columns
    gone, of = unused("lost_keys", names), unused("lost_doc", names)
    lost = index.repeated(lines).groupBy(F.col("doc_id").alias(of)).agg(F.collect_set("key").alias(gone))
    # rows without a doc_id lose nothing and don't take part in the join, where they would all be one key
    named = docs.where("doc_id is not null")
    whole = named.join(lost.hint("shuffle_hash"), named["doc_id"] == lost[of], "left").select(*(named[c] for c in names), gone)
    whole = whole.union(docs.where("doc_id is null").withColumn(gone, F.lit(None).cast("array<binary>")))
    at, fields = names.index("text"), [*names, "n_lines", "n_dropped"]

    def rewrite(parts):
        for b in slices(parts, 1024, 4_000_000):
            kept, before, dropped = [], [], []
            for text, keys in zip(texts_of(b, "text"), b.column(gone).to_pylist(), strict=True):
                held = text.split("\n")
                before.append(len(held))
                if keys:
                    keys = set(keys)
                    held = [line for line, k in zip(held, line_keys(text.encode(), shortest), strict=True) if k not in keys]
                    text = "\n".join(held)
                dropped.append(before[-1] - len(held))
                kept.append(text)
            columns = [b.column(c) for c in names]
            columns[at] = pa.array(kept, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(before, pa.int64()), pa.array(dropped, pa.int64())], fields)

    schema = docs.schema.add("n_lines", "long").add("n_dropped", "long")
    return whole.mapInArrow(rewrite, schema)
