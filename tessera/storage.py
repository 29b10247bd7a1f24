"""Working data between jobs: Parquet in the folder that all machines share.

What a later job reads again goes to the folder in ``spark.checkpoint.dir``, so a lost executor costs a re-read and never a file that only one machine had.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; where none is named and all runs on one machine, one of our own."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master) is None:
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        named = "file://" + os.path.join(tempfile.gettempdir(), f"tessera-work-{os.getuid()}")
    return named.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.tessera_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete what ``materialize`` wrote for ``tables``; nothing that is still to be run may read them."""
    for df in tables:
        session = df.sparkSession
        where = session._jvm.org.apache.hadoop.fs.Path(df.tessera_path)
        where.getFileSystem(session._jsc.hadoopConfiguration()).delete(where, True)
