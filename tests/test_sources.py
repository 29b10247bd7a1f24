"""Files in, files out, and streams driven to their end."""

import struct

import pytest
from pyspark.sql import functions as F

from tessera.sources import tables as T
from tessera.streaming import logs as L


def test_manifest(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_text("case_id,image_path\nc1,/a/c1.nii.gz\n,/a/sub-07_ct.nii.gz\n,\n")
    assert sorted(r.case_id for r in T.read_manifest(spark, str(p)).collect()) == ["c1", "sub-07"]
    assert [r.case_id for r in T.read_manifest(spark, str(p), only=["c1"]).collect()] == ["c1"]
    with pytest.raises(ValueError, match="lacks mask"):
        T.read_manifest(spark, str(p), required=("case_id", "mask"))


def test_parts_and_sinks(spark, tmp_path):
    for case in ("a", "b"):
        (tmp_path / case).mkdir()
        (tmp_path / case / "f.csv").write_text(f"case_id,v\n{case},1\n")
    df = T.read_parts(spark, f"{tmp_path}/*/f.csv")
    assert sorted((r.case_id, r.source_file[-7:]) for r in df.collect()) == [("a", "a/f.csv"), ("b", "b/f.csv")]
    T.write_table(df, f"{tmp_path}/out", "csv")
    T.append_log(df, f"{tmp_path}/log")
    T.append_log(df, f"{tmp_path}/log")
    assert spark.read.json(f"{tmp_path}/log").count() == 4
    assert T.file_manifest(spark, f"{tmp_path}/a/f.csv").first().bytes == 14


def test_documents(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"case_id": "x", "lesions": [{"status": null, "volume": 3.0}, {"status": "bad", "volume": 9.0}, {"status": null, "volume": 0.5}]}')
    df = T.read_documents(spark, f"{tmp_path}/r.json", "case_id string, lesions array<struct<status:string,volume:double>>")
    assert df.select(T.real_entries(F.col("lesions"), 1.0)).first()[0] == 1


def test_image_header(spark, tmp_path):
    head = bytearray(352)
    struct.pack_into("<4h", head, 40, 3, 10, 20, 30)
    struct.pack_into("<4f", head, 76, 1.0, 0.5, 0.5, 2.0)
    (tmp_path / "a.nii").write_bytes(bytes(head))
    r = T.nifti_headers(spark, f"{tmp_path}/a.nii").first()
    assert r.shape == [10, 20, 30] and r.spacing == [0.5, 0.5, 2.0]


def test_streams(spark, tmp_path):
    rows = [(i, i % 3, (i * 5) % 7) for i in range(60)]
    df = spark.createDataFrame(rows, "seq long, user long, idx long").withColumn("at", F.timestamp_seconds(F.col("seq") * 60)).withColumn("v", F.lit(1.0))
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = L.read_stream(spark, f"{tmp_path}/in", df.schema)
    got = L.run_once(L.latest_status(stream, "user", "seq", ["seq", "idx"]), "latest_rows", "complete")
    assert sorted((r.user, r.seq) for r in got.collect()) == [(0, 57), (1, 58), (2, 59)]
    got = L.run_once(L.windowed(stream, "at", ["user"], "v", "10 minutes", "1 minute"), "win", "complete")
    assert sum(r.n for r in got.collect()) == 60
    got = L.run_once(L.pass_counter(stream.withColumn("__seq", F.col("seq")), "user", "idx"), "passes", "update")
    last = {u: [i for s, v, i in rows if v == u] for u in range(3)}
    want = {u: 1 + sum(b < a for a, b in zip(x, x[1:], strict=False)) for u, x in last.items()}
    assert {r.user: r.passes for r in got.collect()} == want


def test_stalls(spark, tmp_path):
    import time

    spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v int").write.parquet(f"{tmp_path}/in")
    events = spark.readStream.schema("k string, v int").parquet(f"{tmp_path}/in")
    query = L.stalls(events, "k", "2 seconds").writeStream.outputMode("update").format("memory").queryName("stalls").trigger(processingTime="500 milliseconds").option("checkpointLocation", f"{tmp_path}/c").start()
    try:
        for _ in range(60):
            got = {(r.k, r.events, r.stalled) for r in spark.table("stalls").collect()}
            if len(got) == 4:
                break
            time.sleep(1)
    finally:
        query.stop()
    assert got == {("a", 2, False), ("b", 1, False), ("a", 2, True), ("b", 1, True)}
