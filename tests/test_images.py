"""Volumes written byte by byte and read back; series, spaces, feature tables and artifacts."""

import gzip
import hashlib
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.sources import config as CF
from tessera.sources import images as I
from tessera.sources import tables as T


def nifti(x, spacing=(1.0, 2.0, 3.0), origin=(10.0, -5.0, 0.0), slope=0.0, intercept=0.0, matrix=False):
    kind = {"int16": 4, "uint8": 2, "float32": 16}[x.dtype.name]
    h = bytearray(352)
    struct.pack_into("<i", h, 0, 348)
    struct.pack_into("<8h", h, 40, 3, *x.shape[::-1], 1, 1, 1, 1)
    struct.pack_into("<2h", h, 70, kind, x.dtype.itemsize * 8)
    struct.pack_into("<4f", h, 76, 1.0, *spacing)
    struct.pack_into("<3f", h, 108, 352.0, slope, intercept)
    struct.pack_into("<2h", h, 252, 1, 1 if matrix else 0)
    struct.pack_into("<3f", h, 268, *origin)
    for i in range(3):
        struct.pack_into("<4f", h, 280 + 16 * i, *(spacing[i] if i == j else 0.0 for j in range(3)), origin[i])
    h[344:348] = b"n+1\0"
    return bytes(h) + x.tobytes()


def element(group, number, form, value, explicit=True):
    value += b"\0" * (len(value) % 2)
    if not explicit:
        return struct.pack("<HHI", group, number, len(value)) + value
    if form in I.LONG_FORMS:
        return struct.pack("<HH2sHI", group, number, form, 0, len(value)) + value
    return struct.pack("<HH2sH", group, number, form, len(value)) + value


def dicom(sop, uid, instance, z, pixels, explicit=True, modality="CT", extra=b""):
    e = lambda g, n, f, v: element(g, n, f, v, explicit)
    syntax = b"1.2.840.10008.1.2.1" if explicit else b"1.2.840.10008.1.2"
    body = e(8, 0x18, b"UI", sop.encode()) + e(8, 0x60, b"CS", modality.encode()) + e(8, 0x103E, b"LO", b"Head CTA") + extra + e(0x20, 0xE, b"UI", uid.encode())
    body += e(0x20, 0x13, b"IS", str(instance).encode()) if instance is not None else b""
    body += e(0x20, 0x32, b"DS", f"0\\0\\{z}".encode()) if z is not None else b""
    body += e(0x28, 0x10, b"US", struct.pack("<H", pixels.shape[0])) + e(0x28, 0x11, b"US", struct.pack("<H", pixels.shape[1])) + e(0x28, 0x100, b"US", struct.pack("<H", 16)) + e(0x28, 0x103, b"US", struct.pack("<H", 1))
    body += e(0x28, 0x1052, b"DS", b"-1000") + e(0x28, 0x1053, b"DS", b"2") + e(0x7FE0, 0x10, b"OW", pixels.astype("<i2").tobytes())
    return b"\0" * 128 + b"DICM" + element(2, 0x10, b"UI", syntax) + body


def test_nifti(spark, tmp_path):
    x = np.arange(24, dtype=np.int16).reshape(2, 3, 4) - 5
    (tmp_path / "a.nii").write_bytes(nifti(x))
    (tmp_path / "b.nii.gz").write_bytes(gzip.compress(nifti(x.astype(np.float32), slope=2.0, intercept=1.0, matrix=True)))
    (tmp_path / "c.txt").write_bytes(b"no image")
    (tmp_path / "empty.nii").write_bytes(b"")
    with zipfile.ZipFile(tmp_path / "d.zip", "w") as z:
        z.writestr("in/e.nii", nifti((x > 0).astype(np.uint8)))
    got = {r.path.rsplit("/", 1)[-1]: r for r in I.headers(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.nii", "b.nii.gz", "e.nii"}
    assert all(r.shape == [4, 3, 2] and r.spacing == [1.0, 2.0, 3.0] and r.origin == [10.0, -5.0, 0.0] for r in got.values())
    v = {}
    for r in I.voxels(spark, str(tmp_path)).collect():
        v.setdefault(r.path.rsplit("/", 1)[-1], {})[r.z, r.y, r.x] = r.hu
    assert v["a.nii"] == {k: float(x[k]) for k in np.ndindex(x.shape)} and v["b.nii.gz"] == {k: 2.0 * x[k] + 1 for k in np.ndindex(x.shape)}
    mask = I.voxels(spark, f"{tmp_path}/d.zip", above=0).collect()
    assert {(r.z, r.y, r.x) for r in mask} == {tuple(map(int, k)) for k in np.argwhere(x > 0)}


def test_dicom_series(spark, tmp_path):
    p = np.arange(6).reshape(2, 3)
    nested = struct.pack("<HH2sHI", 0x0008, 0x1140, b"SQ", 0, 0xFFFFFFFF) + b"\xfe\xff\x00\xe0\xff\xff\xff\xff" + b"\xfe\xff\x0d\xe0\0\0\0\0" + b"\xfe\xff\xdd\xe0\0\0\0\0"
    for name, raw in {
        "b.dcm": dicom("1", "9.9", 1, 30.0, p + 1, extra=nested), "a.dcm": dicom("2", "9.9", 2, 20.0, p + 2), "again.dcm": dicom("2", "9.9", 2, None, p + 50), "c.dcm": dicom("3", "9.9", 3, 10.0, p + 3, explicit=False),
        "o1.dcm": dicom("7", "8.8", 2, None, p), "o2.dcm": dicom("8", "8.8", 1, None, p), "mr.dcm": dicom("5", "7.7", 1, 0.0, p, modality="MR"), "none.dcm": dicom("6", "", 1, 0.0, p), "no.txt": b"nothing at all",
    }.items():
        (tmp_path / name).write_bytes(raw)
    files = I.dicom_files(spark, str(tmp_path))
    assert files.count() == 8
    assert {(r.series_uid, r.n_files, r.description) for r in I.series(files).collect()} == {("9.9", 4, "Head CTA"), ("8.8", 2, "Head CTA")}
    order = I.ordered_files(files.where("series_uid in ('9.9', '8.8')"))
    got = {(r.series_uid, r.order): (r.path.rsplit("/", 1)[-1], r.ordered_by) for r in order.collect()}
    assert got == {("9.9", 1): ("c.dcm", "z"), ("9.9", 2): ("a.dcm", "z"), ("9.9", 3): ("b.dcm", "z"), ("8.8", 1): ("o2.dcm", "instance"), ("8.8", 2): ("o1.dcm", "instance")}
    v = {(r.z, r.y, r.x): r.hu for r in I.dicom_voxels(spark, str(tmp_path), order.where("series_uid = '9.9'")).collect()}
    assert len(v) == 18 and v[0, 0, 0] == 2 * 3 - 1000 and v[2, 1, 2] == 2 * 6 - 1000


@pytest.mark.parametrize("spacing,origin,shape", [((1.0, 1.0, 1.0), (0.0, 0.0, 0.0), (6, 6, 6)), ((0.5, 2.0, 1.0), (0.25, 0.5, 0.0), (12, 4, 7)), ((3.0, 1.0, 0.4), (-1.0, 2.0, 0.3), (3, 3, 9))])
def test_resampling(spark, spacing, origin, shape):
    mask = [(z, y, x) for z in range(5) for y in range(5) for x in range(5) if (z + 2 * y + x) % 3 == 0]
    df = spark.createDataFrame([(1, *v) for v in mask], "c int, z int, y int, x int")
    head = lambda s, o, n: spark.createDataFrame([(1, [*map(float, s)], [*map(float, o)], list(n))], "c int, spacing array<double>, origin array<double>, shape array<int>")
    own = head((1, 1, 1), (0, 0, 0), (5, 5, 5))
    got = {(r.z, r.y, r.x) for r in I.resampled(df, own, head(spacing, origin, shape), "c").collect()}
    want = set()
    for z, y, x in np.ndindex(shape[::-1]):
        at = [origin[i] + v * spacing[i] for i, v in enumerate((x, y, z))]
        i, j, k = (int(np.floor(a + 0.5)) for a in at)
        if (k, j, i) in set(mask):
            want.add((z, y, x))
    assert got == want
    assert I.same_space(own, head(spacing, origin, shape), "c").first().same is False and I.same_space(own, own, "c").first().same


def test_feature_tables(spark, tmp_path):
    (tmp_path / "long.csv").write_text("case_id,feature_name,feature_value,region\n1,vol,3.5,aorta\n2,vol,x,aorta\n2,vol,7,aorta\n")
    (tmp_path / "wide.csv").write_text("case_id,a b,c\n1,2,nan\n3,,4\n")
    (tmp_path / "other.csv").write_text("id,v\n1,2\n")
    rows = T.feature_tables(spark, [f"{tmp_path}/{n}.csv" for n in ("long", "wide", "other", "absent")])
    got = sorted((r.case_id, r.region, r.feature_name, r.feature_value, r.feature_group) for r in rows.where("feature_value is not null").collect())
    assert got == [("1", "", "a b", 2.0, "wide_or_qc"), ("1", "aorta", "vol", 3.5, ""), ("2", "aorta", "vol", 7.0, ""), ("3", "", "c", 4.0, "wide_or_qc")] and rows.count() == 7
    wide = {r.case_id: r for r in T.modeling_wide(spark, str(tmp_path), ["long.csv", "absent.csv"]).collect()}
    assert wide["1"]["aorta__vol"] == 3.5 and wide["2"]["aorta__vol"] == 7.0
    assert T.feature_tables(spark, [f"{tmp_path}/absent.csv"]).count() == 0


def test_cases_artifacts_and_activity(spark, tmp_path):
    out = tmp_path / "outputs"
    for c in ("c1", "c2"):
        (out / c).mkdir(parents=True)
        (out / c / "mask.nii").write_bytes(b"x")
    (tmp_path / "clinical.csv").write_text("case_id,age\nc1,70\n")
    assert sorted((r.case_id, r.age) for r in T.case_table(spark, None, f"{tmp_path}/clinical.csv", str(out)).collect()) == [("c1", "70"), ("c2", None)]
    (tmp_path / "m.csv").write_text("case_id,image_path,age\nc1,/a/c1.nii,1\n")
    assert T.case_table(spark, f"{tmp_path}/m.csv", f"{tmp_path}/clinical.csv", str(out)).columns == ["case_id", "image_path", "age", "age_clinical"]
    written = tmp_path / "tables"
    assert len(T.write_all({"b": spark.range(3).coalesce(1), "a": spark.range(5).coalesce(1)}, str(written))) == 2
    got = {r.artifact: (r.files, r.rows) for r in T.artifact_manifest(spark, str(written)).collect()}
    assert got == {"a": (1, 5), "b": (1, 3)}
    f = T.fingerprint(spark, f"{tmp_path}/m.csv", T.read_text_csv(spark, f"{tmp_path}/m.csv")).first()
    digest = hashlib.sha256((tmp_path / "m.csv").read_bytes()).hexdigest()
    assert (f.rows, f.columns, f.bytes, f.sha256) == (1, 3, (tmp_path / "m.csv").stat().st_size, hashlib.sha256(digest.encode()).hexdigest())
    quiet = T.latest_activity(spark, str(out), F.current_timestamp() + F.expr("interval 1 hour"), 600).first()
    assert quiet.stalled and not T.latest_activity(spark, str(out), None, 3600).first().stalled and T.latest_activity(spark, f"{tmp_path}/nothing").first().latest is None


def test_enumeration_completeness_and_providers(spark):
    images = spark.createDataFrame([("/i/sub-1_ct.nii.gz",), ("/i/sub-2_ct.nii.gz",)], "path string")
    masks = spark.createDataFrame([("/m/sub-1_la.nii.gz",), ("/m/sub-1_laa.nii.gz",), ("/m/sub-2_x.nii.gz",)], "path string")
    got = T.enumerated(images, masks, {"la": "_la.nii.gz", "laa": "_laa.nii.gz"})
    assert {(r.case_id, r.region) for r in got.collect()} == {("sub-1", "la"), ("sub-1", "laa")} and T.enumerated(images, masks, {"la": "_la.nii.gz"}, ["sub-2"]).count() == 0
    rows = spark.createDataFrame([(1, "2", " ", None), (2, None, "3", "4"), (3, "1", None, "x")], "id int, a__x string, a__y string, b__x string")
    assert [r.id for r in T.complete_rows(rows, ["a__", "b__"]).orderBy("id").collect()] == [2, 3] and T.complete_rows(rows, ["z__"]).count() == 0
    cases = spark.createDataFrame([(i,) for i in range(4)], "k int")
    give = lambda rows: spark.createDataFrame(rows, "k int, v double")
    got = {r.k: (r.v, r.provider) for r in T.first_provider(cases, "k", "v", [("first", give([(0, 1.0), (1, None)])), ("second", give([(0, 5.0), (1, 2.0), (2, 3.0)]))]).collect()}
    assert got == {0: (1.0, "first"), 1: (2.0, "second"), 2: (3.0, "second"), 3: (None, "")}


def test_configuration(tmp_path):
    (tmp_path / "c.json").write_text('{"a": {"b": 1, "c": [1]}, "d": "x"}')
    base = CF.load(str(tmp_path / "c.json"))
    assert CF.overridden(base, ["a.b=2.5", "a.e.f=true", "d=plain text"]) == {"a": {"b": 2.5, "c": [1], "e": {"f": True}}, "d": "plain text"} and base["a"]["b"] == 1
    assert CF.merged({"a": {"b": 1}}, {"a": 3}) == {"a": 3} and CF.config_hash({"a": 1, "b": 2}) == CF.config_hash({"b": 2, "a": 1}) != CF.config_hash({"a": 1})
    with pytest.raises(ValueError):
        CF.overridden({}, ["nothing"])
    (tmp_path / "l.json").write_text("[1]")
    with pytest.raises(ValueError):
        CF.load(str(tmp_path / "l.json"))
