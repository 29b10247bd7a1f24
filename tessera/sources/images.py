"""Images as tables: NIfTI volumes and DICOM files through Spark's binary reader, headers, series, voxels and spaces.

A file is decoded in the task that reads it, and leaves it slice by slice as Arrow batches. Supported are NIfTI-1 (single file, little-endian, also
gzipped) and DICOM with explicit or implicit little-endian syntax and uncompressed pixels. Files in ZIP archives are read like others.
"""

from __future__ import annotations

import gzip
import io
import struct
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed values of the formats: element types of NIfTI, tags of DICOM that are read, and its representations with long lengths.
NIFTI_TYPES = {2: "u1", 4: "<i2", 8: "<i4", 16: "<f4", 64: "<f8", 256: "i1", 512: "<u2", 768: "<u4"}
DICOM_TAGS = {
    (0x0008, 0x0018): "sop_uid", (0x0008, 0x0060): "modality", (0x0020, 0x000E): "series_uid", (0x0008, 0x103E): "description", (0x0020, 0x0013): "instance",
    (0x0020, 0x0032): "position", (0x0028, 0x0030): "pixel_spacing", (0x0018, 0x0050): "thickness", (0x0028, 0x0010): "rows", (0x0028, 0x0011): "columns",
    (0x0028, 0x0100): "bits", (0x0028, 0x0103): "signed", (0x0028, 0x1052): "intercept", (0x0028, 0x1053): "slope",
}
LONG_FORMS = (b"OB", b"OD", b"OF", b"OL", b"OW", b"SQ", b"UC", b"UN", b"UR", b"UT")
HEADERS = "path string, shape array<int>, spacing array<double>, origin array<double>, kind int, slope double, intercept double"
VOXELS = "path string, z int, y int, x int, hu double"
FILES = "path string, sop_uid string, modality string, series_uid string, description string, instance int, position array<double>, pixel_spacing array<double>, thickness double"


def contents(path: str, raw: bytes) -> Iterator[tuple[str, bytes]]:
    """(path, bytes) of a file, unpacked if it is gzipped, or of each file of a ZIP archive."""
    if raw[:4] == b"PK\x03\x04":
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            for name in sorted(z.namelist()):
                if not name.endswith("/"):
                    yield from contents(f"{path}!{name}", z.read(name))
    else:
        yield path, gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw


def nifti_header(raw: bytes) -> dict | None:
    """Shape and spacing in x, y, z, the first voxel's position, element type and scaling; None for other files."""
    if len(raw) < 352 or raw[344:347] not in (b"n+1", b"ni1") or struct.unpack_from("<i", raw, 0)[0] != 348:
        return None
    n = struct.unpack_from("<h", raw, 40)[0]
    slope, intercept = struct.unpack_from("<2f", raw, 112)
    if struct.unpack_from("<h", raw, 254)[0] > 0:  # a matrix by rows; the last column is the position
        origin = [struct.unpack_from("<4f", raw, 280 + 16 * i)[3] for i in range(3)]
    else:
        origin = list(struct.unpack_from("<3f", raw, 268))
    return {
        "shape": [int(v) for v in struct.unpack_from(f"<{n}h", raw, 42)][:3],
        "spacing": [float(v) for v in struct.unpack_from(f"<{n}f", raw, 80)][:3],
        "origin": [float(v) for v in origin],
        "kind": int(struct.unpack_from("<h", raw, 70)[0]),
        "slope": float(slope) if slope else 1.0,
        "intercept": float(intercept) if slope else 0.0,
        "offset": int(struct.unpack_from("<f", raw, 108)[0]),
    }


def nifti_array(raw: bytes) -> np.ndarray | None:
    """Values in z, y, x, scaled."""
    h = nifti_header(raw)
    if h is None or h["kind"] not in NIFTI_TYPES:
        return None
    nx, ny, nz = (h["shape"] + [1, 1, 1])[:3]
    x = np.frombuffer(raw, NIFTI_TYPES[h["kind"]], nx * ny * nz, h["offset"]).reshape(nz, ny, nx)
    return x * h["slope"] + h["intercept"] if (h["slope"], h["intercept"]) != (1.0, 0.0) else x


def dicom_elements(raw: bytes, pixels: bool = False) -> dict | None:
    """The values of ``DICOM_TAGS`` and, if asked for, the pixels in y, x; None for files that aren't DICOM."""
    if raw[128:132] != b"DICM":
        return None
    at, explicit, out = 132, True, {}
    while at + 8 <= len(raw):
        group, element = struct.unpack_from("<HH", raw, at)
        if group == 2 or explicit:
            form = raw[at + 4 : at + 6]
            if form in LONG_FORMS:
                size, start = struct.unpack_from("<I", raw, at + 8)[0], at + 12
            else:
                size, start = struct.unpack_from("<H", raw, at + 6)[0], at + 8
        else:
            form, (size,), start = b"", struct.unpack_from("<I", raw, at + 4), at + 8
        if (group, element) == (0x7FE0, 0x0010):
            if pixels and size != 0xFFFFFFFF:
                kind = "<i2" if out.get("signed") else "<u2"
                ny, nx = out["rows"], out["columns"]
                out["pixels"] = np.frombuffer(raw, kind if out.get("bits", 16) == 16 else "u1", ny * nx, start).reshape(ny, nx)
            break
        if size == 0xFFFFFFFF:  # a sequence without a length: on to its end
            end = raw.find(b"\xfe\xff\xdd\xe0\x00\x00\x00\x00", start)
            if end < 0:
                break
            at = end + 8
            continue
        value = raw[start : start + size]
        if (group, element) == (0x0002, 0x0010):
            explicit = value.rstrip(b"\0 ") != b"1.2.840.10008.1.2"
        name = DICOM_TAGS.get((group, element))
        if name in ("rows", "columns", "bits", "signed"):
            out[name] = struct.unpack_from("<H", value)[0]
        elif name:
            text = value.rstrip(b"\0 ").decode("latin-1").strip()
            try:
                out[name] = text if name in ("sop_uid", "modality", "series_uid", "description") else [float(v) for v in text.split("\\")] if name in ("position", "pixel_spacing") else float(text)
            except ValueError:
                out[name] = None
        at = start + size
    return out


def _binary(spark: SparkSession, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").load(pattern).select("path", "content")


def _files(batches) -> Iterator[tuple[str, bytes]]:
    for b in batches:
        for path, raw in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
            yield from contents(path, raw)


def headers(spark: SparkSession, pattern: str) -> DataFrame:
    """``HEADERS`` of NIfTI files; others are left out."""

    def decode(batches):
        for path, raw in _files(batches):
            if h := nifti_header(raw):
                yield pa.RecordBatch.from_pylist([{"path": path, **{k: h[k] for k in ("shape", "spacing", "origin", "kind", "slope", "intercept")}}], schema)

    schema = pa.schema([("path", pa.string()), ("shape", pa.list_(pa.int32())), ("spacing", pa.list_(pa.float64())), ("origin", pa.list_(pa.float64())), ("kind", pa.int32()), ("slope", pa.float64()), ("intercept", pa.float64())])
    return _binary(spark, pattern).mapInArrow(decode, HEADERS)


def _slices(path: str, x: np.ndarray, z0: int = 0, only: float | None = None) -> Iterator[pa.RecordBatch]:
    for z, plane in enumerate(x, z0):
        y, c = np.nonzero(plane > only) if only is not None else np.indices(plane.shape).reshape(2, -1)
        if len(y):
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(y)), pa.array(np.full(len(y), z, np.int32)), pa.array(y.astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(plane[y, c].astype(np.float64))], ["path", "z", "y", "x", "hu"])


def voxels(spark: SparkSession, pattern: str, above: float | None = None) -> DataFrame:
    """``VOXELS`` of NIfTI files; with ``above`` only those of larger values, as for masks."""

    def decode(batches):
        for path, raw in _files(batches):
            x = nifti_array(raw)
            if x is not None:
                yield from _slices(path, x, only=above)

    return _binary(spark, pattern).mapInArrow(decode, VOXELS)


def dicom_files(spark: SparkSession, pattern: str) -> DataFrame:
    """``FILES``: what orders and groups DICOM files; others are left out."""
    names = [f.split()[0] for f in FILES.split(", ")]
    kinds = pa.schema([(n, pa.string()) if n in ("path", "sop_uid", "modality", "series_uid", "description") else (n, pa.int32()) if n == "instance" else (n, pa.float64()) if n == "thickness" else (n, pa.list_(pa.float64())) for n in names])

    def decode(batches):
        for path, raw in _files(batches):
            d = dicom_elements(raw)
            if d is not None:
                d["instance"] = int(d["instance"]) if d.get("instance") is not None else None
                yield pa.RecordBatch.from_pylist([{"path": path, **{n: d.get(n) for n in names[1:]}}], kinds)

    return _binary(spark, pattern).mapInArrow(decode, FILES)


def series(files: DataFrame, modality: str = "CT") -> DataFrame:
    """(series_uid, n_files, description): the files of a modality by series; files without a series are left out."""
    rows = files.where((F.upper("modality") == modality) & (F.coalesce("series_uid", F.lit("")) != ""))
    return rows.groupBy("series_uid").agg(F.count("*").alias("n_files"), F.min("description").alias("description"))


def ordered_files(files: DataFrame, share: float = 0.7) -> DataFrame:
    """(series_uid, path, order, ordered_by): of files with one SOP UID (else one path) the one with more to order by, then the shorter path; in order of the
    position's z where at least ``share`` have one, else of the instance number where as many have that, else of the path.
    """
    z = F.when(F.size("position") >= 3, F.col("position")[2])
    rows = files.withColumn("z", z).withColumn("key", F.coalesce(F.nullif(F.col("sop_uid"), F.lit("")), F.col("path")))
    richness = F.col("z").isNotNull().cast("int") + F.col("instance").isNotNull().cast("int")
    kept = rows.groupBy("series_uid", "key").agg(F.min_by(F.struct("path", "z", "instance"), F.struct(-richness, F.length("path"), F.col("path"))).alias("r")).select("series_uid", "r.*")
    n = Window.partitionBy("series_uid")  # a series is a volume's slices
    need = F.greatest(F.lit(1), F.floor(F.count("*").over(n) * share))
    by = F.when(F.count("z").over(n) >= need, "z").when(F.count("instance").over(n) >= need, "instance").otherwise("path")
    held = kept.withColumn("ordered_by", by)
    first = F.when(F.col("ordered_by") == "z", F.col("z")).when(F.col("ordered_by") == "instance", F.col("instance").cast("double"))
    order = F.row_number().over(n.orderBy(first.asc_nulls_last(), F.col("instance").asc_nulls_last(), F.col("path")))
    return held.withColumn("order", order).select("series_uid", "path", "order", "ordered_by")


def dicom_voxels(spark: SparkSession, pattern: str, order: DataFrame) -> DataFrame:
    """``VOXELS`` of DICOM files, z by ``order`` (path, order from 1); path is the series."""

    def decode(batches):
        for b in batches:
            for path, raw, uid, z in zip(*(b.column(c).to_pylist() for c in ("path", "content", "series_uid", "order")), strict=True):
                for _, one in contents(path, raw):
                    d = dicom_elements(one, pixels=True)
                    if d and "pixels" in d:
                        slope, intercept = d.get("slope"), d.get("intercept")
                        yield from _slices(uid, (d["pixels"] * (1.0 if slope is None else slope) + (intercept or 0.0))[None], z - 1)

    joined = _binary(spark, pattern).join(order.select("path", "series_uid", "order"), "path")
    return joined.select("path", "content", "series_uid", "order").mapInArrow(decode, VOXELS)


def same_space(a: DataFrame, b: DataFrame, key: str, tolerance: float = 1e-3) -> DataFrame:
    """(key, same): whether two headers agree in shape, and in spacing and origin within a tolerance."""
    j = a.alias("a").join(b.alias("b"), key)
    near = lambda c: F.forall(F.zip_with(F.col(f"a.{c}"), F.col(f"b.{c}"), lambda x, y: F.abs(x - y)), lambda v: v <= tolerance)
    return j.select(key, ((F.col("a.shape") == F.col("b.shape")) & near("spacing") & near("origin")).alias("same"))


def resampled(mask: DataFrame, own: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """(key, z, y, x): a mask (key, z, y, x) in another image's grid, by the nearest voxel; headers with axis-parallel grids of one direction.

    Each voxel of the mask is dealt to the rows, columns and slices whose centres are nearest to it, so work grows with the mask.
    """
    h = own.select(key, F.col("spacing").alias("_s"), F.col("origin").alias("_o")).join(wanted.select(key, F.col("spacing").alias("_t"), F.col("origin").alias("_p"), F.col("shape").alias("_n")), key)
    rows = mask.join(F.broadcast(h), key)  # a row an image
    out = rows
    for i, c in enumerate("xyz"):
        low = (F.col("_o")[i] + (F.col(c) - 0.5) * F.col("_s")[i] - F.col("_p")[i]) / F.col("_t")[i]
        high = (F.col("_o")[i] + (F.col(c) + 0.5) * F.col("_s")[i] - F.col("_p")[i]) / F.col("_t")[i]
        a, z = F.greatest(F.ceil(low), F.lit(0)), F.least(F.ceil(high) - 1, F.col("_n")[i] - 1)
        out = out.withColumn(f"_{c}", F.when(a <= z, F.sequence(a.cast("int"), z.cast("int"))).otherwise(F.array().cast("array<int>")))
    for c in "zyx":
        out = out.withColumn(f"_{c}", F.explode(f"_{c}"))
    return out.select(key, *[F.col(f"_{c}").alias(c) for c in "zyx"])
