"""Images in files: NIfTI volumes and PNG pictures, found by folder, loaded on their common support."""

from __future__ import annotations

import gzip
import io
import re
import struct
import warnings
import zlib
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

VOLUME = "subject string, feature string, i int, j int, k int, val double"
HEADER = "subject string, feature string, path string, shape array<int>, depth int, affine array<double>"
#: Fixed values of the formats: NIfTI data types by code, PNG's signature and channels by colour type.
NIFTI_TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}
PNG_SIGNATURE, PNG_CHANNELS = b"\x89PNG\r\n\x1a\n", {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def read_nifti(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(volume with its scaling applied, affine 4 x 4) of a NIfTI-1 or -2 file, gzipped or not."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    for order in "<>":
        size = struct.unpack(f"{order}i", data[:4])[0]
        if size in (348, 540):
            break
    else:
        raise ValueError("no NIfTI file")
    if size == 348:
        dims = struct.unpack(f"{order}8h", data[40:56])
        code, = struct.unpack(f"{order}h", data[70:72])
        start, slope, shift = struct.unpack(f"{order}3f", data[108:120])
        pixdim = struct.unpack(f"{order}8f", data[76:108])
        sform, rows = struct.unpack(f"{order}h", data[254:256])[0], struct.unpack(f"{order}12f", data[280:328])
    else:
        code, = struct.unpack(f"{order}h", data[12:14])
        dims = struct.unpack(f"{order}8q", data[16:80])
        pixdim = struct.unpack(f"{order}8d", data[104:168])
        start, = struct.unpack(f"{order}q", data[168:176])
        slope, shift = struct.unpack(f"{order}2d", data[176:192])
        sform, rows = struct.unpack(f"{order}i", data[348:352])[0], struct.unpack(f"{order}12d", data[400:496])
    if code not in NIFTI_TYPES:
        raise ValueError(f"NIfTI data type {code}")
    shape = dims[1 : dims[0] + 1]
    raw = np.frombuffer(data, order + NIFTI_TYPES[code], int(np.prod(shape)), int(start)).reshape(shape, order="F").astype(np.float64)
    if slope and np.isfinite(slope):
        raw = raw * slope + shift
    affine = np.eye(4)
    affine[:3] = np.reshape(rows, (3, 4)) if sform > 0 else np.diag([*pixdim[1:4], 1.0])[:3]
    return raw, affine


def write_nifti(volume: np.ndarray, affine: np.ndarray | None = None) -> bytes:
    """A NIfTI-1 file of doubles."""
    affine, head = np.eye(4) if affine is None else affine, bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, volume.ndim, *volume.shape, *(1,) * (7 - volume.ndim))
    struct.pack_into("<2h", head, 70, 64, 64)
    struct.pack_into("<8f", head, 76, 1, *np.sqrt((affine[:3, :3] ** 2).sum(axis=0)), 1, 1, 1, 1)
    struct.pack_into("<3f", head, 108, 352, 1, 0)
    struct.pack_into("<h", head, 254, 1)
    struct.pack_into("<12f", head, 280, *affine[:3].ravel())
    head[344:348] = b"n+1\0"
    return bytes(head) + np.asarray(volume, "<f8").tobytes(order="F")


def unpacked(raw: np.ndarray, depth: int, wide: int) -> np.ndarray:
    """Samples of `depth` bits, from rows of bytes."""
    if depth == 16:
        return raw.reshape(len(raw), -1, 2).astype(np.uint16) @ np.array([256, 1], np.uint16)
    if depth == 8:
        return raw
    bits = np.unpackbits(raw, axis=1).reshape(len(raw), -1, depth)
    return (bits @ (1 << np.arange(depth)[::-1])).astype(np.uint8)[:, :wide]


def read_png(data: bytes) -> np.ndarray:
    """(rows, columns, channels) of a PNG that is not interlaced: grey, palette or colour, of any depth."""
    if data[:8] != PNG_SIGNATURE:
        raise ValueError("no PNG file")
    at, body, head, palette = 8, b"", None, None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body += part
        at += size + 12
    wide, high, depth, colour, _, _, laced = head
    if laced or colour not in PNG_CHANNELS:
        raise ValueError("this kind of PNG is not read")
    channels = PNG_CHANNELS[colour]
    step, width = max(1, channels * depth // 8), -(-wide * channels * depth // 8)
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(high, width + 1)
    out = np.zeros((high + 1, width + step), np.int64)  # with a border of zeros
    for y in range(high):
        kind, line, above, row = raw[y, 0], raw[y, 1:].astype(np.int64), out[y], out[y + 1]
        if kind == 0:
            row[step:] = line
        elif kind == 2:
            row[step:] = (line + above[step:]) % 256
        elif kind == 1:
            for x in range(step):
                row[step + x :: step] = np.cumsum(line[x::step]) % 256
        else:
            for x in range(step, len(row)):
                left, up, corner = row[x - step], above[x], above[x - step]
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    guess = min((left, up, corner), key=lambda v: (abs(left + up - corner - v), (left, up, corner).index(v)))
                row[x] = (line[x - step] + guess) % 256
    samples = unpacked(out[1:, step:].astype(np.uint8), depth, wide * channels).reshape(high, wide, channels)
    if colour == 3:
        return palette[samples[:, :, 0]]
    return samples


def subject_of(path: str, rule: str) -> str:
    """The one subject id that the rule finds in a path, however often."""
    found = set(re.findall(rule, path))
    if len(found) != 1:
        raise ValueError(f"{path} names the subjects {sorted(found)}")
    return found.pop()


def search(spark: SparkSession, folder: str, subject_rule: str, globs: Mapping[str, str]) -> DataFrame:
    """(subject, feature, path): files by a glob for each feature; a file or a subject's feature twice is an error."""
    parts = [spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder).select("path", F.lit(feature).alias("feature")) for feature, glob in globs.items()]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    ids = F.array_distinct(F.regexp_extract_all("path", F.lit(subject_rule), F.lit(1 if re.compile(subject_rule).groups else 0)))
    named = whole.select("feature", "path", ids.alias("ids"))
    if not named.where("size(ids) <> 1").isEmpty():
        raise ValueError("a path names no subject or several")
    out = named.select(F.col("ids")[0].alias("subject"), "feature", "path")
    if not out.groupBy("subject", "feature").count().where("count > 1").isEmpty() or not out.groupBy("path").count().where("count > 1").isEmpty():
        raise ValueError("a subject has a feature twice")
    return out


def subjects(table: DataFrame) -> DataFrame:
    """The subjects' ids in order; none is an error."""
    out = table.select("subject").distinct().orderBy("subject")
    if out.isEmpty():
        raise ValueError("no images are found")
    return out


def parts_of(path: str, feature: str, content: bytes, names: Mapping[str, Sequence[str]]) -> tuple[list[tuple[str, np.ndarray]], int, np.ndarray]:
    """((feature, volume) of each channel, bytes of a sample, affine) of a file; names: own names of a feature's channels."""
    if ".nii" in path:
        volume, affine = read_nifti(content)
        return [(feature, volume.reshape((*volume.shape, *(1,) * (3 - volume.ndim))))], 8, affine
    picture = read_png(content)
    channels = picture.shape[2]
    own = names.get(feature, ())
    named = [feature] if channels == 1 else [own[c] if c < len(own) else f"{feature}{c}" for c in range(channels)]
    return [(n, picture[:, :, c][:, :, None].astype(float)) for c, n in enumerate(named)], picture.dtype.itemsize, np.eye(4)


def contents(spark: SparkSession, table: DataFrame) -> DataFrame:
    paths = [r["path"] for r in table.select("path").collect()]  # a study's files
    files = spark.read.format("binaryFile").load(paths).select(bare("path").alias("_bare"), "content")
    return files.join(F.broadcast(table.withColumn("_bare", bare("path"))), "_bare").select("subject", "feature", "path", "content")


def bare(path: str) -> Column:
    """A path as it is compared: a local one may be written with or without its scheme and with any slashes after it."""
    return F.regexp_replace(F.col(path), r"^(file:)?/+", "/")


def headers(spark: SparkSession, table: DataFrame, names: Mapping[str, Sequence[str]]) -> DataFrame:
    """HEADER: a row for each file and channel, files of zeros too."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                parts, depth, affine = parts_of(r.path, r.feature, bytes(r.content), names)
                yield pd.DataFrame([(r.subject, feature, r.path, list(v.shape), depth, affine.ravel().tolist()) for feature, v in parts], columns=["subject", "feature", "path", "shape", "depth", "affine"])

    return contents(spark, table).mapInPandas(rows, HEADER)


def volumes(spark: SparkSession, table: DataFrame, names: Mapping[str, Sequence[str]], zeros: bool) -> DataFrame:
    """VOLUME rows: every voxel of every file, or those that are not zero. One file is held at a time."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                for feature, volume in parts_of(r.path, r.feature, bytes(r.content), names)[0]:
                    i, j, k = np.nonzero(np.ones_like(volume) if zeros else volume)
                    yield pd.DataFrame({"subject": r.subject, "feature": feature, "i": i, "j": j, "k": k, "val": volume[i, j, k]})

    return contents(spark, table).mapInPandas(rows, VOLUME)


def checked_paths(table: DataFrame) -> DataFrame:
    """The table (subject, feature, path) without missing paths: a file twice, no file or a mix of formats is an error, a gap a warning."""
    held = table.where("path is not null")
    if held.isEmpty():
        raise ValueError("no images are found")
    if not held.groupBy("path").count().where("count > 1").isEmpty():
        raise ValueError("a file stands for more than one subject and feature")
    if held.select(F.col("path").contains(".nii")).distinct().count() > 1:
        raise TypeError("volumes and pictures are not mixed")
    features = table.select("feature").distinct().count()
    gaps = held.groupBy("subject").agg(F.countDistinct("feature").alias("n")).where(F.col("n") < features).unionByName(table.select("subject").distinct().join(held, "subject", "left_anti").select("subject", F.lit(0).cast("long").alias("n")))
    missing = [r["subject"] for r in gaps.orderBy("subject").collect()]  # a study's subjects
    if missing:
        warnings.warn(f"subjects without some of their files: {missing}", MissingImages, stacklevel=3)
    return held


class MissingImages(UserWarning):
    """A subject has not every feature."""


def load(spark: SparkSession, table: DataFrame, mask: str | None = None, names: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """(subject, feature, vox, i, j, k, val) on the support, numbered in raster order, from (subject, feature, path).

    The support is the voxels that are not zero in any file, so a file of zeros leaves none; of pictures it is every
    place; with the path of a `mask` (volumes only) it is the mask's. Affines, shapes and sample depths must agree.
    """
    names, table = names or {}, checked_paths(table)
    whole = headers(spark, table, names).select("path", "shape", "depth", "affine").distinct().collect()  # a row a file
    pictures = ".nii" not in whole[0]["path"]
    for what in ("shape", "depth", "affine"):
        if len({tuple(r[what]) if what != "depth" else r[what] for r in whole}) > 1:
            raise ValueError(f"the files differ in {what}")
    if mask is not None:
        if pictures:
            raise ValueError("a mask is for volumes")
        over = spark.createDataFrame([("mask", "mask", mask)], "subject string, feature string, path string")
        held = headers(spark, over, {}).first()
        if tuple(held["shape"]) != tuple(whole[0]["shape"]) or tuple(held["affine"]) != tuple(whole[0]["affine"]):
            raise ValueError("the mask is not on the images' grid")
        support = volumes(spark, over, {}, False).where("val > 0").select("i", "j", "k")
    elif pictures:
        support = volumes(spark, table.limit(1), names, True).select("i", "j", "k").distinct()
    else:
        support = volumes(spark, table, names, False).groupBy("i", "j", "k").agg(F.count("*").alias("n")).where(F.col("n") == len(whole)).select("i", "j", "k")
    number = numbered(support, tuple(whole[0]["shape"]))
    return volumes(spark, table, names, True).join(number, ["i", "j", "k"]).select("subject", "feature", "vox", "i", "j", "k", "val")


def numbered(support: DataFrame, shape: tuple[int, ...]) -> DataFrame:
    """(i, j, k, vox): dense numbers in raster order, by counts of the planes before, so that no window holds all voxels."""
    planes = support.groupBy("i").agg(F.count("*").alias("n"))
    before = planes.select("i", (F.sum("n").over(Window.orderBy("i")) - F.col("n")).alias("before"))  # a row a plane
    place = F.row_number().over(Window.partitionBy("i").orderBy("j", "k")) - 1
    return support.withColumn("place", place).join(F.broadcast(before), "i").select("i", "j", "k", (F.col("before") + F.col("place")).alias("vox"))


def read_mask(spark: SparkSession, path: str) -> DataFrame:
    """(i, j, k) of the voxels over 0 in a volume, or in a NumPy array of two or three axes."""
    if not path.endswith(".npy"):
        return volumes(spark, spark.createDataFrame([("mask", "mask", path)], "subject string, feature string, path string"), {}, False).where("val > 0").select("i", "j", "k")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                held = np.load(io.BytesIO(bytes(content)), allow_pickle=False)
                yield pd.DataFrame(np.argwhere(held.reshape((*held.shape, *(1,) * (3 - held.ndim))) > 0), columns=["i", "j", "k"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, "i int, j int, k int")
