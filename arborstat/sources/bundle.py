"""Sinks and their readers: measurement bundles by feature, ordered exports, records, saved fits and their manifest."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_bundle(panel: DataFrame, path: str, features: Sequence[str]) -> None:
    """A folder a feature, so that a feature is read without the others."""
    panel.unpivot(["vox", "img"], list(features), "feat", "val").write.partitionBy("feat").parquet(path)


def read_bundle(spark: SparkSession, path: str, features: Sequence[str], voxels: DataFrame | None = None) -> DataFrame:
    held = spark.read.parquet(path).where(F.col("feat").isin(*features))
    return held if voxels is None else held.join(voxels.select("vox").distinct(), "vox", "left_semi")


def stable_order(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A total order: the keys, then every other column, missing values last."""
    rest = [c for c in df.columns if c not in keys]
    return df.orderBy(*(F.asc_nulls_last(c) for c in [*keys, *rest]))


def write_csv(df: DataFrame, path: str, keys: Sequence[str], label: str | None = None) -> bool:
    """One ordered file of a report's rows, none if there are none. Rows without a label are left out."""
    out = df if label is None else df.where(F.col(label).isNotNull())
    if out.isEmpty():
        return False
    stable_order(out, keys).coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return True


def write_records(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


def hadoop(spark: SparkSession, path: str):
    """(file system, path class) that a path belongs to."""
    kind = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return kind(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), kind


def there(spark: SparkSession, path: str) -> bool:
    fs, kind = hadoop(spark, path)
    return fs.exists(kind(path))


def publish(df: DataFrame, path: str) -> None:
    """Write beside the place and move there when whole, so that a reader sees all or nothing; a place that is taken is an error."""
    spark = df.sparkSession
    fs, kind = hadoop(spark, path)
    if fs.exists(kind(path)):
        raise FileExistsError(path)
    beside = f"{path.rstrip('/')}.{uuid.uuid4().hex}.tmp"
    df.write.parquet(beside)
    if not fs.rename(kind(beside), kind(path)):
        raise OSError(f"{beside} can't be moved to {path}")


def verified_files(spark: SparkSession, folder: str, digests: Mapping[str, str]) -> list[str]:
    """The names of files under a folder that are missing or whose MD5 is another; executors read them."""
    held = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.md5("content").alias("md5"))
    found = {r["name"]: r["md5"] for r in held.where(F.col("name").isin(*digests)).collect()}  # a study's files
    return sorted(name for name, md5 in digests.items() if found.get(name) != md5)


def save_fit(folder: str, tables: Mapping[str, DataFrame], about: Mapping[str, str] | None = None) -> None:
    """A fit's tables as a folder each, with what it is about; a kept draw matrix is warned of where it is large."""
    from ..operators.figures import warn_if_large

    for name, table in tables.items():
        if name == "draws":
            warn_if_large(table.count() * 8 * len(table.columns))
        table.write.parquet(f"{folder}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(folder.rstrip("/").rsplit("/", 1)[-1], dict(about or {}))], "key string, about map<string,string>").coalesce(1).write.json(f"{folder}/about")


def load_fit(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of a saved fit by name; a folder that isn't there is an error."""
    if not there(spark, folder):
        raise FileNotFoundError(folder)
    fs, kind = hadoop(spark, folder)
    names = [s.getPath().getName() for s in fs.listStatus(kind(folder)) if s.isDirectory()]
    return {n: spark.read.parquet(f"{folder}/{n}") for n in sorted(names) if n != "about"}


def manifest(spark: SparkSession, folder: str) -> list[dict]:
    """(key, about) of the fits under a folder: those of its manifest.json that are there, or without one every saved fit; none without a folder."""
    if not there(spark, folder):
        return []
    if there(spark, f"{folder}/manifest.json"):
        listed = spark.read.option("multiLine", True).schema("demos array<struct<key:string,blurb:string>>").json(f"{folder}/manifest.json").select(F.inline("demos")).collect()
        return [{"key": r["key"], "about": {"blurb": r["blurb"] or ""}} for r in listed if there(spark, f"{folder}/{r['key']}")]
    fs, kind = hadoop(spark, folder)
    names = sorted(s.getPath().getName() for s in fs.listStatus(kind(folder)) if s.isDirectory())
    return [{"key": n, "about": {}} for n in names if there(spark, f"{folder}/{n}/about")]
