"""What a source of images is: a support, features, subjects, an affine, and values of any part of the support.

A source draws or reads the same values each time, so an experiment that has lost or never held a voxel can take
it from there again.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bundle, files, gauss

AXES = ("i", "j", "k")
#: Where a source names no affine: voxels of size 1.
IDENTITY = tuple(np.eye(4).ravel().tolist())


class Source(ABC):
    """Packed rows (exp_id, vox, i, j, k, y) of one experiment."""

    exp_id: str = "demo"
    features: tuple[str, ...] = ()
    subjects: tuple[str, ...] = ()
    affine: tuple[float, ...] = IDENTITY

    @abstractmethod
    def whole(self, spark: SparkSession) -> DataFrame:
        """Every voxel of the support."""

    def support(self, spark: SparkSession) -> DataFrame:
        """(vox, i, j, k)"""
        return self.whole(spark).select("vox", *AXES)

    def load(self, spark: SparkSession, chosen: DataFrame | None = None) -> DataFrame:
        """The voxels at the chosen places (i, j, k), in the source's own numbers; places off the support are a ValueError."""
        held = self.whole(spark)
        if chosen is None:
            return held
        wanted = chosen.select(*AXES).distinct()
        if not wanted.join(held.select(*AXES), list(AXES), "left_anti").isEmpty():
            raise ValueError("voxels outside the support are asked for")
        return held.join(wanted, list(AXES), "left_semi")


@dataclass(frozen=True)
class GaussSource(Source):
    """A seeded Gaussian box, redrawn at every load."""

    shape: tuple[int, ...] = (2, 3, 4)
    b: int = 1
    n_img: int = 10
    seed: int = 0
    mu: tuple[float, ...] | None = None
    cov: tuple[tuple[float, ...], ...] | None = None
    voxel: float | None = None
    exp_id: str = "gauss"

    @property
    def features(self) -> tuple[str, ...]:
        return tuple(f"y{f}" for f in range(self.b))

    @property
    def subjects(self) -> tuple[str, ...]:
        return tuple(str(s) for s in range(self.n_img))

    @property
    def affine(self) -> tuple[float, ...]:
        return IDENTITY if self.voxel is None else tuple(np.diag([self.voxel] * 3 + [1.0]).ravel().tolist())

    def whole(self, spark: SparkSession) -> DataFrame:
        return gauss.experiment(spark, self.exp_id, self.b, self.n_img, self.shape, self.seed, self.mu, self.cov)


@dataclass(frozen=True)
class TableSource(Source):
    """Packed rows of a table."""

    frame: DataFrame | None = None
    features: tuple[str, ...] = ()
    subjects: tuple[str, ...] = ()
    exp_id: str = "table"

    def whole(self, spark: SparkSession) -> DataFrame:
        return self.frame


def packed_rows(long: DataFrame, exp_id: str, features: Sequence[str], subjects: Sequence[str]) -> DataFrame:
    """Packed rows from (subject, feature, vox, i, j, k, val): a voxel's values by feature, then subject."""
    place = F.create_map(*(F.lit(x) for f, feature in enumerate(features) for s, subject in enumerate(subjects) for x in (f"{feature}\0{subject}", f * len(subjects) + s)))
    at = long.withColumn("at", place[F.concat_ws("\0", "feature", "subject")])
    return at.groupBy("vox", *AXES).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "val"))), lambda s: s["val"]).alias("y")).select(F.lit(exp_id).alias("exp_id"), "vox", *AXES, "y")  # a voxel's own images


@dataclass(frozen=True)
class FileSource(Source):
    """Volumes or pictures by (subject, feature, path); subjects in order, features as they are first named."""

    table: DataFrame
    mask: str | None = None
    names: Mapping[str, Sequence[str]] = field(default_factory=dict)
    exp_id: str = "files"
    features: tuple[str, ...] = ()
    subjects: tuple[str, ...] = ()
    affine: tuple[float, ...] = IDENTITY

    @classmethod
    def of(cls, spark: SparkSession, table: DataFrame, mask: str | None = None, names: Mapping[str, Sequence[str]] | None = None, exp_id: str = "files") -> FileSource:
        heads = files.headers(spark, files.checked_paths(table), names or {}).select("feature", "affine").distinct().orderBy("feature").collect()  # a row a channel
        order = [n for own in (names or {}).values() for n in own]
        features = sorted({r["feature"] for r in heads}, key=lambda f: (order.index(f) if f in order else len(order), f))
        return cls(table, mask, names or {}, exp_id, tuple(features), tuple(r["subject"] for r in files.subjects(table).collect()), tuple(heads[0]["affine"]))

    @classmethod
    def search(cls, spark: SparkSession, folder: str, subject_rule: str, globs: Mapping[str, str], **more) -> FileSource:
        """Of the files under a folder, by a rule for subjects and a glob for each feature."""
        return cls.of(spark, files.search(spark, folder, subject_rule, globs), **more)

    def whole(self, spark: SparkSession) -> DataFrame:
        return packed_rows(files.load(spark, self.table, self.mask, self.names), self.exp_id, self.features, self.subjects)


@dataclass(frozen=True)
class BundleSource(Source):
    """A bundle (a folder a feature) and its places (vox, i, j, k); only asked features are read."""

    path: str
    places: DataFrame
    features: tuple[str, ...] = ()
    n_img: int = 0
    exp_id: str = "bundle"

    @property
    def subjects(self) -> tuple[str, ...]:
        return tuple(str(s) for s in range(self.n_img))

    def whole(self, spark: SparkSession) -> DataFrame:
        held = bundle.read_bundle(spark, self.path, self.features).withColumnRenamed("feat", "feature").withColumn("subject", F.col("img").cast("string"))
        return packed_rows(held.join(self.places, "vox"), self.exp_id, self.features, self.subjects)


def white_noise(seed: int, b: int = 1, n_img: int = 50, shape: Sequence[int] = (10, 10, 10)) -> Source:
    return GaussSource(tuple(shape), b, n_img, seed, exp_id=f"wgn{seed}")


#: Clean data by name. A study of files is added by `register_study`.
BUILDERS: dict[str, Callable[..., Source]] = {"wgn": white_noise}


def register_study(name: str, build: Callable[..., Source]) -> None:
    BUILDERS[name] = build


def build_clean(source: str, **settings) -> Source:
    """The source of clean data that a name and settings stand for."""
    if source not in BUILDERS:
        raise ValueError(f"no source {source!r}")
    return BUILDERS[source](**settings)
