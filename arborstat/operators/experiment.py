"""One experiment and what can be done to it: design, selection, bootstrap, offsets, growth, scaling.

Every operation gives a new experiment and leaves the old one. Offsets are logged as patches, so that voxels
which are taken from the source later carry them too; operations that could not be replayed drop the source.
"""

from __future__ import annotations

import hashlib
import warnings
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.mancova import bases
from ..sources.contract import AXES, IDENTITY, Source
from .grid import inflate

PACKED = "exp_id string, vox long, i int, j int, k int, y array<double>"


class NoBiasTerm(UserWarning):
    """No row of the design is all ones: the regression goes through the origin."""


@dataclass(frozen=True)
class Patch:
    """An offset (features, images) on the places (i, j, k) of a table."""

    places: DataFrame
    offset: np.ndarray


def sampled_design(n_img: int, a: int | None = None, contrast: np.ndarray | None = None, seed: int | None = None, bias: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(x, contrast): standard normal regressors, all of interest unless a contrast says which; a bias row goes first."""
    if (a is None) == (contrast is None):
        raise ValueError("a number of regressors or a contrast")
    held = np.ones(a, bool) if contrast is None else np.asarray(contrast, bool)
    return with_bias(np.random.default_rng(seed).standard_normal((len(held), n_img)), held) if bias else (np.random.default_rng(seed).standard_normal((len(held), n_img)), held)


def with_bias(x: np.ndarray, contrast: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([np.ones((1, x.shape[1])), x]), np.concatenate([[False], contrast])


def bootstrap_images(n_img: int, n: int, seed: int | None = None) -> np.ndarray:
    """The images of a bootstrap: n draws of n_img with replacement."""
    return np.random.default_rng(seed).choice(n_img, n, replace=True)


def picked(images: Sequence[int], n_img: int, features: int) -> Column:
    """A packed voxel's values at the images, feature by feature."""
    return F.transform(F.array(*(F.lit(int(f * n_img + k)) for f in range(features) for k in images)), lambda at: F.col("y")[at])


def shifted(offset: np.ndarray) -> Column:
    flat = F.array(*(F.lit(float(v)) for v in np.asarray(offset, float).ravel()))
    return F.zip_with("y", flat, lambda a, b: a + b)


@dataclass(frozen=True)
class Experiment:
    """Packed voxels, their images' design, and where they come from."""

    packed: DataFrame
    n_img: int
    features: tuple[str, ...]
    subjects: tuple[str, ...] = ()
    affine: tuple[float, ...] = IDENTITY
    x: np.ndarray | None = None
    contrast: np.ndarray | None = None
    source: Source | None = None
    patches: tuple[Patch, ...] = ()
    scale: tuple[np.ndarray, np.ndarray] | None = None
    meta: dict = field(default_factory=dict)

    @classmethod
    def of(cls, spark, source: Source, **design) -> Experiment:
        """All that a source holds; design: what `sampled` takes."""
        out = cls(source.load(spark), len(source.subjects), tuple(source.features), tuple(source.subjects), source.affine, source=source)
        return out.sampled(**design) if design else out

    def designed(self, x: np.ndarray, contrast: np.ndarray, bias: bool = False) -> Experiment:
        """With a design (regressors, images); a warning where it has no row of ones."""
        x, contrast = with_bias(np.asarray(x, float), np.asarray(contrast, bool)) if bias else (np.asarray(x, float), np.asarray(contrast, bool))
        if x.shape != (len(contrast), self.n_img):
            raise ValueError("a design has a row for each regressor and a column for each image")
        if not (x == 1).all(axis=1).any():
            warnings.warn("no bias term: the regression goes through the origin", NoBiasTerm, stacklevel=2)
        return replace(self, x=x, contrast=contrast)

    def sampled(self, a: int | None = None, contrast: np.ndarray | None = None, seed: int | None = None, bias: bool = False) -> Experiment:
        return self.designed(*sampled_design(self.n_img, a, contrast, seed, bias))

    def images(self, chosen: Sequence[int]) -> Experiment:
        """Images in the given order, with repeats, their design and subjects with them; the source is dropped."""
        if any(not 0 <= k < self.n_img for k in chosen):
            raise ValueError("there is no such image")
        packed = self.packed.withColumn("y", picked(chosen, self.n_img, len(self.features)))
        subjects = tuple(self.subjects[k] for k in chosen) if self.subjects else ()
        return replace(self, packed=packed, n_img=len(chosen), subjects=subjects, x=None if self.x is None else self.x[:, list(chosen)], source=None, patches=())

    def bootstrap(self, n: int, seed: int | None = None, noise: float = 0.0) -> Experiment:
        """n images drawn with replacement; noise: its spread, as a multiple of the sample covariance's root.

        Noise is drawn by voxel from the seed and the voxel's number, so any task draws the same.
        """
        if noise < 0:
            raise ValueError("noise is at least 0")
        out = self.images(bootstrap_images(self.n_img, n, seed))
        if not noise:
            return out
        b = len(self.features)
        turn = np.linalg.cholesky(out.covariance() * noise**2 + 1e-300 * np.eye(b))

        def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pdf.assign(y=[(np.asarray(y) + (turn @ np.random.default_rng([seed or 0, int(v)]).standard_normal((b, n))).ravel()).tolist() for v, y in zip(pdf["vox"], pdf["y"], strict=True)])

        return replace(out, packed=out.packed.mapInPandas(rows, PACKED))

    def moments(self) -> tuple[np.ndarray, np.ndarray]:
        """(means, covariance) of the features over all images and voxels, in one pass."""
        b, n = len(self.features), self.n_img
        cells = self.packed.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("at"), "y").select(*(F.col("y")[F.lit(f * n) + F.col("at")].alias(f"f{f}") for f in range(b)))
        one = cells.agg(*(F.avg(f"f{f}").alias(f"m{f}") for f in range(b)), *(F.covar_samp(f"f{f}", f"f{g}").alias(f"c{f}_{g}") for f in range(b) for g in range(f, b))).first()
        cov = np.array([[one[f"c{min(f, g)}_{max(f, g)}"] for g in range(b)] for f in range(b)], float)
        return np.array([one[f"m{f}"] for f in range(b)], float), cov

    def covariance(self) -> np.ndarray:
        return self.moments()[1]

    def masked(self, places: DataFrame) -> Experiment:
        """The voxels at the places that are held, numbered anew in raster order; none is an error."""
        held = self.packed.join(places.select(*AXES).distinct(), list(AXES), "left_semi")
        if held.isEmpty():
            raise ValueError("no voxel is left")
        return replace(self, packed=renumbered(held))

    def offset(self, offset: np.ndarray, places: DataFrame | None = None, vox: Sequence[int] | None = None, stretch: float | None = None) -> Experiment:
        """An offset on places or voxels, logged as a patch; stretch: of the spread over voxels there, which drops the source."""
        if (places is None) == (vox is None):
            raise ValueError("places or voxels")
        if places is None:
            places = self.packed.where(F.col("vox").isin(*map(int, vox)))
        places = places.select(*AXES).distinct()
        offset = np.asarray(offset, float).reshape(len(self.features), self.n_img)
        marked = self.packed.join(places.withColumn("_inside", F.lit(True)), list(AXES), "left")
        inside = F.coalesce("_inside", F.lit(False))
        moved = marked.withColumn("y", F.when(inside, shifted(offset)).otherwise(F.col("y")))
        if stretch is not None:
            length = len(self.features) * self.n_img
            mean = moved.where(inside).agg(F.array(*(F.avg(F.col("y")[at]) for at in range(length))).alias("_mean"))  # one row
            moved = moved.crossJoin(F.broadcast(mean)).withColumn("y", F.when(inside, F.zip_with("y", "_mean", lambda a, m: m + stretch * (a - m))).otherwise(F.col("y")))
        packed = moved.select(*self.packed.columns)
        return replace(self, packed=packed, patches=(*self.patches, Patch(places, offset)), source=None if stretch is not None else self.source)

    def inflated(self, halo: int | None = None, places: DataFrame | None = None) -> Experiment:
        """Grown to a box of `halo` around every voxel, or to places, within the source's support.

        Voxels that are held keep their values; others come from the source, scaled as these are, and carry every patch.
        """
        if (halo is None) == (places is None):
            raise ValueError("a halo or places")
        if self.source is None:
            raise ValueError("without a source no voxel can be taken again")
        spark = self.packed.sparkSession
        support = self.source.support(spark)
        wanted = inflate(self.packed.select(*AXES), support, halo, AXES) if halo is not None else support.join(places.select(*AXES).distinct(), list(AXES), "left_semi")
        added = wanted.select(*AXES).join(self.packed.select(*AXES), list(AXES), "left_anti")
        fresh = self.source.load(spark, added)
        if self.scale is not None:
            fresh = fresh.withColumn("y", scaled_values(*self.scale, self.n_img))
        for patch in self.patches:
            marked = fresh.join(patch.places.withColumn("_inside", F.lit(True)), list(AXES), "left")
            fresh = marked.withColumn("y", F.when(F.coalesce("_inside", F.lit(False)), shifted(patch.offset)).otherwise(F.col("y"))).drop("_inside")
        exp_id = F.lit(self.packed.select("exp_id").first()[0])
        return replace(self, packed=renumbered(self.packed.unionByName(fresh.withColumn("exp_id", exp_id).select(*self.packed.columns))))

    def scaled(self) -> Experiment:
        """Features whitened: centred, divided by their spread and turned onto the correlation's eigenvectors; once only."""
        if self.scale is not None:
            return self
        mean, cov = self.moments()
        spread = np.sqrt(np.diag(cov))
        if (spread <= 0).any():
            raise ValueError("a feature has no variance")
        matrix = np.linalg.eigh(cov / np.outer(spread, spread))[1].T / spread
        patches = tuple(Patch(p.places, matrix @ p.offset) for p in self.patches)
        return replace(self, packed=self.packed.withColumn("y", scaled_values(matrix, mean, self.n_img)), scale=(matrix, mean), patches=patches)

    def unscaled(self) -> Experiment:
        """The images as they were before scaling."""
        if self.scale is None:
            return self
        matrix, mean = self.scale
        back = np.linalg.inv(matrix)
        flat = scaled_values(back, np.zeros(len(mean)), self.n_img)
        moved = F.transform(flat, lambda v, at: v + F.array(*map(F.lit, map(float, mean)))[F.floor(at / self.n_img).cast("int")])
        return replace(self, packed=self.packed.withColumn("y", moved), scale=None, patches=tuple(Patch(p.places, back @ p.offset) for p in self.patches))

    def target_stats(self, places: DataFrame) -> dict | None:
        """The target's voxels as one region: size, LLR, and what its overlap with itself is; None where it holds no voxel."""
        if self.x is None:
            raise ValueError("a target's statistics need a design")
        q, b, n = bases(self.x, self.contrast), len(self.features), self.n_img
        held = self.packed.join(places.select(*AXES).distinct(), list(AXES), "left_semi")
        sums = [F.sum(F.col("y")[at]).alias(f"s{at}") for at in range(b * n)]
        products = [F.sum(F.aggregate(F.zip_with(F.slice("y", f * n + 1, n), F.slice("y", g * n + 1, n), lambda u, v: u * v), F.lit(0.0), lambda t, v: t + v)).alias(f"p{f}_{g}") for f in range(b) for g in range(f, b)]
        one = held.agg(F.count("*").alias("size"), *sums, *products).first()
        size, active = one["size"], self.packed.count()
        if not size:
            return None
        total = np.array([one[f"s{at}"] for at in range(b * n)]).reshape(b, n)
        t = np.array([[one[f"p{min(f, g)}_{max(f, g)}"] for g in range(b)] for f in range(b)])
        a0, a1 = total @ q[0].T, total @ q[1].T
        t, h = t - a0 @ a0.T / size, a1 @ a1.T / size
        (sign_e, log_e), (sign_t, log_t) = np.linalg.slogdet(t - h), np.linalg.slogdet(t)
        return {"n_voxel": size, "llr": 0.5 * size * (log_t - log_e) if sign_e > 0 and sign_t > 0 else None, "dice": 1.0, "sens": 1.0, "ppv": 1.0, "spec": 1.0, "tp": size, "fp": 0, "fn": 0, "tn": active - size}

    def backgrounds(self, image: int | None = None) -> DataFrame:
        """(vox, i, j, k, features..., rgb): each voxel's mean over images, or one image, as it was before scaling.

        rgb: the three colours together, where the features are red, green and blue on a plane; else NULL.
        """
        if image is not None and not 0 <= image < self.n_img:
            raise ValueError("there is no such image")
        raw = self.unscaled()
        n = raw.n_img

        def of(f: int) -> Column:
            part = F.slice("y", f * n + 1, n)
            return part[image] if image is not None else F.aggregate(part, F.lit(0.0), lambda t, v: t + v) / n

        out = raw.packed.select("vox", *AXES, *(of(f).alias(name) for f, name in enumerate(raw.features)))
        colours = {name.lower(): name for name in raw.features}
        plane = raw.packed.agg(F.max("k") == F.min("k")).first()[0]
        if set(colours) == {"red", "green", "blue"} and plane:
            return out.withColumn("rgb", F.array(*(F.col(colours[c]) for c in ("red", "green", "blue"))))
        return out.withColumn("rgb", F.lit(None).cast("array<double>"))

    def ranges(self, image: int | None = None) -> DataFrame:
        """(feature, low, high) of the backgrounds."""
        held = self.backgrounds(image)
        one = held.agg(*(c for f in self.features for c in (F.min(f).alias(f"low_{f}"), F.max(f).alias(f"high_{f}"))))
        return one.select(F.inline(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f"low_{f}").alias("low"), F.col(f"high_{f}").alias("high")) for f in self.features))))

    def value_hash(self) -> str:
        """A hash of the values in the order of voxels, whatever their partitions: rows' digests are summed, then hashed."""
        row = F.conv(F.substring(F.sha2(F.concat_ws(",", F.col("vox").cast("string"), F.transform("y", lambda v: v.cast("string"))), 256), 1, 15), 16, 10).cast("decimal(38,0)")
        found = self.packed.agg(F.count("*").alias("n"), F.sum(row).alias("total")).first()
        return hashlib.sha256(f"{self.features}{self.n_img}:{found['n']}:{found['total']}".encode()).hexdigest()[:32]


def scaled_values(matrix: np.ndarray, mean: np.ndarray, n_img: int) -> Column:
    """A packed voxel's values centred and multiplied by the matrix, feature by feature."""
    def added(total: Column, part: Column, w: float, m: float) -> Column:
        return F.zip_with(total, part, lambda t, v: t + w * (v - m))

    def first(part: Column, w: float, m: float) -> Column:
        return F.transform(part, lambda v: w * (v - m))

    parts, out = [F.slice("y", f * n_img + 1, n_img) for f in range(len(mean))], []
    for row in np.asarray(matrix, float):
        total = first(parts[0], float(row[0]), float(mean[0]))
        for part, w, m in zip(parts[1:], row[1:], mean[1:], strict=True):
            total = added(total, part, float(w), float(m))
        out.append(total)
    return F.concat(*out)


def renumbered(packed: DataFrame) -> DataFrame:
    """Dense numbers in raster order: within a plane by a window, between planes by their counts."""
    from ..sources.files import numbered

    number = numbered(packed.select(*AXES), ())
    return packed.drop("vox").join(number, list(AXES)).select(*packed.columns)
