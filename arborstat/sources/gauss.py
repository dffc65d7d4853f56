"""Seeded Gaussian measurements on a box, as packed rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..plans.fits import PACKED

#: Voxels whose rows a task makes.
BLOCK_VOXELS = 50_000


def sample(b: int, n_img: int, shape: Sequence[int], seed: int | None = None, mu: np.ndarray | None = None, cov: np.ndarray | None = None) -> np.ndarray:
    """(b, images, voxels): standard normal, centred; with mu or cov, moved to have exactly that mean and covariance."""
    rng = np.random.default_rng(seed)
    y = rng.standard_normal((b, n_img, int(np.prod(shape))))
    y -= y.mean(axis=(1, 2), keepdims=True)
    if cov is not None:
        flat = y.reshape(b, -1)
        held = flat @ flat.T / (flat.shape[1] - 1)
        y = (root(np.asarray(cov, float)) @ np.linalg.inv(root(held)) @ flat).reshape(y.shape)
    return y if mu is None else y + np.asarray(mu, float).reshape(b, 1, 1)


def root(m: np.ndarray) -> np.ndarray:
    values, vectors = np.linalg.eigh(m)
    return vectors @ np.diag(np.sqrt(np.maximum(values, 0))) @ vectors.T


def places(shape: Sequence[int]) -> np.ndarray:
    """(voxels, 3): raster order; planes have k = 0."""
    whole = (*shape, *(1,) * (3 - len(shape)))
    return np.stack(np.unravel_index(np.arange(int(np.prod(whole))), whole), axis=1)


def packed_frame(exp_id: str, y: np.ndarray, ijk: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"exp_id": exp_id, "vox": np.arange(len(ijk)), "i": ijk[:, 0], "j": ijk[:, 1], "k": ijk[:, 2], "y": y.reshape(-1, y.shape[2]).T.tolist()})


def drawn_rows(b: int, n_img: int, n_vox: int, seed: int | None) -> Iterator[np.ndarray]:
    """(b, voxels) of each image in turn: the stream of `sample`, one generator a feature, each past the features before it."""
    streams = []
    for feature in range(b):
        rng = np.random.default_rng(seed)
        for _ in range(feature * n_img):
            rng.standard_normal(n_vox)  # an image at a time, so that no more is held
        streams.append(rng)
    for _ in range(n_img):
        yield np.stack([rng.standard_normal(n_vox) for rng in streams])


def experiment(spark: SparkSession, exp_id: str, b: int, n_img: int, shape: Sequence[int], seed: int = 0, mu: np.ndarray | None = None, cov: np.ndarray | None = None) -> DataFrame:
    """Packed rows of one seeded experiment: the values of `sample`, whatever the box's size.

    A task redraws the whole box image by image, as the seed's stream has no other way in, and keeps its own block
    of voxels; so every block is centred and turned by the whole box's moments, and a lost task draws the same again.
    """
    n_vox = int(np.prod(shape))
    whole = (*shape, *(1,) * (3 - len(shape)))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for block in pdf["id"]:
                vox = np.arange(block * BLOCK_VOXELS, min((block + 1) * BLOCK_VOXELS, n_vox))
                total, products, own = np.zeros(b), np.zeros((b, b)), np.empty((b, n_img, len(vox)))
                for k, image in enumerate(drawn_rows(b, n_img, n_vox, seed)):
                    total += image.sum(axis=1)
                    products += image @ image.T
                    own[:, k] = image[:, vox]
                n = n_img * n_vox
                mean = total / n
                own -= mean[:, None, None]
                if cov is not None:
                    held = (products - n * np.outer(mean, mean)) / (n - 1)
                    own = (root(np.asarray(cov, float)) @ np.linalg.inv(root(held)) @ own.reshape(b, -1)).reshape(own.shape)
                if mu is not None:
                    own = own + np.asarray(mu, float).reshape(b, 1, 1)
                yield packed_frame(exp_id, own, np.stack(np.unravel_index(vox, whole), axis=1)).assign(vox=vox)

    blocks = -(-n_vox // BLOCK_VOXELS)
    return spark.range(0, blocks, 1, blocks).mapInPandas(rows, PACKED)


def subset(packed: DataFrame, chosen: DataFrame) -> DataFrame:
    """The chosen (vox) of an experiment; voxels that it does not hold are an error."""
    if not chosen.join(packed.select("vox"), "vox", "left_anti").isEmpty():
        raise ValueError("voxels outside the support are asked for")
    return packed.join(chosen.select("vox").distinct(), "vox", "left_semi")
