"""Screening, whitening, stretching, offsets, row selection and group-respecting splits."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def screen_constant(panel: DataFrame, features: Sequence[str], rtol: float = 1e-6) -> DataFrame:
    """(vox, dead): dead where any feature's spread over images is at most rtol of its median over voxels."""
    spread = panel.groupBy("vox").agg(*(F.stddev_pop(f).alias(f) for f in features))
    middle = spread.agg(*(F.percentile(f, F.lit(0.5)).alias(f"mid_{f}") for f in features))  # one row
    dead = F.lit(False)
    for f in features:
        dead = dead | (F.col(f) <= rtol * F.col(f"mid_{f}"))
    return spread.crossJoin(F.broadcast(middle)).select("vox", dead.alias("dead"))


def drop_constant(panel: DataFrame, features: Sequence[str], rtol: float = 1e-6) -> DataFrame:
    kept = screen_constant(panel, features, rtol).where(~F.col("dead")).select("vox")
    if kept.isEmpty():
        raise ValueError("every voxel is constant")
    return panel.join(kept, "vox", "left_semi")


def moments(panel: DataFrame, features: Sequence[str]) -> DataFrame:
    """(f, g, mean_f, mean_g, cov) of each pair of features over all cells, in one pass."""
    pairs = [(f, g) for i, f in enumerate(features) for g in features[i:]]
    one = panel.agg(*(F.avg(f).alias(f"m_{f}") for f in features), *(F.covar_samp(f, g).alias(f"c_{f}_{g}") for f, g in pairs))
    rows = F.array(*(F.struct(F.lit(f).alias("f"), F.lit(g).alias("g"), F.col(f"m_{f}").alias("mean_f"), F.col(f"m_{g}").alias("mean_g"), F.col(f"c_{f}_{g}").alias("cov")) for f, g in pairs))
    return one.select(F.inline(rows))


def whitening(panel: DataFrame, features: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(scale matrix, means): features are divided by their spread, then turned onto the correlation's eigenvectors."""
    rows = moments(panel, features).collect()  # b (b + 1) / 2 rows
    index = {f: i for i, f in enumerate(features)}
    cov, mean = np.zeros((len(features),) * 2), np.zeros(len(features))
    for r in rows:
        cov[index[r["f"]], index[r["g"]]] = cov[index[r["g"]], index[r["f"]]] = r["cov"]
        mean[index[r["f"]]] = r["mean_f"]
    std = np.sqrt(np.diag(cov))
    if (std <= 0).any():
        raise ValueError("a feature has no variance")
    _, vectors = np.linalg.eigh(cov / np.outer(std, std))
    return vectors.T @ np.diag(1 / std), mean


def apply_scale(panel: DataFrame, features: Sequence[str], scale: np.ndarray, mean: np.ndarray) -> DataFrame:
    """Linear columns of literals; no join."""
    out = {f: sum((F.lit(float(scale[i, j])) * (F.col(g) - float(mean[j])) for j, g in enumerate(features)), F.lit(0.0)) for i, f in enumerate(features)}
    return panel.withColumns(out)


def undo_scale(panel: DataFrame, features: Sequence[str], scale: np.ndarray, mean: np.ndarray) -> DataFrame:
    back = np.linalg.inv(scale)
    return panel.withColumns({f: sum((F.lit(float(back[i, j])) * F.col(g) for j, g in enumerate(features)), F.lit(float(mean[i]))) for i, f in enumerate(features)})


def standardize(panel: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mean 0 and spread 1 of each feature over all cells."""
    one = panel.agg(*(F.avg(f).alias(f"m_{f}") for f in features), *(F.stddev_samp(f).alias(f"s_{f}") for f in features))
    return panel.crossJoin(F.broadcast(one)).select("vox", "img", *(F.try_divide(F.col(f) - F.col(f"m_{f}"), F.col(f"s_{f}")).alias(f) for f in features))


def stretch(panel: DataFrame, features: Sequence[str], scale: float) -> DataFrame:
    """Deviations from each image's mean over voxels, times scale. Means are joined, not windowed: an image may hold all voxels."""
    means = panel.groupBy("img").agg(*(F.avg(f).alias(f"m_{f}") for f in features))
    return panel.join(F.broadcast(means), "img").select("vox", "img", *((F.col(f"m_{f}") + scale * (F.col(f) - F.col(f"m_{f}"))).alias(f) for f in features))


def add_offset(panel: DataFrame, feature: str, offset: Column, inside: Column) -> DataFrame:
    return panel.withColumn(feature, F.col(feature) + F.when(inside, offset).otherwise(0.0))


def select_images(panel: DataFrame, selection: DataFrame) -> DataFrame:
    """Images by (new_img, old_img), with repeats and in the new order."""
    return panel.join(F.broadcast(selection.withColumnRenamed("old_img", "img")), "img").drop("img").withColumnRenamed("new_img", "img")


def leading_images(panel: DataFrame, n: int) -> DataFrame:
    held = panel.agg(F.max("img")).first()[0]
    if held is None or n > held + 1:
        raise ValueError(f"{n} images are asked for, {0 if held is None else held + 1} held")
    return panel.where(F.col("img") < n)


def split_groups(groups: DataFrame, fraction: float, seed: str = "") -> DataFrame:
    """(grp, n, fold): groups in md5 order, cut where the running count is closest to the fraction. One row a group."""
    order = Window.orderBy(F.md5(F.concat(F.lit(seed), F.col("grp").cast("string")).cast("binary")), "grp")
    running = groups.select("grp", "n", F.row_number().over(order).alias("pos"), F.sum("n").over(order).alias("cum"))
    target = running.agg((F.sum("n") * fraction).alias("target"))
    cut = running.crossJoin(F.broadcast(target)).agg(F.min_by("pos", F.struct(F.abs(F.col("cum") - F.col("target")), "pos")).alias("cut"))
    return running.crossJoin(F.broadcast(cut)).select("grp", "n", F.when(F.col("pos") <= F.col("cut"), "a").otherwise("b").alias("fold"))
