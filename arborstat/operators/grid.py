"""Operators on the voxel grid: neighbours, components, cluster extents, enhancement, smoothing."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import known
from ..tables import discard, written

FWHM_TO_SIGMA = 1 / math.sqrt(8 * math.log(2))
#: A kernel reaches so many standard deviations.
TRUNCATE = 4.0


def offsets(conn: int, dims: int) -> list[tuple[int, ...]]:
    """Shifts to the neighbours: 4 or 8 in a plane, 6, 18 or 26 in space."""
    reach = {(2, 4): 1, (2, 8): 2, (3, 6): 1, (3, 18): 2, (3, 26): 3}.get((dims, conn))
    if reach is None:
        raise ValueError(f"no {conn} neighbours in {dims} dimensions")
    return [d for d in itertools.product((-1, 0, 1), repeat=dims) if 0 < sum(map(abs, d)) <= reach]


def neighbour_pairs(cells: DataFrame, conn: int = 4, axes: tuple[str, ...] = ("i", "j"), keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, u, v): voxels next to each other, by an equi-join on shifted coordinates."""
    shifts = F.array(*(F.struct(*(F.lit(x).alias(f"d{a}") for a, x in zip(axes, d, strict=True))) for d in offsets(conn, len(axes))))
    moved = cells.select(*keys, F.col("vox").alias("u"), *axes, F.explode(shifts).alias("d")).select(*keys, "u", *((F.col(a) + F.col(f"d.d{a}")).alias(a) for a in axes))
    return moved.join(cells.select(*keys, F.col("vox").alias("v"), *axes), [*keys, *axes]).select(*keys, "u", "v")


#: Cells of one image that a task labels in one go; larger images take rounds of joins.
IMAGE_CELLS = 2_000_000


def components(cells: DataFrame, conn: int = 4, axes: tuple[str, ...] = ("i", "j"), keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, vox, comp): comp is the smallest voxel of the connected component.

    Images (one for each of `keys`) whose cells a task holds are labelled there, one pass for all; beyond
    IMAGE_CELLS labels spread over written edges.
    """
    most = cells.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    return labelled(cells, conn, axes, keys) if most <= IMAGE_CELLS else spread_labels(cells, conn, axes, keys)


def touching(place: np.ndarray, shifts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of cells (n, dims) that are next to each other, each pair once."""
    place = place - place.min(axis=0) + 1
    span = place.max(axis=0) + 2
    code = np.ravel_multi_index(tuple(place.T), tuple(span))
    order = np.argsort(code, kind="stable")
    held, pairs = code[order], []
    for shift in shifts[len(shifts) // 2 :]:  # the other half are the same pairs
        to = code + np.ravel_multi_index(tuple(place[0] + shift), tuple(span)) - code[0] if len(code) else code
        at = np.minimum(np.searchsorted(held, to), len(held) - 1)
        met = held[at] == to
        pairs.append(np.stack([np.flatnonzero(met), order[at[met]]]))
    u, v = np.concatenate(pairs, axis=1)
    return u, v


def labelled(cells: DataFrame, conn: int, axes: tuple[str, ...], keys: tuple[str, ...]) -> DataFrame:
    """Each image's components by its own task: labels fall to the least neighbour's and jump to their own label's."""
    shifts, kinds = np.array(offsets(conn, len(axes)), np.int64), dict(cells.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "vox long", "comp long"])

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        vox = pdf["vox"].to_numpy(np.int64)
        u, v = touching(pdf[list(axes)].to_numpy(np.int64), shifts)
        rank = np.argsort(np.argsort(vox, kind="stable"), kind="stable")
        comp = rank.copy()
        by_rank = np.argsort(rank)
        while len(u):
            low = np.minimum(comp[u], comp[v])
            new = comp.copy()
            np.minimum.at(new, by_rank[comp[u]], low)  # the old labels' own cells too, so that whole trees move
            np.minimum.at(new, by_rank[comp[v]], low)
            np.minimum.at(new, u, low)
            np.minimum.at(new, v, low)
            new = new[by_rank[new]]
            if (new == comp).all():
                break
            comp = new
        return pdf[list(keys)].assign(vox=vox, comp=vox[by_rank[comp]])

    return cells.select(*keys, F.col("vox").cast("long").alias("vox"), *axes).groupBy(*keys).applyInPandas(label, schema)


def spread_labels(cells: DataFrame, conn: int, axes: tuple[str, ...], keys: tuple[str, ...]) -> DataFrame:
    """The same by joins: labels spread and jump until they stay."""
    edges = written(neighbour_pairs(cells, conn, axes, keys), "edges")
    label = old = written(cells.select(*keys, "vox", F.col("vox").alias("comp")), "labels")
    while True:
        spread = edges.join(label.withColumnRenamed("vox", "v"), [*keys, "v"]).groupBy(*keys, "u").agg(F.min("comp").alias("near"))
        near = label.join(spread.withColumnRenamed("u", "vox"), [*keys, "vox"], "left").select(*keys, "vox", "comp", F.least("comp", "near").alias("low"))
        # The label of the label's own voxel, so that long components settle in few rounds.
        far = near.select(*keys, F.col("vox").alias("low"), F.col("low").alias("jump"))
        new = written(near.join(far, [*keys, "low"], "left").select(*keys, "vox", F.least("low", "jump").alias("new"), "comp"), "labels")
        discard(old)
        if new.where("new <> comp").isEmpty():
            discard(edges)
            return new.select(*keys, "vox", F.col("new").alias("comp"))
        old, label = new, new.select(*keys, "vox", F.col("new").alias("comp"))


def cluster_extents(stats: DataFrame, threshold: float, conn: int = 4, axes: tuple[str, ...] = ("i", "j"), keys: tuple[str, ...] = ("k",)) -> tuple[DataFrame, DataFrame]:
    """((keys, vox, extent), (keys, max_stat)): sizes of the components at or over the threshold, by draw.

    Voxels below it have extent 0, and a draw without a cluster has the maximum 0.
    """
    over = stats.where(F.col("stat") >= threshold)
    comp = components(over.select(*keys, "vox", *axes), conn, axes, keys)
    sizes = comp.groupBy(*keys, "comp").agg(F.count("*").alias("extent"))
    each = stats.select(*keys, "vox", "stat").join(comp, [*keys, "vox"], "left").join(sizes, [*keys, "comp"], "left")
    each = each.select(*keys, "vox", F.when(F.col("stat").isNotNull(), F.coalesce("extent", F.lit(0))).alias("extent"))
    return each, each.groupBy(*keys).agg(F.coalesce(F.max("extent"), F.lit(0)).alias("max_stat"))


def enhance(image: DataFrame, height_power: float = 2.0, extent_power: float = 0.5, steps: int = 100, conn: int = 4, axes: tuple[str, ...] = ("i", "j"), keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, vox, tfce): threshold-free cluster enhancement, the sum of extent^E height^H over equal steps to the maximum.

    By `keys` (draws, say) each image has a maximum of its own. Unknown statistics count as 0 in it and stay unknown.
    """
    held = image.select(*keys, "vox", *axes, known(F.col("stat")).alias("stat"))
    most = held.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    way = enhanced if most <= IMAGE_CELLS else enhanced_by_joins
    return way(held, height_power, extent_power, steps, conn, axes, keys)


def enhanced(held: DataFrame, height_power: float, extent_power: float, steps: int, conn: int, axes: tuple[str, ...], keys: tuple[str, ...]) -> DataFrame:
    """Each image by its own task: from the highest step down cells come in and components only merge, so a pair of neighbours counts once."""
    shifts, kinds = np.array(offsets(conn, len(axes)), np.int64), dict(held.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), f"vox {kinds['vox']}, tfce double"])

    def lift(pdf: pd.DataFrame) -> pd.DataFrame:
        stat = pdf["stat"].to_numpy(np.float64, na_value=np.nan)
        unknown = np.isnan(stat)
        tfce = np.zeros(len(stat))
        top = stat[~unknown].max(initial=0.0)
        if top > 0:
            heights = np.append(top * np.arange(1.0, steps) / steps, top)
            level = np.where(stat > 0, np.searchsorted(heights, stat, side="right"), 0)  # the steps that a cell reaches
            cells = np.flatnonzero(level)
            cells = cells[np.argsort(-level[cells], kind="stable")]
            level = level[cells]
            tfce[cells] = summed(level, *touching(pdf[list(axes)].to_numpy(np.int64)[cells], shifts), heights, height_power, extent_power)
        return pdf[list(keys)].assign(vox=pdf["vox"].to_numpy(), tfce=pd.arrays.FloatingArray(tfce, unknown))

    return held.groupBy(*keys).applyInPandas(lift, schema)


def summed(level: np.ndarray, u: np.ndarray, v: np.ndarray, heights: np.ndarray, height_power: float, extent_power: float) -> np.ndarray:
    """Each cell's sum over its steps of extent^E height^H. level: the steps a cell reaches, falling; u, v: neighbours."""
    met = np.minimum(level[u], level[v])
    order = np.argsort(-met, kind="stable")
    u, v = u[order], v[order]
    steps = np.arange(len(heights), 0, -1)
    cells, pairs = np.searchsorted(-level, -steps, side="right"), np.searchsorted(-met[order], -steps, side="right")
    comp, out, n, had, joined = np.empty(len(level), np.int64), np.zeros(len(level)), 0, 0, 0
    for step, m, to in zip(steps.tolist(), cells.tolist(), pairs.tolist(), strict=True):
        comp[had:m] = np.arange(n, n + m - had)
        n += m - had
        label = np.arange(n)
        a, b = comp[u[joined:to]], comp[v[joined:to]]
        while True:
            x, y = label[a], label[b]
            apart = x != y
            if not apart.any():
                break
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while (label[label] != label).any():
                label = label[label]
        first = label == np.arange(n)
        comp[:m] = (np.cumsum(first) - 1)[label][comp[:m]]
        n, had, joined = int(first.sum()), m, to
        out[:m] += (np.bincount(comp[:m], minlength=n) ** extent_power * heights[step - 1] ** height_power)[comp[:m]]
    return out


def enhanced_by_joins(held: DataFrame, height_power: float, extent_power: float, steps: int, conn: int, axes: tuple[str, ...], keys: tuple[str, ...]) -> DataFrame:
    """The same, a row a cell and step, for images that no task may hold."""
    top = held.groupBy(*keys).agg(F.max("stat").alias("top"))  # a row an image
    with_top = held.join(F.broadcast(top), list(keys)) if keys else held.crossJoin(F.broadcast(top))
    # Only the steps that a voxel reaches: s steps of height top / steps each, the last at top itself.
    step = F.struct(F.col("s").alias("step"), F.when(F.col("s") == steps, F.col("top")).otherwise(F.col("top") * F.col("s") / steps).alias("height"))
    levels = with_top.where("top > 0 and stat > 0").select(*keys, "vox", *axes, "stat", "top", F.explode(F.expr(f"sequence(1, {steps})")).alias("s")).withColumn("l", step)
    over = written(levels.select(*keys, "vox", *axes, "stat", F.col("l.step").alias("step"), F.col("l.height").alias("height")).where("stat >= height"), "levels")
    comp = components(over.select(*keys, "step", "vox", *axes), conn, axes, (*keys, "step"))
    sizes = comp.groupBy(*keys, "step", "comp").agg(F.count("*").alias("extent"))
    part = over.join(comp, [*keys, "step", "vox"]).join(sizes, [*keys, "step", "comp"]).groupBy(*keys, "vox").agg(F.sum(F.pow("extent", F.lit(extent_power)) * F.pow("height", F.lit(height_power))).alias("tfce"))
    return held.select(*keys, "vox", "stat").join(part, [*keys, "vox"], "left").select(*keys, "vox", F.when(F.col("stat").isNotNull(), F.coalesce("tfce", F.lit(0.0))).alias("tfce"))


def kernel(fwhm: float, size: float = 1.0) -> list[tuple[int, float]]:
    """(shift, weight) of a truncated Gaussian, weights summing to 1."""
    sigma = fwhm * FWHM_TO_SIGMA / size
    reach = int(TRUNCATE * sigma + 0.5)
    raw = [math.exp(-0.5 * (x / sigma) ** 2) for x in range(-reach, reach + 1)] if sigma else [1.0]
    return [(x, w / sum(raw)) for x, w in zip(range(-reach, reach + 1), raw, strict=True)]


def smooth(spark: SparkSession, image: DataFrame, fwhm: float | None, axes: tuple[str, ...] = ("i", "j"), keys: tuple[str, ...] = ()) -> DataFrame:
    """`image` (keys, vox, axes, val) smoothed axis by axis, weights renormalised within the mask."""
    if not fwhm:
        return image
    weights = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(w).alias("w")) for x, w in kernel(fwhm)))
    spread = image.select(*keys, *axes, F.col("val").alias("num"), F.lit(1.0).alias("den"))
    for a in axes:
        moved = spread.withColumn("d", F.explode(weights)).withColumn(a, F.col(a) + F.col("d.x"))
        spread = moved.groupBy(*keys, *axes).agg(F.sum(F.col("num") * F.col("d.w")).alias("num"), F.sum(F.col("den") * F.col("d.w")).alias("den"))
    return image.drop("val").join(spread, [*keys, *axes]).select(*keys, "vox", *axes, F.try_divide("num", "den").alias("val"))


def bounding_box(cells: DataFrame, axes: tuple[str, ...] = ("i", "j")) -> DataFrame:
    return cells.agg(*(f(a).alias(f"{name}_{a}") for a in axes for name, f in (("lo", F.min), ("hi", F.max))))


def inflate(held: DataFrame, support: DataFrame, halo: int, axes: tuple[str, ...] = ("i", "j")) -> DataFrame:
    """The support's voxels within a box of `halo` around a held voxel. Axis by axis, so shifts add and don't multiply."""
    grown = held.select(*axes)
    for a in axes:
        grown = grown.withColumn("d", F.explode(F.sequence(F.lit(-halo), F.lit(halo)))).withColumn(a, F.col(a) + F.col("d")).drop("d").distinct()
    return support.join(grown, list(axes), "left_semi")


def crop(cells: DataFrame, box: DataFrame, axes: tuple[str, ...] = ("i", "j")) -> DataFrame:
    """The cells within a bounding box, in coordinates from its corner."""
    inside = cells.crossJoin(F.broadcast(box))  # one row
    for a in axes:
        inside = inside.where(F.col(a).between(F.col(f"lo_{a}"), F.col(f"hi_{a}"))).withColumn(a, F.col(a) - F.col(f"lo_{a}"))
    return inside.select(*cells.columns)


def scatter(values: DataFrame, grid: DataFrame, column: str, axes: tuple[str, ...] = ("i", "j"), empty: float = 0.0) -> DataFrame:
    """(axes, column) of every place of a grid: a voxel's value, `empty` where no voxel is."""
    return grid.select(*axes).join(values.select(*axes, column), list(axes), "left").select(*axes, F.coalesce(column, F.lit(empty)).alias(column))


def gather(volume: DataFrame, voxels: DataFrame, column: str, axes: tuple[str, ...] = ("i", "j")) -> DataFrame:
    """(vox, column): a volume's values at the voxels."""
    return voxels.select("vox", *axes).join(volume.select(*axes, column), list(axes)).select("vox", column)


def voxel_sizes(affine: np.ndarray) -> np.ndarray:
    """A voxel's size along each axis, from a 4 x 4 affine."""
    return np.sqrt((np.asarray(affine, float)[:3, :3] ** 2).sum(axis=0))


def halo(fwhm: float, size: float = 1.0) -> int:
    """Voxels beyond which a kernel reaches nothing."""
    return int(TRUNCATE * fwhm * FWHM_TO_SIGMA / size + 0.5)


def mask_entropy(labels: DataFrame) -> DataFrame:
    """Shannon entropy in bits of the labels from 0 on; 0 if there are none."""
    from ..functions.columns import entropy_bits

    counts = labels.where("label >= 0").groupBy("label").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).agg(entropy_bits(F.col("n") / F.col("total")).alias("entropy"))
