"""Scores of a fit's discoveries against planted targets, by experiment: masks as tables of voxels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tree_stats import confusion_metrics

COUNTS = ("tp", "fp", "fn", "tn")


def union(*masks: DataFrame) -> DataFrame:
    out = masks[0]
    for m in masks[1:]:
        out = out.unionByName(m)
    return out.distinct()


def intersection(*masks: DataFrame) -> DataFrame:
    out = masks[0].distinct()
    for m in masks[1:]:
        out = out.join(m, out.columns, "left_semi")
    return out


def difference(mask: DataFrame, *others: DataFrame) -> DataFrame:
    out = mask.distinct()
    for m in others:
        out = out.join(m, out.columns, "left_anti")
    return out


def counted(pred: Column, target: Column, suffix: str = "") -> list[Column]:
    cells = {"tp": pred & target, "fp": pred & ~target, "fn": ~pred & target, "tn": ~pred & ~target}
    return [F.count_if(c).alias(f"{n}{suffix}") for n, c in cells.items()]


def marked(voxels: DataFrame, targets: DataFrame, key: str, n_targets: int) -> DataFrame:
    """`voxels` (key, vox, ...) with t0, t1, ... and `target`, whether any of them holds the voxel."""
    held = targets.groupBy(key, "vox").agg(*(F.bool_or(F.col("target") == i).alias(f"t{i}") for i in range(n_targets)))
    each = {f"t{i}": F.coalesce(f"t{i}", F.lit(False)) for i in range(n_targets)}
    out = voxels.join(held, [key, "vox"], "left").withColumns(each)
    return out.withColumn("target", F.greatest(F.lit(False), F.lit(False), *(F.col(f"t{i}") for i in range(n_targets))))


def union_score(active: DataFrame, regions: DataFrame, targets: DataFrame, key: str = "exp_id", n_targets: int = 1) -> DataFrame:
    """(key, num_vox, n_pred, tp, fp, fn, tn) of the regions' union against the targets' union among the active voxels.

    With several targets the same counts follow against each, as tp0, fp0, ..., the others being background.
    """
    pred = regions.select(key, "vox").distinct().withColumn("pred", F.lit(True))
    cells = marked(active.select(key, "vox"), targets, key, n_targets).join(pred, [key, "vox"], "left").withColumn("pred", F.coalesce("pred", F.lit(False)))
    p, more = F.col("pred"), []
    if n_targets > 1:
        more = [c for i in range(n_targets) for c in counted(p, F.col(f"t{i}"), str(i))]
    each = cells.groupBy(key).agg(F.count("*").alias("num_vox"), *counted(p, F.col("target")), *more)
    number = regions.groupBy(key).agg(F.countDistinct("region").alias("n_pred"))
    return each.join(number, key, "left").withColumn("n_pred", F.coalesce("n_pred", F.lit(0).cast("long")))


def region_records(active: DataFrame, regions: DataFrame, targets: DataFrame, key: str = "exp_id", n_targets: int = 1) -> DataFrame:
    """(key, region, num_vox, pval, target, target0, ...): each region's active voxels, and how many lie in the targets."""
    cells = marked(regions.join(active.select(key, "vox"), [key, "vox"], "left_semi"), targets, key, n_targets)
    each = [F.count_if(f"t{i}").alias(f"target{i}") for i in range(n_targets)] if n_targets > 1 else []
    return cells.groupBy(key, "region").agg(F.count("*").alias("num_vox"), F.max("pval").alias("pval"), F.count_if("target").alias("target"), *each)


def detection_score(active: DataFrame, regions: DataFrame, targets: DataFrame, tested: DataFrame, key: str = "exp_id", n_targets: int = 1) -> DataFrame:
    """A row an experiment: counts of `union_score`, the smallest p-value of all tested, and `pred`, the records of its regions.

    active (key, vox); regions (key, region, vox, pval); targets (key, target, vox), target from 0; tested (key, pval).
    """
    least = tested.groupBy(key).agg(F.min(F.when(~F.isnan("pval"), F.col("pval"))).alias("min_pval"))
    records = region_records(active, regions, targets, key, n_targets)
    rest = [c for c in records.columns if c != key]
    pred = records.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias("pred"))  # what one fit discovers
    return union_score(active, regions, targets, key, n_targets).join(least, key, "left").join(pred, key, "left").withColumn("pred", F.coalesce("pred", F.array().cast(pred.schema["pred"].dataType)))


def pred_block(scores: DataFrame, field: str, key: str = "exp_id") -> DataFrame:
    """(key, place, value): one field of the records as a rectangle, NULL where an experiment has fewer regions than the widest."""
    widest = scores.agg(F.max(F.size("pred")).alias("widest"))  # one row
    places = scores.crossJoin(F.broadcast(widest)).where("widest > 0").select(key, "pred", F.explode(F.sequence(F.lit(0), F.col("widest") - 1)).alias("place"))
    return places.select(key, "place", F.get("pred", F.col("place"))[field].alias("value"))


def max_z_region(nodes: DataFrame, active: Column, order: Sequence[str], counts: Sequence[str] = COUNTS) -> DataFrame:
    """One row: the active node of the largest known z, the first in order on ties, its size, z and confusion counts."""
    z = F.when(active & ~F.isnan("z"), F.col("z"))
    place = F.struct((-z).alias("down"), *(F.coalesce(c, F.lit(-1)).alias(c) for c in order))
    return nodes.where(z.isNotNull()).agg(F.min_by(F.struct(*order, "size", "z", *counts), place).alias("best")).select("best.*")


def best_dice(nodes: DataFrame, order: Sequence[str], counts: Sequence[str] = ("tp", "fp", "fn", "tn", "dice"), digits: int = 9) -> DataFrame:
    """One row: the node of the best Dice, the first in order on ties."""
    place = F.struct((-F.round("dice", digits)).alias("down"), *(F.coalesce(c, F.lit(-1)).alias(c) for c in order))
    return nodes.agg(F.min_by(F.struct(*order, *counts), place).alias("best")).select("best.*")


def centroids(nodes: DataFrame, keys: Sequence[str], axes: Sequence[str] = ("i", "j"), digits: int = 1) -> DataFrame:
    """Mean place of each node, from its size and the sums of its voxels' places."""
    return nodes.select(*keys, *(F.round(F.col(a) / F.col("size"), digits).alias(f"c{a}") for a in axes))


def plan_labels(voxels: DataFrame, patches: DataFrame, n_patches: int) -> DataFrame:
    """(vox, label): the last patch (vox, seq) that holds a voxel, the rest one label after them; labels without voxels are renumbered away."""
    last = patches.groupBy("vox").agg(F.max("seq").alias("seq"))
    raw = voxels.select("vox").join(last, "vox", "left").select("vox", F.coalesce("seq", F.lit(n_patches)).alias("raw"))
    held = raw.select("raw").distinct()  # as many as there are patches, and one
    dense = held.select("raw", (F.expr("row_number() over (order by raw)") - 1).alias("label"))
    return raw.join(F.broadcast(dense), "raw").select("vox", "label")


def voxel_lists(labels: DataFrame) -> DataFrame:
    """(label, vox_list): the voxels of each label, in order; labels are one experiment's."""
    return labels.where("label >= 0").groupBy("label").agg(F.array_sort(F.collect_list("vox")).alias("vox_list"))


def scored(counts: DataFrame) -> DataFrame:
    return counts.withColumns(confusion_metrics())
