"""Statistics of every node of a static tree: project each voxel, roll up, compute.

A voxel's sufficient statistics (size, projections on the nuisance and interest bases, sums of
products) add up the tree, so images are reduced before anything is shuffled by node. They come from the cells
that are known alone; no dense panel is made.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import det2, dice, five_statistics, llr, precision, sensitivity, specificity

LEVELS = ("region", "nation", "vox")


def node_level() -> Column:
    """0 root, 1 region, 2 nation, 3 voxel, from grouping()."""
    return (3 - F.grouping("region") - F.grouping("nation") - F.grouping("vox")).cast("int").alias("level")


def roll_up(voxels: DataFrame, sums: Sequence[str]) -> DataFrame:
    """(level, region, nation, vox, sums...) of every node from a row for each voxel."""
    return voxels.rollup(*LEVELS).agg(node_level(), *(F.sum(s).alias(s) for s in sums)).select("level", *LEVELS, *sums)


def voxel_projections(held: DataFrame, n: int, features: Sequence[str]) -> DataFrame:
    """(vox, size, a0_f, a1_f, t_fg): projections on intercept and linear trend, and sums of products, over all n images.

    held has the cells that are known; the others are the voxel's mean, which enters by algebra and not as rows:
    the trend sums to 0 over all images, so over those missing to minus what it sums to over those known.
    """
    trend = (F.col("img") - (n - 1) / 2) / math.sqrt(n * (n * n - 1) / 12) if n > 1 else F.lit(0.0)
    sums = [F.count("*").alias("known"), F.sum(trend).alias("along")]
    for i, f in enumerate(features):
        sums += [F.avg(f).alias(f"m_{f}"), F.sum(F.col(f) * trend).alias(f"s_{f}"), *(F.sum(F.col(f) * F.col(g)).alias(f"p_{f}_{g}") for g in features[i:])]
    own = held.groupBy("vox").agg(*sums)
    out = [F.lit(1).cast("long").alias("size")]
    for i, f in enumerate(features):
        mean = F.col(f"m_{f}")
        out += [(mean * math.sqrt(n)).alias(f"a0_{f}"), (F.col(f"s_{f}") - mean * F.col("along")).alias(f"a1_{f}")]
        out += [(F.col(f"p_{f}_{g}") + (n - F.col("known")) * mean * F.col(f"m_{g}")).alias(f"t_{f}_{g}") for g in features[i:]]
    return own.select("vox", *out)


def standardized(held: DataFrame, n: int, features: Sequence[str]) -> DataFrame:
    """The known cells with mean 0 and spread 1 of each feature over all cells, the missing ones at their voxel's mean."""
    sums = [c for f in features for c in (F.avg(f).alias(f"m_{f}"), F.var_pop(f).alias(f"v_{f}"))]
    own = held.groupBy("vox").agg(F.count("*").alias("known"), *sums)
    # Spread over all cells: that of the known ones within their voxel, and of all voxels' means.
    cells = F.count("*") * n
    moments = [c for f in features for c in (F.avg(f"m_{f}").alias(f"mean_{f}"), F.sqrt((F.sum(F.col("known") * F.col(f"v_{f}")) + n * F.var_pop(f"m_{f}") * F.count("*")) / (cells - 1)).alias(f"std_{f}"))]
    one = own.agg(*moments)  # one row
    return held.crossJoin(F.broadcast(one)).select("vox", "img", *(F.try_divide(F.col(f) - F.col(f"mean_{f}"), F.col(f"std_{f}")).alias(f) for f in features))


def error_hypothesis(nodes: DataFrame, features: Sequence[str]) -> DataFrame:
    """Adds e_f_g and h_f_g: T - H and H of each node."""
    out = nodes
    for i, f in enumerate(features):
        for g in features[i:]:
            h = F.col(f"a1_{f}") * F.col(f"a1_{g}") / F.col("size")
            out = out.withColumn(f"h_{f}_{g}", h).withColumn(f"e_{f}_{g}", F.col(f"t_{f}_{g}") - F.col(f"a0_{f}") * F.col(f"a0_{g}") / F.col("size") - h)
    return out


def tree_error_hypothesis(held: DataFrame, n: int, tree: DataFrame, features: Sequence[str]) -> DataFrame:
    voxels = voxel_projections(held, n, features)
    sums = [c for c in voxels.columns if c != "vox"]
    return error_hypothesis(roll_up(voxels.join(tree, "vox"), sums), features)


def tree_llr(held: DataFrame, n: int, tree: DataFrame, feature: str, min_size: int = 1) -> DataFrame:
    nodes = tree_error_hypothesis(held, n, tree, [feature])
    e, h = F.col(f"e_{feature}_{feature}"), F.col(f"h_{feature}_{feature}")
    return nodes.select("level", *LEVELS, "size", F.when(F.col("size") >= min_size, llr(e, e + h, F.col("size"))).alias("llr"))


def tree_llr_two(held: DataFrame, n: int, tree: DataFrame, f: str, g: str) -> DataFrame:
    """The same for two features, by closed-form determinants."""
    nodes = tree_error_hypothesis(held, n, tree, [f, g])
    e = [F.col(f"e_{a}_{b}") for a, b in ((f, f), (f, g), (g, g))]
    t = [F.col(f"e_{a}_{b}") + F.col(f"h_{a}_{b}") for a, b in ((f, f), (f, g), (g, g))]
    return nodes.select("level", *LEVELS, "size", llr(det2(*e), det2(*t), F.col("size")).alias("llr"))


def tree_five_statistics(held: DataFrame, n: int, tree: DataFrame, feature: str) -> DataFrame:
    """A row for each node and statistic: E and H are computed once, statistics unpivoted."""
    nodes = tree_error_hypothesis(held, n, tree, [feature])
    found = five_statistics(F.col(f"e_{feature}_{feature}"), F.col(f"h_{feature}_{feature}"), F.lit(1.0))
    return nodes.select("level", *LEVELS, *(c.alias(k) for k, c in found.items())).unpivot(["level", *LEVELS], list(found), "statistic", "value")


def tree_confusion(voxels: DataFrame) -> DataFrame:
    """Overlap of every node with a target, from (vox, region, nation, target)."""
    marked = voxels.withColumns({"tp": F.col("target").cast("long"), "fp": (~F.col("target")).cast("long")})
    nodes = roll_up(marked, ["tp", "fp"])
    total = marked.agg(F.sum("tp").alias("pos"), F.sum("fp").alias("neg"))  # one row
    counted = nodes.crossJoin(F.broadcast(total)).select("level", *LEVELS, "tp", "fp", (F.col("pos") - F.col("tp")).alias("fn"), (F.col("neg") - F.col("fp")).alias("tn"))
    return counted.withColumns(confusion_metrics())


def confusion_metrics() -> dict[str, Column]:
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return {"dice": dice(tp, fp, fn), "sens": sensitivity(tp, fn), "ppv": precision(tp, fp), "spec": specificity(tn, fp)}
