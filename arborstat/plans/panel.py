"""The dense panel of measurements and the static tree over its voxels.

Here a voxel is a supplier, an image a month of shipping, and the features are means of a line's
quantity, price and discount. Missing (voxel, image) cells hold the voxel's mean.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import written

FEATURES = ("qty", "price", "disc")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def images(lines: DataFrame) -> DataFrame:
    """(month, img): the images in order, numbered from 0. A row for each month that occurs."""
    months = lines.select(F.date_format("l_shipdate", "yyyy-MM").alias("month")).distinct()
    return months.select("month", F.expr("row_number() over (order by month) - 1").cast("int").alias("img"))


def sparse_panel(lines: DataFrame) -> tuple[DataFrame, int]:
    """((vox, img, qty, price, disc) of the cells that have lines, number of images): lines are read once, as a written table."""
    cells = lines.groupBy(F.col("l_suppkey").alias("vox"), F.date_format("l_shipdate", "yyyy-MM").alias("month")).agg(
        F.avg("l_quantity").alias("qty"), F.avg("l_extendedprice").alias("price"), F.avg("l_discount").alias("disc")
    )
    cells = written(cells, "cells")
    months = [r["month"] for r in cells.select("month").distinct().orderBy("month").collect()]  # of the calendar
    number = F.create_map(*(F.lit(x) for i, m in enumerate(months) for x in (m, i)))[F.col("month")] if months else F.lit(None).cast("int")
    return cells.select("vox", number.cast("int").alias("img"), *FEATURES), len(months)


def dense_panel(lines: DataFrame) -> DataFrame:
    """(vox, img, qty, price, disc) for every voxel and image."""
    held, n = sparse_panel(lines)
    means = held.groupBy("vox").agg(*(F.avg(f).alias(f"mean_{f}") for f in FEATURES))
    grid = means.withColumn("img", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))) if n else means.withColumn("img", F.lit(0))
    return grid.join(held, ["vox", "img"], "left").select("vox", "img", *(F.coalesce(f, f"mean_{f}").alias(f) for f in FEATURES))


def dense_arrays(held: DataFrame, n: int, feature: str) -> DataFrame:
    """(vox, y): a voxel's values in the order of all images, its mean where it has no line; nothing but its own cells is moved."""
    own = held.groupBy("vox").agg(F.avg(feature).alias("mean"), F.map_from_entries(F.collect_list(F.struct("img", feature))).alias("at"))
    return own.select("vox", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.try_element_at("at", i), F.col("mean"))).alias("y"))


def packed(panel: DataFrame, feature: str) -> DataFrame:
    """(vox, y): a voxel's values in the order of its images."""
    return panel.groupBy("vox").agg(F.transform(F.array_sort(F.collect_list(F.struct("img", feature))), lambda s: s[feature]).alias("y"))


def voxel_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vox, region, nation): the static hierarchy over the voxels."""
    suppliers, nations = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    # 25 nations, whatever the scale.
    return suppliers.join(F.broadcast(nations), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("vox"), F.col("n_regionkey").alias("region"), F.col("s_nationkey").alias("nation"))


def trend_basis(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit intercept and unit centred linear trend over n images."""
    t = np.arange(n) - (n - 1) / 2
    return np.full(n, 1 / np.sqrt(n)), t / np.sqrt((t * t).sum())
