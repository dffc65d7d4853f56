"""Registered queries of the engine on the driver's tables; `oracles` holds their SQL.

Floating results are rounded, as engines sum in different orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import grid, permutation, preprocess, tree_stats
from ..tables import written
from .panel import FEATURES, dense_arrays, dense_panel, images, sparse_panel, table, trend_basis, voxel_tree

DIGITS, N_PERM = 6, 50
#: Nations whose suppliers are the planted target.
TARGET_NATIONS = (3, 7, 12)


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, DIGITS).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense_panel(table(spark, sf_dir, "lineitem"))


def panel_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(panel(spark, sf_dir))


def voxel_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preprocess.screen_constant(panel(spark, sf_dir), FEATURES, rtol=0.9)


def whiten_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(preprocess.moments(panel(spark, sf_dir), FEATURES))


def zero_mean_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(preprocess.standardize(panel(spark, sf_dir), FEATURES))


def sigma_stretch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(preprocess.stretch(panel(spark, sf_dir), FEATURES, 1.5))


def offset_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = panel(spark, sf_dir).join(voxel_tree(spark, sf_dir), "vox")
    inside = F.col("nation").isin(*TARGET_NATIONS)
    return rounded(preprocess.add_offset(held, "qty", 0.5 * F.col("img"), inside).select("vox", "img", "qty"))


def image_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All images in reverse order, the even ones again behind them."""
    months = images(table(spark, sf_dir, "lineitem")).select("img")
    order = F.when(F.col("again"), F.col("img")).otherwise(-F.col("img"))
    both = months.withColumn("again", F.lit(False)).unionByName(months.where("img % 2 = 0").withColumn("again", F.lit(True)))
    chosen = both.select(F.col("img").alias("old_img"), (F.row_number().over(Window.orderBy("again", order)) - 1).cast("int").alias("new_img"))  # a row an image
    return rounded(preprocess.select_images(panel(spark, sf_dir), chosen).select("vox", "img", "qty"))


def leading_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(preprocess.leading_images(panel(spark, sf_dir), 12).select("vox", "img", "qty"))


def group_split_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("grp")).agg(F.count("*").alias("n"))
    return preprocess.split_groups(groups, 0.5)


def tree_node_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = panel(spark, sf_dir).groupBy("vox").agg(F.lit(1).cast("long").alias("size"), F.sum("qty").alias("qty"))
    return rounded(tree_stats.roll_up(sums.join(voxel_tree(spark, sf_dir), "vox"), ["size", "qty"]))


def tree_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tree_stats.tree_confusion(voxel_tree(spark, sf_dir).withColumn("target", F.col("nation").isin(*TARGET_NATIONS))))


def known_cells(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    return sparse_panel(table(spark, sf_dir, "lineitem"))


def tree_eh_b1(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = tree_stats.tree_error_hypothesis(*known_cells(spark, sf_dir), voxel_tree(spark, sf_dir), ["qty"])
    return rounded(nodes.select("level", "region", "nation", "vox", "size", F.col("e_qty_qty").alias("e"), F.col("h_qty_qty").alias("h")))


def tree_llr_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tree_stats.tree_llr(*known_cells(spark, sf_dir), voxel_tree(spark, sf_dir), "qty"))


def five_stats_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tree_stats.tree_five_statistics(*known_cells(spark, sf_dir), voxel_tree(spark, sf_dir), "qty"))


def tree_llr_b2(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, n = known_cells(spark, sf_dir)
    return rounded(tree_stats.tree_llr_two(tree_stats.standardized(held, n, ["qty", "price"]), n, voxel_tree(spark, sf_dir), "qty", "price"))


def perm_table_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation.hashed_permutations(spark, N_PERM, images(table(spark, sf_dir, "lineitem")).count())


def draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LLR draws of every node: packed voxels meet all permuted bases in a matrix product."""
    return written(permutation.tree_draws(voxel_draws(spark, sf_dir, N_PERM), voxel_tree(spark, sf_dir)), "draws")


def voxel_draws(spark: SparkSession, sf_dir: str, n_perm: int) -> DataFrame:
    held, n = known_cells(spark, sf_dir)
    intercept, trend = trend_basis(n)
    bases = permutation.permuted_bases(permutation.hashed_permutations(spark, n_perm, n), trend)
    return written(permutation.voxel_draws(dense_arrays(held, n, "qty"), bases, intercept), "voxels")


NODE = ("level", "region", "nation", "vox")


def perm_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(draws(spark, sf_dir))


def draw_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(permutation.z_scores(draws(spark, sf_dir), NODE).drop("stat"))


def max_stat_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(permutation.max_null(permutation.z_scores(draws(spark, sf_dir), NODE), "z"))


def fwer_pvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = permutation.z_scores(draws(spark, sf_dir), NODE).withColumn("z", F.round("z", DIGITS))
    return rounded(permutation.rank_pvalues(z.where("k = 0").select(*NODE, "z"), permutation.max_null(z, "z"), "z"))


def critical_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(permutation.critical_value(permutation.max_null(permutation.z_scores(draws(spark, sf_dir), NODE), "z")))


def voxel_stat_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(draws(spark, sf_dir).where("level = 3").select("k", "vox", "stat"))


def cft_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(draws(spark, sf_dir).where("level = 3 and k > 0").agg(F.percentile("stat", F.lit(0.95)).alias("threshold"), F.count("stat").alias("n")))


def part_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vox, i, j, val): parts' mean price on the plane of size and brand."""
    cells = table(spark, sf_dir, "part").groupBy(F.col("p_size").alias("i"), "p_brand").agg(F.avg("p_retailprice").alias("val"))
    return cells.select("i", F.dense_rank().over(brand_order()).cast("int").alias("j"), "val").select((F.col("i") * 1000 + F.col("j")).cast("long").alias("vox"), "i", "j", "val")


def brand_order():
    return Window.orderBy("p_brand")


def grid_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = part_grid(spark, sf_dir)
    middle = cells.agg(F.percentile("val", F.lit(0.5)).alias("mid"))
    return cells.crossJoin(F.broadcast(middle)).where("val >= mid").drop("mid")


def neighbor_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = part_grid(spark, sf_dir)
    pairs = grid.neighbour_pairs(cells, 4)
    return rounded(pairs.join(cells.select(F.col("vox").alias("v"), "val"), "v").groupBy(F.col("u").alias("vox")).agg(F.count("*").alias("n"), F.avg("val").alias("near")))


def grid_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.components(grid_threshold(spark, sf_dir), 4)


def cluster_extent_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draw k adds a multiple of the cell's place to its value; every cell's extent and its draw's largest."""
    cells = part_grid(spark, sf_dir).crossJoin(F.broadcast(spark.range(4).select(F.col("id").cast("int").alias("k"))))
    stats = cells.select("k", "vox", "i", "j", (F.col("val") + F.col("k") * F.pmod(F.col("i") * 7 + F.col("j") * 13, F.lit(100))).alias("stat"))
    each, null = grid.cluster_extents(stats, 1500.0)
    return each.join(F.broadcast(null), "k")  # a row a draw


def price_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_grid(spark, sf_dir).select("vox", "i", "j", (F.col("val") / 1000).alias("stat"))


def tfce_enhance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All hundred heights; every eleventh cell is unknown."""
    image = price_image(spark, sf_dir).withColumn("stat", F.when(F.col("vox") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("stat")))
    return rounded(grid.enhance(image))


def grid_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(grid.smooth(spark, part_grid(spark, sf_dir), 2.0).select("vox", "val"))


def grid_inflate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of the upper tenth, grown by one."""
    cells = part_grid(spark, sf_dir)
    top = cells.agg(F.percentile("val", F.lit(0.9)).alias("top"))
    return grid.inflate(cells.crossJoin(F.broadcast(top)).where("val >= top"), cells, 1).select("vox", "i", "j")


def grid_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.bounding_box(grid_threshold(spark, sf_dir))


def entropy_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(grid.mask_entropy(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("label"))))


QUERIES = (
    panel_fill, voxel_screen, whiten_moments, zero_mean_scale, sigma_stretch, offset_patch, image_select, leading_images, group_split_cut, tree_node_sum, tree_confusion, tree_eh_b1, tree_llr_scan,
    five_stats_unpivot, tree_llr_b2, perm_table_md5, perm_draws, draw_zscore, max_stat_null, fwer_pvalues, critical_value, voxel_stat_matrix, cft_quantile, neighbor_join, grid_components,
    cluster_extent_test, tfce_enhance, grid_smooth, grid_inflate, grid_bbox, entropy_bits,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}
