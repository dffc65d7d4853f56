"""Registered queries of scoring, reporting, provenance and whole fits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import provenance, report, scoring, tree_stats
from ..tables import written
from . import fits
from .catalogue import NODE, TARGET_NATIONS, rounded
from .panel import dense_arrays, images, sparse_panel, table, trend_basis, voxel_tree


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as trials: method (priority), seed, x (year) and metric (thousands of price)."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("method"), F.pmod("o_custkey", F.lit(20)).alias("seed"), F.year("o_orderdate").alias("x"), (F.col("o_totalprice") / 1000).alias("metric"), "o_orderkey"
    )


METHODS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def method_names(spark: SparkSession, sf_dir: str) -> list[str]:
    """The methods of the catalogue: as many as there are priorities."""
    return [r[0] for r in trials(spark, sf_dir).select("method").distinct().orderBy("method").collect()]


def sem_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(report.mean_band(trials(spark, sf_dir), "method", "x", "metric"))


def percentile_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(report.percentile_band(trials(spark, sf_dir), "method", "x", "metric"))


def head_to_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, *others = method_names(spark, sf_dir)
    return rounded(report.head_to_head(trials(spark, sf_dir), ["seed", "x"], "method", one, others, "metric"))


def win_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = trials(spark, sf_dir).groupBy("method", "seed", "x").agg(F.avg("metric").alias("metric"))
    return rounded(report.win_rates(means, ["seed", "x"], "x", "method", method_names(spark, sf_dir)[0], "metric"))


def discovery_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quantity at which a nation's mean price first reaches a level."""
    lines = table(spark, sf_dir, "lineitem").join(voxel_tree(spark, sf_dir), F.col("l_suppkey") == F.col("vox"))
    return rounded(report.discovery_threshold(lines.select("nation", F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("metric")), ["nation"], "x", "metric", 40.0))


def balanced_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = trials(spark, sf_dir).groupBy("method", "seed", "x").agg(F.avg("metric").alias("metric"))
    return rounded(report.balanced(means, ["seed", "x"], len(method_names(spark, sf_dir))))


def tie_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(report.tie_table(trials(spark, sf_dir), ["seed"], ["method"], "metric", decisive=400.0))


def tune_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each year's best (method, seed) by the whole thousands of its mean, ties by method and seed."""
    means = trials(spark, sf_dir).groupBy("x", "method", "seed").agg(F.round(F.avg("metric") / 50).alias("metric"))
    return rounded(report.best_settings(means, ["x"], "metric", [F.col("method") != F.lit("2-HIGH"), F.col("method"), F.col("seed")]))


def loglog_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice")
    return rounded(report.log_slope(lines, "l_returnflag", "l_quantity", "l_extendedprice"))


def seed_pareto(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(report.lorenz(trials(spark, sf_dir), "seed", "metric"))


def size_staircase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(report.staircase(table(spark, sf_dir, "part"), "p_size", "p_retailprice").select("p_size", "best"))


def min_size_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.least_size(table(spark, sf_dir, "part"), "p_size", 100)


def common_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.histogram(table(spark, sf_dir, "customer"), "c_acctbal", 12)


def rejection_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(report.rejection_curve(table(spark, sf_dir, "lineitem"), "l_discount", [0.01, 0.025, 0.05, 0.075]))


def rank_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(report.spearman(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity", "l_discount"))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, n, o): nations' sizes and overlaps with the suppliers in debt, by region."""
    supplier = table(spark, sf_dir, "supplier").join(voxel_tree(spark, sf_dir), F.col("s_suppkey") == F.col("vox"))
    return supplier.groupBy(F.col("region").alias("key"), "nation").agg(F.count("*").alias("n"), F.sum((F.col("s_acctbal") < 0).cast("long")).alias("o"))


def homogeneity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(report.homogeneity_completeness(regions(spark, sf_dir), "key"))


def fp_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.false_positive_parts(regions(spark, sf_dir), "key")


def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_stats.tree_confusion(voxel_tree(spark, sf_dir).withColumn("target", F.col("nation").isin(*TARGET_NATIONS)))


def best_dice_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.best_dice(confusion(spark, sf_dir), NODE))


def region_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean place of each node's suppliers on a plane ten wide."""
    places = voxel_tree(spark, sf_dir).select("*", F.lit(1).cast("long").alias("size"), F.expr("(vox - 1) div 10").alias("i"), F.expr("(vox - 1) % 10").alias("j"))
    return scoring.centroids(tree_stats.roll_up(places, ["size", "i", "j"]), NODE)


def union_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusion counts of two overlapping selections' union against the target."""
    tree = voxel_tree(spark, sf_dir).withColumn("exp_id", F.lit("demo"))
    found = tree.where("region = 1").withColumn("region", F.lit(0)).unionByName(tree.where("nation in (3, 4)").withColumn("region", F.lit(1)))
    target = tree.where(F.col("nation").isin(*TARGET_NATIONS)).withColumn("target", F.lit(0))
    return rounded(scoring.scored(scoring.union_score(tree, found, target)).select("tp", "fp", "fn", "tn", "dice", "sens", "ppv", "spec"))


def geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(uid, parent): customers under nations under regions, as a graph of records."""
    nation, customer = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    up = nation.select(F.concat(F.lit("n"), "n_nationkey").alias("uid"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    return up.unionByName(customer.select(F.concat(F.lit("c"), "c_custkey").alias("uid"), F.concat(F.lit("n"), "c_nationkey").alias("parent")))


def dag_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.ancestors(geography(spark, sf_dir))


def dag_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's name with its nation's and region's beside it."""
    region, nation, customer = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    records = region.select(F.concat(F.lit("r"), "r_regionkey").alias("uid"), F.lit("region").alias("function"), F.col("r_name").alias("name"))
    records = records.unionByName(nation.select(F.concat(F.lit("n"), "n_nationkey").alias("uid"), F.lit("nation").alias("function"), F.col("n_name").alias("name")))
    records = records.unionByName(customer.select(F.concat(F.lit("c"), "c_custkey").alias("uid"), F.lit("customer").alias("function"), F.col("c_name").alias("name")))
    flat = provenance.flattened(records, geography(spark, sf_dir), "customer", ["name"])
    return flat.select("uid", F.col("`customer.name`").alias("customer"), F.col("`nation.name`").alias("nation"), F.col("`region.name`").alias("region"))


def declared_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(uid, cell): every customer is a declared leaf of its nation."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("uid"), F.col("c_nationkey").alias("cell"))


def recorded_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(uid): those with a dear order are recorded, so that some leaves and cells are not."""
    return table(spark, sf_dir, "orders").where("o_totalprice > 440000").select(F.col("o_custkey").alias("uid"))


def cell_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations beyond the first nine are cells of their poor customers alone, of whom few have no order at all."""
    declared = declared_customers(spark, sf_dir)
    poor = table(spark, sf_dir, "customer").where("c_acctbal < -900").select(F.col("c_custkey").alias("uid"))
    few = declared.where("cell > 8").join(poor, "uid", "left_semi")
    held = recorded_customers(spark, sf_dir).unionByName(table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("uid")))
    return provenance.complete_cells(declared.where("cell <= 8").unionByName(few), recorded_customers(spark, sf_dir).unionByName(held.where("uid % 2 = 0")))


def todo_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.missing(declared_customers(spark, sf_dir).select("uid"), recorded_customers(spark, sf_dir))


def recipe_uid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of steps from their canonical JSON, and seeds from the ids, by the operators that give them."""
    from ..functions.identity import recipe_id, seed_from_uid

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids = [recipe_id("plant", {"segment": s, "nation": n, "kinds": {"b", "a"}}) for s, n in zip(pdf["c_mktsegment"], pdf["c_nationkey"].tolist(), strict=True)]
            yield pd.DataFrame({"c_custkey": pdf["c_custkey"], "uid": ids, "seed": [seed_from_uid(u) for u in ids]})

    return table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey").mapInPandas(rows, "c_custkey long, uid string, seed long")


def latest_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", "value")
    return rounded(provenance.latest(events.withColumn("at", F.struct("ts", "event_id")), "user_id", "at").drop("at", "ts"))


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream, counted by day and type."""
    from ..streaming.ingest import event_counts, run_to_end
    from ..tables import new_path

    path = f"{sf_dir}/events.parquet"
    # A stream reads folders: the table as it is, written as one.
    folder = new_path(spark, "events")
    spark.read.parquet(path).write.parquet(folder)
    events = spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)
    done = run_to_end(spark, event_counts(events), new_path(spark, "state"), new_path(spark, "windows"))
    return rounded(done.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total")))


def cluster_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxel and cluster tests together: the extents of clusters over the pooled null's tail, ranked."""
    return rounded(fits.fit_clusters(experiment(spark, sf_dir), design(spark, sf_dir), 1).select("vox", "extent", "pval", "sig", "effect"))


def experiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suppliers' mean quantities as images on a plane ten wide, with a planted trend in one corner."""
    held, n = sparse_panel(table(spark, sf_dir, "lineitem"))
    placed = dense_arrays(held, n, "qty").withColumns({"i": F.expr("cast((vox - 1) div 10 as int)"), "j": F.expr("cast((vox - 1) % 10 as int)")})
    y = F.when((F.col("i") < 4) & (F.col("j") < 4), F.transform("y", lambda v, img: v + 0.1 * img)).otherwise(F.col("y"))
    return placed.select(F.lit("demo").alias("exp_id"), "vox", "i", "j", F.lit(0).alias("k"), y.alias("y"))


def design(spark: SparkSession, sf_dir: str) -> fits.Design:
    intercept, trend = trend_basis(images(table(spark, sf_dir, "lineitem")).count())
    return fits.Design(np.stack([intercept, trend]), np.array([False, True]))


def region_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fits.fit_regions(experiment(spark, sf_dir), design(spark, sf_dir), 1))


def split_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = design(spark, sf_dir)
    return rounded(fits.fit_split(experiment(spark, sf_dir), d, 1, np.arange(d.x.shape[1]) % 2 == 0))


def oracle_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = experiment(spark, sf_dir)
    labels = packed.select("vox", F.expr("if(i < 4 and j < 4, 0L, 1L)").alias("label"))
    return rounded(fits.oracle_regions(packed, design(spark, sf_dir), 1, labels))


def ward_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    draws = fits.region_draws(experiment(spark, sf_dir), design(spark, sf_dir), 1, 0, 1)
    return rounded(draws.select("exp_id", F.inline("nodes")).select("node", "size", "left", "right", "llr"))


def tree_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    draws = fits.region_draws(experiment(spark, sf_dir), design(spark, sf_dir), 1, 0, 1)
    return fits.node_layout(draws.select("exp_id", F.inline("nodes")))


def voxel_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxel statistics under permutations, maxima by draw, rank p-values and the effects that significant voxels make."""
    return rounded(fits.fit_voxels(experiment(spark, sf_dir), design(spark, sf_dir), 1).select("vox", "stat", "pval", "sig", "effect"))


def enhanced_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of smoothed, scaled and standardised statistics, enhanced draw by draw."""
    found = fits.fit_voxels(experiment(spark, sf_dir), design(spark, sf_dir), 1, 39, fwhm=2.0, scale=True, z=True, enhanced=True)
    return rounded(found.select("vox", "stat", "pval", "sig", "effect"))


def region_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean images and models of the regions that a fit discovers."""
    held, d = written(experiment(spark, sf_dir), "experiment"), design(spark, sf_dir)
    draws = fits.region_draws(held, d, 1, fits.N_PERM, fits.N_INNER)
    nodes = draws.where("draw = 0").select("exp_id", F.inline("nodes"))
    found = fits.estimates(fits.discovered(fits.significant_nodes(draws)), held, nodes.select("exp_id", "node", "left", "right"), d, 1)
    return rounded(found.select("node", "size", F.col("e")[0].alias("e"), F.col("h")[0].alias("h"), "pval"))


QUERIES = (
    sem_band, percentile_band, head_to_head, win_rates, discovery_threshold, balanced_panel, tie_table, tune_best, loglog_slope, seed_pareto, size_staircase, min_size_cutoff, common_bins, rejection_curve,
    rank_correlation, homogeneity, fp_parts, best_dice_node, region_centroids, union_score, dag_ancestors, dag_flatten, cell_complete, todo_leaves, recipe_uid, latest_records, event_windows, cluster_fit,
    region_fit, split_fit, oracle_fit, ward_tree, tree_layout, voxel_fit, enhanced_fit, region_estimates,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}
