"""Registered queries of the experiment's lifecycle, scoring, figures, records and sweeps."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import figures, grid, permutation, provenance, scoring, tree_stats
from ..operators.experiment import Experiment, sampled_design
from ..sources.contract import AXES, TableSource
from ..tables import written
from .catalogue import NODE, TARGET_NATIONS, draws, grid_threshold, known_cells, panel, part_grid, rounded, voxel_draws
from .panel import images, packed, table, trend_basis, voxel_tree
from .reporting import confusion, geography, method_names, regions, trials

#: Draws of the bootstrap; seeds of the sampled design and the bootstrap; features of the experiment.
BOOTSTRAP, DESIGN_SEED, BOOTSTRAP_SEED, FEATURES = 30, 5, 7, ("qty", "price")
STATUSES, INNER_COUNTS = ("O", "F", "P"), (5, 10, 25, 50)


def suppliers_experiment(spark: SparkSession, sf_dir: str) -> Experiment:
    """Mean quantities and prices of suppliers on a plane ten wide, with a trend over images."""
    voxels = panel(spark, sf_dir).groupBy("vox").agg(F.array_sort(F.collect_list(F.struct("img", *FEATURES))).alias("c"))  # a voxel's own images
    frame = voxels.select(
        F.lit("suppliers").alias("exp_id"), "vox", F.expr("cast((vox - 1) div 10 as int)").alias("i"), F.expr("cast((vox - 1) % 10 as int)").alias("j"), F.lit(0).alias("k"),
        F.concat(*(F.col(f"c.{f}") for f in FEATURES)).alias("y"),
    )
    frame = written(frame, "experiment")
    n = images(table(spark, sf_dir, "lineitem")).count()
    intercept, trend = trend_basis(n)
    held = Experiment.of(spark, TableSource(frame, FEATURES, tuple(map(str, range(n))), "suppliers"))
    return held.designed(np.stack([np.ones(n), trend]), np.array([False, True]))


def target_places(spark: SparkSession, sf_dir: str, held: Experiment, where: str) -> DataFrame:
    return held.packed.join(voxel_tree(spark, sf_dir), "vox").where(where).select(*AXES)


TARGET = f"nation in {TARGET_NATIONS}"


def unpacked(held: Experiment) -> DataFrame:
    """(vox, img, features...)"""
    at = F.explode(F.sequence(F.lit(0), F.lit(held.n_img - 1))).alias("img")
    return held.packed.select("vox", "y", at).select("vox", "img", *(F.col("y")[F.lit(f * held.n_img) + F.col("img")].alias(name) for f, name in enumerate(held.features)))


def image_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(unpacked(suppliers_experiment(spark, sf_dir).bootstrap(BOOTSTRAP, BOOTSTRAP_SEED)))


def design_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(reg, img, x, interest) of two sampled regressors behind a bias row."""
    x, contrast = sampled_design(images(table(spark, sf_dir, "lineitem")).count(), a=2, seed=DESIGN_SEED, bias=True)
    return rounded(spark.createDataFrame([(r, i, float(x[r, i]), bool(contrast[r])) for r in range(len(x)) for i in range(x.shape[1])], "reg int, img int, x double, interest boolean"))


def mask_restrict(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = suppliers_experiment(spark, sf_dir)
    return held.masked(target_places(spark, sf_dir, held, TARGET)).packed.select("vox", "i", "j")


def whitened_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both whitened features, whose signs are a matter of convention, and the first one turned back."""
    held = suppliers_experiment(spark, sf_dir).scaled()
    back = unpacked(held.unscaled()).select("vox", "img", "qty")
    turned = unpacked(held).select("vox", "img", F.abs("qty").alias("first"), F.abs("price").alias("second"))
    return rounded(turned.join(back, ["vox", "img"]))


def inflate_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growth by one voxel: what was dropped comes back from the source with the offset that was planted."""
    held = suppliers_experiment(spark, sf_dir)
    offset = np.stack([0.5 * np.arange(held.n_img), np.zeros(held.n_img)])
    planted = held.offset(offset, places=target_places(spark, sf_dir, held, TARGET))
    grown = planted.masked(target_places(spark, sf_dir, held, "region = 1")).inflated(halo=1)
    total = F.aggregate(F.slice("y", 1, held.n_img), F.lit(0.0), lambda t, v: t + v)
    return rounded(grown.packed.select("i", "j", total.alias("total")))


def scored_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    """Regions of the world are experiments, nations of even number what was found, chosen nations and debtors the targets."""
    debt = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("vox"), (F.col("s_acctbal") < 0).alias("debt"))
    tree = voxel_tree(spark, sf_dir).withColumnRenamed("region", "exp_id").join(debt, "vox")
    pval = (F.col("nation") + 1) * 0.01
    found = tree.where("nation % 2 = 0").select("exp_id", F.col("nation").alias("region"), "vox", pval.alias("pval"))
    targets = tree.where(TARGET).select("exp_id", F.lit(0).alias("target"), "vox").unionByName(tree.where("debt").select("exp_id", F.lit(1).alias("target"), "vox"))
    tested = tree.select("exp_id", F.when(F.col("nation") % 5 != 0, pval).otherwise(F.lit(float("nan"))).alias("pval"))
    return tree.select("exp_id", "vox"), found, targets, tested


def detection_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.detection_score(*scored_tables(spark, sf_dir), n_targets=2).drop("pred"))


def detection_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.detection_score(*scored_tables(spark, sf_dir), n_targets=2).select("exp_id", F.inline("pred")))


def pred_rectangle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.pred_block(scoring.detection_score(*scored_tables(spark, sf_dir), n_targets=2), "num_vox")


def max_z_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The node of two voxels or more whose observed z is the largest, against the planted nations."""
    z = rounded(permutation.z_scores(draws(spark, sf_dir), NODE).where("k = 0").select(*NODE, "z"))
    nodes = confusion(spark, sf_dir).withColumn("size", F.col("tp") + F.col("fp"))
    return scoring.max_z_region(figures.region_extras(nodes, z, NODE), F.col("size") >= 2, NODE)


def target_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The planted nations' suppliers as one region, of one feature."""
    held = suppliers_experiment(spark, sf_dir)
    one = Experiment(held.packed.withColumn("y", F.slice("y", 1, held.n_img)), held.n_img, held.features[:1], x=held.x, contrast=held.contrast)
    found = one.target_stats(target_places(spark, sf_dir, held, TARGET))
    kinds = ", ".join(f"{k} {'double' if k in ('llr', 'dice', 'sens', 'ppv', 'spec') else 'long'}" for k in found)
    return rounded(spark.createDataFrame([tuple(float(v) if k == "llr" else v for k, v in found.items())], kinds))


def planted_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three plants, the last without voxels; the second overlaps the first."""
    tree = voxel_tree(spark, sf_dir)
    plants = [tree.where(w).select("vox", F.lit(i).alias("seq")) for i, w in enumerate(("region = 1", "nation in (3, 4)", "nation > 99"))]
    labels = scoring.plan_labels(tree, plants[0].unionByName(plants[1]).unionByName(plants[2]), 3)
    return scoring.voxel_lists(labels).select("label", F.size("vox_list").cast("long").alias("n"), F.concat_ws(",", "vox_list").alias("voxels"))


def mask_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = voxel_tree(spark, sf_dir)
    a, b, c = (tree.where(w).select("vox") for w in ("region = 1", "nation in (3, 4, 8)", "vox % 4 = 0"))
    parts = {"union": scoring.union(a, b, c), "intersection": scoring.intersection(a, c), "difference": scoring.difference(a, b, c)}
    out = [df.select(F.lit(k).alias("op"), "vox") for k, df in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


def region_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(figures.region_regression(panel(spark, sf_dir).join(voxel_tree(spark, sf_dir), "vox"), ["nation"], "img", "img", "qty"))


def drift_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fit against one with statistics a ten-thousandth larger, whose regions of the second level are missing."""
    nodes = written(tree_stats.tree_llr(*known_cells(spark, sf_dir), voxel_tree(spark, sf_dir), "qty"), "nodes")
    ref = nodes.select(*NODE, F.col("llr").alias("stat"), F.round(1 / (1 + F.col("llr")), 2).alias("pval"))
    got = nodes.where("level <> 1").select(*NODE, (F.col("llr") * 1.0001).alias("stat"), F.round(1 / (1 + 1.05 * F.col("llr")), 2).alias("pval"))
    return rounded(figures.drift_report(ref, got, NODE))


def difference_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, *others = method_names(spark, sf_dir)
    return rounded(figures.difference_band(trials(spark, sf_dir), ["seed", "x"], "x", "method", one, others, "metric"))


def rate_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(figures.rates(trials(spark, sf_dir), ["method", "x"], F.col("metric") > 250))


def seed_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(figures.seed_medians(trials(spark, sf_dir), ["method", "x"], "seed", "metric"))


def precision_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of nations as trials: debtors are the effect, nations without any are spurious."""
    rest = F.col("n") - F.col("o")
    per = regions(spark, sf_dir).groupBy((F.col("nation") % 7).alias("trial")).agg(
        F.sum("o").alias("tp"), F.sum(rest).alias("fp"), F.max(F.col("nation")).cast("long").alias("fn"), F.sum(F.when(F.col("o") > 0, rest).otherwise(0)).alias("leaked"), F.sum(F.when(F.col("o") == 0, rest).otherwise(0)).alias("spurious")
    )
    return rounded(figures.precision_parts(per))


def runtime_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("seconds"))
    return rounded(figures.runtime_summary(lines, "l_returnflag", "x", "seconds"))


def deepest_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer's seed and year: the last order's region is the reference; every third customer has none."""
    rows = table(spark, sf_dir, "orders").select(F.pmod("o_custkey", F.lit(20)).alias("seed"), F.when(F.col("o_custkey") % 4 != 0, F.year("o_orderdate")).alias("x"), "o_orderkey", F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey") % 3).alias("reg"))
    return figures.deepest_agreement(rows, ["seed", "x"], "o_orderkey", "reg")


def stability_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trials(spark, sf_dir).withColumns({"m": F.col("o_orderkey") % 5 + 1, "sig": F.col("metric") > 200})
    return rounded(figures.stability_table(rows, "x", "m", "seed", ["metric", "sig"]))


def wide_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = trials(spark, sf_dir).groupBy("x", "method").agg(F.avg("metric").alias("mean"), F.max("metric").alias("top"), F.min("metric").alias("least"), F.stddev_samp("metric").alias("sd"))
    long = per.select("x", "method", F.lit("level").alias("metric"), F.col("mean").alias("own"), F.col("top").alias("other"))
    long = long.unionByName(per.where("x <> 1996").select("x", "method", F.lit("spread").alias("metric"), F.col("sd").alias("own"), F.col("least").alias("other")))
    return rounded(figures.wide_metrics(long, ["x", "method"], "metric", ["level", "spread"], {"own": "own_{m}", "other": "{m}_other"}))


def width_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderstatus", F.col("o_orderpriority").alias("method"), F.year("o_orderdate").alias("width"), F.floor(F.col("o_totalprice") / 400000).cast("double").alias("metric"))
    best = figures.width_table(rows, "o_orderstatus", "method", method_names(spark, sf_dir), "width", "metric")
    names = method_names(spark, sf_dir)
    return best.select("o_orderstatus", *(F.col(f"`{n}`").alias(f"w{i}") for i, n in enumerate(names)))


def tune_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference arm tells statistics apart; the others tie in all odd years and adopt its choice."""
    year = F.year("o_orderdate")
    metric = F.when(F.col("o_orderpriority") == "1-URGENT", F.pmod(year, F.lit(3)) + F.when(F.col("o_orderstatus") == "F", 0.5).otherwise(0.0)).otherwise(F.pmod(year, F.lit(2)).cast("double"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("method"), F.when(F.col("o_custkey") % 2 == 0, "raw").otherwise("z").alias("zt"), F.col("o_orderstatus").alias("stat"), year.alias("fwhm"), metric.alias("metric"))
    return figures.tuned(rows, "method", "1-URGENT", "metric", STATUSES)


def matched_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean price at which each flag's mean discount curve over quantities first reaches a level."""
    curve = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", F.col("l_quantity").alias("x")).agg(F.avg("l_extendedprice").alias("y"))
    return rounded(figures.matched_metric(curve, "l_returnflag", "x", "y", 20.25))


def feature_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "supplier").withColumns({"empty": F.lit(None).cast("double"), "flag": F.col("s_acctbal") > 0, "gain_sum": F.lit(1.0)})
    found = figures.feature_columns(df, {"generic": ["s_acctbal"]}, ["s_suppkey"], {"gain": "pruning"})
    return spark.createDataFrame(found, "grp string, name string")


def visible_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return figures.visible_rows(table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", F.col("s_nationkey").alias("n_voxel")), "s_acctbal", True, least=5)


def swept_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(label, n): a figure for each value of the axis that varies beside the swept one."""
    rows = trials(spark, sf_dir).withColumns({"b": F.lit(1), "num_img": F.col("x") % 3})
    x = figures.swept_axis(rows, "metric", ["b", "x", "num_img"])
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(f"{x}{suffix}").alias("label"), "n") for suffix, df in figures.split_frames(rows, x, ["b", "num_img"])]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def tidy_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = {"label": ("o_orderpriority", "string"), "status": ("o_orderstatus", "int"), "price": ("o_totalprice", "bigint"), "key": ("o_orderkey", "bigint"), "absent": ("no_such", "double")}
    return figures.tidy(table(spark, sf_dir, "orders"), columns, {"1-URGENT": "first", "5-LOW": "last"})


def method_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return figures.ranked(trials(spark, sf_dir).select("method").distinct(), "method", ["5-LOW", "2-HIGH", "none"])


def region_extras(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = panel(spark, sf_dir).join(voxel_tree(spark, sf_dir), "vox").where("nation % 3 = 0").groupBy("nation").agg(F.max("price").alias("top_price"))
    return rounded(figures.region_extras(regions(spark, sf_dir), extra, ["nation"]))


def leaf_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines are leaves, orders cells: a line without a recorded time takes its order's longest, and its order's build where that is not held."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("cell"), F.col("l_linenumber").alias("leaf"), F.when(F.col("l_returnflag") != "R", F.col("l_quantity")).alias("time_sec"), (F.col("l_orderkey") % 2 == 0).alias("cell_held"), F.when(F.col("l_orderkey") % 3 != 0, F.col("l_tax")).alias("cell_sec"))
    return rounded(provenance.estimated_seconds(lines).select("cell", "leaf", "cost"))


def merged_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments of each flag's prices, merged from those of its months."""
    month = F.date_format("l_shipdate", "yyyy-MM")
    parts = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", month.alias("month")).agg(F.count("l_extendedprice").alias("n"), F.avg("l_extendedprice").alias("mean"), (F.var_pop("l_extendedprice") * F.count("l_extendedprice")).alias("m2"))
    return rounded(provenance.merged_moments(parts, ["l_returnflag"]))


def draw_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(permutation.draw_summary(draws(spark, sf_dir), NODE)[0])


def inner_count_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(permutation.inner_count_sweep(draws(spark, sf_dir), NODE, INNER_COUNTS))


def walk_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(permutation.voxel_statistics_walk(voxel_draws(spark, sf_dir, 9)))


def validation_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("uid"), F.col("c_mktsegment").alias("cache"))
    return provenance.validation_order(jobs, ["MACHINERY", "BUILDING", "AUTOMOBILE", "FURNITURE", "HOUSEHOLD"], 3)


def recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' orders as records: even ones are leaves, others segmentations, by the customer's cell."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), key).alias("uid"), F.when(key % 2 == 0, "stat").otherwise("segment").alias("function"), F.array(F.concat(F.lit("c"), "o_custkey")).alias("parents"), (F.col("o_totalprice") / 1000).alias("time_sec"))


def cache_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared = table(spark, sf_dir, "lineitem").where("l_quantity >= 45").select(F.concat(F.lit("o"), "l_orderkey").alias("uid"))
    return provenance.members(recorded(spark, sf_dir), declared).select("uid", "function")


def leaves_by_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = provenance.leaves_by_cell(recorded(spark, sf_dir), "stat")
    return rounded(found.groupBy("cell").agg(F.count("*").alias("n"), F.max("time_sec").alias("longest")))


def grid_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions by segments by strengths, numbered in order."""
    axes = [table(spark, sf_dir, "region").select("r_regionkey").orderBy("r_regionkey").coalesce(1), spark.createDataFrame([("wgn",), ("hcp",)], "source string").coalesce(1), spark.createDataFrame([(0.5,), (1.0,), (2.0,)], "llr double").coalesce(1)]
    return provenance.grid_product(axes)


def export_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by cache and function of the customers that are exported, with the nations and regions above them."""
    region, nation, customer = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    named = [(region, "r", "r_regionkey", "region"), (nation, "n", "n_nationkey", "nation"), (customer, "c", "c_custkey", "customer")]
    parts = [df.select(F.concat(F.lit(mark), key).alias("uid"), F.lit(kind).alias("function")) for df, mark, key, kind in named]
    records = parts[0].unionByName(parts[1]).unionByName(parts[2])
    chosen = customer.where("c_acctbal > 9000").select(F.concat(F.lit("c"), "c_custkey").alias("uid"), F.col("c_mktsegment").alias("cache"))
    return provenance.export_closure(records, geography(spark, sf_dir), chosen)[1]


def value_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vox, digest): of each voxel's quantities in hundredths, in the order of images, however they are partitioned."""
    cells = packed(panel(spark, sf_dir).select("vox", "img", F.round(F.col("qty") * 100).cast("long").alias("qty")).repartition(7), "qty")
    return cells.select("vox", F.sha2(F.concat_ws(",", F.transform("y", lambda v: v.cast("string"))), 256).alias("digest"))


def volume_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells over the middle value as a volume, cropped to its box; empty places hold -1."""
    cells = part_grid(spark, sf_dir)
    over = grid_threshold(spark, sf_dir)
    whole = grid.scatter(over, cells, "val", empty=-1.0)
    return rounded(grid.crop(whole, grid.bounding_box(over)))


def volume_gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(grid.gather(grid.scatter(grid_threshold(spark, sf_dir), part_grid(spark, sf_dir), "val"), part_grid(spark, sf_dir), "val"))


def backgrounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over images as they were before scaling, with each feature's range."""
    held = suppliers_experiment(spark, sf_dir).scaled()
    wide = held.ranges().groupBy().pivot("feature", list(FEATURES)).agg(F.first("low").alias("low"), F.first("high").alias("high"))
    return rounded(held.backgrounds().select("vox", "qty", "price").crossJoin(F.broadcast(wide)))  # one row


QUERIES = (
    backgrounds, image_bootstrap, design_sample, mask_restrict, whitened_pair, inflate_replay, detection_score, detection_regions, pred_rectangle, max_z_region, target_stats, planted_labels, mask_algebra, region_regression,
    drift_report, difference_band, rate_line, seed_medians, precision_parts, runtime_summary, deepest_agreement, stability_table, wide_metrics, width_table, tune_ties, matched_metric, feature_columns, visible_rows,
    swept_axis, tidy_frame, method_order, region_extras, leaf_costs, merged_moments, draw_summary, inner_count_sweep, walk_statistics, validation_order, cache_members, leaves_by_cell, grid_product, export_manifest,
    value_hashes, volume_scatter, volume_gather,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}
