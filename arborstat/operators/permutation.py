"""Permutation inference: seeded permutations, draws, z-scores, maxima, rank p-values.

The nuisance is the intercept alone, which no permutation moves, so a Freedman-Lane draw is
the interest basis permuted: data stay where they are and every voxel meets all permuted
bases in one matrix product.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import known
from .tree_stats import LEVELS, node_level

#: Divisors below it count as 1.
LEAST_STD = 1e-12


def hashed_permutations(spark: SparkSession, n_perm: int, n: int, seed: str = "") -> DataFrame:
    """(k, pos, src), k = 0 the identity: positions ranked by md5, so any engine draws the same."""
    grid = spark.range(n_perm + 1).select(F.col("id").cast("int").alias("k")).crossJoin(spark.range(n).select(F.col("id").cast("int").alias("pos")))
    mark = F.md5(F.concat(F.lit(seed), F.col("k").cast("string"), F.lit(":"), F.col("pos").cast("string")).cast("binary"))
    src = F.when(F.col("k") == 0, F.col("pos")).otherwise(F.row_number().over(Window.partitionBy("k").orderBy(mark, "pos")) - 1)
    return grid.select("k", "pos", src.cast("int").alias("src"))


def seeded_permutation(seed: int, n: int) -> np.ndarray:
    """Index array of a seed; 0 is the identity."""
    return np.arange(n) if seed == 0 else np.argsort(np.random.default_rng(seed).permutation(n))


def permuted_bases(permutations: DataFrame, basis: np.ndarray) -> np.ndarray:
    """(k, image) values of a basis row under each permutation. Bounded by permutations times images."""
    rows = permutations.orderBy("k", "pos").toPandas()
    return basis[rows["src"].to_numpy().reshape(-1, len(basis))]


def voxel_draws(packed: DataFrame, bases: np.ndarray, intercept: np.ndarray) -> DataFrame:
    """(vox, size, a0, t, a1 array): a matrix product of a batch of voxels and all permuted bases."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = np.stack(batch.column(1).to_numpy(zero_copy_only=False)) if batch.num_rows else np.zeros((0, len(intercept)))
            a1 = pa.array(list(y @ bases.T), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.ones(len(y), np.int64)), pa.array(y @ intercept), pa.array((y * y).sum(axis=1)), a1], ["vox", "size", "a0", "t", "a1"])

    return packed.select("vox", "y").mapInArrow(rows, "vox long, size long, a0 double, t double, a1 array<double>")


def tree_draws(voxels: DataFrame, tree: DataFrame) -> DataFrame:
    """(k, level, region, nation, vox, stat): the LLR of every node under every permutation; k = 0 observed.

    A node's draws go up the tree as one array, summed by element, and become rows only there.
    """
    sums = voxels.join(tree, "vox").rollup(*LEVELS).agg(node_level(), *(F.sum(c).alias(c) for c in ("size", "a0", "t")), *array_sums("a1", draw_count(voxels)))
    total = F.col("t") - F.col("a0") * F.col("a0") / F.col("size")
    error = total - F.col("p") * F.col("p") / F.col("size")
    stat = F.when((total > 0) & (error > 0), 0.5 * F.col("size") * (F.ln(total) - F.ln(error)))
    return sums.select("level", *LEVELS, "size", "a0", "t", F.posexplode("a1").alias("k", "p")).select("k", "level", *LEVELS, stat.alias("stat"))


def draw_count(voxels: DataFrame) -> int:
    return voxels.agg(F.max(F.size("a1"))).first()[0] or 0


def array_sums(column: str, n: int) -> list[Column]:
    """The sum of arrays of n numbers, element by element, as an array: one partial sum an element and task."""
    return [F.array(*(F.sum(F.col(column)[i]) for i in range(n))).alias(column)]


def z_scores(draws: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Adds z: each node's draws, the observed among them, about their mean by their spread."""
    node = Window.partitionBy(*keys)  # a node's window holds its draws, as many as there are permutations
    stat = known(F.col("stat"))
    mu, sd = F.avg(stat).over(node), F.stddev_samp(stat).over(node)
    return draws.withColumn("z", (F.col("stat") - mu) / F.when(sd > LEAST_STD, sd).otherwise(1.0))


def max_null(draws: DataFrame, value: str, active: Column | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, k, max_stat): the largest value over the active nodes of each draw, NULL if there is none."""
    c = known(F.col(value))
    return draws.groupBy(*keys, "k").agg(F.max(c if active is None else F.when(active, c)).alias("max_stat"))


def rank_pvalues(observed: DataFrame, null: DataFrame, value: str, alpha: float = 0.05, keys: tuple[str, ...] = ()) -> DataFrame:
    """Adds pval and sig: the share of draws whose maximum is at least the value, and at least 1 / n.

    By `keys` (experiments, say) each has a null of its own, a row for each permutation: its maxima are one array.
    """
    held = null.where("max_stat is not null").groupBy(*keys).agg(F.array_sort(F.collect_list("max_stat")).alias("maxima"))
    n = F.size("maxima")
    reached = F.size(F.filter("maxima", lambda m: m >= F.col(value)))
    p = F.when(F.col(value).isNotNull() & (n > 0), F.greatest(reached / n, 1 / n))
    both = observed.join(held, list(keys), "left") if keys else observed.crossJoin(F.broadcast(held))  # one row without keys
    return both.withColumn("pval", p).withColumn("sig", F.col("pval") <= alpha).drop("maxima")


def critical_value(null: DataFrame, alpha: float = 0.05) -> DataFrame:
    return null.agg(F.percentile(known(F.col("max_stat")), F.lit(1 - alpha)).alias("critical"))


def draw_summary(draws: DataFrame, keys: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """((keys, stat, mu, std, z), (k, max_stat)): every node's observed value among its draws, and each draw's largest z."""
    z = z_scores(draws, keys)
    node = Window.partitionBy(*keys)
    whole = z.withColumns({"mu": F.avg(known(F.col("stat"))).over(node), "std": F.stddev_samp(known(F.col("stat"))).over(node)})
    return whole.where("k = 0").select(*keys, "stat", "mu", "std", "z"), max_null(z, "z")


def inner_count_sweep(draws: DataFrame, keys: tuple[str, ...], counts: tuple[int, ...]) -> DataFrame:
    """(keys, m, z): the observed value's z among the first m draws and itself, for every m, from one deepest walk.

    One pass: each count's moments are sums over the draws up to it, added up before the shuffle.
    """
    stat = known(F.col("stat"))
    parts = [c for m in counts for c in (F.avg(F.when(F.col("k") <= m, stat)).alias(f"mu_{m}"), F.stddev_samp(F.when(F.col("k") <= m, stat)).alias(f"sd_{m}"))]
    wide = draws.groupBy(*keys).agg(F.max(F.when(F.col("k") == 0, stat)).alias("stat"), *parts)
    rows = F.array(*(F.struct(F.lit(m).alias("m"), ((F.col("stat") - F.col(f"mu_{m}")) / F.when(F.col(f"sd_{m}") > LEAST_STD, F.col(f"sd_{m}")).otherwise(1.0)).alias("z")) for m in counts))
    return wide.select(*keys, F.inline(rows))


def voxel_statistics_walk(voxels: DataFrame, statistics: tuple[str, ...] = ("llr", "wilks", "pillai", "hotelling", "roy")) -> DataFrame:
    """(k, vox, statistic, value): several statistics of one feature under every permutation, from one walk's projections."""
    from ..functions.columns import five_statistics

    long = voxels.select("vox", "a0", "t", F.posexplode("a1").alias("k", "p"))
    h = F.col("p") * F.col("p")
    found = five_statistics(F.col("t") - F.col("a0") * F.col("a0") - h, h, F.lit(1.0))
    return long.select("k", "vox", *(found[s].alias(s) for s in statistics)).unpivot(["k", "vox"], list(statistics), "statistic", "value")
