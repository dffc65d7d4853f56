"""Reporting over tables of results: curves, bands, head-to-heads, thresholds, ties and decompositions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio, xlog2x


def mean_band(df: DataFrame, series: str, x: str, metric: str, z: float = 1.96) -> DataFrame:
    """Mean, and mean plus and minus z standard errors, by series and x; missing trials drop."""
    one = df.groupBy(series, x).agg(F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("sd"), F.count(metric).alias("n"))
    half = z * F.col("sd") / F.sqrt("n")
    return one.select(series, x, "n", "mean", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"))


def percentile_band(df: DataFrame, series: str, x: str, metric: str, outside: float = 0.05) -> DataFrame:
    q = F.percentile(metric, F.array(F.lit(outside / 2), F.lit(1 - outside / 2)))
    return df.groupBy(series, x).agg(F.avg(metric).alias("mean"), q.alias("q")).select(series, x, "mean", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def head_to_head(df: DataFrame, pair: Sequence[str], series: str, one: str, others: Sequence[str], metric: str) -> DataFrame:
    """(pair, own, best_other, diff, win): a method against the best of the others with the same seed and x."""
    wide = df.groupBy(*pair).pivot(series, [one, *others]).agg(F.avg(metric))
    best = F.greatest(*(F.col(f"`{o}`") for o in others)) if len(others) > 1 else F.col(f"`{others[0]}`")
    out = wide.select(*pair, F.col(f"`{one}`").alias("own"), best.alias("best_other"))
    return out.select(*pair, "own", "best_other", (F.col("own") - F.col("best_other")).alias("diff"), (F.col("own") > F.col("best_other")).cast("int").alias("win"))


def win_rates(df: DataFrame, pair: Sequence[str], x: str, series: str, one: str, metric: str) -> DataFrame:
    """(x, series, rate, n): how often `one` beats each other method, over pairs that both have."""
    own = df.where(F.col(series) == one).select(*pair, F.col(metric).alias("own"))
    other = df.where(F.col(series) != one).select(*pair, series, F.col(metric).alias("other"))
    both = own.join(other, list(pair)).where("own is not null and other is not null")
    return both.groupBy(x, series).agg(F.avg((F.col("own") > F.col("other")).cast("int")).alias("rate"), F.count("*").alias("n"))


def discovery_threshold(df: DataFrame, arm: Sequence[str], x: str, metric: str, level: float) -> DataFrame:
    """(arm, threshold, status): where the mean curve first rises to a level, between points on a log scale."""
    curve = df.groupBy(*arm, x).agg(F.avg(metric).alias("m"))
    w = Window.partitionBy(*arm).orderBy(x)  # a point for each x of a declared sweep
    steps = curve.withColumns({"m0": F.lag("m").over(w), "x0": F.lag(x).over(w)})
    part = (F.lit(level) - F.col("m0")) / (F.col("m") - F.col("m0"))
    cross = F.when((F.col("m0") < level) & (F.col("m") >= level), F.pow(F.lit(10.0), F.log10("x0") + part * (F.log10(x) - F.log10("x0"))))
    out = steps.groupBy(*arm).agg(F.min_by("m", x).alias("first"), F.min_by(cross, F.when(cross.isNotNull(), F.col(x))).alias("at"))
    return out.select(*arm, F.when(F.col("first") < level, F.col("at")).alias("threshold"), F.when(F.col("first") >= level, "below").when(F.col("at").isNull(), "above").otherwise("ok").alias("status"))


def balanced(df: DataFrame, cell: Sequence[str], variants: int) -> DataFrame:
    """Rows of cells that hold every variant."""
    full = df.groupBy(*cell).agg(F.count("*").alias("n")).where(F.col("n") == variants).select(*cell)
    return df.join(full, list(cell), "left_semi")


def tie_table(df: DataFrame, cell: Sequence[str], arm: Sequence[str], metric: str, tol: float = 1e-9, decisive: float = 0.01) -> DataFrame:
    """Of each arm's cells, how far variants lie apart: shares of ties and of decisive gaps, mean, median and largest gap."""
    gaps = df.groupBy(*arm, *cell).agg((F.max(metric) - F.min(metric)).alias("gap"))
    return gaps.groupBy(*arm).agg(
        F.count("*").alias("n"), (100 * F.avg((F.col("gap") <= tol).cast("int"))).alias("ties"), (100 * F.avg((F.col("gap") > decisive).cast("int"))).alias("decisive"), F.avg("gap").alias("mean_gap"), F.percentile("gap", F.lit(0.5)).alias("median_gap"), F.max("gap").alias("max_gap")
    )


def best_settings(df: DataFrame, arm: Sequence[str], metric: str, ranks: Sequence[Column], atol: float = 1e-12) -> DataFrame:
    """Each arm's best row; ties within atol go by `ranks` in order."""
    top = df.groupBy(*arm).agg(F.max(metric).alias("top"))
    near = df.join(top, list(arm)).where(F.col(metric) >= F.col("top") - atol).drop("top")
    return near.withColumn("place", F.row_number().over(Window.partitionBy(*arm).orderBy(*ranks))).where("place = 1").drop("place")


def log_slope(df: DataFrame, series: str, x: str, y: str, decades: float = 1.0) -> DataFrame:
    """(series, slope, n): the log-log slope over the top decades of x; NULL under two points."""
    top = df.groupBy(series).agg(F.max(x).alias("top"))
    part = df.join(top, series).where((F.col(x) > 0) & (F.col(y) > 0) & (F.col(x) >= F.col("top") / 10**decades))
    return part.groupBy(series).agg(F.when(F.countDistinct(x) >= 2, F.regr_slope(F.log10(y), F.log10(x))).alias("slope"), F.count("*").alias("n"))


def lorenz(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, total, place, share, cumulative): keys by falling totals. One row a key."""
    totals = df.groupBy(key).agg(F.sum(value).alias("total"))
    all_of = totals.agg(F.sum("total").alias("all"))
    order = Window.orderBy(F.desc("total"), key)
    share = ratio(F.col("total"), F.col("all"))
    return totals.crossJoin(F.broadcast(all_of)).select(key, "total", F.row_number().over(order).alias("place"), share.alias("share"), ratio(F.sum("total").over(order.rowsBetween(Window.unboundedPreceding, 0)), F.col("all")).alias("cumulative"))


def staircase(df: DataFrame, size: str, z: str) -> DataFrame:
    """(size, best): the largest z at that size or more, kept where it changes. Sizes are summed first, so one row a size."""
    per_size = df.groupBy(size).agg(F.max(z).alias("z")).where("z is not null")
    down = Window.orderBy(F.desc(size)).rowsBetween(Window.unboundedPreceding, 0)
    best = per_size.select(size, F.max("z").over(down).alias("best"))
    return best.withColumn("above", F.lead("best").over(Window.orderBy(size))).where("above is null or above <> best").drop("above")


def least_size(df: DataFrame, size: str, most: int) -> DataFrame:
    """(least): the smallest cutoff that keeps at most so many rows and splits no size."""
    counts = df.groupBy(size).agg(F.count("*").alias("n"))
    kept = counts.withColumn("kept", F.sum("n").over(Window.orderBy(F.desc(size))))
    return kept.agg(F.coalesce(F.min(F.when(F.col("kept") <= most, F.col(size))), F.max(size) + 1).alias("least"))


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """(bin, n) over common bins of all values; none if they are all the same."""
    span = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    place = F.least(F.lit(bins), (F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins) + 1).cast("int"))
    return df.crossJoin(F.broadcast(span)).where("hi > lo").groupBy(place.alias("bin")).agg(F.count("*").alias("n"))


def rejection_curve(df: DataFrame, p: str, alphas: Sequence[float]) -> DataFrame:
    """(alpha, rate, n): the share of experiments whose smallest p-value is at most alpha."""
    grid = F.explode(F.array(*map(F.lit, alphas)))
    return df.select(F.col(p).alias("p"), grid.alias("alpha")).groupBy("alpha").agg(F.avg((F.col("p") <= F.col("alpha")).cast("int")).alias("rate"), F.count("*").alias("n"))


def homogeneity_completeness(regions: DataFrame, key: str) -> DataFrame:
    """(key, hom, com) from detected regions (key, n, o): sizes and overlaps with the target.

    hom: how much knowing the region says of target or not; com: how much the target's voxels share a region.
    """
    parts = regions.withColumns({"rest": F.col("n") - F.col("o")})
    totals = parts.groupBy(key).agg(F.sum("n").alias("tn"), F.sum("o").alias("to"), F.sum("rest").alias("tr"))
    joined = parts.join(totals, key)

    def h(a: Column, b: Column) -> Column:
        return -xlog2x(F.coalesce(ratio(a, b), F.lit(0.0)))

    n, o, rest, tn, to, tr = (F.col(c) for c in ("n", "o", "rest", "tn", "to", "tr"))
    summed = joined.groupBy(key).agg(
        F.max(h(to, tn) + h(tr, tn)).alias("h_c"), F.sum(ratio(n, tn) * (h(o, n) + h(rest, n))).alias("h_ck"), F.sum(h(n, tn)).alias("h_k"),
        F.sum(ratio(to, tn) * h(o, to) + ratio(tr, tn) * F.coalesce(h(rest, tr), F.lit(0.0))).alias("h_kc"), F.max("to").alias("to"), F.max("tn").alias("tn"),
    )
    fine = (F.col("tn") > 0) & (F.col("to") > 0)
    return summed.select(key, F.when(fine, F.when(F.col("h_c") > 0, 1 - F.col("h_ck") / F.col("h_c")).otherwise(1.0)).alias("hom"), F.when(fine, F.when(F.col("h_k") > 0, 1 - F.col("h_kc") / F.col("h_k")).otherwise(1.0)).alias("com"))


def false_positive_parts(regions: DataFrame, key: str) -> DataFrame:
    """(key, fp, spurious, leaked): false voxels of regions without and with overlap."""
    rest = F.col("n") - F.col("o")
    return regions.groupBy(key).agg(F.sum(rest).alias("fp"), F.sum(F.when(F.col("o") == 0, rest).otherwise(0)).alias("spurious"), F.sum(F.when(F.col("o") > 0, rest).otherwise(0)).alias("leaked"))


def spearman(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """(key, pearson, spearman) of the rows that have both: average ranks on ties, by counts of each value and not by a window over rows."""
    whole = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())

    def ranks(c: str) -> DataFrame:
        counts = whole.groupBy(key, c).agg(F.count("*").alias("n"))
        before = F.sum("n").over(Window.partitionBy(key).orderBy(c)) - F.col("n")
        return counts.select(key, c, (before + (F.col("n") + 1) / 2).alias(f"rank_{c}"))

    both = whole.join(ranks(a), [key, a]).join(ranks(b), [key, b])
    return both.groupBy(key).agg(F.corr(a, b).alias("pearson"), F.corr(f"rank_{a}", f"rank_{b}").alias("spearman"))


def log_beta(a: float, b: float) -> float:
    from math import lgamma

    return lgamma(a) + lgamma(b) - lgamma(a + b)


def beta_share(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(1 - x, b, a)
    front = np.exp(a * np.log(x) + b * np.log1p(-x) - log_beta(a, b)) / a
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    out = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            c = 1 + top / c
            d = 1 / (d if abs(d) > 1e-300 else 1e-300)
            c = c if abs(c) > 1e-300 else 1e-300
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return float(front * out)


def binomial_interval(hits: int, n: int, confidence: float = 0.95) -> tuple[float, float]:
    """The exact interval of a share, by bisection on the beta distribution."""
    def quantile(p: float, a: float, b: float) -> float:
        low, high = 0.0, 1.0
        for _ in range(100):
            middle = (low + high) / 2
            low, high = (middle, high) if beta_share(middle, a, b) < p else (low, middle)
        return (low + high) / 2

    tail = (1 - confidence) / 2
    return (0.0 if hits == 0 else quantile(tail, hits, n - hits + 1)), (1.0 if hits == n else quantile(1 - tail, hits + 1, n - hits))
