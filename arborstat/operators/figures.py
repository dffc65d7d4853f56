"""Tables behind figures: tidy frames, axes, regressions, bands, decompositions, runtimes and stability."""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Mapping, Sequence
from fnmatch import fnmatchcase

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio
from .report import head_to_head, log_slope


def tidy(df: DataFrame, columns: Mapping[str, tuple[str, str]], labels: Mapping[str, str] | None = None, label: str = "label") -> DataFrame:
    """Typed columns {name: (source column, type)}: what can't be cast or has no column is NULL; `label` by a map, others as they are."""
    out = df.select(*((F.expr(f"try_cast(`{source}` as {kind})") if source in df.columns else F.lit(None).cast(kind)).alias(name) for name, (source, kind) in columns.items()))
    if labels:
        named = F.create_map(*(F.lit(x) for pair in labels.items() for x in pair))
        out = out.withColumn(label, F.coalesce(named[F.col(label)], F.col(label)))
    return out.distinct()


def swept_axis(df: DataFrame, effect: str, candidates: Sequence[str]) -> str | None:
    """The column that a sweep moves: none where no effect is known, else the first with several values, else the effect."""
    held = df.agg(F.count(effect).alias("known"), *(F.countDistinct(c).alias(f"n_{i}") for i, c in enumerate(candidates))).first()
    if not held["known"]:
        return None
    return next((c for i, c in enumerate(candidates) if held[f"n_{i}"] > 1), effect)


def split_frames(df: DataFrame, x: str, axes: Sequence[str], declared: Mapping[str, int] | None = None) -> list[tuple[str, DataFrame]]:
    """(suffix, rows) for each value of the other axes that vary, or that several values are declared of."""
    axes = [a for a in axes if a != x and a in df.columns]
    held = df.agg(*(F.countDistinct(a).alias(a) for a in axes)).first() if axes else {}
    moving = [a for a in axes if held[a] > 1 or (declared or {}).get(a, 0) > 1]
    if not moving:
        return [("", df)]
    values = df.select(*moving).distinct().dropna().orderBy(*moving).collect()  # a figure each
    return [("".join(f"_{a}{int(v[a])}" for a in moving), df.where(" and ".join(f"`{a}` = {v[a]!r}" for a in moving))) for v in values]


def visible_rows(df: DataFrame, y: str, log_y: bool = False, size: str = "n_voxel", least: int = 0) -> DataFrame:
    """Rows that a scatter shows: on a log axis those with a known y over 0, and of a least size where it is over 1."""
    out = df.where((F.col(y) > 0) & ~F.isnan(y) & (F.col(y) < float("inf"))) if log_y else df
    return out.where(F.col(size) >= least) if least > 1 else out


def feature_columns(df: DataFrame, groups: Mapping[str, Sequence[str]], skip: Sequence[str] = (), prefixes: Mapping[str, str] | None = None, rest: str = "significance") -> list[tuple[str, str]]:
    """(group, column) of a frame's features: no boolean column, none to skip, none without any value; sorted."""
    kinds = [(c, k) for c, k in df.dtypes if k != "boolean" and c not in skip]
    known = df.agg(*(F.count(F.when(~F.isnan(c), F.col(c)) if k in ("double", "float") else F.col(c)).alias(c) for c, k in kinds)).first()

    def group(c: str) -> str:
        named = next((g for g, held in groups.items() if c in held), None)
        return named or next((g for p, g in (prefixes or {}).items() if c.startswith(p)), rest)

    return sorted((group(c), c) for c, _ in kinds if known[c])


def ranked(df: DataFrame, column: str, order: Sequence[str], place: str = "place") -> DataFrame:
    """Adds the place of a label in a catalogue, labels outside it last and by name."""
    rank = F.coalesce(F.create_map(*(F.lit(x) for i, name in enumerate(order) for x in (name, i)))[F.col(column)], F.lit(len(order))) if order else F.lit(0)
    labels = df.select(column).distinct().withColumn("_rank", rank)
    return df.join(F.broadcast(labels.select(column, (F.row_number().over(Window.orderBy("_rank", column))).alias(place))), column)  # a row a label


def region_extras(regions: DataFrame, extra: DataFrame, on: Sequence[str]) -> DataFrame:
    """Regions with further columns by id; a column that both have is an error."""
    clash = (set(regions.columns) & set(extra.columns)) - set(on)
    if clash:
        raise ValueError(f"columns twice: {sorted(clash)}")
    same = None
    right = extra.select(*(F.col(c).alias(f"_{c}") if c in on else F.col(c) for c in extra.columns))
    for c in on:
        same = F.col(c).eqNullSafe(F.col(f"_{c}")) if same is None else same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return regions.join(right, same, "left").drop(*(f"_{c}" for c in on))


def region_regression(values: DataFrame, keys: Sequence[str], image: str, x: str, y: str) -> DataFrame:
    """(keys, n, slope, intercept, r2, spread): each region's mean by image regressed on x; spread: mean over images of its spread over voxels."""
    per = values.groupBy(*keys, image, x).agg(F.avg(y).alias("mean"), F.stddev_pop(y).alias("std"))
    flat = F.stddev_pop("mean") == 0
    return per.groupBy(*keys).agg(F.count("*").alias("n"), F.regr_slope("mean", x).alias("slope"), F.regr_intercept("mean", x).alias("intercept"), F.when(~flat, F.regr_r2("mean", x)).alias("r2"), F.avg("std").alias("spread"))


def drift_report(ref: DataFrame, got: DataFrame, on: Sequence[str], floor: float = 1e-12) -> DataFrame:
    """One row: largest relative differences of statistics, and how many p-values are not the same (unknown equals unknown).

    ref and got: (on, stat, pval); what only one of them has counts as a p-value that differs.
    """
    right = got.select(*(F.col(c).alias(f"_{c}") for c in on), F.col("stat").alias("_stat"), F.col("pval").alias("_pval"), F.lit(True).alias("_there"))
    same = None
    for c in on:
        same = F.col(c).eqNullSafe(F.col(f"_{c}")) if same is None else same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    both = ref.withColumn("there", F.lit(True)).join(right, same, "full")
    apart = F.abs(F.col("stat") - F.col("_stat")) / F.greatest(F.abs("stat"), F.lit(floor))
    flipped = ~F.col("pval").eqNullSafe(F.col("_pval")) | F.col("there").isNull() | F.col("_there").isNull()
    return both.agg(F.max(apart).alias("stat_rel"), F.count_if(flipped).alias("n_flip"), F.count("*").alias("n"), F.max("stat").alias("max_ref"), F.max("_stat").alias("max_got"), F.avg(F.col("_stat").isNotNull().cast("int")).alias("known"))


def difference_band(df: DataFrame, pair: Sequence[str], x: str, series: str, one: str, others: Sequence[str], metric: str, width: float = 0.5) -> DataFrame:
    """(x, n, median, low, high) of a method less the best other, over seeds: the median and a central band."""
    diff = head_to_head(df, pair, series, one, others, metric).where("diff is not null")
    q = F.percentile("diff", F.array(F.lit(0.5), F.lit((1 - width) / 2), F.lit(1 - (1 - width) / 2)))
    return diff.groupBy(x).agg(F.count("*").alias("n"), q.alias("q")).select(x, "n", F.col("q")[0].alias("median"), F.col("q")[1].alias("low"), F.col("q")[2].alias("high"))


def rates(df: DataFrame, keys: Sequence[str], holds: Column) -> DataFrame:
    """(keys, rate, n): the percentage of trials for which something holds."""
    return df.groupBy(*keys).agg((100 * F.avg(F.coalesce(holds, F.lit(False)).cast("int"))).alias("rate"), F.count("*").alias("n"))


def seed_medians(df: DataFrame, keys: Sequence[str], seed: str, metric: str) -> DataFrame:
    """(keys, n_seed, median): the median over seeds of each seed's mean."""
    per = df.groupBy(*keys, seed).agg(F.avg(metric).alias("mean"))
    return per.groupBy(*keys).agg(F.count("*").alias("n_seed"), F.percentile("mean", F.lit(0.5)).alias("median"))


MECHANISMS = ("none", "over-inclusion", "spurious", "both")


def precision_parts(df: DataFrame) -> DataFrame:
    """Trials that detect anything, with false volumes as multiples of the effect's, precision without each error, and the mechanism.

    df has tp, fp, fn, leaked and spurious: false voxels of regions that touch the effect and of those that don't.
    """
    tp, fn, leaked, spurious = (F.col(c) for c in ("tp", "fn", "leaked", "spurious"))
    out = df.where(F.col("tp") + F.col("fp") > 0)
    true = tp + fn
    kind = F.when((leaked > 0) & (spurious > 0), MECHANISMS[3]).when(leaked > 0, MECHANISMS[1]).when(spurious > 0, MECHANISMS[2]).otherwise(MECHANISMS[0])
    return out.withColumns({
        "pred_vol": tp + F.col("fp"), "true_vol": true, "vol_leak": ratio(leaked, true), "vol_spur": ratio(spurious, true), "vol_fp": ratio(F.col("fp"), true),
        "ppv_noleak": ratio(tp, tp + spurious), "ppv_nospur": ratio(tp, tp + leaked), "mechanism": kind,
    })


def runtime_summary(df: DataFrame, series: str, x: str, seconds: str, decades: float = 1.0, spans: float = 10.0) -> DataFrame:
    """(series, x, median, low, high, slope) in minutes; the log-log slope of medians only where x spans enough, else NULL."""
    per = df.groupBy(series, x).agg((F.percentile(seconds, F.lit(0.5)) / 60).alias("median"), (F.min(seconds) / 60).alias("low"), (F.max(seconds) / 60).alias("high"))
    span = df.agg((F.max(x) / F.greatest(F.min(x), F.lit(1))).alias("span"))  # one row
    slopes = log_slope(per, series, x, "median", decades).select(series, "slope").crossJoin(F.broadcast(span)).select(series, F.when(F.col("span") >= spans, F.col("slope")).alias("slope"))
    return per.join(slopes, series, "left")


def deepest_agreement(df: DataFrame, keys: Sequence[str], count: str, region: str) -> DataFrame:
    """Adds agree: whether a row names the region that its group's deepest count names; two rows without a region agree."""
    deep = df.groupBy(*keys).agg(F.max_by(F.struct(F.col(region).alias("region")), count).alias("_deep")).select(*(F.col(k).alias(f"_{k}") for k in keys), "_deep")
    same = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"_{k}")) if same is None else same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return df.join(deep, same).withColumn("agree", F.col(region).eqNullSafe(F.col("_deep.region"))).select(*df.columns, "agree")


def stability_table(df: DataFrame, effect: str, count: str, seed: str, metrics: Sequence[str]) -> DataFrame:
    """(effect, count, metrics..., n_seed, z_ceiling): means by strength and count; a z that is among its own m + 1 draws is m / sqrt(m + 1) at most."""
    out = df.groupBy(effect, count).agg(*(F.avg(F.col(m).cast("double")).alias(m) for m in metrics), F.countDistinct(seed).alias("n_seed"))
    return out.withColumn("z_ceiling", F.col(count) / F.sqrt(F.col(count) + 1))


def wide_metrics(long: DataFrame, keys: Sequence[str], metric: str, metrics: Sequence[str], fields: Mapping[str, str]) -> DataFrame:
    """A row for each key: of every metric in turn its fields, named by patterns such as 'glow_{m}'."""
    wide = long.groupBy(*keys).pivot(metric, list(metrics)).agg(*(F.first(f, ignorenulls=True).alias(f) for f in fields))
    one = len(fields) == 1
    return wide.select(*keys, *(F.col(f"`{m}`" if one else f"`{m}_{f}`").alias(pattern.format(m=m)) for m in metrics for f, pattern in fields.items()))


def width_table(df: DataFrame, rows: str, columns: str, names: Sequence[str], width: str, metric: str) -> DataFrame:
    """A row for each of `rows`: by each column the width of the best mean, the narrowest on ties."""
    means = df.groupBy(rows, columns, width).agg(F.avg(metric).alias("mean"))
    best = means.groupBy(rows, columns).agg(F.min_by(width, F.struct((-F.col("mean")).alias("down"), F.col(width).alias("width"))).alias("best"))
    return best.groupBy(rows).pivot(columns, list(names)).agg(F.first("best"))


def tuned(df: DataFrame, arm: str, reference: str, metric: str, statistics: Sequence[str], atol: float = 1e-12) -> DataFrame:
    """(arm, zt, stat, fwhm, tied): each arm's best variant of (zt, stat, fwhm, mean metric).

    Variants within atol of the best are tied. The reference arm is settled first, by the narrowest width, then the order of
    `statistics`, then raw before z; the other arms' ties keep to its statistic where they have it, then go the same way.
    """
    means = df.groupBy(arm, "zt", "stat", "fwhm").agg(F.avg(metric).alias("mean"))
    top = means.groupBy(arm).agg(F.max("mean").alias("top"))
    near = means.join(top, arm).where(F.col("mean") >= F.col("top") - atol)
    rank = F.create_map(*(F.lit(x) for i, s in enumerate(statistics) for x in (s, i)))[F.col("stat")]
    usual = [F.col("fwhm"), rank, F.col("zt") != "raw"]
    one = near.where(F.col(arm) == reference).agg(F.min_by("stat", F.struct(*(c.alias(f"c{i}") for i, c in enumerate(usual)))).alias("ref"))  # one row
    order = F.struct(F.coalesce((F.col("stat") != F.col("ref")) & (F.col(arm) != reference), F.lit(False)).alias("other"), *(c.alias(f"c{i}") for i, c in enumerate(usual)))
    best = near.crossJoin(F.broadcast(one)).groupBy(arm).agg(F.min_by(F.struct("zt", "stat", "fwhm"), order).alias("best"), F.count("*").alias("tied"))
    return best.select(arm, "best.*", "tied")


def matched_metric(curve: DataFrame, series: str, x: str, y: str, level: float) -> DataFrame:
    """(series, y): y where a curve's x first reaches a level, between its points; NULL where it never does."""
    w = Window.partitionBy(series).orderBy(x)
    steps = curve.withColumns({"x0": F.lag(x).over(w), "y0": F.lag(y).over(w)})
    at = F.when(F.col(x) == level, F.col(y)).when((F.col("x0") < level) & (F.col(x) > level), F.col("y0") + (level - F.col("x0")) / (F.col(x) - F.col("x0")) * (F.col(y) - F.col("y0")))
    return steps.groupBy(series).agg(F.min_by(at, F.when(at.isNotNull(), F.col(x))).alias(y))


def text_table(df: DataFrame, digits: int = 3, latex: bool = False) -> str:
    """A report's few rows as aligned text or as the body of a LaTeX table; missing values are dashes."""
    def cell(v: object) -> str:
        if v is None or isinstance(v, float) and np.isnan(v):
            return "--" if latex else "-"
        text = f"{v:.{digits}f}" if isinstance(v, float) else str(v)
        return text.replace("_", r"\_").replace("%", r"\%").replace("&", r"\&") if latex else text

    rows = [list(map(cell, df.columns)), *([cell(v) for v in r] for r in df.collect())]
    if latex:
        return "\n".join([f"\\begin{{tabular}}{{{'l' * len(df.columns)}}}", *(" & ".join(r) + r" \\" for r in rows), r"\end{tabular}"])
    widths = [max(map(len, column)) for column in zip(*rows, strict=True)]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(r, widths, strict=True)).rstrip() for r in rows)


def resolve_names(patterns: Iterable[str], names: Sequence[str]) -> list[str]:
    """Names of a catalogue by literals or globs, each once, in the order of the patterns; a pattern without any is an error."""
    out: list[str] = []
    for pattern in patterns:
        found = [pattern] if pattern in names else [n for n in names if fnmatchcase(n, pattern)]
        if not found:
            raise ValueError(f"nothing is named {pattern!r}")
        out += [n for n in found if n not in out]
    return out


def narrowed(leaves: Sequence[Mapping], labels: Sequence[str] | None, known: Sequence[str], key: str = "ana") -> list[Mapping]:
    """The leaves of the named methods, all where none is named; leaves without a method never match, an unknown name is an error."""
    if not labels:
        return list(leaves)
    unknown = sorted(set(labels) - set(known))
    if unknown:
        raise ValueError(f"no method {unknown}")
    return [leaf for leaf in leaves if leaf.get(key) in set(labels)]


def warn_if_large(n_bytes: int, most: int = 1 << 30) -> bool:
    """A warning before a kept draw matrix is saved."""
    if n_bytes > most:
        warnings.warn(f"the draw matrix that is saved has {n_bytes} bytes", ResourceWarning, stacklevel=2)
    return n_bytes > most
