"""Column expressions: missing values, test statistics, overlap metrics.

NULL means "not analysed". Every quotient and logarithm is guarded, so that NaN and infinity
never enter an aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def known(c: Column) -> Column:
    """NULL for NaN and infinity."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def ratio(a: Column, b: Column, fill: float | None = None) -> Column:
    out = F.try_divide(a.cast("double"), b.cast("double"))
    return out if fill is None else F.coalesce(out, F.lit(fill))


def llr(det_e: Column, det_t: Column, n: Column) -> Column:
    """n / 2 (ln |E + H| - ln |E|), NULL unless both are positive."""
    return F.when((det_e > 0) & (det_t > 0), 0.5 * n * (F.ln(det_t) - F.ln(det_e)))


def wilks(det_e: Column, det_t: Column) -> Column:
    """1 - |E| / |E + H|."""
    return F.when((det_e > 0) & (det_t > 0), -F.expm1(F.ln(det_e) - F.ln(det_t)))


def five_statistics(e: Column, h: Column, n: Column) -> dict[str, Column]:
    """The five test statistics of one feature, whose E and H are numbers."""
    return {"llr": llr(e, e + h, n), "wilks": wilks(e, e + h), "pillai": ratio(h, e + h), "hotelling": ratio(h, e), "roy": ratio(h, e)}


def det2(a: Column, b: Column, c: Column) -> Column:
    """Determinant of the symmetric [[a, b], [b, c]]."""
    return a * c - b * b


def dice(tp: Column, fp: Column, fn: Column) -> Column:
    return ratio(2 * tp, 2 * tp + fp + fn, 0.0)


def sensitivity(tp: Column, fn: Column) -> Column:
    return ratio(tp, tp + fn, 0.0)


def precision(tp: Column, fp: Column) -> Column:
    return ratio(tp, tp + fp)


def specificity(tn: Column, fp: Column) -> Column:
    return ratio(tn, tn + fp)


def entropy_bits(p: Column) -> Column:
    """Summed over the classes: an aggregate of -p log2 p."""
    return F.coalesce(-F.sum(F.when(p > 0, p * F.log2(p))), F.lit(0.0))


def xlog2x(p: Column) -> Column:
    return F.when(p > 0, p * F.log2(p)).otherwise(0.0)
