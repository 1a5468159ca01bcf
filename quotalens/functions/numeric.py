"""Budgets, safe ratios, probability transforms and reproducible uniforms as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def budget(fraction: float | Column, n: Column, least: int = 1) -> Column:
    """Number of selections for a share of ``n``: half-even rounding, never below ``least``.

    ``rint`` rounds halves to even as the published budgets do; ``round`` would not.
    """
    share = fraction if isinstance(fraction, Column) else F.lit(float(fraction))
    return F.greatest(F.lit(least), F.rint(share * n)).cast("bigint")


def clamped_budget(fraction: float | Column, n: Column) -> Column:
    """Grid form of :func:`budget`: between zero and ``n``."""
    return F.least(budget(fraction, n, least=0), n.cast("bigint"))


def ratio(top: Column, bottom: Column) -> Column:
    """``top / bottom`` as double, NULL where the denominator is zero."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def is_finite(value: Column) -> Column:
    """True for a known number other than NaN and the infinities."""
    v = value.cast("double")
    return F.coalesce(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), F.lit(False))


def clip_probability(p: Column, eps: float) -> Column:
    """Clip into ``[eps, 1 - eps]``; a NULL, NaN or infinite probability fails the query."""
    inside = F.greatest(F.lit(eps), F.least(F.lit(1.0 - eps), p))
    return F.when(is_finite(p), inside).otherwise(
        F.raise_error(F.lit("probabilities contain NaN, infinity or NULL")).cast("double")
    )


def logit(p: Column, eps: float) -> Column:
    """Log odds of the clipped probability."""
    c = clip_probability(p, eps)
    return F.log(c) - F.log1p(-c)


def expit(x: Column) -> Column:
    """Inverse of the log odds, written so that neither branch overflows."""
    small = F.exp(-F.abs(x))
    return F.when(x >= 0, F.lit(1.0) / (F.lit(1.0) + small)).otherwise(small / (F.lit(1.0) + small))


def platt(p: Column, intercept: float, slope: float, eps: float) -> Column:
    """Two-parameter logistic recalibration of a probability."""
    return clip_probability(expit(F.lit(intercept) + F.lit(slope) * logit(p, eps)), eps)


def uniform(*parts: Column | str) -> Column:
    """A uniform in [0, 1) that depends only on the given values.

    52 bits of an MD5 over the values joined with '|': the same row gets the same number on any cluster, at
    any partitioning and after any retry.
    """
    text = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))
