"""Arithmetic on scores, votes and weights as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """The value, or null for NaN and infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def stable_sigmoid(x: Column) -> Column:
    """1 / (1 + e^-x) without overflow."""
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def platt(x: Column, slope: float, intercept: float) -> Column:
    """Calibrated probability of a logit."""
    return stable_sigmoid(x * slope + intercept)


def order_gap(ab: Column, ba: Column, slope: float, intercept: float) -> Column:
    """Distance of the calibrated probabilities of a pair's two orders."""
    return F.abs(platt(ab, slope, intercept) - platt(ba, slope, intercept))


def order_gap_of(present: list[str], slope: float, intercept: float, missing_allowed: bool = False) -> Column:
    """The order gap from what a score table has: logits of both orders, else the stored gap of its logits around their mean.

    NaN, infinite or negative values raise; without either source it raises, or with
    ``missing_allowed`` is null.
    """
    wrong = lambda what: F.raise_error(F.lit(what)).cast("double")
    if {"logit_ab", "logit_ba"} <= set(present):
        ab, ba = F.col("logit_ab"), F.col("logit_ba")
        sound = finite(ab).isNotNull() & finite(ba).isNotNull()
        return F.when(sound, order_gap(ab, ba, slope, intercept)).otherwise(wrong("an order's logit is not finite"))
    if {"logit", "order_gap"} <= set(present):
        half = F.col("order_gap") / 2
        gap = order_gap(F.col("logit") + half, F.col("logit") - half, slope, intercept)
        return F.when(finite(half).isNotNull() & (half >= 0), gap).otherwise(wrong("a stored order gap is not finite or negative"))
    if missing_allowed:
        return F.lit(None).cast("double")
    raise ValueError("neither logits of both orders nor their gap")


def number(text: Column) -> Column:
    """The text as a double; what is no number is null."""
    return text.try_cast("double")


def votes(target: Column) -> Column:
    """The nearest ninth, half to even."""
    return F.rint(target * 9).cast("int")


def band(v: Column) -> Column:
    """pos from 8 votes, neg up to 2, else mid."""
    return F.when(v >= 8, "pos").when(v <= 2, "neg").otherwise("mid")


def similarity_band(j: Column) -> Column:
    """far below 0.2, near from 0.5, else mid; a negative (unknown) similarity is mid."""
    return F.when(j < 0, "mid").when(j < 0.2, "far").when(j < 0.5, "mid").otherwise("near")


def confidence(p: Column) -> Column:
    """Distance from undecided, 0..1."""
    return F.abs(2 * p - 1)


def base_weight(p: Column, base: float = 1.0) -> Column:
    """Training weight of a soft label."""
    return base * (0.3 + 0.7 * confidence(p))


def clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def inverse_variance(p: Column, n_votes: int = 9) -> Column:
    """Inverse of a vote share's variance plus that of a quarter vote's slack, before scaling by the median."""
    q = clip(p, 0.001, 0.999)
    return 1 / (q * (1 - q) / n_votes + F.lit(1 / 36))


def clean(c: Column) -> Column:
    """NaN becomes 0.5, infinities 1 and 0."""
    return F.when(F.isnan(c), 0.5).when(c == float("inf"), 1.0).when(c == float("-inf"), 0.0).otherwise(c)


def total(columns: list[Column]) -> Column:
    """Sum in the order given."""
    return reduce(lambda a, b: a + b, columns)
