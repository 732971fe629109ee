"""Scalar expressions that Spark has no function for."""

from __future__ import annotations

import math
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

#: Acklam's rational approximation of the inverse normal distribution function.
ACKLAM_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
ACKLAM_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
ACKLAM_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
ACKLAM_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
ACKLAM_LOW = 0.02425


def rounded(c: Column, digits: int = 6) -> Column:
    """Rounded, without a negative zero: for results that are compared by value."""
    return F.round(c, digits) + F.lit(0.0)


def ordered(c: Column, digits: int | None) -> Column:
    """What values are ordered by: themselves, or rounded where sums of other engines have to tie alike."""
    return c if digits is None else F.round(c, digits)


def _horner(x: Column, coefficients: tuple[float, ...], last: float | None = None) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out if last is None else out * x + F.lit(last)


def inverse_normal(p: Column) -> Column:
    """Quantile of the standard normal distribution; relative error below 1.2e-9."""
    low = F.sqrt(-2.0 * F.ln(p))
    high = F.sqrt(-2.0 * F.ln(1.0 - p))
    q = p - 0.5
    tail = lambda x: _horner(x, ACKLAM_C) / _horner(x, ACKLAM_D, 1.0)
    return (
        F.when(p < ACKLAM_LOW, tail(low))
        .when(p > 1 - ACKLAM_LOW, -tail(high))
        .otherwise(_horner(q * q, ACKLAM_A) * q / _horner(q * q, ACKLAM_B, 1.0))
    )


def inverse_normal_sql(p: str) -> str:
    """The same as SQL text."""

    def horner(x: str, cs: tuple[float, ...], last: float | None = None) -> str:
        out = repr(cs[0])
        for c in (*cs[1:], *(() if last is None else (last,))):
            out = f"({out} * {x} + {c!r})"
        return out

    def tail(x: str) -> str:
        return f"{horner(x, ACKLAM_C)} / {horner(x, ACKLAM_D, 1.0)}"

    low, high, q = f"sqrt(-2.0 * ln({p}))", f"sqrt(-2.0 * ln(1.0 - {p}))", f"({p} - 0.5)"
    middle = f"{horner(f'({q} * {q})', ACKLAM_A)} * {q} / {horner(f'({q} * {q})', ACKLAM_B, 1.0)}"
    return f"CASE WHEN {p} < {ACKLAM_LOW!r} THEN {tail(low)} WHEN {p} > {1 - ACKLAM_LOW!r} THEN -({tail(high)}) ELSE {middle} END"


def normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def choose(n: Column, k: Column) -> Column:
    """Binomial coefficient as a double."""
    steps = F.sequence(F.lit(1), F.greatest(k.cast("int"), F.lit(1)))
    product = F.aggregate(steps, F.lit(1.0), lambda acc, i: acc * (n - k + i) / i)
    return F.when((k < 0) | (k > n), F.lit(0.0)).when(k == 0, F.lit(1.0)).otherwise(product)


def perplexity_weights(scores: Column, keff: Column | float) -> Column:
    """Softmax weights of an array of scores, with the temperature at which exp(entropy) is keff.

    60 bisection steps on the log temperature in [ln 1e-4, ln 1e4], all rows of a batch at once; with keff
    scores or fewer, all weigh the same.
    """
    keff = F.lit(float(keff)) if isinstance(keff, (int, float)) else keff.cast("double")
    return F.pandas_udf(_softened, ArrayType(DoubleType()))(scores, keff)


def _softened(scores: pd.Series, keff: pd.Series) -> pd.Series:
    sizes = np.array([len(x) for x in scores])
    there = np.arange(sizes.max(initial=0))[None, :] < sizes[:, None]
    if not there.size:
        return scores
    own = np.zeros(there.shape)
    own[there] = np.concatenate(scores.to_list())
    own = np.where(there, own - np.where(there, own, -np.inf).max(axis=1, keepdims=True), 0.0)
    most = keff.to_numpy()
    lo, hi = np.full(len(own), math.log(1e-4)), np.full(len(own), math.log(1e4))
    for _ in range(60):
        middle = (lo + hi) / 2
        u = own / np.exp(middle)[:, None]
        e = np.where(there, np.exp(u), 0.0)
        z = e.sum(axis=1)
        wide = np.exp(np.log(z) - (e * u).sum(axis=1) / z) > most
        lo, hi = np.where(wide, lo, middle), np.where(wide, middle, hi)
    w = np.where(there, np.exp(own / np.exp((lo + hi) / 2)[:, None]), 0.0)
    w = np.where((sizes <= most)[:, None], there / np.maximum(sizes, 1)[:, None], w / w.sum(axis=1, keepdims=True))
    return pd.Series([row[:n] for row, n in zip(w, sizes)])


def rounded_half_up(v: np.ndarray, digits: int) -> np.ndarray:
    """Non-negative numbers rounded as Spark's round does: halves of their shortest decimals go up."""
    scaled = v * 10.0**digits
    with np.errstate(invalid="ignore"):
        out = np.floor(scaled + 0.5) / 10.0**digits
        near = np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6)
    for k in near.tolist():
        out[k] = float(Decimal(repr(float(v[k]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
    return out


def half_up_codes(v: np.ndarray, digits: int) -> np.ndarray:
    """`rounded_half_up` of finite numbers, times 10 ^ digits, as whole numbers."""
    scaled = v * 10.0**digits
    out = np.floor(scaled + 0.5)
    scaled -= out
    near = np.abs(np.abs(scaled, out=scaled) - 0.5, out=scaled) < 1e-6
    out = out.astype(np.int32)
    if near.any():
        out[near] = np.rint(rounded_half_up(v[near], digits) * 10.0**digits).astype(np.int32)
    return out
