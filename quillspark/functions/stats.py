"""The hypergeometric distribution over arrays (A6); log-gamma and Student's distribution as expressions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.text import _c


def _stirling_error(x: np.ndarray) -> np.ndarray:
    """ln(x!) less Stirling's formula, for whole x >= 1: exact values up to 15, the series (error below 1e-16) above."""
    k = np.arange(1, 16)
    exact = np.array([math.lgamma(i + 1) for i in k]) - (k * np.log(k) - k + 0.5 * np.log(2 * math.pi * k))
    sq = x * x
    series = (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - 1 / 1188 / sq) / sq) / sq) / sq) / x
    return np.where(x <= 15, exact[np.minimum(x, 15).astype(int) - 1], series)


def _deviance(x: np.ndarray, mean: float) -> np.ndarray:
    """x ln(x / mean) + mean - x without cancellation: a power series where x is near the mean."""
    v = (x - mean) / (x + mean)
    sq, series = v * v, 0.0
    for j in range(9, 0, -1):
        series = (series + 1.0 / (2 * j + 1)) * sq
    return np.where(np.abs(v) < 0.1, (x - mean) * v + 2 * x * v * series, x * np.log(x / mean) + mean - x)


def _ln_binomial(x: np.ndarray, n: float, p: float, q: float) -> np.ndarray:
    """log of the binomial probability of x out of n, q = 1 - p, in its deviance form: errors do not grow with n."""
    if n == 0:
        return np.zeros(len(x))
    out = np.empty(len(x))
    none, all_ = x <= 0, x >= n
    out[none], out[all_] = n * math.log1p(-p), n * math.log(p)
    y = x[~none & ~all_]
    out[~none & ~all_] = (
        _stirling_error(np.array([n]))[0] - _stirling_error(y) - _stirling_error(n - y) - _deviance(y, n * p) - _deviance(n - y, n * q)
        + 0.5 * np.log(n / (2 * math.pi * y * (n - y)))
    )
    return out


def ln_hypergeom(x, row1: int, row2: int, col1: int) -> np.ndarray:
    """log P(X = x) for the upper-left cell of a 2x2 table with the given margins (neither column empty), from three binomial
    probabilities with the column's share."""
    x = np.asarray(x, np.float64)
    n = float(row1 + row2)
    p, q = col1 / n, (n - col1) / n
    return _ln_binomial(x, float(row1), p, q) + _ln_binomial(col1 - x, float(row2), p, q) - _ln_binomial(np.array([float(col1)]), n, p, q)


def ln_gamma(x) -> Column:
    """ln(Gamma(x)) for x > 0: Stirling's series after eight steps up."""
    x = _c(x)
    up = x + 8.0
    sq = up * up
    series = (F.lit(1 / 12) - (F.lit(1 / 360) - (F.lit(1 / 1260) - (F.lit(1 / 1680) - F.lit(1 / 1188) / sq) / sq) / sq) / sq) / up
    out = (up - 0.5) * F.log(up) - up + F.lit(0.5 * math.log(2 * math.pi)) + series
    for k in range(8):
        out = out - F.log(x + float(k))
    return out


def erfc_of_root(x) -> Column:
    """erfc(sqrt(x)) for x > 0: the power series of erf below 2, the continued fraction of the upper
    incomplete gamma function from there on; both of a fixed number of terms."""
    steps = F.sequence(F.lit(1), F.lit(80))
    series = F.aggregate(
        steps, F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("acc")),
        lambda st, k: F.struct((st["term"] * x / (k + 0.5)).alias("term"), (st["acc"] + st["term"] * x / (k + 0.5)).alias("acc")),
        lambda st: st["acc"])
    fraction = F.aggregate(F.reverse(steps), x + 160.5, lambda t, k: x + 2 * k - 1.5 - k * (k - 0.5) / t)
    root = F.sqrt(x / math.pi) * F.exp(-x)
    return F.when(x < 2, 1 - 2 * root * series).otherwise(root / fraction)


#: Terms of the continued fraction (it needs about the root of the larger parameter), and the degrees of freedom up to which it is used.
BETA_TERMS, STUDENT_DOF = 2000, 1_000_000


def incomplete_beta(x, a, b) -> Column:
    """Regularised I_x(a, b) by its continued fraction, evaluated from the last term back; 0 < x <= (a + 1) / (a + b + 2)."""
    x, a, b = _c(x), _c(a), _c(b)
    front = F.exp(a * F.log(x) + b * F.log1p(-x) + ln_gamma(a + b) - ln_gamma(a) - ln_gamma(b)) / a

    def term(m):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m - 1) * (a + b + m - 1) * x / ((a + 2 * m - 2) * (a + 2 * m - 1))
        return odd, even

    def step(t, m):
        odd, even = term(m)
        return F.lit(1.0) + odd / (F.lit(1.0) + even / t)

    # 1/(1 + d1/(1 + d2/(1 + ...))): the pair (d_2m-1, d_2m) is folded in from the largest m down
    return front / F.aggregate(F.reverse(F.sequence(F.lit(1), F.lit(BETA_TERMS))), F.lit(1.0), step)


def student_two_sided(t, dof) -> Column:
    """P(|T| >= |t|) of Student's distribution. Past STUDENT_DOF degrees of freedom the normal tail with its first correction."""
    t, dof = _c(t), _c(dof).cast("double")
    sq = t * t
    x, y = dof / (dof + sq), sq / (dof + sq)
    tail = F.when(x < (dof / 2 + 1) / (dof / 2 + 2.5), incomplete_beta(x, dof / 2, F.lit(0.5))).otherwise(
        F.lit(1.0) - incomplete_beta(y, F.lit(0.5), dof / 2))
    normal = erfc_of_root(sq / 2) + (F.abs(t) * sq + F.abs(t)) * F.exp(-sq / 2) / F.sqrt(F.lit(2 * math.pi)) / (2 * dof)
    return F.when(t.isNull() | (dof <= 0), F.lit(None).cast("double")).when(sq == 0, F.lit(1.0)).when(dof > STUDENT_DOF, normal).otherwise(tail)
