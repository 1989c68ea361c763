"""Logit family and log densities as native columns (no Python at run time)."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

NEG_INF = float("-inf")
HALF_LOG_TWO_PI = 0.5 * math.log(2.0 * math.pi)


def as_col(x) -> Column:
    return x if isinstance(x, Column) else (F.col(x) if isinstance(x, str) else F.lit(x))


def bound(value, f) -> Column:
    """f(value), with the value computed once where f uses it inside a lambda; a plan would put its expression there."""
    return F.transform(F.array(value), f)[0]


def logit(x) -> Column:
    """log(x / (1 - x)), infinite at the ends."""
    x = as_col(x)
    return F.when(x <= 0, F.lit(NEG_INF)).when(x >= 1, F.lit(-NEG_INF)).otherwise(F.log(x / (1 - x)))


def expit(x) -> Column:
    return 1 / (1 + F.exp(-as_col(x)))


def _stirling(x: Column) -> Column:
    """Asymptotic series of log-gamma; the next term is below 1e-14 from x = 8 on."""
    y = 1 / x
    y2 = y * y
    tail = y * (
        1 / 12 - y2 * (1 / 360 - y2 * (1 / 1260 - y2 * (1 / 1680 - y2 * (1 / 1188 - y2 * (691 / 360360 - y2 / 156)))))
    )
    return (x - 0.5) * F.log(x) - x + HALF_LOG_TWO_PI + tail


def lgamma(x) -> Column:
    """log Gamma(x) for x > 0: the series directly, or shifted up by eight below 8."""
    x = as_col(x).cast("double")
    rising = x
    for k in range(1, 8):
        rising = rising * (x + k)
    return F.when(x >= 8, _stirling(x)).otherwise(_stirling(x + 8) - F.log(rising))


def xlogy(k, x) -> Column:
    """k * log(x) with 0 * log(0) = 0 and log(0) = -infinity (Spark's log(0) is null)."""
    k, x = as_col(k), as_col(x)
    return F.when(k == 0, 0.0).when(x <= 0, F.lit(NEG_INF)).otherwise(k * F.log(x))


def log_choose(n, k) -> Column:
    n, k = as_col(n), as_col(k)
    return lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)


def log_binom(k, n, p) -> Column:
    k, n, p = as_col(k), as_col(n), as_col(p)
    inside = log_choose(n, k) + xlogy(k, p) + xlogy(n - k, 1 - p)
    return F.when((k < 0) | (k > n), F.lit(NEG_INF)).otherwise(inside)


def log_pois(k, mu) -> Column:
    k, mu = as_col(k), as_col(mu)
    return F.when(k < 0, F.lit(NEG_INF)).otherwise(xlogy(k, mu) - mu - lgamma(k + 1))


def log_multinom_cell(k, p) -> Column:
    """One cell of a multinomial; add ``lgamma(total + 1)`` once per vector."""
    k = as_col(k)
    return xlogy(k, p) - lgamma(k + 1)


def log_norm(x, mean, sd) -> Column:
    x, mean, sd = as_col(x), as_col(mean), as_col(sd)
    z = F.try_divide(x - mean, sd)
    return -0.5 * z * z - F.log(sd) - HALF_LOG_TWO_PI


def log_beta(x, a, b) -> Column:
    x, a, b = as_col(x), as_col(a), as_col(b)
    return xlogy(a - 1, x) + xlogy(b - 1, 1 - x) + lgamma(a + b) - lgamma(a) - lgamma(b)
