"""The multi-state report: histories against transition and detection kernels."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from resight.operators import histories as H, kernels as K, score


def history_report(hist: DataFrame, rates: DataFrame, detect: DataFrame, keys, k: int, strict_guard: bool = False) -> DataFrame:
    """Counted histories with their probability under each key's kernel.

    ``rates`` holds log rates between k states, ``detect`` the detection of the live ones.
    """
    keys = list(keys)
    last = H.last_period(hist, keys)
    kernel = K.rate_to_transition(rates, keys, k)
    cells = K.history_cells(kernel, detect, last.select(*keys, F.col("s").alias("lags")), keys, k)
    return K.history_probability(hist, cells, last, keys, strict_guard)


def fit_report(hist: DataFrame, rates: DataFrame, detect: DataFrame, keys, k: int):
    """(observed and predicted recaptures, log likelihood per key)."""
    p = history_report(hist, rates, detect, keys, k)
    return score.expected_by_history(p, keys), score.score_cjs(p, keys)


def history_report_by_period(hist: DataFrame, rates: DataFrame, detect: DataFrame, keys, k: int, strict_guard: bool = False) -> DataFrame:
    """The same with detection by period and location: ``detect`` has (keys, t_k, loc, p)."""
    keys = list(keys)
    kernel = K.rate_to_transition(rates, keys, k)
    return K.history_probability_by_period(hist, kernel, detect, H.last_period(hist, keys), keys, k, strict_guard)
