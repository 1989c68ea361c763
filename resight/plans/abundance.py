"""Abundance of every season and group in one job, and the comparison of its routes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from resight.operators import fit, histories as H, score, summary
from resight.operators.joins import match
from resight.session import settle


def abundance(hist: DataFrame, keys, cells=None):
    """(fit per key, statistics, totals by two routes) from counted histories.

    The counted table is settled once: everything after it is small, and no step goes
    back to individual rows.
    """
    keys = list(keys)
    hist = settle(hist)
    bounds = H.last_period(hist, keys)
    stats = settle(H.js_from_histories(hist, bounds, keys))
    scored = fit.score_grid(stats, keys, cells)
    return fit.fit_grid(scored, keys), stats, summary.total_check(stats, hist, keys)


def year_report(hist: DataFrame, keys, cells=None) -> DataFrame:
    """One row per key: totals, estimated abundance with its 95 % interval, overall mark rate."""
    keys = list(keys)
    fitted, stats, totals = abundance(hist, keys, cells)
    est = summary.wald_interval(fitted, est="mean_nsuper", se="sd_nsuper").select(
        *keys, "best_phi", "best_p", F.col("value").alias("nsuper"), "lower", "upper"
    )
    marks = score.beta_posterior(stats.groupBy(*keys).agg(F.sum("marked").alias("marked"), F.sum("seen").alias("seen")))
    return match(match(est, totals, keys), marks.select(*keys, "v_mean", "v_sd"), keys)


def two_methods(hist: DataFrame, keys, cells=None) -> DataFrame:
    """One row per key and method: abundance fitted to the per-period statistics and to the counted histories."""
    keys = list(keys)
    hist = settle(hist)
    bounds = H.last_period(hist, keys)
    out = None
    for method, scored in (("statistics", fit.score_grid(settle(H.js_from_histories(hist, bounds, keys)), keys, cells)), ("histories", fit.score_history_grid(hist, bounds, keys, cells))):
        one = summary.wald_interval(fit.fit_grid(scored, keys), est="mean_nsuper", se="sd_nsuper")
        one = one.select(*keys, F.lit(method).alias("method"), "best_phi", "best_p", F.col("value").alias("nsuper"), "lower", "upper")
        out = one if out is None else out.unionByName(one)
    return out
