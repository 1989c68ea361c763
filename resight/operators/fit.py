"""Abundance fits for every group at once over a grid of (phi, p).

Each grid cell of each group is one row holding the group's per-period counts (at most a
few dozen numbers). Cells are spread over the cluster by a hash of group and cell, so a
group never sits in one task. Entries are found per cell under B >= 0.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from resight.functions.mathx import log_beta, log_choose, lgamma, xlogy
from resight.operators.joins import match
from resight.operators.model import lambda_const, tau_of
from resight.session import settle

CHUNK = 512
TINY = 1e-12


def _fitted(u: np.ndarray, phi: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Fitted first detections under entries B >= 0, exactly, for a stack of count vectors.

    Dividing the fitted value of period i by p q^i, q = phi (1 - p), turns B >= 0 into "does
    not decrease", so the Poisson maximum is a weighted isotonic regression: periods are taken
    in order, and as long as a pool's ratio falls below the one before, the two are one pool. Each row
    keeps a stack of its pools, all rows take a step together, and the memory is that of the counts. A
    pool's weight is a geometric sum, so no small difference is ever taken; ratios are kept as logs.
    """
    n, s = u.shape
    q = np.clip(phi * (1 - p), TINY, 1 - TINY)
    log_q, log_gap = np.log(q), np.log1p(-q)
    total, start, level = np.zeros((n, s)), np.zeros((n, s), int), np.full((n, s), -np.inf)
    top = np.full(n, -1)

    def ratio(rows, at, i):
        a = start[rows, at]
        with np.errstate(divide="ignore"):
            return np.log(np.maximum(total[rows, at], 0.0)) + log_gap[rows] - np.log1p(-(q[rows] ** (i - a + 1))) - a * log_q[rows]

    every = np.arange(n)
    for i in range(s):
        top += 1
        total[every, top], start[every, top] = u[:, i], i
        level[every, top] = ratio(every, top, i)
        rows = every[top > 0]
        while len(rows := rows[(top[rows] > 0)]) and len(rows := rows[level[rows, top[rows] - 1] > level[rows, top[rows]]]):
            total[rows, top[rows] - 1] += total[rows, top[rows]]
            top[rows] -= 1
            level[rows, top[rows]] = ratio(rows, top[rows], i)
    opens = np.zeros((n, s), int)
    row, pool = np.nonzero(np.arange(s)[None, :] <= top[:, None])
    opens[row, start[row, pool]] = 1
    of = np.cumsum(opens, axis=1) - 1
    return np.exp(level[every[:, None], of] + np.arange(s) * log_q[:, None])


def _entries(mu: np.ndarray, phi: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Entries behind fitted first detections; later entrants survive part of an interval."""
    q, c = phi * (1 - p), np.where(phi < 1, (phi - 1) / np.log(phi), 1.0)
    x = mu / p[:, None]
    out = x.copy()
    out[:, 1:] = np.maximum(x[:, 1:] - q[:, None] * x[:, :-1], 0.0) / c[:, None]
    # within a pooled run the difference is rounding only
    out[:, 1:][out[:, 1:] < 1e-9 * x[:, 1:]] = 0.0
    return out


FITTED = T.StructType([T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("entries", "mu")])


@F.pandas_udf(FITTED)
def _entries_udf(u: pd.Series, phi: pd.Series, p: pd.Series) -> pd.DataFrame:
    entries: list = [None] * len(u)
    fitted: list = [None] * len(u)
    lengths = u.map(len).to_numpy()
    f, d = phi.to_numpy(float), p.to_numpy(float)
    for s in np.unique(lengths):
        where = np.flatnonzero(lengths == s)
        for i in range(0, len(where), CHUNK):
            rows = where[i : i + CHUNK]
            mu = _fitted(np.stack(u.iloc[rows].to_numpy()).astype(float), f[rows], d[rows])
            b = _entries(mu, f[rows], d[rows])
            for k, row in enumerate(rows):
                entries[row], fitted[row] = b[k], mu[k]
    return pd.DataFrame({"entries": entries, "mu": fitted})


def deconvolve_entries(df: DataFrame) -> DataFrame:
    """Rows with an array u and scalars phi, p -> entries B >= 0 maximising the Poisson
    likelihood of u, and the fitted first detections mu."""
    return df.withColumn("_e", _entries_udf("u", "phi", "p")).select("*", "_e.entries", "_e.mu").drop("_e")


def grid(phi=(0.02, 0.98, 0.02), p=(0.02, 0.98, 0.02)):
    """Array column of all (phi, p) cells between the bounds."""

    def steps(lo, hi, by):
        n = int(round((hi - lo) / by))
        return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: F.lit(lo) + i * F.lit(by))

    return F.flatten(F.transform(steps(*phi), lambda f: F.transform(steps(*p), lambda d: F.struct(f.alias("phi"), d.alias("p")))))


def score_grid(stats: DataFrame, keys, cells=None, a: float = 0.5, b: float = 0.5) -> DataFrame:
    """Profile log likelihood and abundance of every grid cell of every group."""
    keys = list(keys)
    cols = ["first_seen", "marked", "recap_later", "recap_now", "at_risk"]
    packed = stats.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("t_k", *[F.col(c).cast("double").alias(c) for c in cols]))).alias("path"))
    # terms free of parameters, once per group
    known = F.filter("path", lambda x: x["t_k"] < F.size("path"))
    const = F.aggregate(known, F.lit(0.0), lambda acc, x: acc + log_choose(x["marked"], x["recap_later"]))
    inner = F.filter("path", lambda x: (x["t_k"] >= 2) & (x["t_k"] < F.size("path")))
    const = const + F.aggregate(inner, F.lit(0.0), lambda acc, x: acc + log_choose(x["at_risk"], x["recap_now"]))
    const = const - F.aggregate("path", F.lit(0.0), lambda acc, x: acc + lgamma(x["first_seen"] + 1))
    packed = packed.withColumns({"const": const, "u": F.transform("path", lambda x: x["first_seen"])})
    # the rows are small but costly, so their number of tasks follows the cores, not the bytes
    spread = 2 * stats.sparkSession.sparkContext.defaultParallelism
    rows = packed.withColumn("cell", F.explode(grid() if cells is None else cells)).select("*", "cell.phi", "cell.p").drop("cell")
    fitted = deconvolve_entries(rows.repartition(spread, *keys, "phi", "p"))

    s = F.size("path")

    def term(x):
        lam = lambda_const(F.col("phi"), F.col("p"), s - x["t_k"])
        tau = tau_of(F.col("p"), lam)
        later = F.when(x["t_k"] < s, xlogy(x["recap_later"], lam) + xlogy(x["marked"] - x["recap_later"], 1 - lam)).otherwise(0.0)
        now = F.when(
            (x["t_k"] >= 2) & (x["t_k"] < s), xlogy(x["recap_now"], tau) + xlogy(x["at_risk"] - x["recap_now"], 1 - tau)
        ).otherwise(0.0)
        return later + now

    marks = F.aggregate("path", F.lit(0.0), lambda acc, x: acc + term(x))
    return _profile(fitted, keys, F.col("const") + marks, a, b)


def _profile(fitted: DataFrame, keys, marks, a: float, b: float) -> DataFrame:
    """Log likelihood of cells from that of the marks and the fitted arrivals."""
    arrivals = F.aggregate(F.arrays_zip("u", "mu"), F.lit(0.0), lambda acc, z: acc + xlogy(z["u"], z["mu"]) - z["mu"])
    loglik = marks + arrivals + log_beta("phi", a, b) + log_beta("p", a, b)
    return fitted.select(*keys, "phi", "p", F.aggregate("entries", F.lit(0.0), lambda x, y: x + y).alias("nsuper"), F.aggregate("u", F.lit(0.0), lambda x, y: x + y).alias("u_total"), loglik.alias("loglik"), "entries")


def score_history_grid(hist: DataFrame, bounds: DataFrame, keys, cells=None, a: float = 0.5, b: float = 0.5) -> DataFrame:
    """The same profile from counted histories (keys, t_k, r_k, tag, n) instead of per-period statistics.

    A marked individual is found again after d periods with probability phi p (phi (1 - p))^(d - 1), and never in the
    L periods left with 1 - lambda(L). So a key needs no more than the number found again, the sum of
    their d - 1 and the number never found by L; grid cells meet these counts only. Arrivals and entries
    are as in ``score_grid``. A recapture in the period of capture counts as one in the next.
    """
    keys = list(keys)
    h = match(hist, bounds, keys)
    marked, again = F.col("tag"), F.col("r_k").isNotNull()
    wait = F.greatest(F.col("r_k") - F.col("t_k"), F.lit(1)) - 1
    by = h.groupBy(*keys, "s", "t_k").agg(
        F.sum("n").cast("double").alias("u"),
        F.coalesce(F.sum(F.when(marked & again, F.col("n"))), F.lit(0)).cast("double").alias("found"),
        F.coalesce(F.sum(F.when(marked & again, F.col("n") * wait)), F.lit(0)).cast("double").alias("waits"),
        F.coalesce(F.sum(F.when(marked & ~again, F.col("n"))), F.lit(0)).cast("double").alias("never"),
    )
    packed = by.groupBy(*keys, "s").agg(F.map_from_entries(F.collect_list(F.struct("t_k", "u"))).alias("m"), F.sum("found").alias("found"), F.sum("waits").alias("waits"), F.collect_list(F.struct("t_k", "never")).alias("left"))
    dense = F.transform(F.sequence(F.lit(1), F.col("s")), lambda t: F.coalesce(F.try_element_at("m", t.cast("int")), F.lit(0.0)))
    packed = packed.withColumn("u", dense).withColumn("const", -F.aggregate("u", F.lit(0.0), lambda acc, x: acc + lgamma(x + 1))).drop("m")
    spread = 2 * hist.sparkSession.sparkContext.defaultParallelism
    rows = packed.withColumn("cell", F.explode(grid() if cells is None else cells)).select("*", "cell.phi", "cell.p").drop("cell")
    fitted = deconvolve_entries(rows.repartition(spread, *keys, "phi", "p"))
    phi, p = F.col("phi"), F.col("p")
    never = F.aggregate("left", F.lit(0.0), lambda acc, x: acc + xlogy(x["never"], 1 - lambda_const(phi, p, F.col("s") - x["t_k"])))
    marks = F.col("const") + xlogy("found", phi * p) + xlogy("waits", phi * (1 - p)) + never
    return _profile(fitted, keys, marks, a, b)


def fit_grid(scored: DataFrame, keys) -> DataFrame:
    """Best cell and weighted mean and sd of phi, p and N per group.

    Weights are exp(loglik) relative to the group's best. The scored cells are settled, so
    that they are not scored again for the second of the two aggregations. The
    variance of N is the variance between cells plus the mean counting variance within
    them, N^2 / u for u first detections.
    """
    keys = list(keys)
    usable = settle(scored.drop("entries")).where(~F.isnan("loglik") & F.col("loglik").isNotNull())
    order = F.struct("loglik", "phi", "p")
    best = usable.groupBy(*keys).agg(F.max("loglik").alias("best_loglik"), F.max_by(F.struct("phi", "p", "nsuper"), order).alias("b"))
    w = F.exp(F.col("loglik") - F.col("best_loglik"))
    aggs = [F.sum(w).alias("w")]
    for c in ("phi", "p", "nsuper"):
        aggs += [F.sum(w * F.col(c)).alias(f"_{c}1"), F.sum(w * F.col(c) * F.col(c)).alias(f"_{c}2")]
    aggs.append(F.sum(w * F.coalesce(F.try_divide(F.col("nsuper") * F.col("nsuper"), "u_total"), F.lit(0.0))).alias("_within"))
    out = match(usable, best, keys).groupBy(*keys, "best_loglik", "b").agg(*aggs)
    res = [F.col("best_loglik")] + [F.col(f"b.{c}").alias(f"best_{c}") for c in ("phi", "p", "nsuper")]
    for c in ("phi", "p", "nsuper"):
        mean = F.col(f"_{c}1") / F.col("w")
        var = F.greatest(F.col(f"_{c}2") / F.col("w") - mean * mean, F.lit(0.0))
        if c == "nsuper":
            var = var + F.col("_within") / F.col("w")
        res += [mean.alias(f"mean_{c}"), F.sqrt(var).alias(f"sd_{c}")]
    return out.select(*keys, *res)


def weighted_quantiles(scored: DataFrame, keys, value: str, probs=(0.025, 0.5, 0.975)) -> DataFrame:
    """Quantiles of a grid quantity under the cell weights: smallest value reaching the share."""
    part = W.partitionBy(*keys)
    w = scored.withColumn("_w", F.exp(F.col("loglik") - F.max("loglik").over(part)))
    run = F.sum("_w").over(part.orderBy(value).rowsBetween(W.unboundedPreceding, 0)) / F.sum("_w").over(part)
    w = w.withColumn("_c", run)
    return w.groupBy(*keys).agg(*[F.min(F.when(F.col("_c") >= q - 1e-12, F.col(value))).alias(f"q{round(q * 1000)}") for q in probs])
