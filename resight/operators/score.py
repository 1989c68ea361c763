"""Likelihood terms summed over counted tables, for many parameter sets at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from resight.functions.mathx import (
    NEG_INF, lgamma, log_beta, log_binom, log_choose, log_norm, log_pois, xlogy,
)
from resight.operators.joins import match
from resight.session import settle_lookup


def _split(k, n, p):
    """The part of a binomial log density which depends on p."""
    return xlogy(k, p) + xlogy(F.col(n) - F.col(k), 1 - p)


def score_js(stats: DataFrame, quantities: DataFrame, group, sets, total: str = "poisson", a: float = 0.5, b: float = 0.5) -> DataFrame:
    """Log likelihood and prior of every set given its group's per-period statistics.

    ``quantities`` is the output of ``js_quantities`` with v and nsuper kept; it meets the
    statistics, a checked lookup, on (group, t_k), so the sets are shuffled once, by set. Terms free of parameters are computed once per statistic
    before the join; the sum per set is partially aggregated where the set's periods lie.
    """
    group, sets = list(group), list(sets)
    base = stats.withColumns(
        {
            "_c_mark": log_choose("seen", "marked"),
            "_c_later": log_choose("marked", "recap_later"),
            "_c_now": log_choose("at_risk", "recap_now"),
            "_c_u": -lgamma(F.col("first_seen") + 1),
        }
    )
    j = match(quantities, settle_lookup(base), [*group, "t_k"])
    t, s = F.col("t_k"), F.col("s")
    inner, known = (t >= 2) & (t < s), t < s
    off = (F.col("marked") > F.col("seen")) | (F.col("recap_later") > F.col("marked")) | (inner & (F.col("recap_now") > F.col("at_risk")))
    terms = {
        "mark": F.when(known, F.col("_c_mark") + _split("marked", "seen", F.col("v"))).otherwise(0.0),
        "later": F.when(known, F.col("_c_later") + _split("recap_later", "marked", F.col("lambda"))).otherwise(0.0),
        "now": F.when(inner, F.col("_c_now") + _split("recap_now", "at_risk", F.col("tau"))).otherwise(0.0),
        "cells": F.col("_c_u") + xlogy("first_seen", F.col("multP")),
    }
    summed = j.groupBy(*group, *sets).agg(
        *[F.sum(F.when(off, F.lit(NEG_INF)).otherwise(c)).alias(n) for n, c in terms.items()],
        F.sum("first_seen").alias("uTot"),
        *[F.first(c).alias(c) for c in ("psiPtot", "nsuper", "phi", "p")],
    )
    if total == "binomial":
        size = log_binom("uTot", F.bround("nsuper", 0), F.col("psiPtot"))
    else:
        size = log_pois("uTot", F.col("nsuper") * F.col("psiPtot"))
    out = summed.withColumns(
        {"cells": F.col("cells") + lgamma(F.col("uTot") + 1), "size": size, "prior": log_beta("phi", a, b) + log_beta("p", a, b)}
    )
    parts = ["mark", "later", "now", "cells", "size", "prior"]
    return out.withColumn("loglik", sum((F.col(c) for c in parts[1:]), F.col(parts[0]))).select(*group, *sets, *parts, "loglik")


def score_histories(hist: DataFrame, quantities: DataFrame, group, sets) -> DataFrame:
    """Per counted history: marked or not, and recaptured later or not; times its count."""
    h = hist.groupBy(*group, "t_k", "tag", F.col("r_k").isNotNull().alias("again")).agg(F.sum("n").alias("n"))
    j = match(quantities, settle_lookup(h), [*group, "t_k"])
    later = F.when(F.col("again"), xlogy("n", F.col("lambda"))).otherwise(xlogy("n", 1 - F.col("lambda")))
    term = F.when(F.col("tag"), xlogy("n", F.col("v")) + later).otherwise(xlogy("n", 1 - F.col("v")))
    return j.groupBy(*group, *sets).agg(F.sum(term).alias("loglik"))


def score_counts(df: DataFrame, keys, obs: str, exp: str, kind: str = "poisson", size: str | None = None, x_offset: float = 0, mu_offset: float = 0, nonzero_only: bool = False) -> DataFrame:
    """Sum of Poisson terms of counts, or binomial ones where ``size`` is the number of trials."""
    rows = df.where(F.col(obs) > 0) if nonzero_only else df
    term = count_term(obs, exp, kind, size, x_offset, mu_offset)
    return rows.groupBy(*keys).agg(F.sum(term).alias("loglik"), F.count(F.lit(1)).alias("n_cells"))


def count_term(obs: str, exp: str, kind: str = "poisson", size: str | None = None, x_offset: float = 0, mu_offset: float = 0, nonzero_only: bool = False):
    """One cell's log density, as a column; null where ``nonzero_only`` leaves the cell out."""
    if kind == "binomial":
        term = log_binom(obs, size, F.col(exp))
    else:
        term = log_pois(F.col(obs) + x_offset, F.col(exp) + mu_offset)
    return F.when(F.col(obs) > 0, term) if nonzero_only else term


def score_count_terms(df: DataFrame, keys, terms: dict) -> DataFrame:
    """Several such sums in one pass; ``terms`` maps a name to the arguments of ``count_term``."""
    return df.groupBy(*keys).agg(*[F.coalesce(F.sum(count_term(**kw)), F.lit(0.0)).alias(name) for name, kw in terms.items()])


def score_cjs(hist: DataFrame, keys, prob: str = "prob") -> DataFrame:
    """Sum of n log P over tagged histories."""
    return hist.where("tag").groupBy(*keys).agg(F.sum(xlogy("n", F.col(prob))).alias("loglik"))


def expected_by_history(hist: DataFrame, keys=("t_yr",), prob: str = "prob") -> DataFrame:
    """Observed and predicted recaptures by capture period and both locations, tagged rows.

    A history's prediction is its probability times all individuals captured with it.
    """
    total = F.sum("n").over(W.partitionBy(*keys, "t_k", "t_l", "tag"))
    rows = hist.withColumn("pred", F.col(prob) * total).where("tag")
    return rows.groupBy(*keys, "t_k", "t_l", "r_l").agg(F.sum("n").alias("obs"), F.sum("pred").alias("pred"))


def beta_posterior(stats: DataFrame, a: float = 0.5, b: float = 0.5) -> DataFrame:
    """Exact posterior of the mark rate: Beta(a + R, b + n - R)."""
    x, y = F.col("marked") + a, F.col("seen") - F.col("marked") + b
    return stats.withColumns({"v_mean": x / (x + y), "v_sd": F.sqrt(x * y / ((x + y) * (x + y) * (x + y + 1)))})


def score_penalties(devs: DataFrame, sigma: DataFrame, keys, bias: bool = False) -> DataFrame:
    """Sum of normal log densities of deviations, by kind; ``bias`` centres at -sigma^2/2."""
    j = devs.join(settle_lookup(sigma), "kind")
    mean = -0.5 * F.col("sigma") * F.col("sigma") if bias else F.lit(0.0)
    return j.groupBy(*keys, "kind").agg(F.sum(log_norm("dev", mean, F.col("sigma"))).alias("logpen"))


def score_arrivals(hist: DataFrame, shares: DataFrame, keys, sets=()) -> DataFrame:
    """-sum n log r[t_k], where r are arrival shares by period."""
    u = hist.groupBy(*keys, "t_k").agg(F.sum("n").alias("n"))
    return match(shares, settle_lookup(u), [*keys, "t_k"]).groupBy(*keys, *sets).agg((-F.sum(xlogy("n", F.col("r")))).alias("nll"))


def score_biodata(counts: DataFrame, shares: DataFrame, keys, sets=()) -> DataFrame:
    """Log likelihood of class counts (keys, kind, cls, n) under class shares (sets, kind, cls, share), by keys, kind and set.

    Two classes make a binomial, more a multinomial. What does not depend on the shares is summed once for each key. A
    class that was counted but has no share makes its kind impossible.
    """
    keys, sets = list(keys), list(sets)
    fixed = counts.groupBy(*keys, "kind").agg((lgamma(F.sum("n") + 1) - F.sum(lgamma(F.col("n") + 1))).alias("_const"), F.sum("n").alias("_total"))
    known = settle_lookup(match(counts, fixed, [*keys, "kind"]))
    met = match(shares, known, ["kind", "cls"]).groupBy(*keys, "kind", *sets).agg(
        F.sum(xlogy("n", F.col("share"))).alias("_logs"), F.sum("n").alias("_met"), F.first("_const").alias("_const"), F.first("_total").alias("_total")
    )
    loglik = F.when(F.col("_met") < F.col("_total"), F.lit(NEG_INF)).otherwise(F.col("_const") + F.col("_logs"))
    return met.select(*keys, "kind", *sets, loglik.alias("loglik"))
