import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from resight.operators import summary as C
from resight.session import settle_lookup
from resight.sources.sheets import split_param


def draws(spark, values, chains=4):
    rows = [("a", i % chains, float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "param string, chain int, value double")


@pytest.mark.parametrize("kind", ["smooth", "ties", "tiny", "one"])
def test_quantiles_are_exact(spark, kind):
    rng = np.random.default_rng(4)
    x = {"smooth": rng.normal(0, 1, 60_001), "ties": rng.integers(0, 3, 5000).astype(float), "tiny": np.array([3.0, 1.0]), "one": np.array([5.0])}[kind]
    probs = (0.0, 0.025, 0.25, 0.5, 0.975, 1.0)
    # a coarse sketch, so that brackets are wide and the fallback is reached as well
    for accuracy in (20_000, 50):
        got = C.exact_quantiles(draws(spark, x).repartition(5), ["param"], "value", probs, accuracy).drop("param").first()
        assert list(got) == pytest.approx(np.quantile(x, probs).tolist(), abs=1e-12)


def test_half_of_all_rows_are_one_value(spark):
    x = np.concatenate([np.full(30_000, 2.5), np.random.default_rng(1).normal(2, 1, 30_000)])
    got = C.exact_quantiles(draws(spark, x), ["param"], "value", (0.1, 0.5, 0.9)).drop("param").first()
    assert list(got) == pytest.approx(np.quantile(x, (0.1, 0.5, 0.9)).tolist())


def test_diagnostics(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(10, 2, (4, 500))
    x[0] += 1.0
    got = C.chain_diagnostics(draws(spark, x.T.ravel()), ["param"]).first()
    w, b = x.var(axis=1, ddof=1).mean(), x.mean(axis=1).var(ddof=1)
    plus = 499 / 500 * w + b
    assert got.rhat == pytest.approx(np.sqrt(plus / w)) and got.n_eff == pytest.approx(min(2000, 4 * plus / b))
    assert got["mean"] == pytest.approx(x.mean()) and got.sd == pytest.approx(x.std(ddof=1))
    flat = C.chain_diagnostics(draws(spark, np.zeros(40)), ["param"]).first()
    assert (flat.rhat, flat.n_eff, flat.sd) == (1.0, 1.0, 0.0)


def test_mode(spark):
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(5, 0.5, 6000), rng.normal(9, 1.5, 4000)])
    df = draws(spark, x)
    assert C.draw_mode(df, ["param"]).first().mode == pytest.approx(5, abs=0.2)
    dens = C.draw_density(df, ["param"]).orderBy("x").collect()
    assert sum(r.y for r in dens) * (dens[1].x - dens[0].x) == pytest.approx(1, abs=0.01)
    # the binned sum agrees with the sum over all draws
    q3, q1 = np.quantile(x, (0.75, 0.25))
    bw = 0.9 * min(x.std(ddof=1), (q3 - q1) / 1.34) * len(x) ** -0.2
    at = dens[200]
    direct = np.exp(-0.5 * ((at.x - x) / bw) ** 2).sum() / (len(x) * bw * np.sqrt(2 * np.pi))
    assert at.y == pytest.approx(direct, rel=2e-3)
    assert C.draw_mode(draws(spark, np.full(10, 3.0)), ["param"]).first().mode == pytest.approx(3.0, abs=0.05)


def test_histogram_keeps_every_draw(spark):
    x = np.linspace(0, 1, 1001)
    h = C.draw_histogram(draws(spark, x), ["param"], bins=10)
    rows = {r.bin: r.n for r in h.collect()}
    assert set(rows) == set(range(1, 11)) and sum(rows.values()) == 1001


def test_normal_draws(spark):
    e = spark.createDataFrame([("a", 2.0, 0.1)], "param string, est double, se double")
    x = C.normal_draws(e, 4000, 1, ["param"])
    m, s = x.agg(F.avg("value"), F.stddev("value")).first()
    assert m == pytest.approx(2, abs=0.01) and s == pytest.approx(0.1, rel=0.05)
    y = C.normal_draws(e, 4000, 1, ["param"], "log").agg(F.avg("value")).first()[0]
    assert y == pytest.approx(np.exp(2.0), rel=0.01)


def test_compare_keeps_what_one_method_lacks(spark):
    a = spark.createDataFrame([(1, 0.1), (2, 0.2)], "t_k int, value double")
    b = spark.createDataFrame([(2, 0.3), (3, 0.4)], "t_k int, value double")
    rows = C.compare_methods({"a": a, "b": b}, ["t_k"], "v").collect()
    assert len(rows) == 6 and sum(r.value is not None for r in rows) == 4


def test_param_names(spark):
    df = spark.createDataFrame([("lambda[12]",), ("phi",)], "param string")
    assert [(r.name, r.idx) for r in split_param(df).collect()] == [("lambda", 12), ("phi", None)]


def test_lookup_is_broadcast_only_when_small(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        big = spark.range(1000)
        small = settle_lookup(spark.range(10))
        large = settle_lookup(spark.range(1000), max_rows=100)
        plan = lambda df: df._jdf.queryExecution().sparkPlan().toString()
        assert "BroadcastHashJoin" in plan(big.join(small, "id"))
        assert "Broadcast" not in plan(big.join(large, "id")) and big.join(large, "id").count() == 1000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_missing_keys_stay(spark):
    """A scalar parameter has no index; its rows are summarised like any other."""
    rows = [("phi", None, i % 2, float(i)) for i in range(50)] + [("lambda", 1, i % 2, float(-i)) for i in range(50)]
    df = spark.createDataFrame(rows, "param string, idx int, chain int, value double")
    got = {r.param: r for r in C.summarize_draws(df, ["param", "idx"]).collect()}
    assert got["phi"].q50 == 24.5 and got["phi"].idx is None and got["lambda"].q50 == -24.5
    assert C.draw_mode(df, ["param", "idx"]).count() == 2
    assert C.draw_histogram(df, ["param", "idx"]).agg(F.sum("n")).first()[0] == 100
    a = df.groupBy("param", "idx").agg(F.avg("value").alias("value"))
    assert C.compare_methods({"a": a, "b": a}, ["param", "idx"], "m").count() == 4


def test_brackets_are_narrowed_before_anything_is_ordered(spark, monkeypatch):
    """With a coarse sketch the brackets hold thousands of values; after the narrowing passes no group orders more than a few hundred."""
    n = 60_000
    draws = spark.range(n).select(F.lit(1).alias("k"), F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.exp(F.col("id") / 5000.0)).alias("value"))
    draws = draws.union(spark.createDataFrame([(2, 1.0), (2, 2.0), (3, None), (4, 5.0)], "k int, value double"))
    cut = []
    inner = C._narrowed
    monkeypatch.setattr(C, "_narrowed", lambda rows, brackets, keys: cut.append(brackets.collect()) or inner(rows, brackets, keys))
    probs = (0.0, 0.025, 0.5, 0.51, 0.975, 1.0)
    got = {r.k: r for r in C.exact_quantiles(draws, ["k"], "value", probs, accuracy=100, limit=64).collect()}
    values = np.sort([7.0 if i % 3 == 0 else math.exp(i / 5000.0) for i in range(n)])
    for q, name in zip(probs, ("q0", "q2_5", "q50", "q51", "q97_5", "q100")):
        assert got[1][name] == pytest.approx(np.quantile(values, q), rel=1e-12)
    assert got[2]["q50"] == 1.5 and got[4]["q97_5"] == 5.0 and 3 not in {k for k, r in got.items() if r.q50 is not None}
    assert len(cut) == 2
    whole = inner(draws.select("k", F.col("value").alias("x")).where("x is not null"), spark.createDataFrame(cut[-1], spark.createDataFrame(cut[-1]).schema), ["k"]).where("k = 1").first()
    inside = [int(((values >= a.lo) & (values <= a.hi) & (values != 7.0)).sum()) for a in whole.asked]
    assert max(inside) <= 64
