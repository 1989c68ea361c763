import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from resight.functions import calendar as K, draws as D, mathx as X


def column(spark, expr, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_lgamma(spark):
    xs = [1e-6, 0.01, 0.5, 1.0, 1.5, 2.0, 7.99, 8.0, 8.01, 30.0, 1e3, 1e7, 1e12]
    got = column(spark, X.lgamma("x"), [(x,) for x in xs], "x double")
    for x, g in zip(xs, got):
        assert g == pytest.approx(math.lgamma(x), rel=1e-13, abs=2e-14)


def test_log_densities_at_the_edges(spark):
    rows = [(0.0, 5.0, 0.0), (5.0, 5.0, 1.0), (2.0, 5.0, 0.0), (6.0, 5.0, 0.5), (0.0, 0.0, 0.3)]
    got = column(spark, X.log_binom("k", "n", F.col("p")), rows, "k double, n double, p double")
    assert got == pytest.approx([0.0, 0.0, -math.inf, -math.inf, 0.0], abs=1e-12)
    assert column(spark, X.log_pois("k", F.col("m")), [(0.0, 0.0), (1.0, 0.0)], "k double, m double") == pytest.approx([0.0, -math.inf], abs=1e-12)


def test_logit_round_trip(spark):
    got = column(spark, X.expit(X.logit("x")), [(0.001,), (0.5,), (0.999,)], "x double")
    assert got == pytest.approx([0.001, 0.5, 0.999])


def test_weeks(spark):
    days = [dt.date(2019, 12, 25) + dt.timedelta(days=i) for i in range(800)]
    rows = spark.createDataFrame([(d,) for d in days], "d date").select("d", K.week_sunday("d"), K.week_block("d")).collect()
    for d, sunday, block in rows:
        assert sunday == int(d.strftime("%U"))
        assert block == (d.timetuple().tm_yday - 1) // 7 + 1


def test_dates(spark):
    text = ["5-Oct-13", "05-Oct-2013", "5/10/2013", "31-Dec-99", "1-Jan-68", "1-Jan-69", "", "soon", None, " 7-Nov-14 ", "31-Feb-14", "5 Oct 2013"]
    got = column(spark, K.parse_date("t"), [(t,) for t in text], "t string")
    d = dt.date
    assert got == [d(2013, 10, 5), d(2013, 10, 5), d(2013, 10, 5), d(1999, 12, 31), d(2068, 1, 1), d(1969, 1, 1), None, None, None, d(2014, 11, 7), None, d(2013, 10, 5)]
    assert column(spark, K.parse_date("t", "mdy"), [("10/5/2013",)], "t string") == [d(2013, 10, 5)]


def test_rollover(spark):
    assert column(spark, K.week_rollover("w"), [(19,), (20,), (None,)], "w int") == [71, 20, None]


def test_draws_do_not_depend_on_partitioning(spark):
    df = spark.range(5000).select("id", D.uniform(7, "id").alias("u"), D.standard_normal(7, "id").alias("z"))
    a = df.repartition(1).orderBy("id").collect()
    b = df.repartition(13).orderBy("id").collect()
    assert a == b
    u, z = [r.u for r in a], [r.z for r in a]
    assert 0 <= min(u) and max(u) < 1 and sum(u) / len(u) == pytest.approx(0.5, abs=0.02)
    assert sum(z) / len(z) == pytest.approx(0, abs=0.05) and sum(x * x for x in z) / len(z) == pytest.approx(1, abs=0.06)


def test_pick_follows_the_weights(spark):
    df = spark.range(20000).select(D.pick(D.uniform(1, "id"), [("a", F.lit(1.0)), ("b", F.lit(3.0)), ("c", F.lit(0.0))]).alias("x"))
    n = {r.x: r["count"] for r in df.groupBy("x").count().collect()}
    assert set(n) == {"a", "b"} and n["a"] / 20000 == pytest.approx(0.25, abs=0.02)
    none = spark.range(1).select(D.pick(F.lit(0.5), [("a", F.lit(0.0)), ("b", F.lit(None).cast("double"))]).alias("x"))
    assert none.first().x is None


def test_job_folder_goes_with_the_job(spark):
    import os

    from resight.session import job, settle

    with job(spark) as outer:
        kept = settle(spark.range(5))
        with job(spark) as inner:
            assert inner.startswith(outer) and settle(spark.range(3)).count() == 3
        assert kept.count() == 5 and os.path.isdir(outer) and not os.path.exists(inner)
    assert not os.path.exists(outer)
