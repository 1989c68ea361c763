"""Every registered query against its SQL counterpart on the smallest tables."""

import pytest

import __spark_entry__ as entry
from oracle import compare, connect

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, con, name):
    df = QUERIES[name](spark, small)
    if name in SQL:
        result = compare(df, con, SQL[name])
        assert result is None or result.startswith("ok"), result
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    else:
        assert df.count() > 0


def test_sql_has_no_stray_names():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark, small):
    df = entry.entry(spark)
    assert df.columns == ["t_yr", "grp", "t_k", "obs_v", "obs_tau", "obs_lambda", "obs_multP"]
    assert df.count() > 0


def test_one_user_with_a_third_of_all_events(spark, small, tmp_path):
    """Captures and statistics stay right when one user dominates."""
    from pyspark.sql import functions as F

    import duckdb

    e = spark.read.parquet(f"{small}/events.parquet")
    e.withColumn("user_id", F.when(F.col("event_id") % 3 == 0, 1).otherwise(F.col("user_id")).cast("long")).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    for name in ("histories", "js_from_histories", "exact_quantiles"):
        assert compare(QUERIES[name](spark, str(tmp_path)), con, SQL[name]) is None


def test_events_are_passed_over_once(spark, small, monkeypatch):
    """A query counts the events once, whatever it builds from them, and no event is shuffled by its own id."""
    from resight import session

    asked, keep = [], session._settled

    def seen(df):
        out = keep(df)
        asked.append((df._jdf.queryExecution().executedPlan().toString(), out[1]))
        return out

    monkeypatch.setattr(session, "_settled", seen)
    QUERIES["compare_methods"](spark, small)
    events = [path for plan, path in asked if "events.parquet" in plan]
    # asked for often, written once: the counts that a next sighting moves, and the counts themselves
    assert len(events) > 2 and len(set(events)) == 2
    assert not any("hashpartitioning(event_id" in plan for plan, _ in asked)


def test_reuse_ends_with_its_job(spark, tmp_path):
    from resight import session

    one = spark.range(5).withColumnRenamed("id", "a")
    with session.reuse():
        first, again = session._settled(one)[1], session._settled(spark.range(5).withColumnRenamed("id", "a"))[1]
        other = session._settled(spark.range(5).withColumnRenamed("id", "b"))
        with session.reuse():
            assert session._settled(one)[1] == first
    assert first == again and other[1] != first and other[0].columns == ["b"]
    with session.reuse():
        assert session._settled(one)[1] != first
    assert session._settled(one)[1] != session._settled(one)[1]
