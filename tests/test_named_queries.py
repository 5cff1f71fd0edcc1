"""Every named query against its SQL twin, and what their plans must and must not hold."""

import pytest

import __spark_entry__ as entry
from compare import connect, difference
from tidemark.plans.named import QUERIES, SQL

# At the smallest scale a day's bucket holds too few members to overflow.
TWIN_DIR = "/root/testdata/sf0.01"
STREAMING = [n for n in QUERIES if n.startswith("sm") or n in ("src6_live_source", "src8_replay_then_tail")]


@pytest.fixture(scope="module")
def twin():
    return connect(TWIN_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_same_as_twin(spark, twin, name):
    ours = QUERIES[name](spark, TWIN_DIR).toPandas()
    assert len(ours) > 0
    assert difference(ours, twin.execute(SQL[name]).df()) is None


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["w_start", "w_end", "max_value"]
    assert rows.count() > 0


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in STREAMING])
def test_plan_has_no_pairing_and_no_python(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    for banned in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython", "MapInPandas"):
        assert banned not in plan


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_flagship_reads_two_columns_and_pushes_its_filter(spark, sf_dir):
    plan = _plan(QUERIES["flagship_max_rstream"](spark, sf_dir))
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string,value:double>" in plan
    assert "user_id" not in plan


def test_time_range_reaches_the_scan(spark, sf_dir):
    plan = _plan(QUERIES["flt3_time_range"](spark, sf_dir))
    assert "GreaterThanOrEqual(ts," in plan and "LessThanOrEqual(ts," in plan


def test_buckets_that_a_range_misses_are_not_opened(spark, sf_dir):
    found = QUERIES["src2_open_buckets"](spark, sf_dir)
    plan = _plan(found)
    assert "dynamicpruningexpression(bucket" in plan and "dynamicpruningexpression(true)" not in plan


def test_short_index_leaves_members_where_they_are(spark, sf_dir):
    plan = _plan(QUERIES["jn3_assign_bucket"](spark, sf_dir))
    assert "BroadcastHashJoin" in plan
    long_plan = _plan(QUERIES["jn3_assign_bucket_long_index"](spark, sf_dir))
    assert "BroadcastExchange" not in long_plan.split("Window")[0]
