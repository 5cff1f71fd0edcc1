"""Streams over files that arrive one by one, against the same work over the whole table."""

import os
import shutil
from datetime import datetime, timedelta

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidemark import Agg, ContinuousQuery, WindowSpec
from tidemark.operators import windows
from tidemark.plans import stream_queries
from tidemark.plans.inputs import as_observations
from tidemark.session import fresh_folder, shared_folder
from tidemark.sinks.publish import bucketed, publish_batches
from tidemark.sinks.results import result_events
from tidemark.sources.event_log import EVENT_SCHEMA
from tidemark.streaming import handover, live, publish, shared

HOUR = 3_600_000
SPEC = WindowSpec(6 * HOUR, HOUR)
AGGS = [Agg("max", "value", "max_value")]
END = "2100-01-01 00:00:00"


@pytest.fixture(scope="module")
def arrivals(spark, sf_dir, tmp_path_factory):
    """The events in six files, in order of time; a file's age tells when it arrived."""
    folder = tmp_path_factory.mktemp("arrivals")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    for i in range(6):
        part = tmp_path_factory.mktemp("part") / "p"
        low, high = 5 * i, 5 * i + 5
        day = F.dayofmonth("ts") - 1
        events.where((day >= low) & (day < high)).coalesce(1).write.parquet(str(part))
        source = next(p for p in os.listdir(part) if p.endswith(".parquet"))
        shutil.copy(part / source, folder / f"{i}.parquet")
        os.utime(folder / f"{i}.parquet", (1_700_000_000 + i * 60,) * 2)
    return str(folder)


@pytest.fixture(scope="module")
def table(spark, sf_dir):
    return as_observations(spark.read.parquet(f"{sf_dir}/events.parquet"))


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()))


def run(spark, arrivals, build, step=live.drain):
    def whole(closing):
        source = live.live_source(spark, arrivals, EVENT_SCHEMA, max_files_per_trigger=1)
        return build(as_observations(live.with_watermark(source.unionByName(closing), "2 hours")))

    folder = fresh_folder(spark, "test-stream")
    return live.run_to_end(spark, whole, folder, EVENT_SCHEMA, "ts", F.to_timestamp(F.lit(END)), step)


def bounds(df):
    cast = [F.col(f"window.{c}").cast("timestamp_ntz").alias(f"w_{c}") for c in ("start", "end")]
    return df.select(*cast, *[c for c in df.columns if c not in ("window", "batch_id")])


def test_live_windows_equal_batch(spark, arrivals, table):
    path = run(spark, arrivals, lambda obs: live.live_window(obs, SPEC, AGGS, by=["property"]))
    got = bounds(spark.read.parquet(path).where("property IS NOT NULL"))
    want = windows.flat(windows.windowed(table, SPEC, AGGS, ["property"]))
    assert rows(got, "w_start", "w_end", "property", "max_value") == rows(want, "w_start", "w_end", "property", "max_value")


@pytest.mark.parametrize("width, slide", [(6 * HOUR, HOUR // 6), (6 * HOUR + 90_000, HOUR // 6)])
def test_live_panes_equal_batch(spark, arrivals, table, width, slide):
    spec = WindowSpec(width, slide)
    aggs = [*AGGS, Agg("min", "value", "low"), Agg("avg", "value", "mean", exact=2), Agg("count", "*", "n"), Agg("sum", "value", "total", exact=2)]
    path = run(spark, arrivals, lambda obs: live.live_window(obs, spec, aggs, by=["property"]))
    got = bounds(spark.read.parquet(path).where("property IS NOT NULL"))
    want = windows.flat(windows.windowed(table, spec, aggs, ["property"], panes=False))
    names = ["w_start", "w_end", "property", *[a.out for a in aggs]]
    assert want.count() > 1000 and rows(got, *names) == rows(want, *names)


def test_plan_of_live_panes_does_not_grow_with_the_overlap(spark, arrivals):
    def plan(slide):
        source = as_observations(live.with_watermark(live.live_source(spark, arrivals, EVENT_SCHEMA), "2 hours"))
        found = live.live_window(source, WindowSpec(6 * HOUR, slide), AGGS, by=["property"])
        return found._jdf.queryExecution().analyzed().toString()

    assert abs(len(plan(20_000)) - len(plan(HOUR // 6))) < 200


@pytest.mark.parametrize("mode", ["IStream", "DStream"])
def test_two_stage_r2s_equals_batch(spark, arrivals, table, mode):
    path = run(
        spark, arrivals, lambda obs: live.live_window(obs, SPEC, AGGS, by=["property"]),
        lambda results, folder: publish.r2s_stream(results, folder, SPEC, mode),
    )
    got = bounds(spark.read.parquet(path).where("property IS NOT NULL"))
    want = windows.flat(windows.r2s(windows.windowed(table, SPEC, AGGS, ["property"]), SPEC, mode))
    assert rows(got, "w_start", "property", "max_value") == rows(want, "w_start", "property", "max_value")


def _events(rows_):
    return result_events(
        rows_, ["max_value"], F.md5(F.concat_ws("|", "stream", "property")), F.array("stream"), ["stream", "property"]
    )


def test_published_batches_equal_batch(spark, arrivals, table):
    def build(obs):
        found = live.live_window(obs, SPEC, AGGS, by=["stream", "property"])
        cast = [F.col(f"window.{c}").cast("timestamp_ntz").alias(c) for c in ("start", "end")]
        return _events(found.withColumn("window", F.struct(*cast)))

    path = run(spark, arrivals, build, publish.publish_stream)
    got = spark.read.parquet(path)
    assert got.select("batch_id").distinct().count() > 3
    want = bucketed(publish_batches(_events(windows.windowed(table, SPEC, AGGS, ["stream", "property"]))))
    assert rows(got, "event_id", "bucket_ts") == rows(want, "event_id", "bucket_ts")


def _publishing(folder):
    """Runs, and returns the folders of micro-batches by name."""
    return {name: sorted(d for d in os.listdir(os.path.join(folder, name)) if "=" in d) for name in ("arrived", "buckets", "pending", "pointers", "commits")}


def test_publishing_commits_and_forgets(spark, arrivals, table):
    def build(obs):
        found = live.live_window(obs, SPEC, AGGS, by=["stream", "property"])
        cast = [F.col(f"window.{c}").cast("timestamp_ntz").alias(c) for c in ("start", "end")]
        return _events(found.withColumn("window", F.struct(*cast)))

    buckets = run(spark, arrivals, build, publish.publish_stream)
    folder = buckets.removesuffix("/buckets")
    want = bucketed(publish_batches(_events(windows.windowed(table, SPEC, AGGS, ["stream", "property"]))))
    got = publish.committed(spark, folder)
    assert rows(got, "event_id", "bucket_ts") == rows(want, "event_id", "bucket_ts")
    pointed = want.groupBy("query_hash").agg(F.max("bucket_ts").alias("bucket_ts"))
    assert rows(publish.latest_pointers(spark, folder), "query_hash", "bucket_ts") == rows(pointed, "query_hash", "bucket_ts")
    parts = _publishing(folder.removeprefix("file:"))
    assert len(parts["commits"]) == len(parts["buckets"]) > 3 and not parts["arrived"] and len(parts["pending"]) <= 2
    # A part that was written but not committed is not read.
    got.limit(3).drop("batch_id").write.parquet(f"{buckets}/batch_id=999")
    assert publish.committed(spark, folder).count() == want.count()


def test_replay_goes_over_into_the_tail_and_on_after_a_stop(spark, arrivals, table, tmp_path):
    at = F.lit("2024-01-12 00:00:00").cast("timestamp_ntz")
    history, folder = table.where(F.col("ts") <= at), fresh_folder(spark, "test-handover")
    # A replay that was stopped before its mark: written anew.
    history.limit(5).write.parquet(f"{folder}/replayed")

    def arrive(*files):
        for i in files:
            shutil.copy(f"{arrivals}/{i}.parquet", tmp_path / f"{i}.parquet")
        source = as_observations(live.live_source(spark, str(tmp_path), EVENT_SCHEMA, max_files_per_trigger=1))
        # By the second run the log has grown; the replay stays what it was.
        log = history if 3 not in files else table
        return handover.replay_then_tail(log, source.unionByName(source), folder, 72 * HOUR, at, "40 days")

    day = F.dayofmonth("ts") - 1
    replayed = table.where((F.col("ts") <= at) & (F.col("ts") >= at - F.expr("INTERVAL 72 HOURS")))
    for files, upto in ([(1, 2), 15], [(3, 4, 5), 31]):
        got = arrive(*files)
        tail = table.where((day >= 5) & (day < upto)).join(replayed, "member_id", "left_anti")
        assert rows(got.where("phase = 'historical'"), "member_id", "ts") == rows(replayed, "member_id", "ts")
        assert rows(got.where("phase = 'live'"), "member_id", "ts") == rows(tail, "member_id", "ts")


def test_shared_queries_equal_single_ones(spark, arrivals, table):
    queries = {
        "a": ContinuousQuery((Agg("max", "value", "top"),), (SPEC,), group_by=("property",)),
        "b": ContinuousQuery((Agg("max", "value", "peak"), Agg("min", "value", "low")), (SPEC,), group_by=("property",)),
        "c": ContinuousQuery((Agg("count", "value", "n"),), (WindowSpec(HOUR, HOUR),)),
    }
    got = rows(shared.run_shared(table, queries), "query_hash", "window.start", "group", "var", "value")
    for name, q in queries.items():
        single = windows.windowed(table, q.windows[0], q.aggregates, q.group_by)
        for agg in q.aggregates:
            group = F.concat_ws("|", *q.group_by)
            want = rows(single, F.lit(name), "window.start", group, F.lit(agg.out), F.col(agg.out).cast("double"))
            assert [r for r in got if r[0] == name and r[3] == agg.out] == want
    # Two aggregations for three queries.
    plan = shared.run_shared(table, queries)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Union") == 1

    path = run(spark, arrivals, lambda obs: shared.run_shared(obs, queries, lambda o, s, a, by: live.live_window(o, s, a, by=by)))
    stored = spark.read.parquet(path).where("window.end < timestamp'2099-01-01'")
    streamed = rows(stored, "query_hash", F.col("window.start").cast("timestamp_ntz"), "group", "var", "value")
    assert streamed == got


def test_a_member_that_comes_three_times_counts_once(spark, arrivals, table):
    source = live.live_source(spark, arrivals, EVENT_SCHEMA)
    thrice = as_observations(live.with_watermark(source.unionByName(source).unionByName(source), "40 days"))
    path = live.drain(live.dedup_stream(thrice).select("member_id"), fresh_folder(spark, "test-dedup"))
    assert spark.read.parquet(path).count() == table.count()


def test_running_again_adds_nothing(spark, arrivals):
    folder = fresh_folder(spark, "test-again")
    source = live.live_source(spark, arrivals, EVENT_SCHEMA)
    first = spark.read.parquet(live.drain(source, folder)).count()
    assert spark.read.parquet(live.drain(source, folder)).count() == first


def test_distinct_aggregates_are_refused_on_streams(spark, arrivals):
    source = live.live_source(spark, arrivals, EVENT_SCHEMA)
    with pytest.raises(ValueError):
        live.live_window(source, SPEC, [Agg("count", "value", distinct=True)], "1 hour")


def test_folder_setting_comes_from_the_session(spark):
    before = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_folder(spark) == (before or spark.sparkContext.getCheckpointDir()).rstrip("/")


@pytest.fixture(scope="module")
def backwards(tmp_path_factory):
    """One event in each of 40 files that span 13 months, the latest first; two triggers read them."""
    folder = tmp_path_factory.mktemp("backwards")
    (folder / "events.parquet").mkdir()
    for i in range(40):
        at = datetime(2024, 2, 1) - timedelta(days=10 * i)
        kinds = [("event_id", pa.int64(), i), ("ts", pa.timestamp("us"), at), ("user_id", pa.int64(), i), ("event_type", pa.string(), "view"),
                 ("value", pa.float64(), 1.0), ("props", pa.string(), "{}")]
        path = folder / "events.parquet" / f"{i}.parquet"
        pq.write_table(pa.table({name: pa.array([value], kind) for name, kind, value in kinds}), path)
        os.utime(path, (1_700_000_000 + i * 60,) * 2)
    return folder


def test_named_streams_lose_nothing_however_long_the_table(spark, backwards):
    assert stream_queries.watermark(spark, str(backwards)).agg(F.sum("n")).first()[0] == 40
    assert stream_queries.dedup_stream(spark, str(backwards)).count() == 40


def test_late_rows_raise(spark, backwards):
    with pytest.raises(RuntimeError, match="after the watermark"):
        run(spark, str(backwards / "events.parquet"), lambda obs: live.live_window(obs, SPEC, AGGS, by=["property"]))
