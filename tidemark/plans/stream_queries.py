"""Named queries that run Structured Streaming to the end of its input."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.model import Agg, ContinuousQuery, WindowSpec
from tidemark.operators.windows import union_streams
from tidemark.plans.inputs import (
    AVG2, DAILY, HOUR, LIVE_EVENTS, SIX_HOURLY, as_observations, sql, table, windows_sql,
)
from tidemark.plans.named import named
from tidemark.session import fresh_folder
from tidemark.sinks.results import result_events
from tidemark.sources.event_log import EVENT_SCHEMA
from tidemark.streaming import live, publish, shared

# The whole table is replayed as a stream, in whatever order its files come, so the allowed
# delay spans all of it. A live deployment sets the delay that its sources need.
END = "2100-01-01 00:00:00"


def _bounds_of(spark, sf_dir):
    """Seconds between the first and the last event, one more, and the last event's time."""
    ts = F.col("ts").cast("timestamp")
    b = table(spark, sf_dir, "events").agg(F.min(F.unix_seconds(ts)).alias("lo"), F.max(F.unix_seconds(ts)).alias("hi")).first()
    return (b["hi"] - b["lo"] + 2, b["hi"]) if b["lo"] is not None else (1, 0)


def _live(spark, sf_dir, delay, closing=None):
    events = live.live_source(spark, LIVE_EVENTS.format(sf_dir), EVENT_SCHEMA)
    if closing is not None:
        events = events.unionByName(closing)
    return live.with_watermark(events, f"{delay} seconds")


def _run(spark, sf_dir, purpose, build, run=live.drain):
    """`build` turns live observations into a streaming result. Rows of the closing events
    have no property, and are left out by the caller."""
    delay, last = _bounds_of(spark, sf_dir)
    folder = fresh_folder(spark, purpose)

    def whole(closing):
        return build(as_observations(_live(spark, sf_dir, delay, closing)))

    end = F.greatest(F.to_timestamp(F.lit(END)), F.timestamp_seconds(F.lit(last))) + F.make_dt_interval(secs=F.lit(delay))
    return live.run_to_end(spark, whole, folder, EVENT_SCHEMA, "ts", end, run, apart=10 + delay // (365 * 86_400))


def _bounds(rows, *rest):
    start, end = (F.col(f"window.{c}").cast("timestamp_ntz") for c in ("start", "end"))
    return rows.select(start.alias("w_start"), end.alias("w_end"), *rest)


@named("sm1_live_window", sql("win6h", body=f"""
SELECT w_start, w_end, property, max(value) AS max_value, {AVG2} AS avg_value FROM win6h GROUP BY ALL"""))
def live_window(spark, sf_dir):
    aggs = [Agg("max", "value", "max_value"), Agg("avg", "value", "avg_value", exact=2)]
    path = _run(spark, sf_dir, "live-window", lambda obs: live.live_window(obs, SIX_HOURLY, aggs, by=["property"]))
    rows = spark.read.parquet(path).where(F.col("property").isNotNull())
    return _bounds(rows, "property", "max_value", "avg_value")


# 1,080 windows overlap.
@named("sm1_live_window_20s", sql("obs", body=f"""
SELECT w_start, w_end, max(value) AS max_value, {AVG2} AS avg_value, count(value) AS n
FROM ({windows_sql('obs', 'INTERVAL 6 HOUR', 'INTERVAL 20 SECOND', 1080)}) GROUP BY ALL"""))
def live_window_20s(spark, sf_dir):
    aggs = [Agg("max", "value", "max_value"), Agg("avg", "value", "avg_value", exact=2), Agg("count", "value", "n")]
    path = _run(spark, sf_dir, "live-window-20s", lambda obs: live.live_window(obs, WindowSpec(6 * HOUR, 20_000), aggs))
    return _bounds(spark.read.parquet(path).where("n > 0"), "max_value", "avg_value", "n")


@named("sm2_watermark", sql("win1d", body="SELECT w_start, w_end, count(value) AS n FROM win1d GROUP BY ALL"))
def watermark(spark, sf_dir):
    path = _run(spark, sf_dir, "watermark", lambda obs: live.live_window(obs, DAILY, [Agg("count", "value", "n")]))
    rows = spark.read.parquet(path).where(F.col("n") > 0)
    return _bounds(rows, "n")


@named("sm3_dedup_stream", sql("obs", body="SELECT member_id, ts, value FROM obs"))
def dedup_stream(spark, sf_dir):
    """Every event comes twice, by replay and live."""
    delay, _ = _bounds_of(spark, sf_dir)
    folder = fresh_folder(spark, "dedup")
    replayed, arriving = (
        live.live_source(spark, LIVE_EVENTS.format(sf_dir), EVENT_SCHEMA) for _ in range(2)
    )
    both = as_observations(live.with_watermark(union_streams(replayed, arriving), f"{delay} seconds"))
    path = live.drain(live.dedup_stream(both, ["member_id"]).select("member_id", "ts", "value"), folder)
    return spark.read.parquet(path).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


_PUBLISHED = """
, placed AS (SELECT *, row_number() OVER (PARTITION BY query_hash ORDER BY emitted_at, event_id) - 1 AS ordinal FROM results),
full_batches AS (SELECT * FROM placed QUALIFY count(*) OVER (PARTITION BY query_hash, floor(ordinal / 20)) = 20)
SELECT event_id, query_hash, value,
       max((epoch_us(emitted_at) // 1000)) OVER (PARTITION BY query_hash, floor(ordinal / 20)) AS bucket_ts FROM full_batches"""


def _published(spark, sf_dir):
    """The folder of a view that was published from a stream."""
    aggs = [Agg("max", "value", "max_value"), Agg("min", "value", "min_value"), Agg("avg", "value", "avg_value", exact=2)]

    def build(obs):
        rows = live.live_window(obs, SIX_HOURLY, aggs, by=["stream", "property"])
        start, end = (F.col(f"window.{c}").cast("timestamp_ntz").alias(c) for c in ("start", "end"))
        # Closing events yield no value, hence no result. Filtering them by property instead
        # would reach below the watermark, and event time would never move on.
        return result_events(
            rows.withColumn("window", F.struct(start, end)), [a.out for a in aggs], F.md5(F.concat_ws("|", "stream", "property")),
            F.array("stream"), ["stream", "property"],
        )

    return _run(spark, sf_dir, "publish", build, publish.publish_stream).removesuffix("/buckets")


@named("sm4_publish_stream", sql("results", body=_PUBLISHED))
def publish_stream(spark, sf_dir):
    return publish.committed(spark, _published(spark, sf_dir)).select("event_id", "query_hash", "value", "bucket_ts")


@named("sm4_pointers", sql("results", body=_PUBLISHED.replace("SELECT event_id, query_hash, value", ", published AS (SELECT query_hash") + """)
SELECT query_hash, max(bucket_ts) AS bucket_ts FROM published GROUP BY query_hash"""))
def pointers(spark, sf_dir):
    """The latest bucket of each query's published view."""
    return publish.latest_pointers(spark, _published(spark, sf_dir)).select("query_hash", "bucket_ts")


def _r2s(mode):
    def run(spark, sf_dir):
        aggs = [Agg("max", "value", "max_value")]
        path = _run(
            spark, sf_dir, mode.lower(), lambda obs: live.live_window(obs, SIX_HOURLY, aggs, by=["property"]),
            lambda results, folder: publish.r2s_stream(results, folder, SIX_HOURLY, mode),
        )
        rows = spark.read.parquet(path).where(F.col("property").isNotNull())
        return _bounds(rows, "property", "max_value")
    return run


_MAX6 = ", a AS (SELECT w_start, w_end, property, max(value) AS max_value FROM win6h GROUP BY ALL)\n"
named("sm5_istream_stream", sql("win6h", body=_MAX6 + """
SELECT a.* FROM a WHERE NOT EXISTS (SELECT 1 FROM a b WHERE b.w_start = a.w_start - INTERVAL 1 HOUR
  AND b.property = a.property AND b.max_value = a.max_value)"""))(_r2s("IStream"))
named("sm5_dstream_stream", sql("win6h", body=_MAX6 + """
SELECT a.w_start + INTERVAL 1 HOUR AS w_start, a.w_end + INTERVAL 1 HOUR AS w_end, a.property, a.max_value
FROM a WHERE NOT EXISTS (SELECT 1 FROM a b WHERE b.w_start = a.w_start + INTERVAL 1 HOUR
  AND b.property = a.property AND b.max_value = a.max_value)"""))(_r2s("DStream"))


@named("sm6_multi_query", sql("win6h", "win1d", body=f"""
SELECT 'hottest' AS query_hash, w_start, w_end, property AS "group", 'top' AS var, max(value) AS value FROM win6h GROUP BY ALL
UNION ALL SELECT 'spread', w_start, w_end, property, 'low', min(value) FROM win6h GROUP BY ALL
UNION ALL SELECT 'spread', w_start, w_end, property, 'high', max(value) FROM win6h GROUP BY ALL
UNION ALL SELECT 'daily', w_start, w_end, '', 'mean', {AVG2} FROM win1d GROUP BY ALL"""))
def multi_query(spark, sf_dir):
    queries = {
        "hottest": ContinuousQuery((Agg("max", "value", "top"),), (SIX_HOURLY,), group_by=("property",)),
        "spread": ContinuousQuery(
            (Agg("min", "value", "low"), Agg("max", "value", "high")), (SIX_HOURLY,), group_by=("property",)
        ),
        "daily": ContinuousQuery((Agg("avg", "value", "mean", exact=2),), (DAILY,)),
    }

    def evaluate(obs, spec, aggs, by):
        return live.live_window(obs, spec, aggs, by=by)

    path = _run(spark, sf_dir, "shared", lambda obs: shared.run_shared(obs, queries, evaluate))
    return _bounds(spark.read.parquet(path), "query_hash", "group", "var", "value")
