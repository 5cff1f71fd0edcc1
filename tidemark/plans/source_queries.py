"""Named queries over sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.model import (
    DCT_SOURCE, HAS_TIMESTAMP, LDP_INBOX, RDF_TYPE, SAREF, TREE_MEMBER,
)
from tidemark.operators import buckets, delivery
from tidemark.operators.patterns import to_triples
from tidemark.operators.registry import query_catalog
from tidemark.plans.graph_queries import bnode_triples, container_triples
from tidemark.plans.inputs import (
    DAILY, HOUR, LIVE_EVENTS, SENSOR, as_observations, at, day_buckets, iso_sql, noon_index, observations, query_table, result_table, sql,
    subscriptions, table, triples,
)
from tidemark.plans.named import SQL, named
from tidemark.plans.window_queries import rebalance_sql
from tidemark.session import fresh_folder, stored
from tidemark.sinks import publish
from tidemark.sinks.results import result_triples, to_ntriples
from tidemark.sources import members, modes, notifications
from tidemark.sources.event_log import EVENT_SCHEMA, open_buckets, scan_members, write_bucketed
from tidemark.sources.ntriples import parse_ntriples
from tidemark.streaming import handover, live

FROM, TO = "2024-01-05 00:00:00", "2024-01-12 12:00:00"
CUT, NOW = "2024-01-18 00:00:00", "2024-01-15 00:00:00"


@named("src1_scan_members", sql("obs", body=f"""
SELECT stream, member_id, ts, property, value FROM obs
WHERE ts BETWEEN TIMESTAMP '{FROM}' AND TIMESTAMP '{TO}' ORDER BY ts"""))
def scan(spark, sf_dir):
    rows = scan_members(observations(spark, sf_dir), at(FROM), at(TO))
    return rows.select("stream", "member_id", "ts", "property", "value")


@named("src2_prune_buckets", sql("noon", body=f"""
SELECT stream, node, value FROM (
  SELECT *, lead(value) OVER (PARTITION BY stream ORDER BY value) AS until FROM noon)
WHERE value <= TIMESTAMP '{TO}' AND (until IS NULL OR until > TIMESTAMP '{FROM}')"""))
def prune(spark, sf_dir):
    index = stored(noon_index(observations(spark, sf_dir)), "index")
    return buckets.prune_buckets(index, at(FROM), at(TO)).select("stream", "node", "value")


@named("src2_open_buckets", sql("noon", body=f"""
SELECT o.stream, o.member_id, n.node AS bucket, o.ts, o.value FROM obs o ASOF JOIN noon n ON o.stream = n.stream AND o.ts >= n.value
WHERE o.ts BETWEEN TIMESTAMP '{FROM}' AND TIMESTAMP '{TO}'"""))
def open_pruned(spark, sf_dir):
    obs, path = observations(spark, sf_dir), fresh_folder(spark, "bucketed-log")
    index = stored(noon_index(obs), "index")
    write_bucketed(buckets.assign_bucket(obs, index), path)
    rows = open_buckets(spark.read.parquet(path), index, at(FROM), at(TO))
    return rows.select("stream", "member_id", "bucket", "ts", "value")


@named("src3_read_ntriples", sql("triples", body="SELECT s, p, o, o_type, o_datatype, o_lang FROM triples"))
def ntriples(spark, sf_dir):
    return parse_ntriples(to_ntriples(triples(spark, sf_dir)))


@named("src4_assemble_members", sql("bucketed", "triples", body=f"""
SELECT CASE WHEN b.property = '{SENSOR}click' THEN b.member_id ELSE b.bucket END AS doc, t.member_id, t.s, t.p, t.o
FROM triples t JOIN bucketed b USING (member_id)"""))
def assemble(spark, sf_dir):
    """Click events are documents of their own; the others share their day's, which links them."""
    rows = day_buckets(observations(spark, sf_dir))
    alone = F.col("property") == SENSOR + "click"
    placed = rows.withColumn("doc", F.when(alone, F.col("member_id")).otherwise(F.col("bucket")))
    body = to_triples(placed, ["doc"]).select("doc", "s", "p", "o")
    links = placed.where(~alone).select(
        "doc", F.col("stream").alias("s"), F.lit(TREE_MEMBER).alias("p"), F.col("member_id").alias("o")
    )
    return members.assemble_members(body.unionByName(links)).select("doc", "member_id", "s", "p", "o")


@named("src5_list_bucket", sql("bucketed", body="SELECT DISTINCT bucket AS s, member_id AS o FROM bucketed"))
def list_bucket(spark, sf_dir):
    return members.list_bucket(container_triples(spark, sf_dir))


@named("src6_live_source", "SELECT event_id, ts, user_id, event_type, value FROM events")
def live_source(spark, sf_dir):
    table(spark, sf_dir, "events")
    stream = live.live_source(spark, LIVE_EVENTS.format(sf_dir), EVENT_SCHEMA)
    folder = fresh_folder(spark, "live-source")
    path = live.drain(stream.drop("props"), folder)
    return spark.read.schema("event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double").parquet(path)


@named("src7_route_notifications", sql("bucketed", body=f"""
SELECT stream, member_id AS location FROM bucketed WHERE property <> '{SENSOR}error'"""))
def route(spark, sf_dir):
    rows = day_buckets(observations(spark, sf_dir))
    kind = F.when(F.col("property") == SENSOR + "error", F.lit("Update")).otherwise(F.lit("Add"))
    bodies = rows.select(F.to_json(F.struct(
        kind.alias("type"), F.col("bucket").alias("target"), F.col("member_id").alias("object")
    )).alias("body"))
    return notifications.route_notifications(notifications.parse_notifications(bodies))


@named("src8_historical_plus_live", sql("obs", body=f"""
SELECT member_id, ts, 'historical' AS phase FROM obs
WHERE ts BETWEEN TIMESTAMP '{NOW}' - INTERVAL 72 HOUR AND TIMESTAMP '{NOW}'
UNION ALL SELECT member_id, ts, 'live' FROM obs WHERE ts > TIMESTAMP '{NOW}'"""))
def historical_plus_live(spark, sf_dir):
    obs = observations(spark, sf_dir)
    rows = modes.historical_plus_live(obs, obs.where(F.col("ts") > at(NOW)), "historical+live", 72 * HOUR, at(NOW))
    return rows.select("member_id", "ts", "phase")


@named("src8_replay_then_tail", SQL["src8_historical_plus_live"])
def replay_then_tail(spark, sf_dir):
    """What arrives overlaps the replay by a day."""
    history = observations(spark, sf_dir)
    arrivals = as_observations(live.live_source(spark, LIVE_EVENTS.format(sf_dir), EVENT_SCHEMA))
    days = history.agg(F.datediff(F.max("ts"), F.min("ts"))).first()[0] or 0
    tail = arrivals.where(F.col("ts") > at(NOW) - F.expr("INTERVAL 1 DAY"))
    rows = handover.replay_then_tail(history, tail, fresh_folder(spark, "handover"), 72 * HOUR, at(NOW), f"{days + 2} days")
    return rows.select("member_id", "ts", "phase")


@named("src9_backfill_gap", sql("obs", body=f"""
SELECT member_id, ts FROM obs WHERE ts > TIMESTAMP '{NOW}' AND ts < TIMESTAMP '{CUT}' ORDER BY ts"""))
def backfill_gap(spark, sf_dir):
    obs = observations(spark, sf_dir)
    seen = obs.where((F.col("ts") <= at(NOW)) | (F.col("ts") >= at(CUT)))
    return modes.backfill_gap(obs, seen).select("member_id", "ts")


@named("src10_multi_stream", """
SELECT 'orders' AS stream, CAST(o_orderkey AS VARCHAR) AS member_id, CAST(o_totalprice AS DOUBLE) AS value FROM orders
UNION ALL SELECT 'events', CAST(event_id AS VARCHAR), value FROM events""")
def multi_stream(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        F.lit("orders").alias("stream"), F.col("o_orderkey").cast("string").alias("member_id"),
        F.col("o_totalprice").cast("double").alias("value"),
    )
    events = table(spark, sf_dir, "events").select(
        F.lit("events").alias("stream"), F.col("event_id").cast("string").alias("member_id"), "value"
    )
    return modes.union_streams(orders, events)


_BATCHED = """
, placed AS (SELECT *, row_number() OVER (PARTITION BY query_hash ORDER BY emitted_at, event_id) - 1 AS ordinal FROM results),
batched AS (SELECT *, CAST(floor(ordinal / 20) AS BIGINT) AS batch FROM placed),
full_batches AS (SELECT * FROM batched QUALIFY count(*) OVER (PARTITION BY query_hash, batch) = 20)
"""


@named("snk1_publish_batches", sql("results", body=_BATCHED + "SELECT event_id, query_hash, batch FROM full_batches"))
def publish_batches(spark, sf_dir):
    results = stored(result_table(spark, sf_dir), "results")
    rows = publish.publish_batches(results)
    return rows.select("event_id", "query_hash", "batch")


@named("snk2_write_buckets", sql("results", body=_BATCHED + """
SELECT event_id, query_hash, batch, max((epoch_us(emitted_at) // 1000)) OVER (PARTITION BY query_hash, batch) AS bucket_ts
FROM full_batches"""))
def write_buckets(spark, sf_dir):
    path = fresh_folder(spark, "buckets")
    results = stored(result_table(spark, sf_dir), "results")
    publish.write_buckets(publish.publish_batches(results), path)
    return spark.read.parquet(path).select("event_id", "query_hash", "batch", "bucket_ts")


@named("snk2_write_buckets_again", SQL["snk2_write_buckets"])
def write_buckets_again(spark, sf_dir):
    """Batches that come in two calls, the second with all that the first had."""
    path = fresh_folder(spark, "buckets")
    batches = stored(publish.publish_batches(stored(result_table(spark, sf_dir), "results")), "batches")
    publish.write_buckets(batches.where("batch % 3 = 0"), path)
    publish.write_buckets(batches, path, existing=spark.read.parquet(path))
    return spark.read.parquet(path).select("event_id", "query_hash", "batch", "bucket_ts")


_RESULT_TRIPLES = " UNION ALL ".join(
    f"SELECT event_id AS s, '{p}' AS p, {o} AS o FROM daily_results" for p, o in [
        (RDF_TYPE, f"'{SAREF}Measurement'"),
        (SAREF + "hasTimestamp", iso_sql("emitted_at")),
        (SAREF + "hasValue", "CAST(value AS VARCHAR)"),
        ("http://www.w3.org/ns/prov#wasDerivedFrom", "derived_from"),
        ("http://w3id.org/rsp/vocals-sd#startedAt", iso_sql("started_at")),
        ("http://w3id.org/rsp/vocals-sd#endedAt", iso_sql("ended_at")),
        ("http://www.w3.org/ns/prov#generatedBy", "stream"),
    ]
)


@named("snk3_result_triples", sql("daily_results", body=_RESULT_TRIPLES))
def triples_of_results(spark, sf_dir):
    return result_triples(result_table(spark, sf_dir, DAILY)).select("s", "p", "o")


@named("snk4_compact_triples", sql("obs", body=f"""
SELECT member_id, '<' || member_id || '>' AS s, CAST(NULL AS VARCHAR) AS via, 'saref:relatesToProperty' AS p,
       'sensor:' || substr(property, {len(SENSOR) + 1}) AS o FROM obs
UNION ALL SELECT member_id, '<' || member_id || '>', 'r:hasResult', 'saref:hasValue', CAST(value AS VARCHAR)
  FROM obs WHERE property <> '{SENSOR}error'
UNION ALL SELECT member_id, '<' || member_id || '>', 'r:hasResult', 'r:unit', 'u' FROM obs WHERE property <> '{SENSOR}error'
UNION ALL SELECT member_id, '<' || member_id || '>', 'r:hasResult', NULL, NULL FROM obs WHERE property = '{SENSOR}error'"""))
def compact(spark, sf_dir):
    prefixes = {"saref": SAREF, "sensor": SENSOR, "r": "http://result.example/"}
    rows = bnode_triples(spark, sf_dir)
    return publish.compact_triples(rows.unionByName(rows), prefixes).select("member_id", "s", "via", "p", "o")


@named("snk5_annotate_queries", sql("hashed", body="""
SELECT query_id, query_hash, registered_at AS start_time,
       'http://window.example/' || CASE variant WHEN 0 THEN 'w1' ELSE 'win' END AS window_name,
       'http://pod.example/u' || CAST(user_id AS VARCHAR) || '/' AS stream, width AS window_size, slide AS window_slide,
       CASE variant WHEN 0 THEN 'x' ELSE 'y' END || fn AS projection_variable,
       'http://sensor.example/' || event_type AS focus, CAST(29 AS BIGINT) AS n_triples
FROM hashed"""))
def annotate(spark, sf_dir):
    when = F.col("registered_at")
    notes = publish.annotate_queries(query_catalog(query_table(spark, sf_dir)), when, when, when)
    counts = publish.annotation_triples(notes).groupBy("query_id").agg(F.count(F.lit(1)).alias("n_triples"))
    return notes.join(counts, "query_id").select(
        "query_id", "query_hash", "start_time", "window_name", "stream", "window_size", "window_slide",
        "projection_variable", "focus", "n_triples",
    )


@named("snk6_bucket_index_triples", sql("noon", body=f"""
, r AS (SELECT *, '_:r' || md5(node) AS relation FROM noon)
SELECT stream || '#EventStream' AS s, '{RDF_TYPE}' AS p, 'https://w3id.org/ldes#EventStream' AS o FROM noon GROUP BY stream
UNION ALL SELECT stream || '#EventStream', 'https://w3id.org/ldes#timestampPath', '{HAS_TIMESTAMP}' FROM noon GROUP BY stream
UNION ALL SELECT stream || '#EventStream', 'https://w3id.org/ldes#versionOfPath', '1.0' FROM noon GROUP BY stream
UNION ALL SELECT stream || '#EventStream', 'https://w3id.org/tree#view', stream FROM noon GROUP BY stream
UNION ALL SELECT stream, '{RDF_TYPE}', 'https://w3id.org/tree#Node' FROM noon GROUP BY stream
UNION ALL SELECT stream, '{LDP_INBOX}', arg_max(node, value) FROM noon GROUP BY stream
UNION ALL SELECT stream, 'https://w3id.org/tree#relation', relation FROM r
UNION ALL SELECT relation, '{RDF_TYPE}', 'https://w3id.org/tree#GreaterThanOrEqualToRelation' FROM r
UNION ALL SELECT relation, 'https://w3id.org/tree#node', node FROM r
UNION ALL SELECT relation, 'https://w3id.org/tree#path', path FROM r
UNION ALL SELECT relation, 'https://w3id.org/tree#value', {iso_sql('value')} FROM r"""))
def index_triples(spark, sf_dir):
    return publish.bucket_index_triples(noon_index(observations(spark, sf_dir))).select("s", "p", "o")


@named("snk7_link_sources", sql("bucketed", body=f"""
SELECT member_id AS s, '{DCT_SOURCE}' AS p, bucket || CAST(seq AS VARCHAR) AS o FROM bucketed"""))
def link_sources(spark, sf_dir):
    stored = day_buckets(observations(spark, sf_dir)).withColumn("location", F.concat("bucket", F.col("seq").cast("string")))
    return publish.link_sources(stored).select("s", "p", "o")


@named("snk8_latest_bucket", sql("noon", body=f"""
SELECT stream AS s, '{LDP_INBOX}' AS p, stream || CAST(max((epoch_us(value) // 1000)) AS VARCHAR) || '/' AS o FROM noon GROUP BY stream"""))
def latest_bucket(spark, sf_dir):
    return publish.latest_bucket(noon_index(observations(spark, sf_dir))).select("s", "p", "o")


@named("snk9_fan_out", sql("daily_results", "subscriptions", body="""
SELECT client_id, count(*) AS n_results, max(emitted_at) AS last_emitted
FROM daily_results JOIN subscriptions USING (query_hash) GROUP BY client_id"""))
def fan_out(spark, sf_dir):
    rows = delivery.fan_out(result_table(spark, sf_dir, DAILY), subscriptions(spark, sf_dir))
    return rows.groupBy("client_id").agg(
        F.count(F.lit(1)).alias("n_results"), F.max("emitted_at").alias("last_emitted")
    )


@named("snk10_add_version", sql("obs", body="SELECT member_id, ts, 'v1' AS version FROM obs"))
def add_version(spark, sf_dir):
    return publish.add_version(observations(spark, sf_dir), "v1").select("member_id", "ts", "version")


@named("snk11_initial_load", sql("noon", body=f"""
, firsts AS (SELECT stream, min(ts) AS earliest FROM obs GROUP BY stream),
loaded AS (
  SELECT o.*, coalesce(n.node, o.stream || CAST((epoch_us(f.earliest) // 1000) AS VARCHAR) || '/') AS bucket
  FROM obs o ASOF LEFT JOIN noon n ON o.stream = n.stream AND o.ts >= n.value JOIN firsts f ON f.stream = o.stream)
SELECT * FROM ({rebalance_sql('loaded', 50)})"""))
def initial_load(spark, sf_dir):
    obs = observations(spark, sf_dir)
    index = stored(noon_index(obs), "index")
    return buckets.initial_load(obs, index, 50).select("member_id", "old_bucket", "bucket")
