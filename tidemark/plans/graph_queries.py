"""Named queries over triple patterns, projections and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.model import (
    Agg, ContinuousQuery, FOCUS_PREDICATES, HAS_TIMESTAMP, HAS_VALUE, LDP_CONTAINS, Pattern, RDF_TYPE,
    RELATES_TO_PROPERTY, TREE_VIEW, VANN_PREFIX, WindowSpec, XSD_FLOAT,
)
from tidemark.operators import buckets, delivery, discovery, patterns, provenance, registry, windows
from tidemark.operators.patterns import to_triples as triples_of
from tidemark.plans.continuous import over_triples
from tidemark.plans.inputs import (
    AVG2, DAILY, REPRESENTATIVE, SENSOR, SIX_HOURLY, at, day_buckets, hashed_queries,
    noon_index, observations, query_table, result_table, sql, subscriptions, table, triples, type_index,
)
from tidemark.plans.named import named
from tidemark.session import stored
from tidemark.sinks.publish import annotate_queries
from tidemark.sinks.results import result_triples
from tidemark.sources.event_log import scan_members

PURCHASE = SENSOR + "purchase"
STREAM_0 = "http://pod.example/p0/log/"


@named("flt1_match_triple", sql("triples", body=f"""
SELECT member_id, s AS subject, o AS value FROM triples WHERE p = '{HAS_VALUE}'"""))
def match_triple(spark, sf_dir):
    return patterns.match(triples(spark, sf_dir), Pattern("?subject", HAS_VALUE, "?value"), ["member_id"])


@named("flt1_match_any", sql("triples", body="SELECT s, p, o FROM triples"))
def match_any(spark, sf_dir):
    return patterns.match(triples(spark, sf_dir), Pattern("?s", "?p", "?o"))


@named("flt2_window_scope", sql("triples", body=f"""
SELECT member_id, s, p, o FROM triples WHERE stream = '{STREAM_0}'"""))
def window_scope(spark, sf_dir):
    return patterns.scope(triples(spark, sf_dir), STREAM_0).select("member_id", "s", "p", "o")


@named("flt3_time_range", sql("obs", body="""
SELECT member_id, ts FROM obs WHERE ts BETWEEN TIMESTAMP '2024-01-05 06:00:00' AND TIMESTAMP '2024-01-25 18:30:00'"""))
def time_range(spark, sf_dir):
    rows = scan_members(observations(spark, sf_dir), at("2024-01-05 06:00:00"), at("2024-01-25 18:30:00"), order=False)
    return rows.select("member_id", "ts")


@named("flt4_focus_filter", sql("queries", body="""
SELECT query_id, 'http://sensor.example/' || event_type AS focus FROM queries"""))
def focus_filter(spark, sf_dir):
    catalog = registry.query_catalog(query_table(spark, sf_dir))
    return patterns.extract_focus(registry.catalog_patterns(catalog), FOCUS_PREDICATES)


def container_triples(spark, sf_dir):
    """Each bucket, what it contains and what it is."""
    rows = day_buckets(observations(spark, sf_dir))
    container = "http://www.w3.org/ns/ldp#Container"
    return rows.select(F.inline(F.array(
        patterns.triple(F.col("bucket"), LDP_CONTAINS, F.col("member_id")),
        patterns.triple(F.col("bucket"), RDF_TYPE, F.lit(container)),
    ))).distinct()


@named("flt5_metadata_only", sql("bucketed", body=f"""
SELECT DISTINCT bucket AS s, '{RDF_TYPE}' AS p, 'http://www.w3.org/ns/ldp#Container' AS o FROM bucketed"""))
def metadata_only(spark, sf_dir):
    return patterns.metadata_only(container_triples(spark, sf_dir)).select("s", "p", "o")


@named("flt6_literal_prefixes", """
SELECT DISTINCT 'u' || CAST(user_id AS VARCHAR) AS prefix, 'http://ns.example/' || CAST(user_id AS VARCHAR) || '#' AS namespace
FROM events WHERE event_type <> 'error'
UNION ALL SELECT '', 'http://here.example/#'""")
def literal_prefixes(spark, sf_dir):
    users = table(spark, sf_dir, "events").select("user_id", "event_type").distinct()
    number = F.col("user_id").cast("string")
    space = F.concat(F.lit("http://ns.example/"), number, F.lit("#"))
    tagged = F.when(F.col("event_type") == "error", F.lit("en"))
    stated = users.select(
        space.alias("s"), F.lit(VANN_PREFIX).alias("p"), F.concat(F.lit("u"), number).alias("o"),
        F.lit("literal").alias("o_type"), F.lit(None).cast("string").alias("o_datatype"), tagged.alias("o_lang"),
    ).distinct()
    return patterns.prefix_table(stated, "http://here.example/")


@named("prj1_event_time", sql("obs", body="SELECT member_id, date_trunc('millisecond', ts) AS event_time FROM obs"))
def event_time(spark, sf_dir):
    return patterns.event_times(triples(spark, sf_dir))


@named("prj1_first_event_time", sql("obs", body="SELECT member_id, date_trunc('millisecond', ts) AS event_time FROM obs"))
def first_event_time(spark, sf_dir):
    """Members that state two times: the one stated first counts."""
    rows = triples(spark, sf_dir).withColumn("seq", F.lit(0))
    later = rows.where(F.col("p") == HAS_TIMESTAMP).withColumns(
        {"o": F.lit("2030-01-01T00:00:00.000Z"), "seq": F.lit(1)}
    )
    return patterns.first_event_time(rows.unionByName(later))


@named("prj2_share_event_time", sql("triples", body="""
SELECT member_id, s, p, o, date_trunc('millisecond', ts) AS ts FROM triples"""))
def share_event_time(spark, sf_dir):
    return patterns.share_event_time(triples(spark, sf_dir)).select("member_id", "s", "p", "o", "ts")


@named("prj2_share_first_time", sql("triples", body=f"""
, stated AS (SELECT *, 1 AS seq FROM triples UNION ALL
  SELECT stream, member_id, ts, s, p, '1999-01-01T00:00:00.000Z', o_type, o_datatype, o_lang, 2 FROM triples WHERE p = '{HAS_TIMESTAMP}')
SELECT member_id, s, p, o, date_trunc('millisecond', ts) AS ts FROM stated"""))
def share_first_time(spark, sf_dir):
    """Members that state an earlier time after their own."""
    rows = triples(spark, sf_dir).withColumn("seq", F.lit(1))
    later = rows.where(F.col("p") == HAS_TIMESTAMP).withColumns({"o": F.lit("1999-01-01T00:00:00.000Z"), "seq": F.lit(2)})
    return patterns.share_event_time(rows.unionByName(later), seq="seq").select("member_id", "s", "p", "o", "ts")


@named("prj3_window_bounds", sql("results", body="""
SELECT event_id AS s, started_at AS timestamp_from, ended_at AS timestamp_to FROM results"""))
def window_bounds(spark, sf_dir):
    return provenance.window_bounds(result_triples(result_table(spark, sf_dir)))


@named("prj4_alias_aggregate", sql("win1d", body=f"""
SELECT w_start, w_end, property, max(value) AS top, {AVG2} AS mean FROM win1d GROUP BY ALL"""))
def alias_aggregate(spark, sf_dir):
    aggs = [Agg("max").alias("top"), Agg("avg", exact=2).alias("mean")]
    return windows.flat(windows.windowed(observations(spark, sf_dir), DAILY, aggs, ["property"]))


@named("jn1_subject_star", sql("win180s", body=f"""
SELECT w_start, w_end, max(value) AS max_value FROM win180s WHERE property = '{PURCHASE}' GROUP BY ALL"""))
def subject_star(spark, sf_dir):
    """The pattern matched over the triples of each window, then aggregated."""
    query = ContinuousQuery(
        aggregates=(Agg("max", "o", "max_value"),), windows=(REPRESENTATIVE,),
        patterns=(Pattern("?s", HAS_VALUE, "?o"), Pattern("?s", RELATES_TO_PROPERTY, PURCHASE)),
    )
    return windows.flat(over_triples(query, triples(spark, sf_dir)))


@named("jn1_subject_star_members", sql("obs", body="""
SELECT member_id, member_id AS s, CAST(value AS VARCHAR) AS value, property FROM obs"""))
def subject_star_members(spark, sf_dir):
    predicates = {"value": HAS_VALUE, "property": RELATES_TO_PROPERTY}
    return patterns.star(triples(spark, sf_dir), predicates, ["member_id"])


def _sensor_rows(spark, sf_dir, of: list[str]):
    """`?s` is a sensor, `?o` its value in whole units, so that two streams can agree."""
    return observations(spark, sf_dir).where(F.col("stream").isin(*of)).select(
        "ts", F.col("property").alias("s"), F.floor("value").cast("bigint").alias("o")
    )


_LEFT = [f"http://pod.example/p{i}/log/" for i in (0, 2, 4, 6)]
_RIGHT = [f"http://pod.example/p{i}/log/" for i in (1, 3, 5, 7)]


@named("jn2_cross_window", sql("win6h", body=f"""
, solved AS (SELECT DISTINCT w_end, property AS s, CAST(floor(value) AS BIGINT) AS o, stream FROM win6h),
l AS (SELECT DISTINCT w_end, s, o FROM solved WHERE stream IN ({', '.join(f"'{s}'" for s in _LEFT)})),
r AS (SELECT DISTINCT w_end, s, o FROM solved WHERE stream IN ({', '.join(f"'{s}'" for s in _RIGHT)}))
SELECT w_end, count(*) AS n, CAST(sum(o) AS DOUBLE) / count(*) AS avg_o FROM l JOIN r USING (w_end, s, o) GROUP BY w_end"""))
def cross_window(spark, sf_dir):
    left, right = _sensor_rows(spark, sf_dir, _LEFT), _sensor_rows(spark, sf_dir, _RIGHT)
    both = windows.join_windows(left, right, SIX_HOURLY, SIX_HOURLY, ["s", "o"])
    return both.groupBy("w_end").agg(F.count("o").alias("n"), F.avg("o").alias("avg_o"))


@named("jn2_endpoint_query", sql("win6h", body=f"""
, l AS (SELECT w_end, property AS s, floor(value) AS o, member_id FROM win6h WHERE stream IN ({', '.join(f"'{s}'" for s in _LEFT)})),
r AS (SELECT w_end, property AS s, floor(value) AS o, member_id FROM win6h WHERE stream IN ({', '.join(f"'{s}'" for s in _RIGHT)}))
SELECT w_end - INTERVAL 6 HOUR AS w_start, w_end, count(*) AS n, sum(o) / count(*) AS avg_o, max(o) AS max_o, count(DISTINCT s) AS n_sensors
FROM l JOIN r USING (w_end, s, o) GROUP BY w_end"""))
def endpoint_query(spark, sf_dir):
    """One query over two windows: readings of one sensor that agree, each pair a solution."""
    rows = observations(spark, sf_dir).withColumns({
        "value": F.floor("value"), "stream": F.when(F.col("stream").isin(*_LEFT), "left").otherwise("right")})
    windows_ = tuple(WindowSpec(SIX_HOURLY.width, SIX_HOURLY.slide, name, stream) for name, stream in (("w1", "left"), ("w2", "right")))
    query = ContinuousQuery(
        aggregates=(Agg("count", "*", "n"), Agg("avg", "o", "avg_o", exact=0), Agg("max", "o", "max_o"), Agg("count", "s", "n_sensors", distinct=True)),
        windows=windows_, patterns=tuple(
            Pattern(m, p, o, name) for m, name in (("?a", "w1"), ("?b", "w2")) for p, o in ((RELATES_TO_PROPERTY, "?s"), (HAS_VALUE, "?o"))),
    )
    return windows.flat(over_triples(query, triples_of(rows)))


_ASSIGN_SQL = sql("noon", body="""
SELECT o.member_id, o.ts, coalesce(n.node, 'none') AS bucket
FROM obs o ASOF LEFT JOIN noon n ON o.stream = n.stream AND o.ts >= n.value""")


@named("jn3_assign_bucket", _ASSIGN_SQL)
def assign_bucket(spark, sf_dir):
    obs = observations(spark, sf_dir)
    return buckets.assign_bucket(obs, stored(noon_index(obs), "index")).select("member_id", "ts", "bucket")


@named("jn3_assign_bucket_long_index", _ASSIGN_SQL)
def assign_bucket_long_index(spark, sf_dir):
    """The way taken for an index that is too long to send around."""
    obs = observations(spark, sf_dir)
    index = stored(noon_index(obs), "index")
    return buckets.assign_bucket(obs, index, broadcast_rows=0).select("member_id", "ts", "bucket")


@named("jn4_trace_provenance", sql("daily_results", body="""
SELECT r.event_id, o.member_id FROM daily_results r JOIN obs o
ON o.stream = r.stream AND o.ts BETWEEN r.started_at AND r.ended_at"""))
def trace_provenance(spark, sf_dir):
    results = stored(result_table(spark, sf_dir, DAILY), "results")
    return provenance.trace(results, observations(spark, sf_dir)).select("event_id", "member_id")


@named("jn5_find_streams", sql("type_index", body=f"""
SELECT pod, o AS stream FROM type_index WHERE p = '{TREE_VIEW}' AND pod IN (
  SELECT pod FROM type_index WHERE p = '{RELATES_TO_PROPERTY}' AND o = '{PURCHASE}')"""))
def find_streams(spark, sf_dir):
    return discovery.find_streams(type_index(spark, sf_dir), [PURCHASE])


@named("jn6_locate_stream", sql("type_index", body=f"""
SELECT pod, coalesce(arg_min(s, seq) FILTER (WHERE p = '{RELATES_TO_PROPERTY}' AND o = '{PURCHASE}'),
                     arg_min(o, seq) FILTER (WHERE p = '{TREE_VIEW}')) AS stream FROM type_index GROUP BY pod"""))
def locate_stream(spark, sf_dir):
    return discovery.locate_stream(type_index(spark, sf_dir), PURCHASE)


@named("jn7_reuse_lookup", sql("hashed", body="""
SELECT query_id, query_hash FROM hashed WHERE variant = 0 AND event_type IN ('click', 'view')"""))
def reuse_lookup(spark, sf_dir):
    catalog = registry.query_catalog(
        query_table(spark, sf_dir).where((F.col("variant") == 0) & F.col("event_type").isin("click", "view"))
    )
    stored = annotate_queries(catalog, F.col("registered_at"), F.col("registered_at"), F.col("registered_at"))
    return registry.reusable(hashed_queries(spark, sf_dir), stored).select("query_id", "query_hash")


@named("jn8_deliver", sql("daily_results", "subscriptions", body="""
SELECT event_id, query_hash, client_id FROM daily_results JOIN subscriptions USING (query_hash)"""))
def deliver(spark, sf_dir):
    results = stored(result_table(spark, sf_dir, DAILY), "results")
    return delivery.fan_out(results, subscriptions(spark, sf_dir)).select("event_id", "query_hash", "client_id")


@named("jn9_undeliverable", sql("daily_results", "subscriptions", body="""
SELECT event_id, query_hash FROM daily_results WHERE query_hash NOT IN (SELECT query_hash FROM subscriptions)"""))
def undeliverable(spark, sf_dir):
    rows = delivery.undeliverable(result_table(spark, sf_dir, DAILY), subscriptions(spark, sf_dir))
    return rows.select("event_id", "query_hash")


def bnode_triples(spark, sf_dir):
    """Members whose value sits behind a blank node; for one property the node has no triples."""
    obs = observations(spark, sf_dir)
    node, s = F.concat(F.lit("_:b"), F.col("seq").cast("string")), F.col("member_id")
    outer = F.array(
        patterns.triple(s, RELATES_TO_PROPERTY, F.col("property")),
        patterns.triple(s, "http://result.example/hasResult", node, "bnode"),
    )
    inner = F.array(
        patterns.triple(node, HAS_VALUE, F.col("value"), "literal", XSD_FLOAT),
        patterns.triple(node, "http://result.example/unit", F.lit("u"), "literal", lang="en"),
    )
    full = F.when(F.col("property") == SENSOR + "error", F.slice(inner, 1, 0)).otherwise(inner)
    return obs.select("member_id", F.inline(F.concat(outer, full)))


BNODE_SQL = f"""
SELECT member_id, member_id AS s, CAST(NULL AS VARCHAR) AS via, '{RELATES_TO_PROPERTY}' AS p, property AS o FROM obs
UNION ALL SELECT member_id, member_id, 'http://result.example/hasResult', '{HAS_VALUE}', CAST(value AS VARCHAR)
  FROM obs WHERE property <> '{SENSOR}error'
UNION ALL SELECT member_id, member_id, 'http://result.example/hasResult', 'http://result.example/unit', 'u'
  FROM obs WHERE property <> '{SENSOR}error'
UNION ALL SELECT member_id, member_id, 'http://result.example/hasResult', NULL, NULL
  FROM obs WHERE property = '{SENSOR}error'"""


@named("jn10_inline_bnodes", sql("obs", body=BNODE_SQL))
def inline_bnodes(spark, sf_dir):
    rows = patterns.inline_bnodes(bnode_triples(spark, sf_dir))
    return rows.select("member_id", "s", "via", "p", "o")


@named("jn11_dispatch_results", sql("results", body=f"""
SELECT event_id, query_hash, emitted_at, value FROM results
WHERE property = '{PURCHASE}' AND emitted_at BETWEEN TIMESTAMP '2024-01-08 00:00:00' AND TIMESTAMP '2024-01-22 00:00:00'"""))
def dispatch_results(spark, sf_dir):
    stored = result_table(spark, sf_dir)
    asked = observations(spark, sf_dir).where(F.col("property") == PURCHASE).select(
        F.md5(F.concat_ws("|", "stream", "property")).alias("query_hash")
    )
    rows = registry.dispatch(stored, asked, at("2024-01-08 00:00:00"), at("2024-01-22 00:00:00"))
    return rows.select("event_id", "query_hash", "emitted_at", "value")
