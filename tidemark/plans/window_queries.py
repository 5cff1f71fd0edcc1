"""Named queries over windows, aggregates, order and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.model import Agg, ContinuousQuery, HAS_VALUE, Pattern, RELATES_TO_PROPERTY, WindowSpec
from tidemark.operators import buckets, ordering, triplesets, windows
from tidemark.operators.patterns import dedup_triples
from tidemark.operators.registry import dedup_queries, registry_summary
from tidemark.operators.discovery import exists_metric
from tidemark.plans.continuous import over_observations
from tidemark.plans.inputs import (
    AGGS, AVG2, DAILY, HOUR, REPRESENTATIVE, SENSOR, SIX_HOURLY, SUM2, at, day_buckets, lookalike_queries, noon_index,
    observations, query_table, result_table, sql, subscriptions, triples, type_index, windows_sql,
)
from tidemark.plans.named import named
from tidemark.session import stored

CLICK = SENSOR + "click"
PURCHASE = SENSOR + "purchase"


def _one(func: str, name: str, **kw):
    return [Agg(func, "value", name, **kw)]


def _per_window(func, name, **kw):
    def run(spark, sf_dir):
        rows = windows.windowed(observations(spark, sf_dir), REPRESENTATIVE, _one(func, name, **kw), ["property"])
        return windows.flat(rows)
    return run


def _per_window_sql(expr: str, name: str) -> str:
    return sql("win180s", body=f"SELECT w_start, w_end, property, {expr} AS {name} FROM win180s GROUP BY ALL")


# The representative query: highest value of one property, 180 s windows every 30 s.
@named("flagship_max_rstream", sql("win180s", body=f"""
SELECT w_start, w_end, max(value) AS max_value FROM win180s WHERE property = '{CLICK}' GROUP BY ALL"""))
def flagship(spark, sf_dir):
    query = ContinuousQuery(
        aggregates=(Agg("max", "o", "max_value"),),
        windows=(REPRESENTATIVE,),
        patterns=(Pattern("?s", HAS_VALUE, "?o"), Pattern("?s", RELATES_TO_PROPERTY, CLICK)),
    )
    return windows.flat(over_observations(query, observations(spark, sf_dir)))


named("ag1_win_max", _per_window_sql("max(value)", "max_value"))(_per_window("max", "max_value"))
named("ag2_win_min", _per_window_sql("min(value)", "min_value"))(_per_window("min", "min_value"))
named("ag3_win_avg", _per_window_sql(AVG2, "avg_value"))(_per_window("avg", "avg_value", exact=2))


@named("ag4_win_passthrough", sql("win6h", body=f"""
SELECT w_start, w_end, property, count(value) AS n, {SUM2} / 100 AS total, min(value) AS a_sample,
       count(DISTINCT stream) AS n_streams,
       CAST(sum(DISTINCT CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / 100 AS distinct_total,
       CAST(sum(DISTINCT CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / (count(DISTINCT value) * 100) AS distinct_avg,
       count(*) AS n_rows, string_agg(DISTINCT stream, ' ' ORDER BY stream) AS streams
FROM win6h GROUP BY ALL HAVING count(value) > 1"""))
def win_passthrough(spark, sf_dir):
    aggs = [
        Agg("count", "value", "n"), Agg("sum", "value", "total", exact=2), Agg("sample", "value", "a_sample"),
        Agg("count", "stream", "n_streams", distinct=True),
        Agg("sum", "value", "distinct_total", distinct=True, exact=2),
        Agg("avg", "value", "distinct_avg", distinct=True, exact=2),
        Agg("count", "*", "n_rows"), Agg("group_concat", "stream", "streams", distinct=True),
    ]
    rows = windows.windowed(observations(spark, sf_dir), SIX_HOURLY, aggs, ["property"], having="n > 1")
    return windows.flat(rows)


@named("ag4_group_concat", sql("win180s", body="""
SELECT w_start, w_end, stream, string_agg(DISTINCT property, ' ' ORDER BY property) AS properties
FROM win180s GROUP BY ALL"""))
def group_concat(spark, sf_dir):
    aggs = [Agg("group_concat", "property", "properties", distinct=True)]
    return windows.flat(windows.windowed(observations(spark, sf_dir), REPRESENTATIVE, aggs, ["stream"]))


@named("ag5_one_event_per_binding", sql("results", body="SELECT query_hash, var, value, started_at, ended_at FROM results"))
def one_event_per_binding(spark, sf_dir):
    rows = windows.flat(windows.windowed(observations(spark, sf_dir), SIX_HOURLY, AGGS, ["stream", "property"]))
    split = windows.explode_bindings(rows, [a.out for a in AGGS], ["w_start", "w_end", "stream", "property"])
    return split.select(
        F.md5(F.concat_ws("|", "stream", "property")).alias("query_hash"), "var", "value",
        F.col("w_start").alias("started_at"), F.col("w_end").alias("ended_at"),
    )


@named("ag5_text_binding", sql("win6h", body="""
, a AS (SELECT w_start, w_end, stream, string_agg(DISTINCT property, ' ' ORDER BY property) AS properties, min(property) AS least,
               count(*) AS n FROM win6h GROUP BY ALL)
SELECT w_start, w_end, stream, 'properties' AS var, CAST(NULL AS DOUBLE) AS value, properties AS lexical FROM a
UNION ALL SELECT w_start, w_end, stream, 'least', NULL, least FROM a
UNION ALL SELECT w_start, w_end, stream, 'n', n::DOUBLE, n::VARCHAR FROM a"""))
def text_binding(spark, sf_dir):
    aggs = [Agg("group_concat", "property", "properties", distinct=True), Agg("min", "property", "least"), Agg("count", "*", "n")]
    rows = windows.flat(windows.windowed(observations(spark, sf_dir), SIX_HOURLY, aggs, ["stream"]))
    return windows.explode_bindings(rows, [a.out for a in aggs], ["w_start", "w_end", "stream"])


# Distinct values over 180,000 windows an hour: counted at each change, told by day.
@named("ag4_distinct_step_20ms", sql("obs", body="""
, held AS (SELECT DISTINCT property, user, (us - 3600000000) // 20000 + 1 AS low, us // 20000 AS high
           FROM (SELECT property, stream AS user, epoch_us(ts) AS us FROM obs)),
days AS (SELECT property, user, d, greatest(low, d * 4320000) AS low, least(high, (d + 1) * 4320000 - 1) AS high
         FROM held, unnest(range(low // 4320000, high // 4320000 + 1)) AS u(d)),
fresh AS (SELECT *, high - greatest(low - 1, coalesce(max(high) OVER (
            PARTITION BY property, user, d ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), low - 1)) AS more FROM days)
SELECT TIMESTAMP '1970-01-01' + d::INT * INTERVAL 1 DAY AS day, property, sum(greatest(more, 0))::BIGINT AS n FROM fresh GROUP BY ALL"""))
def distinct_step_20ms(spark, sf_dir):
    runs = windows.flat(windows.distinct_runs(observations(spark, sf_dir), WindowSpec(HOUR, 20), F.col("stream"), ["property"]))
    day = F.date_trunc("day", "w_start").cast("timestamp_ntz").alias("day")
    return runs.groupBy(day, "property").agg(F.sum(F.col("_n") * F.col("n_windows")).alias("n"))


@named("ag6_bucket_overflow", sql("bucketed", body="""
SELECT stream, bucket, count(*) AS n FROM bucketed GROUP BY ALL HAVING count(*) > 40"""))
def bucket_overflow(spark, sf_dir):
    return buckets.overflow(day_buckets(observations(spark, sf_dir)), 40, ["stream", "bucket"])


@named("ag7_earliest_ts", sql("obs", body="SELECT stream, min(ts) AS earliest FROM obs GROUP BY ALL"))
def earliest_ts(spark, sf_dir):
    return buckets.earliest_ts(observations(spark, sf_dir), ["stream"])


@named("ag8_exists_metric", sql("type_index", body=f"""
SELECT pod, bool_or(p = '{RELATES_TO_PROPERTY}' AND o = '{PURCHASE}') AS relevant FROM type_index GROUP BY pod"""))
def has_metric(spark, sf_dir):
    return exists_metric(type_index(spark, sf_dir), [PURCHASE])


@named("ag9_registry_counts", sql("queries", body="""
SELECT 'registered' AS status, count(*) AS n FROM queries
UNION ALL SELECT 'executing', count(*) FROM (SELECT DISTINCT user_id, event_type FROM queries)"""))
def registry_counts(spark, sf_dir):
    return registry_summary(query_table(spark, sf_dir))


@named("ag9_lookalike_counts", sql("lookalikes", body="""
SELECT 'registered' AS status, count(*) AS n FROM lookalikes
UNION ALL SELECT 'executing', count(DISTINCT same) FROM lookalikes"""))
def lookalike_counts(spark, sf_dir):
    return registry_summary(lookalike_queries(spark, sf_dir))


@named("wn1_sliding", sql("win180s", body="""
SELECT w_start, w_end, stream, count(value) AS n, max(value) AS max_value FROM win180s GROUP BY ALL"""))
def sliding(spark, sf_dir):
    aggs = [Agg("count", "value", "n"), Agg("max", "value", "max_value")]
    return windows.flat(windows.windowed(observations(spark, sf_dir), REPRESENTATIVE, aggs, ["stream"]))


@named("wn1_sliding_panes", sql("obs", body=f"""
SELECT w_start, w_end, property, {AVG2} AS avg_value, max(value) AS max_value, count(value) AS n
FROM ({windows_sql('obs', 'INTERVAL 24 HOUR', 'INTERVAL 1 HOUR', 24)}) GROUP BY ALL"""))
def sliding_panes(spark, sf_dir):
    aggs = [Agg("avg", "value", "avg_value", exact=2), Agg("max", "value", "max_value"), Agg("count", "value", "n")]
    spec = WindowSpec(24 * HOUR, HOUR)
    return windows.flat(windows.windowed(observations(spark, sf_dir), spec, aggs, ["property"], panes=True))


# Windows that end between two slides: two panes per slide.
@named("wn1_uneven_slide", sql("obs", body=f"""
SELECT w_start, w_end, property, count(value) AS n, max(value) AS max_value
FROM ({windows_sql('obs', 'INTERVAL 180000 MILLISECOND', 'INTERVAL 30001 MILLISECOND', 6)}) GROUP BY ALL"""))
def uneven_slide(spark, sf_dir):
    aggs = [Agg("count", "value", "n"), Agg("max", "value", "max_value")]
    return windows.flat(windows.windowed(observations(spark, sf_dir), WindowSpec(180_000, 30_001), aggs, ["property"]))


# 180,000 windows overlap. The result of each is there, in runs of equal neighbours; it is told by
# day to keep the answer short. The twin adds up the windows that each event is in.
@named("wn1_step_20ms", sql("obs", body="""
, held AS (SELECT property, value, (epoch_us(ts) - 3600000000) // 20000 + 1 AS low, epoch_us(ts) // 20000 AS high FROM obs),
days AS (SELECT property, value, d, greatest(low, d * 4320000) AS low, least(high, (d + 1) * 4320000 - 1) AS high
         FROM held, unnest(range(low // 4320000, high // 4320000 + 1)) AS u(d)),
fresh AS (SELECT *, high - greatest(low - 1, coalesce(max(high) OVER (
            PARTITION BY property, d ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), low - 1)) AS more FROM days)
SELECT TIMESTAMP '1970-01-01' + d::INT * INTERVAL 1 DAY AS day, property, sum(greatest(more, 0))::BIGINT AS n_windows,
       sum(high - low + 1)::BIGINT AS n, max(value) AS max_value
FROM fresh GROUP BY ALL"""))
def step_20ms(spark, sf_dir):
    aggs = [Agg("count", "value", "n"), Agg("max", "value", "max_value")]
    found = windows.flat(windows.windowed_runs(observations(spark, sf_dir), WindowSpec(HOUR, 20), aggs, ["property"]))
    day = F.date_trunc("day", "w_start").cast("timestamp_ntz").alias("day")
    return found.groupBy(day, "property").agg(
        F.sum("n_windows").alias("n_windows"), F.sum(F.col("n") * F.col("n_windows")).alias("n"), F.max("max_value").alias("max_value"))


# Each of 300 overlapping windows as a row of its own, for one property.
@named("wn1_step_20ms_rows", sql("obs", body=f"""
SELECT w_start, w_end, count(value) AS n, min(value) AS min_value
FROM ({windows_sql('obs', 'INTERVAL 6000 MILLISECOND', 'INTERVAL 20 MILLISECOND', 300)}) WHERE property = '{PURCHASE}' GROUP BY ALL"""))
def step_20ms_rows(spark, sf_dir):
    aggs = [Agg("count", "value", "n"), Agg("min", "value", "min_value")]
    bought = observations(spark, sf_dir).where(F.col("property") == PURCHASE)
    return windows.flat(windows.windowed(bought, WindowSpec(6000, 20), aggs))


@named("wn2_tumbling", sql("win1d", body=f"""
SELECT w_start, w_end, stream, {AVG2} AS avg_value FROM win1d GROUP BY ALL"""))
def tumbling(spark, sf_dir):
    rows = windows.windowed(observations(spark, sf_dir), DAILY, _one("avg", "avg_value", exact=2), ["stream"])
    return windows.flat(rows)


@named("wn3_hop_gap", sql("obs", body=f"""
SELECT w_start, w_end, property, count(value) AS n
FROM ({windows_sql('obs', 'INTERVAL 20 MINUTE', 'INTERVAL 1 HOUR', 1)}) GROUP BY ALL"""))
def hop_gap(spark, sf_dir):
    rows = windows.windowed(observations(spark, sf_dir), WindowSpec(HOUR // 3, HOUR), _one("count", "n"), ["property"])
    return windows.flat(rows)


def _six_hourly_max(spark, sf_dir):
    return windows.windowed(observations(spark, sf_dir), SIX_HOURLY, _one("max", "max_value"), ["property"])


_MAX6 = "a AS (SELECT w_start, w_end, property, max(value) AS max_value FROM win6h GROUP BY ALL)"


def _r2s_sql(body: str) -> str:
    return sql("win6h", body="").rstrip() + f", {_MAX6}\n{body}"


@named("wn4_rstream", _r2s_sql("SELECT * FROM a"))
def rstream(spark, sf_dir):
    return windows.flat(windows.r2s(_six_hourly_max(spark, sf_dir), SIX_HOURLY, "RStream"))


@named("wn5_istream", _r2s_sql("""
SELECT a.* FROM a WHERE NOT EXISTS (SELECT 1 FROM a b WHERE b.w_start = a.w_start - INTERVAL 1 HOUR
  AND b.property = a.property AND b.max_value = a.max_value)"""))
def istream(spark, sf_dir):
    return windows.flat(windows.r2s(_six_hourly_max(spark, sf_dir), SIX_HOURLY, "IStream"))


@named("wn6_dstream", _r2s_sql("""
SELECT a.w_start + INTERVAL 1 HOUR AS w_start, a.w_end + INTERVAL 1 HOUR AS w_end, a.property, a.max_value
FROM a WHERE NOT EXISTS (SELECT 1 FROM a b WHERE b.w_start = a.w_start + INTERVAL 1 HOUR
  AND b.property = a.property AND b.max_value = a.max_value)"""))
def dstream(spark, sf_dir):
    return windows.flat(windows.r2s(_six_hourly_max(spark, sf_dir), SIX_HOURLY, "DStream"))


@named("wn7_lookback", sql("obs", body="""
SELECT member_id, ts, value FROM obs
WHERE ts BETWEEN TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 48 HOUR AND TIMESTAMP '2024-01-20 12:00:00'"""))
def lookback(spark, sf_dir):
    rows = windows.lookback(observations(spark, sf_dir), 48 * HOUR, at("2024-01-20 12:00:00"))
    return rows.select("member_id", "ts", "value")


@named("wn8_ordinal_batch", sql("results", body="""
SELECT query_hash, event_id,
       row_number() OVER (PARTITION BY query_hash ORDER BY emitted_at, event_id) - 1 AS ordinal,
       CAST(floor((row_number() OVER (PARTITION BY query_hash ORDER BY emitted_at, event_id) - 1) / 20) AS BIGINT) AS batch
FROM results"""))
def ordinal_batch(spark, sf_dir):
    results = stored(result_table(spark, sf_dir), "results")
    rows = ordering.ordinal_batch(results, ["query_hash"], 20, "emitted_at", ["event_id"])
    return rows.select("query_hash", "event_id", "ordinal", "batch")


def rebalance_sql(rows: str, size: int) -> str:
    """`rows` with `new_bucket`, by the boundary rows of each bucket and as-of."""
    return f"""
  WITH placed AS (SELECT *, row_number() OVER (PARTITION BY stream, bucket ORDER BY ts, seq) - 1 AS place FROM {rows}),
  starts AS (SELECT stream, bucket, ts AS start_ts FROM placed WHERE place > 0 AND place % {size} = 0),
  moved AS (
    SELECT p.member_id, p.stream, p.bucket, max(s.start_ts) AS start_ts
    FROM placed p LEFT JOIN starts s ON s.stream = p.stream AND s.bucket = p.bucket AND s.start_ts <= p.ts
    GROUP BY ALL)
  SELECT member_id, bucket AS old_bucket,
         CASE WHEN start_ts IS NULL THEN bucket
              ELSE regexp_replace(bucket, '[^/]*/[^/]*$', '') || CAST((epoch_us(start_ts) // 1000) AS VARCHAR) || '/' END AS bucket
  FROM moved"""


@named("wn9_rebalance", sql("bucketed", body=f"SELECT * FROM ({rebalance_sql('bucketed', 20)})"))
def rebalance(spark, sf_dir):
    rows = buckets.rebalance(day_buckets(observations(spark, sf_dir)), 20)
    return rows.select("member_id", "old_bucket", "bucket")


@named("wn10_idle_periods", sql("obs", body="""
, marked AS (SELECT stream, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL
             THEN 1 ELSE 0 END AS fresh FROM obs WINDOW w AS (PARTITION BY stream ORDER BY ts)),
numbered AS (SELECT stream, ts, sum(fresh) OVER (PARTITION BY stream ORDER BY ts) AS no FROM marked)
SELECT stream, min(ts) AS active_from, max(ts) + INTERVAL 30 MINUTE AS idle_from, count(*) AS n
FROM numbered GROUP BY stream, no"""))
def idle_periods(spark, sf_dir):
    return windows.idle_periods(observations(spark, sf_dir), 1_800_000, ["stream"])


@named("so1_sort_events", sql("obs", body="SELECT member_id, ts, seq FROM obs ORDER BY ts, seq"))
def sort_events(spark, sf_dir):
    return ordering.sort_events(observations(spark, sf_dir)).select("member_id", "ts", "seq")


@named("so2_sort_strings", sql("obs", body="SELECT member_id FROM obs ORDER BY member_id"))
def sort_strings(spark, sf_dir):
    return ordering.sort_strings(observations(spark, sf_dir).select("member_id"), "member_id")


@named("so3_earliest_event", sql("obs", body="""
SELECT stream, member_id, ts, value FROM obs
QUALIFY row_number() OVER (PARTITION BY stream ORDER BY ts, seq) = 1"""))
def earliest_event(spark, sf_dir):
    return ordering.earliest(observations(spark, sf_dir), ["member_id", "ts", "value"], ["stream"])


@named("so4_drain_sorted", sql("obs", body="""
SELECT stream, member_id, ts, row_number() OVER (PARTITION BY stream ORDER BY ts, seq) - 1 AS ordinal FROM obs"""))
def drain_sorted(spark, sf_dir):
    """Replay order as a column: the place of each event in its stream."""
    return ordering.positions(observations(spark, sf_dir), ["stream"]).select("stream", "member_id", "ts", "ordinal")


@named("so5_sort_in_bucket", sql("bucketed", body="SELECT bucket, member_id, ts FROM bucketed ORDER BY bucket, ts, seq"))
def sort_in_bucket(spark, sf_dir):
    rows = ordering.sort_in_bucket(day_buckets(observations(spark, sf_dir)), ["bucket"])
    return rows.select("bucket", "member_id", "ts")


@named("so6_first_match", sql("type_index", body="""
SELECT pod, coalesce(arg_min(o, seq) FILTER (WHERE p = 'http://www.w3.org/ns/solid/terms#publicTypeIndex'), '')
  AS first_object FROM type_index GROUP BY pod"""))
def first_match(spark, sf_dir):
    from tidemark.model import PUBLIC_TYPE_INDEX

    return ordering.first_object(type_index(spark, sf_dir), PUBLIC_TYPE_INDEX, ["pod"])


_SPO = ["s", "p", "o"]


@named("st1_insert_data", sql("triples", body=f"""
SELECT s, p, o FROM triples WHERE ts < TIMESTAMP '2024-01-20 00:00:00'
UNION SELECT s, p, o FROM triples WHERE ts >= TIMESTAMP '2024-01-10 00:00:00'"""))
def insert_data(spark, sf_dir):
    rows = triples(spark, sf_dir)
    old = rows.where(F.col("ts") < at("2024-01-20 00:00:00")).select(*_SPO)
    return triplesets.insert_data(old, rows.where(F.col("ts") >= at("2024-01-10 00:00:00")).select(*_SPO))


@named("st2_delete_data", sql("triples", body=f"""
SELECT s, p, o, o_datatype FROM triples EXCEPT SELECT s, p, o, o_datatype FROM triples WHERE p = '{RELATES_TO_PROPERTY}'"""))
def delete_data(spark, sf_dir):
    rows = triples(spark, sf_dir)
    gone = rows.where(F.col("p") == RELATES_TO_PROPERTY).select(*_SPO, "o_datatype")
    return triplesets.delete_data(rows, gone)


_INBOX = "http://www.w3.org/ns/ldp#inbox"


@named("st3_replace_pointer", sql("noon", body=f"""
SELECT stream AS s, '{_INBOX}' AS p, max_by(node, value) AS o FROM noon GROUP BY stream
UNION SELECT stream, 'http://www.w3.org/ns/ldp#contains', node FROM noon"""))
def replace_pointer(spark, sf_dir):
    index = noon_index(observations(spark, sf_dir))
    held = index.select(F.col("stream").alias("s"), F.inline(F.array(
        F.struct(F.lit(_INBOX).alias("p"), F.col("node").alias("o")),
        F.struct(F.lit("http://www.w3.org/ns/ldp#contains").alias("p"), F.col("node").alias("o")),
    )))
    newest = index.groupBy(F.col("stream").alias("s")).agg(F.max_by("node", "value").alias("o"))
    return triplesets.replace_pointer(held, _INBOX, newest.select("s", F.lit(_INBOX).alias("p"), "o"))


@named("st4_dedup_triples", sql("triples", body="SELECT DISTINCT member_id, s, p, o, o_type FROM triples"))
def dedup(spark, sf_dir):
    rows = triples(spark, sf_dir)
    twice = rows.unionByName(rows.where(F.col("o_type") == "literal"))
    return dedup_triples(twice).select("member_id", "s", "p", "o", "o_type")


@named("st5_dedup_queries", sql("hashed", body="""
SELECT query_id, query_hash, registered_at, CAST(2 AS BIGINT) AS registrations FROM hashed WHERE variant = 0"""))
def unique_queries(spark, sf_dir):
    return dedup_queries(query_table(spark, sf_dir))


@named("st5_dedup_lookalikes", sql("lookalikes", body=r"""
SELECT arg_min(query_id, registered_at) AS query_id,
       md5(regexp_replace(arg_min(query_text, registered_at), '\s', '', 'g')) AS query_hash,
       min(registered_at) AS registered_at, count(*) AS registrations
FROM lookalikes GROUP BY same"""))
def unique_lookalikes(spark, sf_dir):
    """Queries that differ in a prefix, in which variable is which, in the white space of a
    literal, or in how symmetric patterns hang together; next to rewordings of the same."""
    return dedup_queries(lookalike_queries(spark, sf_dir))


@named("st6_subscribe", sql("subscriptions", body="""
SELECT query_hash, client_id, count(*) AS n FROM (
  SELECT * FROM subscriptions UNION ALL SELECT * FROM subscriptions WHERE client_id < 'client5') GROUP BY ALL"""))
def subscribe(spark, sf_dir):
    known = subscriptions(spark, sf_dir)
    again = triplesets.subscribe(known, known.where(F.col("client_id") < "client5"))
    return again.groupBy("query_hash", "client_id").agg(F.count(F.lit(1)).alias("n"))
