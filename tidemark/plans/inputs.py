"""The tables the named queries start from: derived by Spark from `events`, next to the same
derivation in SQL.

Every event is kept. Users are spread over eight streams; an event is one observation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import epoch_ms, query_hash
from tidemark.model import (
    Agg,
    HAS_TIMESTAMP,
    HAS_VALUE,
    MEASUREMENT,
    PUBLIC_TYPE_INDEX,
    RDF_TYPE,
    RELATES_TO_PROPERTY,
    TREE_VIEW,
    WindowSpec,
    XSD_DATETIME,
    XSD_FLOAT,
)
from tidemark.operators.patterns import to_triples
from tidemark.operators.windows import windowed
from tidemark.session import prepare
from tidemark.sinks.results import result_events

HOUR = 3_600_000
SIX_HOURLY = WindowSpec(6 * HOUR, HOUR)
DAILY = WindowSpec(24 * HOUR, 24 * HOUR)
REPRESENTATIVE = WindowSpec(180_000, 30_000)
SENSOR = "http://sensor.example/"
# As a pattern, which a live source takes whether the table is one file or a folder of files.
LIVE_EVENTS = "{}/{{events.parquet}}"
STREAMS = 8
AGGS = [
    Agg("max", "value", "max_value"),
    Agg("min", "value", "min_value"),
    Agg("avg", "value", "avg_value", exact=2),
]


def at(text: str) -> Column:
    """A zone-less point in time; compares with event times without casting them."""
    return F.lit(text).cast("timestamp_ntz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def stream_of_user() -> Column:
    hub = F.pmod("user_id", F.lit(STREAMS)).cast("string")
    return F.concat(F.lit("http://pod.example/p"), hub, F.lit("/log/"))


def as_observations(events: DataFrame) -> DataFrame:
    return events.select(
        stream_of_user().alias("stream"),
        F.concat(F.lit("http://pod.example/e"), F.col("event_id").cast("string")).alias("member_id"),
        F.col("event_id").alias("seq"),
        "ts",
        F.concat(F.lit(SENSOR), "event_type").alias("property"),
        "value",
    )


def observations(spark, sf_dir) -> DataFrame:
    return as_observations(table(spark, sf_dir, "events"))


def triples(spark, sf_dir) -> DataFrame:
    return to_triples(observations(spark, sf_dir))


def noon_index(obs: DataFrame) -> DataFrame:
    """A bucket per stream and day that starts at noon; what comes before the first has none."""
    noon = F.date_trunc("day", "ts").cast("timestamp_ntz") + F.expr("INTERVAL '12' HOUR")
    return obs.select("stream", noon.alias("value")).distinct().select(
        "stream",
        F.concat("stream", epoch_ms("value").cast("string"), F.lit("/")).alias("node"),
        F.lit(HAS_TIMESTAMP).alias("path"),
        "value",
    )


def day_buckets(obs: DataFrame) -> DataFrame:
    """Observations with `bucket`, the URL of their stream's day."""
    day = F.date_trunc("day", "ts").cast("timestamp_ntz")
    return obs.withColumn("bucket", F.concat("stream", epoch_ms(day).cast("string"), F.lit("/")))


def result_table(spark, sf_dir, spec: WindowSpec = SIX_HOURLY, aggs=AGGS) -> DataFrame:
    """Results of one continuous query per (stream, property)."""
    obs = observations(spark, sf_dir)
    rows = windowed(obs, spec, aggs, ["stream", "property"])
    return result_events(
        rows, [a.out for a in aggs], F.md5(F.concat_ws("|", "stream", "property")),
        F.array("stream"), ["stream", "property"],
    )


def subscriptions(spark, sf_dir) -> DataFrame:
    """Clients of the queries, for all properties but one."""
    events = table(spark, sf_dir, "events").where(F.col("event_type") != "error")
    property_ = F.concat(F.lit(SENSOR), "event_type")
    client = F.pmod("user_id", F.lit(100)).cast("string")
    return events.select(
        F.md5(F.concat_ws("|", stream_of_user(), property_)).alias("query_hash"),
        F.concat(F.lit("client"), client).alias("client_id"),
    ).distinct()


def type_index(spark, sf_dir) -> DataFrame:
    """One pod per user: which metrics its streams carry, and where their views are."""
    pods = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first"))
    pod = F.concat(F.lit("http://pod.example/u"), F.col("user_id").cast("string"), F.lit("/"))
    entry = F.concat(pod, F.lit("settings#"), "event_type")

    def row(s, p, o, k):
        return F.struct(pod.alias("pod"), s.alias("s"), F.lit(p).alias("p"), o.alias("o"),
                        (F.col("first") * 4 + k).alias("seq"))

    rows = F.array(
        row(entry, RELATES_TO_PROPERTY, F.concat(F.lit(SENSOR), "event_type"), 0),
        row(entry, TREE_VIEW, F.concat(pod, "event_type", F.lit("/")), 1),
    )
    listed = F.when(F.col("event_type") == "click", F.array(
        row(F.concat(pod, F.lit("profile/card#me")), PUBLIC_TYPE_INDEX, F.concat(pod, F.lit("settings/i"), "event_type"), 2)
    )).otherwise(F.array().cast(rows_type()))
    return pods.select(F.inline(F.concat(rows, listed)))


def rows_type() -> str:
    return "array<struct<pod:string,s:string,p:string,o:string,seq:bigint>>"


# One query per user and event type, written in two ways.
PLAIN = """PREFIX saref: <https://saref.etsi.org/core/>
PREFIX sensor: <http://sensor.example/>
PREFIX : <http://window.example/>
REGISTER RStream <out@user@> AS
SELECT (@fn@(?o) AS ?x@fn@)
FROM NAMED WINDOW :w1 ON STREAM <http://pod.example/u@user@/> [RANGE @width@ STEP @slide@]
WHERE {
    WINDOW :w1 {
        ?s saref:hasValue ?o .
        ?s saref:relatesToProperty sensor:@prop@ .
    }
}"""
REWORDED = """
  PREFIX s: <https://saref.etsi.org/core/>
  PREFIX m: <http://sensor.example/>
  PREFIX : <http://window.example/>

  REGISTER RStream <out@user@> AS
  SELECT (@fn@(?val)   as ?y@fn@)
  FROM NAMED WINDOW :win ON STREAM <http://pod.example/u@user@/> [RANGE @width@ STEP @slide@]
  WHERE {
    WINDOW :win { ?e s:relatesToProperty m:@prop@ . ?e s:hasValue ?val . }
  }"""
FIELDS = {"user": "user_text", "fn": "fn", "width": "width_text", "slide": "slide_text", "prop": "event_type"}


_HEAD = """PREFIX saref: <https://saref.etsi.org/core/>
PREFIX @PREFIX@
REGISTER RStream <out@user@> AS SELECT @SELECT@
FROM NAMED WINDOW <http://window.example/w> ON STREAM <http://pod.example/u@user@/@prop@/> [RANGE @width@ STEP @slide@]
WHERE { WINDOW <http://window.example/w> { @BODY@ } } @REST@"""


def _query(select: str, body: str, prefix: str = "ex: <http://one.example/>", rest: str = "") -> str:
    return (_HEAD.replace("@PREFIX@", prefix).replace("@SELECT@", select).replace("@BODY@", body)
            .replace("@REST@", rest).strip())


def _ring(*sizes: int) -> str:
    """Rings of variables, each tied to the next: alike for every node that is looked at alone."""
    starts = [sum(sizes[:i]) for i in range(len(sizes))]
    return " . ".join(f"?v{a + i} saref:isPartOf ?v{a + (i + 1) % n}" for a, n in zip(starts, sizes) for i in range(n))


# Queries that look alike: those with one number are the same query, and no others.
LOOKALIKES = [
    (0, _query("(AVG(?o) AS ?x)", "?s saref:hasValue ?o . FILTER(?s = ex:a)")),
    (0, _query("(AVG(?m) AS ?y)", "FILTER ( ?z = <http://one.example/a> ) ?z saref:hasValue ?m", "b: <http://two.example/>")),
    (1, _query("(AVG(?o) AS ?x)", "?s saref:hasValue ?o . FILTER(?s = ex:a)", "ex: <http://two.example/>")),
    (2, _query("(AVG(?a) AS ?x)", "?s saref:hasValue ?a ; saref:hasWeight ?b . FILTER(?a > 5)")),
    (2, _query("(AVG(?b) AS ?x)", "?s saref:hasWeight ?a . # the other way round\n ?s saref:hasValue ?b . FILTER(?b > 5)")),
    (3, _query("(AVG(?b) AS ?x)", "?s saref:hasValue ?b ; saref:hasWeight ?a . FILTER(?a > 5)")),
    (4, _query("(MAX(?o) AS ?x)", "?s saref:hasValue ?o ; saref:hasUnit ?u . FILTER(?u = \"a b\")")),
    (5, _query("(MAX(?o) AS ?x)", "?s saref:hasValue ?o ; saref:hasUnit ?u . FILTER(?u = \"ab\")")),
    (6, _query("(COUNT(*) AS ?n)", "?s a saref:Measurement , ex:@prop@ .", rest="GROUP BY ?s HAVING (?n > 3)")),
    (6, _query("(count(*) as ?k)", "?q a ex:@prop@ . ?q a saref:Measurement", rest="group by ?q having (?k > 3)")),
    (7, _query("(COUNT(?s) AS ?n)", "?s a saref:Measurement , ex:@prop@ .", rest="GROUP BY ?s HAVING (?n > 3)")),
    (8, _query("(COUNT(?v0) AS ?n)", _ring(6))),
    (8, _query("(COUNT(?v4) AS ?n)", _ring(6))),
    (9, _query("(COUNT(?v0) AS ?n)", _ring(3, 3))),
    (10, _query("(COUNT(*) AS ?n)", _ring(6))),
    (11, _query("(COUNT(*) AS ?n)", _ring(3, 3))),
]


def _pieces(template: str) -> list[tuple[bool, str]]:
    return [(i % 2 == 1, part) for i, part in enumerate(template.split("@")) if part]


def fill(template: str) -> Column:
    return F.concat(*[F.col(FIELDS[t]) if is_field else F.lit(t) for is_field, t in _pieces(template)])


def fill_sql(template: str) -> str:
    return " || ".join(FIELDS[t] if is_field else f"'{t}'" for is_field, t in _pieces(template))


FUNCTION_SQL = (
    "CASE event_type WHEN 'click' THEN 'MAX' WHEN 'view' THEN 'MIN' WHEN 'signup' THEN 'AVG' "
    "WHEN 'purchase' THEN 'SUM' ELSE 'COUNT' END"
)
TYPE_NO_SQL = (
    "CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'signup' THEN 3 "
    "WHEN 'purchase' THEN 4 ELSE 5 END"
)


def query_table(spark, sf_dir) -> DataFrame:
    """`query_id, query_text, registered_at` and what the text was made of."""
    made = (
        table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("ts").alias("registered_at"))
        .withColumns({
            "fn": F.expr(FUNCTION_SQL),
            "user_text": F.col("user_id").cast("string"),
            "width": F.when(F.col("user_id") > 50, F.lit(180000)).otherwise(F.lit(800)).cast("bigint"),
            "slide": F.when(F.col("user_id") > 50, F.lit(30000)).otherwise(F.lit(100)).cast("bigint"),
            "query_no": (F.col("user_id") * 10 + F.expr(TYPE_NO_SQL)).cast("bigint"),
        })
        .withColumns({"width_text": F.col("width").cast("string"), "slide_text": F.col("slide").cast("string")})
    )
    variants = F.array(
        F.struct(F.lit(0).cast("bigint").alias("variant"), fill(PLAIN).alias("query_text")),
        F.struct(F.lit(1).cast("bigint").alias("variant"), fill(REWORDED).alias("query_text")),
    )
    hour = F.expr("INTERVAL '1' HOUR")
    return made.select(
        "user_id", "event_type", "fn", "width", "slide", "query_no", "registered_at", F.inline(variants)
    ).select(
        (F.col("query_no") * 10 + F.col("variant")).alias("query_id"), "query_text",
        F.when(F.col("variant") == 1, F.col("registered_at") + hour).otherwise(F.col("registered_at"))
        .alias("registered_at"),
        "user_id", "event_type", "fn", "width", "slide", "variant",
    )


def lookalike_queries(spark, sf_dir) -> DataFrame:
    """`query_id, query_text, registered_at`: per user and event type all of LOOKALIKES, an hour apart."""
    rows = query_table(spark, sf_dir).where(F.col("variant") == 0).select(
        F.col("query_id").alias("_of"), F.col("registered_at").alias("_first"), "event_type", "fn",
        *[F.col(c).cast("string").alias(n) for c, n in (("user_id", "user_text"), ("width", "width_text"), ("slide", "slide_text"))])
    texts = F.array(*[F.struct(F.lit(i).alias("_no"), fill(text).alias("query_text")) for i, (_, text) in enumerate(LOOKALIKES)])
    # Reading a text costs far more than its bytes suggest: spread by cores, not by size.
    rows = rows.repartition(spark.sparkContext.defaultParallelism)
    return rows.select("_of", "_first", F.inline(texts)).select(
        (F.col("_of") * 100 + F.col("_no")).cast("bigint").alias("query_id"), "query_text",
        (F.col("_first") + F.make_dt_interval(hours=F.col("_no"))).alias("registered_at"))


def hashed_queries(spark, sf_dir) -> DataFrame:
    return query_table(spark, sf_dir).withColumn("query_hash", query_hash("query_text"))


# The same in SQL. ---------------------------------------------------------------------


def iso_sql(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%dT%H:%M:%S.%gZ')"


def windows_sql(rows: str, width: str, slide: str, overlap: int) -> str:
    """Rows of `rows` with the bounds of each window they fall in."""
    return f"""
  SELECT * FROM (
    SELECT r.*, time_bucket({slide}, ts, TIMESTAMP '1970-01-01') - k * {slide} AS w_start,
           time_bucket({slide}, ts, TIMESTAMP '1970-01-01') - k * {slide} + {width} AS w_end
    FROM {rows} r, range({overlap}) ks(k)
  ) WHERE ts < w_end"""


SUM2 = "CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE)"
AVG2 = f"{SUM2} / (count(value) * 100)"

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def _cte(name: str, body: str, *needs: str) -> None:
    CTES[name] = (needs, body)


_cte("obs", f"""
  SELECT 'http://pod.example/p' || CAST(user_id % {STREAMS} AS VARCHAR) || '/log/' AS stream,
         'http://pod.example/e' || CAST(event_id AS VARCHAR) AS member_id,
         event_id AS seq, ts, '{SENSOR}' || event_type AS property, value
  FROM events""")
_cte("triples", f"""
  SELECT stream, member_id, ts, member_id AS s, '{RDF_TYPE}' AS p, '{MEASUREMENT}' AS o,
         'iri' AS o_type, CAST(NULL AS VARCHAR) AS o_datatype, CAST(NULL AS VARCHAR) AS o_lang FROM obs
  UNION ALL SELECT stream, member_id, ts, member_id, '{HAS_TIMESTAMP}', {iso_sql('ts')},
         'literal', '{XSD_DATETIME}', NULL FROM obs
  UNION ALL SELECT stream, member_id, ts, member_id, '{HAS_VALUE}', CAST(value AS VARCHAR),
         'literal', '{XSD_FLOAT}', NULL FROM obs
  UNION ALL SELECT stream, member_id, ts, member_id, '{RELATES_TO_PROPERTY}', property,
         'iri', NULL, NULL FROM obs""", "obs")
_cte("noon", f"""
  SELECT stream, stream || CAST((epoch_us(value) // 1000) AS VARCHAR) || '/' AS node,
         '{HAS_TIMESTAMP}' AS path, value
  FROM (SELECT DISTINCT stream, CAST(date_trunc('day', ts) AS TIMESTAMP) + INTERVAL 12 HOUR AS value FROM obs)""", "obs")
_cte("bucketed", """
  SELECT *, stream || CAST((epoch_us(CAST(date_trunc('day', ts) AS TIMESTAMP)) // 1000) AS VARCHAR) || '/' AS bucket FROM obs""", "obs")


def _results_sql(windows: str) -> str:
    rows = f"""SELECT w_start, w_end, stream, property, max(value) AS max_value, min(value) AS min_value,
                 {AVG2} AS avg_value FROM {windows} GROUP BY ALL"""
    one = "SELECT w_start, w_end, stream, property, '{0}' AS var, {0} AS value FROM a"
    union = " UNION ALL ".join(one.format(v) for v in ("max_value", "min_value", "avg_value"))
    return f"""
  SELECT 'http://example.org/aggregation_event/' || sha256(
           md5(stream || '|' || property) || '|' || var || '|' || stream || '|' || property || '|' || CAST(w_start AS VARCHAR)
         ) AS event_id,
         md5(stream || '|' || property) AS query_hash, stream, property, var, value, w_end AS emitted_at,
         w_start AS started_at, w_end AS ended_at, 'http://example.org/aggregator/service' AS derived_from
  FROM (WITH a AS ({rows}) {union})"""


_cte("win6h", windows_sql("obs", "INTERVAL 6 HOUR", "INTERVAL 1 HOUR", 6), "obs")
_cte("win1d", windows_sql("obs", "INTERVAL 24 HOUR", "INTERVAL 24 HOUR", 1), "obs")
_cte("win180s", windows_sql("obs", "INTERVAL 180 SECOND", "INTERVAL 30 SECOND", 6), "obs")
_cte("results", _results_sql("win6h"), "win6h")
_cte("daily_results", _results_sql("win1d"), "win1d")
_cte("subscriptions", f"""
  SELECT DISTINCT md5('http://pod.example/p' || CAST(user_id % {STREAMS} AS VARCHAR) || '/log/|{SENSOR}' || event_type)
           AS query_hash, 'client' || CAST(user_id % 100 AS VARCHAR) AS client_id
  FROM events WHERE event_type <> 'error'""")
_cte("type_index", f"""
  SELECT pod, pod || 'settings#' || event_type AS s, '{RELATES_TO_PROPERTY}' AS p, '{SENSOR}' || event_type AS o,
         first * 4 AS seq FROM pods
  UNION ALL SELECT pod, pod || 'settings#' || event_type, '{TREE_VIEW}', pod || event_type || '/', first * 4 + 1 FROM pods
  UNION ALL SELECT pod, pod || 'profile/card#me', '{PUBLIC_TYPE_INDEX}', pod || 'settings/i' || event_type, first * 4 + 2
  FROM pods WHERE event_type = 'click'""", "pods")
_cte("pods", """
  SELECT 'http://pod.example/u' || CAST(user_id AS VARCHAR) || '/' AS pod, event_type, min(event_id) AS first
  FROM events GROUP BY ALL""")
_cte("made", f"""
  SELECT *, CAST(width AS VARCHAR) AS width_text, CAST(slide AS VARCHAR) AS slide_text FROM (
    SELECT user_id, event_type, min(ts) AS registered_at, {FUNCTION_SQL} AS fn, CAST(user_id AS VARCHAR) AS user_text,
           CAST(CASE WHEN user_id > 50 THEN 180000 ELSE 800 END AS BIGINT) AS width,
           CAST(CASE WHEN user_id > 50 THEN 30000 ELSE 100 END AS BIGINT) AS slide,
           CAST(user_id * 10 + {TYPE_NO_SQL} AS BIGINT) AS query_no
    FROM events GROUP BY user_id, event_type)""")
_cte("queries", f"""
  SELECT query_no * 10 AS query_id, {fill_sql(PLAIN)} AS query_text, registered_at,
         user_id, event_type, fn, width, slide, CAST(0 AS BIGINT) AS variant FROM made
  UNION ALL
  SELECT query_no * 10 + 1, {fill_sql(REWORDED)}, registered_at + INTERVAL 1 HOUR,
         user_id, event_type, fn, width, slide, CAST(1 AS BIGINT) FROM made""", "made")
_cte("lookalikes", "\nUNION ALL\n".join(
    f"SELECT query_no * 1000 + {i} AS query_id, {fill_sql(text)} AS query_text, registered_at + INTERVAL {i} HOUR AS registered_at, "
    f"query_no * 100 + {of} AS same FROM made" for i, (of, text) in enumerate(LOOKALIKES)), "made")
_cte("hashed", r"SELECT *, md5(regexp_replace(query_text, '\s', '', 'g')) AS query_hash FROM queries", "queries")


def sql(*needs: str, body: str) -> str:
    """`body` behind the named derivations and what they build on."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in CTES[name][0]:
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in needs:
        add(name)
    parts = ", ".join(f"{name} AS ({CTES[name][1]})" for name in ordered)
    return f"WITH {parts}\n{body}" if parts else body
