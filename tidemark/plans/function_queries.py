"""Named queries over the column expressions and the query catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import functions as fn
from tidemark.operators.registry import query_catalog, retarget
from tidemark.plans.inputs import (
    LOOKALIKES, day_buckets, iso_sql, lookalike_queries, noon_index, observations, query_table, result_table, sql, table,
)
from tidemark.plans.named import named


_SPACES = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


@named("sc1_query_hash", f"""
SELECT doc_id, md5(regexp_replace(text, '{_SPACES}', '', 'g')) AS text_hash FROM documents""")
def query_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", fn.query_hash("text").alias("text_hash"))


@named("sc2_bucket_url_child", sql("obs", body="""
SELECT member_id, regexp_replace(stream, '[^/]*$', '') || CAST((epoch_us(ts) // 1000) AS VARCHAR) || '/' AS url,
       'none' AS no_url FROM obs"""))
def bucket_url_child(spark, sf_dir):
    ms = fn.epoch_ms("ts")
    return observations(spark, sf_dir).select(
        "member_id", fn.bucket_url_child("stream", ms).alias("url"),
        fn.bucket_url_child(F.lit("urn:log/"), ms).alias("no_url"),
    )


@named("sc3_bucket_url_sibling", sql("bucketed", body="""
SELECT member_id, stream || CAST((epoch_us(ts) // 1000) AS VARCHAR) || '/' AS url FROM bucketed"""))
def bucket_url_sibling(spark, sf_dir):
    rows = day_buckets(observations(spark, sf_dir))
    return rows.select("member_id", fn.bucket_url_sibling("bucket", fn.epoch_ms("ts")).alias("url"))


@named("sc4_stream_of_inbox", sql("bucketed", body="SELECT member_id, stream AS inbox_of FROM bucketed"))
def stream_of_inbox(spark, sf_dir):
    rows = day_buckets(observations(spark, sf_dir))
    return rows.select("member_id", fn.stream_of_inbox("bucket").alias("inbox_of"))


@named("sc5_epoch_ms", sql("obs", body="SELECT member_id, (epoch_us(ts) // 1000) AS ms, (epoch_us(ts) // 1000) AS ms_of_text FROM obs"))
def epoch_ms(spark, sf_dir):
    return observations(spark, sf_dir).select(
        "member_id", fn.epoch_ms("ts").alias("ms"), fn.epoch_ms(fn.iso_ms("ts")).alias("ms_of_text")
    )


@named("sc6_iso_ms", sql("obs", body=f"SELECT member_id, {iso_sql('ts')} AS iso FROM obs"))
def iso_ms(spark, sf_dir):
    return observations(spark, sf_dir).select("member_id", fn.iso_ms("ts").alias("iso"))


@named("sc7_expand_iri", """
SELECT event_id,
  'http://sensor.example/' || event_type AS named, 'http://x.example/' || event_type AS whole,
  '' AS unknown, 'https://saref.etsi.org/core/' || event_type AS cut, '' AS bare
FROM events""")
def expand_iri(spark, sf_dir):
    prefixes = F.create_map(
        F.lit("sensor"), F.lit("http://sensor.example/"), F.lit("saref"), F.lit("https://saref.etsi.org/core/")
    )

    def made(before: str, after: str = ""):
        return fn.expand_iri(F.concat(F.lit(before), "event_type", F.lit(after)), prefixes)

    return table(spark, sf_dir, "events").select(
        "event_id", made("sensor:").alias("named"), made(" <http://x.example/", "> ").alias("whole"),
        made("other:").alias("unknown"), made("saref:", ":tail").alias("cut"), made("").alias("bare"),
    )


@named("sc8_storage_root", sql("obs", body="SELECT member_id, 'http://pod.example' AS root FROM obs"))
def storage_root(spark, sf_dir):
    return observations(spark, sf_dir).select("member_id", fn.storage_root("stream").alias("root"))


@named("sc9_meta_url", sql("bucketed", body="""
SELECT member_id, 'http://pod.example/.meta' AS member_meta, bucket || '.meta' AS bucket_meta FROM bucketed"""))
def meta_url(spark, sf_dir):
    rows = day_buckets(observations(spark, sf_dir))
    return rows.select(
        "member_id", fn.meta_url("member_id").alias("member_meta"), fn.meta_url("bucket").alias("bucket_meta")
    )


@named("sc10_retarget_query", sql("queries", body=r"""
, moved AS (
  SELECT query_id, replace(query_text, 'http://pod.example/u' || CAST(user_id AS VARCHAR) || '/',
         'http://pod.example/u' || CAST(user_id AS VARCHAR) || '/' || event_type || '/') AS query_text FROM queries)
SELECT query_id, md5(regexp_replace(query_text, '\s', '', 'g')) AS query_hash, query_text FROM moved"""))
def retarget_query(spark, sf_dir):
    pod = F.concat(F.lit("http://pod.example/u"), F.col("user_id").cast("string"), F.lit("/"))
    rows = retarget(query_table(spark, sf_dir), pod, F.concat(pod, "event_type", F.lit("/")))
    return rows.select("query_id", "query_hash", "query_text")


@named("sc11_event_iri", sql("results", body="SELECT event_id, query_hash, var, started_at FROM results"))
def event_iri(spark, sf_dir):
    return result_table(spark, sf_dir).select("event_id", "query_hash", "var", "started_at")


@named("sc12_bucket_ts_of_url", sql("noon", body="SELECT node, (epoch_us(value) // 1000) AS bucket_ts FROM noon"))
def bucket_ts_of_url(spark, sf_dir):
    index = noon_index(observations(spark, sf_dir))
    return index.select("node", fn.bucket_ts_of_url("node").alias("bucket_ts"))


@named("sc13_is_container", sql("bucketed", body="""
SELECT member_id, bucket LIKE '%/' AS bucket_is, member_id LIKE '%/' AS member_is FROM bucketed"""))
def is_container(spark, sf_dir):
    rows = day_buckets(observations(spark, sf_dir))
    return rows.select(
        "member_id", fn.is_container("bucket").alias("bucket_is"), fn.is_container("member_id").alias("member_is")
    )


@named("sc14_query_catalog", sql("hashed", body="""
SELECT query_id, query_hash, 'RStream' AS r2s_operator, 'out' || CAST(user_id AS VARCHAR) AS r2s_name,
       CAST(3 AS BIGINT) AS n_prefixes,
       'http://window.example/' || CASE variant WHEN 0 THEN 'w1' ELSE 'win' END AS window_name,
       'http://pod.example/u' || CAST(user_id AS VARCHAR) || '/' AS stream, width, slide,
       lower(fn) AS func, CASE variant WHEN 0 THEN 'o' ELSE 'val' END AS var,
       CASE variant WHEN 0 THEN 'x' ELSE 'y' END || fn AS alias,
       CAST(2 AS BIGINT) AS n_patterns
FROM hashed"""))
def catalog(spark, sf_dir):
    rows = query_catalog(query_table(spark, sf_dir).select("query_id", "query_text"))
    window, agg = F.get("windows", F.lit(0)), F.get("aggregates", F.lit(0))
    return rows.select(
        "query_id", "query_hash", "r2s_operator", "r2s_name",
        F.size("prefixes").cast("bigint").alias("n_prefixes"),
        window["name"].alias("window_name"), window["stream"].alias("stream"),
        window["width"].alias("width"), window["slide"].alias("slide"),
        agg["func"].alias("func"), agg["var"].alias("var"), agg["alias"].alias("alias"),
        F.size("patterns").cast("bigint").alias("n_patterns"),
    )


@named("sc14_query_patterns", sql("queries", body="""
SELECT query_id, CASE variant WHEN 0 THEN '?s' ELSE '?e' END AS s, 'https://saref.etsi.org/core/hasValue' AS p,
       CASE variant WHEN 0 THEN '?o' ELSE '?val' END AS o FROM queries
UNION ALL
SELECT query_id, CASE variant WHEN 0 THEN '?s' ELSE '?e' END, 'https://saref.etsi.org/core/relatesToProperty',
       'http://sensor.example/' || event_type FROM queries"""))
def patterns(spark, sf_dir):
    from tidemark.operators.registry import catalog_patterns

    rows = catalog_patterns(query_catalog(query_table(spark, sf_dir)))
    return rows.select("query_id", "s", "p", "o")


def _pieces_sql() -> str:
    """What the catalogue must find in each of LOOKALIKES, counted by hand: patterns, filters,
    grouping, a condition on groups, and the aggregate."""
    found = [(1, 1, 0, False, "avg", "o"), (1, 1, 0, False, "avg", "m"), (1, 1, 0, False, "avg", "o"), (2, 1, 0, False, "avg", "a"),
             (2, 1, 0, False, "avg", "b"), (2, 1, 0, False, "avg", "b"), (2, 1, 0, False, "max", "o"), (2, 1, 0, False, "max", "o"),
             (2, 0, 1, True, "count", "*"), (2, 0, 1, True, "count", "*"), (2, 0, 1, True, "count", "s"), (6, 0, 0, False, "count", "v0"),
             (6, 0, 0, False, "count", "v4"), (6, 0, 0, False, "count", "v0"), (6, 0, 0, False, "count", "*"), (6, 0, 0, False, "count", "*")]
    assert len(found) == len(LOOKALIKES)
    values = ", ".join(f"({i}, {p}, {f}, {g}, {str(h).lower()}, '{fn_}', '{v}')" for i, (p, f, g, h, fn_, v) in enumerate(found))
    return sql("lookalikes", body=f"""
SELECT query_id, p::BIGINT AS n_patterns, f::BIGINT AS n_filters, g::BIGINT AS n_grouped, h AS has_having, fn AS func, v AS var, true AS understood
FROM lookalikes JOIN (VALUES {values}) AS t(i, p, f, g, h, fn, v) ON query_id % 100 = i""")


@named("sc14_query_clauses", _pieces_sql())
def query_clauses(spark, sf_dir):
    """Lists after `;` and `,`, filters, COUNT(*), grouping and HAVING as columns."""
    rows = query_catalog(lookalike_queries(spark, sf_dir))
    agg = F.get("aggregates", F.lit(0))
    return rows.select(
        "query_id", *[F.size(c).cast("bigint").alias(n) for c, n in (("patterns", "n_patterns"), ("filters", "n_filters"), ("group_by", "n_grouped"))],
        F.col("having").isNotNull().alias("has_having"), agg["func"].alias("func"), agg["var"].alias("var"), "understood",
    )
