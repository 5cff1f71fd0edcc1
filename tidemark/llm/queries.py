"""The numbered queries of this package, and their SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from tidemark.llm import (
    byte_bpe,
    decontaminate,
    divergence,
    language_model,
    licenses,
    line_dedup,
    near_dedup,
    pii,
    quality_fm,
    quality_rules,
    sharding,
    vector_codes,
    warc_zip,
)
from tidemark.llm.common import table

RANKS = "byte_bpe_multi_50k.tiktoken"
PII_KEY = "replace-me"  # a deployment passes its own secret
QUERIES, SQL = {}, {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_host_quality_rules(spark, sf_dir):
    out = quality_rules.judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


SQL["op1_host_quality_rules"] = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i+1], w[i+2]) AS n
      FROM d, unnest(range(1, len(w) - 1)) AS r(i)),
p AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM g, unnest([0, 1, 2]) AS s(k) WHERE n > 1 GROUP BY doc_id),
c AS (
  SELECT d.doc_id, source, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words
  FROM d LEFT JOIN p USING (doc_id)),
j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS f1, 100 * n_symbols > 10 * word_chars AS f2,
             100 * n_dup_lines > 30 * n_lines AS f3 FROM c),
h AS (SELECT source, count(*)::DOUBLE AS n, sum(f1::INT)::DOUBLE AS a1, sum(f2::INT)::DOUBLE AS a2, sum(f3::INT)::DOUBLE AS a3
      FROM j GROUP BY source),
m AS (SELECT sum(n) AS nn, sum(a1) / sum(n) AS m1, sum(a2) / sum(n) AS m2, sum(a3) / sum(n) AS m3 FROM h),
v AS (SELECT any_value(m1) AS m1, any_value(m2) AS m2, any_value(m3) AS m3, sum(n * (a1 / n - m1) ** 2) / any_value(nn) AS v1,
             sum(n * (a2 / n - m2) ** 2) / any_value(nn) AS v2, sum(n * (a3 / n - m3) ** 2) / any_value(nn) AS v3 FROM h, m),
s AS (SELECT m1, m2, m3, CASE WHEN v1 > 0 THEN least(1e6, greatest(1.0, m1 * (1 - m1) / v1 - 1)) ELSE 1e6 END AS s1,
             CASE WHEN v2 > 0 THEN least(1e6, greatest(1.0, m2 * (1 - m2) / v2 - 1)) ELSE 1e6 END AS s2,
             CASE WHEN v3 > 0 THEN least(1e6, greatest(1.0, m3 * (1 - m3) / v3 - 1)) ELSE 1e6 END AS s3 FROM v),
bad AS (SELECT source, greatest((a1 + m1 * s1) / (n + s1), (a2 + m2 * s2) / (n + s2), (a3 + m3 * s3) / (n + s3)) > 0.5 AS failed
        FROM h, s)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, f1 AS base_failed,
       NOT f1 AND NOT coalesce(failed, false) AS kept
FROM j LEFT JOIN bad ON j.source IS NOT DISTINCT FROM bad.source
"""


@query
def op2_byte_bpe(spark, sf_dir):
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


@query
def op3_license_scan(spark, sf_dir):
    """Documents as files: a source is a root, and ids in thousands and tens are directories below it."""
    docs = table(spark, sf_dir, "documents")
    at = F.concat("source", F.lit("/"), F.floor(F.col("doc_id") / 1000).cast("string"), F.lit("/"),
                  F.floor(F.col("doc_id") % 1000 / 10).cast("string"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return licenses.scan(docs.withColumn("path", at), keep=("doc_id",))


@query
def op4_factorisation_machine(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality_fm.score(docs, quality_fm.train(docs, table(spark, sf_dir, "labels")))


@query
def op5_line_dedup(spark, sf_dir):
    out = line_dedup.judged(table(spark, sf_dir, "documents"))
    return out.select(F.col("row").getField("doc_id").alias("doc_id"), "n_lines", "n_dropped", "emptied",
                      F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


@query
def op6_zip_warc(spark, sf_dir):
    out = warc_zip.archive_and_read(table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op7_hyperminhash(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80)


@query
def op8_winnowing(spark, sf_dir):
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op9_log_bilinear(spark, sf_dir):
    return language_model.score(table(spark, sf_dir, "documents"))


@query
def op10_surrogates(spark, sf_dir):
    out = pii.pseudonymised(table(spark, sf_dir, "documents"), key=PII_KEY)
    counts = [f"n_{k}" for k in pii.TYPES]
    return out.select(F.col("row").getField("doc_id").alias("doc_id"), *counts, F.sha2(F.col("replaced").cast("binary"), 256).alias("replaced_sha256"))


@query
def op11_source_divergence(spark, sf_dir):
    return divergence.audit(table(spark, sf_dir, "documents"))


SQL["op11_source_divergence"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
w AS (SELECT id, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
l AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
own AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY lang, source, term),
c AS (SELECT g.lang, g.source, k.term, coalesce(own.n, 0) AS n, k.n AS ln
      FROM g JOIN k ON k.lang = g.lang LEFT JOIN own ON own.lang = g.lang AND own.source = g.source AND own.term = k.term),
t AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source),
p AS (SELECT c.lang, c.source, c.term, c.n, 1 + (1000000000::HUGEINT * (c.n + 1)) // (t.n + l.v) AS p,
             1 + (1000000000::HUGEINT * (c.ln + 1)) // (l.n + l.v) AS q
      FROM c JOIN t ON t.lang = c.lang AND t.source = c.source JOIN l ON l.lang = c.lang),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
      FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
o AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
  FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM o)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM r WHERE part = 'pair' OR rank <= 200
"""


@query
def op12_hypergeometric_shards(spark, sf_dir):
    return sharding.sharded(table(spark, sf_dir, "documents"))


@query
def op13_cover_tree_codes(spark, sf_dir):
    return vector_codes.compressed(table(spark, sf_dir, "embeddings"))[0].drop("label")


def _lloyd_sql(rounds: int = vector_codes.ROUNDS) -> str:
    """Rounds one after the other, each comparing all parts with all entries."""
    away = "list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""
a{i} AS (SELECT rid, part, arg_min(entry, away * 256 + entry) AS entry, min(away) AS away
       FROM (SELECT x.rid, x.part, b.entry, {away}::BIGINT AS away FROM x JOIN b{i} AS b ON x.part = b.part) GROUP BY rid, part)""")
        if i < rounds:
            steps.append(f"""
s{i} AS (SELECT part, entry, list(m ORDER BY j) AS v FROM (
       SELECT part, entry, j, ((sum(v[j]) - (sum(v[j]) % count(*) + count(*)) % count(*)) // count(*))::BIGINT AS m
       FROM a{i} JOIN x USING (rid, part), unnest(range(1, len(v) + 1)) AS u(j) GROUP BY part, entry, j) GROUP BY part, entry),
b{i + 1} AS (SELECT b.part, b.entry, coalesce(s.v, b.v) AS v FROM b{i} AS b LEFT JOIN s{i} AS s ON s.part = b.part AND s.entry = b.entry)""")
    return f"""
WITH e AS (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS rid, vec_id, label,
         list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS (SELECT rid, part, v[part * (len(v) // 4) + 1 : (part + 1) * (len(v) // 4)] AS v FROM e, unnest([0, 1, 2, 3]) AS u(part)),
b0 AS (SELECT part, rid - 1 AS entry, v FROM x WHERE rid <= 256),{",".join(steps)},
h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS digest FROM b{rounds}),
o AS (SELECT rid, string_agg(lower(format('{{:02x}}', entry)), '' ORDER BY part) AS code, sum(away) AS error FROM a{rounds} GROUP BY rid)
SELECT vec_id, code, error::BIGINT AS error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, digest AS codebooks_sha256
FROM e JOIN o USING (rid), h
"""


SQL["op13_cover_tree_codes"] = _lloyd_sql()
