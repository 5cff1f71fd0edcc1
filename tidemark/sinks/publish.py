"""The materialized view: batches, buckets, annotations, indexes and pointers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import bucket_ts_of_url, bucket_url_child, epoch_ms, iso_ms
from tidemark.model import (
    DCT_DESCRIPTION,
    DCT_SOURCE,
    FOCUS_PREDICATES,
    LDES_EVENT_STREAM,
    LDES_TIMESTAMP_PATH,
    LDES_VERSION_OF_PATH,
    LDP_INBOX,
    PARAMETER_BASE,
    PUBLISH_BATCH,
    RDF_TYPE,
    TREE_GREATER_OR_EQUAL,
    TREE_NODE,
    TREE_NODE_CLASS,
    TREE_PATH,
    TREE_RELATION,
    TREE_VALUE,
    TREE_VIEW,
    TRIPLE,
    VOCALS_REGISTERED,
    XSD_DATETIME,
    XSD_INTEGER,
)
from tidemark.operators.ordering import ordinal_batch
from tidemark.operators.patterns import inline_bnodes, triple

# The description vocabulary of an aggregation, the same for every query.
EXECUTION = "http://example.org/aggregation_function_execution"
FUNCTION = "http://example.org/aggregation_function"
RESULT_STREAM = "http://example.org/aggregation_result_stream"
PROBLEM = "http://example.org/continuous_monitoring_with_solid"
QUERY_BASE = "http://example.org/aggregation_query/"
START_TIME = "http://example.org/aggregation_start_time"
END_TIME = "http://example.org/aggregation_end_time"
LAST_EXECUTION = "http://example.org/last_execution_time"
EXECUTED_QUERY = "http://example.org/aggregation_query"
IMPLEMENTATION = "http://example.org/stream_aggregation_function"
FNO_S = "https://w3id.org/function/ontology#"
FNO = "http://w3id.org/function/ontology#"
STREAM_DATA = "http://purl.oclc.org/NET/UNIS/sao/sao#StreamData"
HAS = "http://www.example.org/has_"
FUNCTION_TEXT = "A function that executes an aggregation function on a RDF stream of data"
RESULT_TEXT = "The stream of generated aggregation data that is the result of the aggregation function"
PARAMETERS = ("solid_pod_url", "aggregation_query", "latest_minutes_to_monitor")


def publish_batches(
    results: DataFrame,
    group: Sequence[str] = ("query_hash",),
    size: int = PUBLISH_BATCH,
    flush: bool = False,
    ts: str = "emitted_at",
    ties: Sequence[str] = ("event_id",),
) -> DataFrame:
    """Results with their `batch`; only full batches, unless `flush` asks for the rest too."""
    batched = ordinal_batch(results, group, size, ts, ties)
    return (batched if flush else batched.where("full")).drop("full")


def bucketed(batches: DataFrame, group: Sequence[str] = ("query_hash",), ts: str = "emitted_at") -> DataFrame:
    """Adds `bucket_ts`, the time in milliseconds of the last element of the row's batch."""
    batch = Window.partitionBy(*group, "batch")
    return batches.withColumn("bucket_ts", epoch_ms(F.max_by(ts, "ordinal").over(batch)))


def write_buckets(
    batches: DataFrame, path: str, existing: DataFrame | None = None,
    group: Sequence[str] = ("query_hash",), ts: str = "emitted_at", ids: Sequence[str] = ("event_id",),
) -> None:
    """Appends published batches by bucket; what a bucket holds already is left as it is.

    A bucket is named by a time, so batches that end at one instant share it: rows are known by
    their ids, and a full batch is stored whatever call brings it. Rows that come again are not.
    Buckets hold some twenty rows, far too few for a folder each: they are rows of day
    partitions, and files are cut by ranges over (day, bucket).
    """
    rows = bucketed(batches, group, ts)
    if existing is not None:
        key = [*group, "bucket_ts", *ids]
        known = existing.select(*[F.col(c).alias(f"_of_{c}") for c in key])
        rows = rows.join(known, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in key], "left_anti")
    dated = rows.withColumn("bucket_date", F.to_date(F.timestamp_millis("bucket_ts")))
    dated.repartitionByRange("bucket_date", "bucket_ts").write.mode("append").partitionBy(
        "bucket_date"
    ).parquet(path)


def annotate_queries(catalog: DataFrame, start: Column, end: Column, executed: Column) -> DataFrame:
    """One description per query: first window, first projection, last focus, and the hash
    by which a later query finds the stored results."""
    first_window = F.get(F.col("windows"), F.lit(0))
    focus = F.filter("patterns", lambda p: p["p"].isin(*FOCUS_PREDICATES))
    return catalog.select(
        "query_id", "query_hash", "query_text",
        start.alias("start_time"), end.alias("end_time"), executed.alias("last_execution_time"),
        first_window["name"].alias("window_name"), first_window["stream"].alias("stream"),
        first_window["width"].alias("window_size"), first_window["slide"].alias("window_slide"),
        F.get(F.col("aggregates"), F.lit(0))["alias"].alias("projection_variable"),
        F.coalesce(F.try_element_at(focus, F.lit(-1))["o"], F.lit("")).alias("focus"),
    )


def annotation_triples(annotations: DataFrame, parameter_base: str = PARAMETER_BASE) -> DataFrame:
    """Annotations as triples: 28 per query, and the query hash as the 29th."""
    ex, fn, out = F.lit(EXECUTION), F.lit(FUNCTION), F.lit(RESULT_STREAM)
    query = F.concat(F.lit(QUERY_BASE), F.col("query_hash"))

    def lit(s, p, o, datatype=None, lang=None):
        return triple(s, p, o, "literal", datatype, lang)

    execution = [
        triple(ex, RDF_TYPE, F.lit(FNO_S + "Execution")),
        triple(ex, FNO_S + "executes", fn),
        triple(ex, VOCALS_REGISTERED, F.col("stream")),
        lit(ex, START_TIME, iso_ms("start_time")),
        lit(ex, END_TIME, iso_ms("end_time")),
        lit(ex, LAST_EXECUTION, epoch_ms("last_execution_time"), XSD_INTEGER),
        triple(ex, EXECUTED_QUERY, query),
    ]
    function = [
        triple(fn, RDF_TYPE, F.lit(FNO_S + "Function")),
        triple(fn, FNO_S + "name", F.lit("aggregation_function")),
        lit(fn, DCT_DESCRIPTION, F.lit(FUNCTION_TEXT), lang="en"),
        triple(fn, FNO + "solves", F.lit(PROBLEM)),
        *[triple(fn, FNO + "expects", F.lit(parameter_base + name)) for name in PARAMETERS],
        triple(fn, FNO + "returns", out),
        triple(fn, FNO + "implements", F.lit(IMPLEMENTATION)),
    ]
    result = [
        triple(out, RDF_TYPE, F.lit(FNO + "OutputStream")),
        triple(out, RDF_TYPE, F.lit(STREAM_DATA)),
        lit(out, DCT_DESCRIPTION, F.lit(RESULT_TEXT), lang="en"),
        triple(F.lit(PROBLEM), RDF_TYPE, F.lit(FNO + "Problem")),
        triple(F.lit(parameter_base + "aggregation_query"), RDF_TYPE, F.lit(FNO + "Parameter")),
    ]
    asked = [
        triple(query, RDF_TYPE, F.lit(FNO + "Query")),
        lit(query, HAS + "query_string", F.col("query_text")),
        lit(query, HAS + "projection_variable", F.col("projection_variable")),
        triple(query, HAS + "window_name", F.col("window_name")),
        lit(query, HAS + "window_size", F.col("window_size"), XSD_INTEGER),
        lit(query, HAS + "window_slide", F.col("window_slide"), XSD_INTEGER),
        triple(query, HAS + "focus", F.col("focus")),
        lit(query, HAS + "query_hash", F.col("query_hash")),
    ]
    return annotations.select("query_id", F.inline(F.array(*execution, *function, *result, *asked)))


def bucket_index_triples(index: DataFrame, version_of: str = "1.0") -> DataFrame:
    """Bucket index as triples: five for the stream, five per bucket, one for the inbox."""
    view, log = F.col("stream"), F.concat("stream", F.lit("#EventStream"))
    heads = index.groupBy("stream").agg(
        F.max_by("node", "value").alias("inbox"), F.min("path").alias("path")
    )
    head = F.array(
        triple(log, RDF_TYPE, F.lit(LDES_EVENT_STREAM)),
        triple(log, LDES_TIMESTAMP_PATH, F.col("path")),
        triple(log, LDES_VERSION_OF_PATH, F.lit(version_of)),
        triple(log, TREE_VIEW, view),
        triple(view, RDF_TYPE, F.lit(TREE_NODE_CLASS)),
        triple(view, LDP_INBOX, F.col("inbox")),
    )
    relation = F.concat(F.lit("_:r"), F.md5("node"))
    body = F.array(
        triple(view, TREE_RELATION, relation, "bnode"),
        triple(relation, RDF_TYPE, F.lit(TREE_GREATER_OR_EQUAL)),
        triple(relation, TREE_NODE, F.col("node")),
        triple(relation, TREE_PATH, F.col("path")),
        triple(relation, TREE_VALUE, iso_ms("value"), "literal", XSD_DATETIME),
    )
    return heads.select("stream", F.inline(head)).unionByName(index.select("stream", F.inline(body)))


def link_sources(stored: DataFrame, member: str = "member_id", location: str = "location") -> DataFrame:
    """Where each stored member lies, as triples."""
    return stored.select(F.inline(F.array(triple(F.col(member), DCT_SOURCE, F.col(location)))))


def latest_bucket(index: DataFrame) -> DataFrame:
    """Pointer to the newest bucket of each stream; newest by number, not by text."""
    newest = index.groupBy("stream").agg(F.max(bucket_ts_of_url("node")).alias("_ts"))
    s = F.col("stream")
    return newest.select(F.inline(F.array(triple(s, LDP_INBOX, bucket_url_child("stream", F.col("_ts"))))))


def add_version(members: DataFrame, version: str) -> DataFrame:
    return members.withColumn("version", F.lit(version))


def shorten(term: Column, prefixes: dict[str, str]) -> Column:
    """`prefix:local` where a namespace fits and the rest is a plain name, else `<iri>`."""
    options = [
        F.when(
            term.startswith(ns) & F.regexp_like(F.substring(term, F.lit(len(ns) + 1), F.length(term)),
                                                F.lit(r"^[A-Za-z0-9_][A-Za-z0-9_-]*$")),
            F.concat(F.lit(prefix + ":"), F.substring(term, F.lit(len(ns) + 1), F.length(term))),
        )
        for prefix, ns in sorted(prefixes.items(), key=lambda kv: (-len(kv[1]), kv[0]))
    ]
    whole = F.when(term.startswith("_:"), term).otherwise(F.concat(F.lit("<"), term, F.lit(">")))
    return F.coalesce(*options, whole)


def compact_triples(triples: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """Triples without repeats, blank nodes folded into what refers to them, names shortened.

    `via` is the shortened predicate to a folded blank node. Rows come in subject order, as
    ranges over (s, via, p, o): the rows of a subject lie together, and a subject with very
    many rows runs over several tasks.
    """
    once = triples.select("member_id", *TRIPLE).dropDuplicates()
    folded = inline_bnodes(once)
    obj = F.when(F.col("o_type") == "literal", F.col("o")).otherwise(shorten(F.col("o"), prefixes))
    short = folded.select(
        "member_id",
        shorten(F.col("s"), prefixes).alias("s"),
        shorten(F.col("via"), prefixes).alias("via"),
        shorten(F.col("p"), prefixes).alias("p"),
        obj.alias("o"), "o_type", "o_datatype", "o_lang",
    )
    order = ["s", "via", "p", "o"]
    return short.repartitionByRange(*order).sortWithinPartitions(*order)
