"""The query log as a table: catalogue, equivalence, re-use, retargeting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import query_hash, retarget_query
from tidemark.operators.canonical import canonical_key
from tidemark.operators.query_text import PARTS, catalog_columns, clauses, read

def query_catalog(queries: DataFrame) -> DataFrame:
    """Query texts to typed columns: r2s, windows, prefixes, aggregates, patterns, filters, plain
    projections, grouping and HAVING.

    A window without a step moves by its width. A text without a REGISTER clause counts as RStream.
    Predicate and object lists are written out. `understood` says whether the columns hold all
    that the text says; what they leave out still counts for `equivalence_key`.
    """
    columns = catalog_columns(F.col("prefixes")) | {"query_hash": query_hash("query_text")}
    return read(queries).withColumns(columns).drop(*PARTS)


def catalog_patterns(catalog: DataFrame) -> DataFrame:
    """One row per triple pattern, with the kind of its predicate."""
    kind = F.when(F.col("p").startswith("?"), F.lit("variable")).otherwise(F.lit("iri"))
    # The outer form: for the plain one Spark adds a test on the array's size and, moving it
    # down, would read every text twice.
    rows = catalog.select("query_id", F.inline_outer("patterns")).where(F.col("p").isNotNull())
    return rows.withColumn("p_type", kind)


def equivalence_key(queries: DataFrame) -> DataFrame:
    """Adds `equivalence_key`, equal for queries that differ in layout, comments, prefixes, variable
    and window names, or the order of clauses and patterns, and for no others."""
    clauses_of = read(queries).withColumn("_clauses", clauses()).drop(*PARTS, "r2s_operator", "r2s_name", "prefixes")
    return canonical_key(clauses_of, "_clauses", "equivalence_key").drop("_clauses")


def dedup_queries(queries: DataFrame) -> DataFrame:
    """The accepted registrations: of equivalent queries the one registered first.

    A grouping with partial results, so that one query registered a million times is no
    sort of a million rows.
    """
    keyed = equivalence_key(queries).withColumn("query_hash", query_hash("query_text"))
    first = F.min_by(F.struct("query_id", "query_hash", "registered_at"),
                     F.struct("registered_at", "query_id")).alias("_first")
    return keyed.groupBy("equivalence_key").agg(
        first, F.count(F.lit(1)).alias("registrations")
    ).select("_first.*", "registrations")


def registry_summary(queries: DataFrame) -> DataFrame:
    """Number of registered queries and of those that run, one row per status."""
    accepted = dedup_queries(queries).agg(
        F.coalesce(F.sum("registrations"), F.lit(0)).alias("registered"),
        F.count(F.lit(1)).alias("executing"),
    )
    return accepted.unpivot([], ["registered", "executing"], "status", "n")


def reusable(queries: DataFrame, annotations: DataFrame) -> DataFrame:
    """Queries for which a materialized result exists, by query hash."""
    return queries.join(annotations.select("query_hash").distinct(), "query_hash", "left_semi")


def dispatch(results: DataFrame, queries: DataFrame, frm, to, ts: str = "emitted_at") -> DataFrame:
    """Stored results of the given queries in `[frm, to]`, in time order."""
    wanted = queries.select("query_hash").distinct()
    kept = results.where(F.col(ts).between(F.lit(frm), F.lit(to)))
    return kept.join(wanted, "query_hash", "left_semi").orderBy(ts, "query_hash")


def retarget(queries: DataFrame, old, new) -> DataFrame:
    """Query texts moved to the stream found for them, hashed anew."""
    moved = queries.withColumn("query_text", retarget_query("query_text", old, new))
    return moved.withColumn("query_hash", query_hash("query_text"))
