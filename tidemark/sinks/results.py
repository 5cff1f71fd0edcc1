"""Result events, their triples, and triples as text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import event_iri, iso_ms, joined_text
from tidemark.model import (
    DERIVED_FROM,
    EVENT_BASE,
    HAS_TIMESTAMP,
    HAS_VALUE,
    MEASUREMENT,
    PROV_DERIVED_FROM,
    PROV_GENERATED_BY,
    RDF_TYPE,
    VOCALS_ENDED_AT,
    VOCALS_STARTED_AT,
    XSD_DATETIME,
    XSD_FLOAT,
)
from tidemark.operators.patterns import triple
from tidemark.operators.windows import explode_bindings, flat


def result_events(
    windowed_df: DataFrame,
    aggs: Sequence[str],
    query_hash: Column,
    streams: Column,
    by: Sequence[str] = (),
    event_base: str = EVENT_BASE,
    derived_from: str = DERIVED_FROM,
) -> DataFrame:
    """Window results to events: one per window, group and projected aggregate. A result that is no
    number has an empty `value`; where there is a text among `aggs`, `lexical` holds what was found.

    An event counts as emitted when its window closes, so a re-run emits the same events.
    """
    rows = explode_bindings(flat(windowed_df), aggs, ["w_start", "w_end", *by])
    named = rows.withColumn("query_hash", query_hash)
    key = joined_text("var", *by)
    texts = ["lexical"] if any(windowed_df.schema[a].dataType.simpleString() == "string" for a in aggs) else []
    return named.select(
        event_iri("query_hash", key, F.col("w_start"), event_base).alias("event_id"),
        "query_hash", *by, "var", "value", *texts,
        F.col("w_end").alias("emitted_at"),
        F.col("w_start").alias("started_at"),
        F.col("w_end").alias("ended_at"),
        F.lit(derived_from).alias("derived_from"),
        streams.alias("streams"),
    )


def result_triples(results: DataFrame) -> DataFrame:
    """Six triples per result, and one per input stream."""
    s = F.col("event_id")
    body = F.array(
        triple(s, RDF_TYPE, F.lit(MEASUREMENT)),
        triple(s, HAS_TIMESTAMP, iso_ms("emitted_at"), "literal", XSD_DATETIME),
        triple(s, HAS_VALUE, F.col("value"), "literal", XSD_FLOAT),
        triple(s, PROV_DERIVED_FROM, F.col("derived_from")),
        triple(s, VOCALS_STARTED_AT, iso_ms("started_at"), "literal", XSD_DATETIME),
        triple(s, VOCALS_ENDED_AT, iso_ms("ended_at"), "literal", XSD_DATETIME),
    )
    inputs = F.transform("streams", lambda stream: triple(s, PROV_GENERATED_BY, stream))
    return results.select(F.inline(F.concat(body, inputs)))


def _escaped(text: Column) -> Column:
    for raw, written in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(raw), F.lit(written))
    return text


def node_text(term: Column) -> Column:
    return F.when(term.startswith("_:"), term).otherwise(F.concat(F.lit("<"), term, F.lit(">")))


def object_text() -> Column:
    quoted = F.concat(F.lit('"'), _escaped(F.col("o")), F.lit('"'))
    return (
        F.when(F.col("o_type") != "literal", node_text(F.col("o")))
        .when(F.col("o_lang").isNotNull(), F.concat(quoted, F.lit("@"), F.col("o_lang")))
        .when(F.col("o_datatype").isNotNull(), F.concat(quoted, F.lit("^^<"), F.col("o_datatype"), F.lit(">")))
        .otherwise(quoted)
    )


def to_ntriples(triples: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One line of N-Triples per triple, in `value`."""
    line = F.concat_ws(" ", node_text(F.col("s")), F.concat(F.lit("<"), F.col("p"), F.lit(">")),
                       object_text(), F.lit("."))
    return triples.select(*keep, line.alias("value"))


def write_ntriples(triples: DataFrame, path: str, mode: str = "append") -> None:
    to_ntriples(triples).write.mode(mode).text(path)
