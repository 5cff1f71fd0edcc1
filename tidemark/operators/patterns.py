"""Triples from observations, triple patterns and graph patterns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import iso_ms
from tidemark.model import (
    FOCUS_PREDICATES,
    HAS_TIMESTAMP,
    HAS_VALUE,
    LDP_CONTAINS,
    MEASUREMENT,
    Pattern,
    RDF_TYPE,
    RELATES_TO_PROPERTY,
    TRIPLE,
    VANN_PREFIX,
    XSD_DATETIME,
    XSD_FLOAT,
)


def triple(s, p: str, o, o_type: str = "iri", datatype: str | None = None, lang: str | None = None):
    """Struct of one triple; `s` and `o` are columns."""
    return F.struct(
        s.alias("s"),
        F.lit(p).alias("p"),
        o.cast("string").alias("o"),
        F.lit(o_type).alias("o_type"),
        F.lit(datatype).cast("string").alias("o_datatype"),
        F.lit(lang).cast("string").alias("o_lang"),
    )


def to_triples(observations: DataFrame, keep: Sequence[str] = ("stream", "member_id", "ts")) -> DataFrame:
    """Observations to the four triples each member consists of, next to the `keep` columns."""
    s = F.col("member_id")
    body = F.array(
        triple(s, RDF_TYPE, F.lit(MEASUREMENT)),
        triple(s, HAS_TIMESTAMP, iso_ms("ts"), "literal", XSD_DATETIME),
        triple(s, HAS_VALUE, F.col("value"), "literal", XSD_FLOAT),
        triple(s, RELATES_TO_PROPERTY, F.col("property")),
    )
    return observations.select(*keep, F.inline(body))


def match(triples: DataFrame, pattern: Pattern, keep: Sequence[str] = ()) -> DataFrame:
    """Solutions of one triple pattern, one column per variable, next to the `keep` columns.

    Constants filter; a variable used twice asks for equal terms.
    """
    rows, taken = triples, {}
    for slot, term in pattern.slots():
        if not term.startswith("?"):
            rows = rows.where(F.col(slot) == term)
        elif term in taken:
            rows = rows.where(F.col(slot) == F.col(taken[term]))
        else:
            taken[term] = slot
    return rows.select(*keep, *[F.col(slot).alias(term[1:]) for term, slot in taken.items()])


def scope(triples: DataFrame, stream: str) -> DataFrame:
    """Triples of the stream that one named window reads."""
    return triples.where(F.col("stream") == stream)


def dedup_triples(triples: DataFrame, within: Sequence[str] = ("member_id",)) -> DataFrame:
    """A graph is a set: repeats of a triple within one member (or window) are dropped."""
    return triples.dropDuplicates([*within, *TRIPLE])


def bgp(triples: DataFrame, patterns: Sequence[Pattern], within: Sequence[str]) -> DataFrame:
    """Basic graph pattern: the patterns' solutions joined on shared variables.

    `within` names the columns that bound the graph, such as `window` or `member_id`. The
    first shared join keys also hold the scope, so that later joins keep the partitioning.
    """
    if not patterns:
        raise ValueError("a graph pattern needs at least one triple pattern")
    solved, todo = match(triples, patterns[0], within), list(patterns[1:])
    while todo:
        bound = set(solved.columns)
        pick = next((p for p in todo if bound & set(p.variables)), None)
        if pick is None:
            raise ValueError("patterns without a shared variable would pair every row with every row")
        todo.remove(pick)
        shared = [v for v in pick.variables if v in bound]
        solved = solved.join(match(triples, pick, within), [*within, *shared])
    return solved


def star(triples: DataFrame, predicates: dict[str, str], within: Sequence[str], subject: str = "s") -> DataFrame:
    """Graph pattern with one subject and constant, single-valued predicates.

    `predicates` maps output column to predicate. One grouping replaces the joins, however
    many predicates there are; a subject that lacks one of them is no solution.
    """
    rows = triples.where(F.col("p").isin(*predicates.values()))
    wide = rows.groupBy(*within, F.col("s").alias(subject)).agg(
        *[F.max(F.when(F.col("p") == p, F.col("o"))).alias(name) for name, p in predicates.items()]
    )
    return wide.dropna(subset=list(predicates))


def extract_focus(patterns: DataFrame, predicates: Sequence[str] = FOCUS_PREDICATES) -> DataFrame:
    """Metrics that a query asks for: objects of the focus predicates in its patterns."""
    hit = F.col("p").isin(*predicates) & (F.col("p_type") == "iri")
    return patterns.where(hit).select("query_id", F.col("o").alias("focus"))


def metadata_only(triples: DataFrame) -> DataFrame:
    return triples.where(F.col("p") != LDP_CONTAINS)


def prefix_table(triples: DataFrame, url: str | None = None) -> DataFrame:
    """(prefix, namespace) pairs stated as plain literals; `url` adds the default prefix."""
    plain = (
        (F.col("p") == VANN_PREFIX) & (F.col("o_type") == "literal") & F.col("o_lang").isNull()
        & F.col("o_datatype").isNull() & (F.col("o") != "") & ~F.col("o").contains('"')
    )
    stated = triples.where(plain).select(F.col("o").alias("prefix"), F.col("s").alias("namespace"))
    if url is None:
        return stated
    default = triples.sparkSession.range(1).select(
        F.lit("").alias("prefix"), F.lit(url + "#").alias("namespace")
    )
    return stated.unionByName(default)


def event_times(triples: DataFrame, path: str = HAS_TIMESTAMP) -> DataFrame:
    """One row per stated event time: `member_id`, `event_time`."""
    return triples.where(F.col("p") == path).select(
        "member_id", F.col("o").try_cast("timestamp").cast("timestamp_ntz").alias("event_time")
    )


def first_event_time(triples: DataFrame, path: str = HAS_TIMESTAMP, seq: str = "seq") -> DataFrame:
    """Per member, the first value of the time path."""
    first = F.min_by(F.col("o").try_cast("timestamp").cast("timestamp_ntz"), seq)
    return triples.where(F.col("p") == path).groupBy("member_id").agg(first.alias("event_time"))


def share_event_time(triples: DataFrame, path: str = HAS_TIMESTAMP, seq: str | None = None) -> DataFrame:
    """All triples of a member get the member's event time as `ts`; members without one drop out.

    Of several times the one stated first counts, where `seq` names the order; else the least."""
    time = F.col("o").try_cast("timestamp").cast("timestamp_ntz")
    stated = triples.where(F.col("p") == path).select("member_id", time.alias("ts"), F.col(seq).alias("_seq") if seq else time.alias("_seq"))
    per_member = stated.where(F.col("ts").isNotNull()).groupBy("member_id").agg(F.min_by("ts", "_seq").alias("ts"))
    return triples.drop("ts").join(per_member, "member_id")


def inline_bnodes(triples: DataFrame) -> DataFrame:
    """An object blank node is replaced by its own (p, o) pairs, one level deep.

    Adds `via`, the predicate that led to the blank node. A reference to a blank node that
    has no triples stays, with empty `p` and `o`.
    """
    blank_subject = F.col("s").startswith("_:")
    inner = triples.where(blank_subject).select(
        "member_id", F.col("s").alias("_node"), F.col("p").alias("_p"), F.col("o").alias("_o"),
        F.col("o_type").alias("_o_type"), F.col("o_datatype").alias("_o_datatype"),
        F.col("o_lang").alias("_o_lang"),
    )
    named = triples.where(~blank_subject)
    direct = named.where(F.col("o_type") != "bnode").withColumn("via", F.lit(None).cast("string"))
    referring = named.where(F.col("o_type") == "bnode").drop("o_type", "o_datatype", "o_lang")
    folded = (
        referring.withColumnRenamed("o", "_node").withColumnRenamed("p", "via")
        .join(inner, ["member_id", "_node"], "left")
        .drop("_node")
    )
    for name in ("p", *TRIPLE[2:]):
        folded = folded.withColumnRenamed(f"_{name}", name)
    return direct.unionByName(folded.select(*direct.columns))
