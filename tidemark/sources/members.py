"""Documents of triples to members."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.model import HAS_TIMESTAMP, LDP_CONTAINS, TREE_MEMBER


def assemble_members(doc_triples: DataFrame, time_path: str = HAS_TIMESTAMP, doc: str = "doc") -> DataFrame:
    """Adds `member_id` to the triples of documents; the membership links themselves go.

    A document that links members holds one member per link, made of the triples with the
    linked subject. A document without links is itself a member, named by the subject that
    carries the time path. The result stays one row per triple: a member is the rows that
    share a `member_id`, and no member is gathered in one place.
    """
    is_link = F.col("p") == TREE_MEMBER
    links = doc_triples.where(is_link).select(doc, F.col("o").alias("s"), F.lit(True).alias("_linked")).distinct()
    names = doc_triples.where(F.col("p") == time_path).select(doc, F.col("s").alias("_own")).distinct()
    alone = names.join(links.select(doc).distinct(), doc, "left_anti")
    body = doc_triples.where(~is_link).join(links, [doc, "s"], "left").join(alone, doc, "left")
    member = F.when(F.col("_linked"), F.col("s")).otherwise(F.col("_own"))
    return body.withColumn("member_id", member).where(F.col("member_id").isNotNull()).drop("_linked", "_own")


def list_bucket(triples: DataFrame) -> DataFrame:
    """Resources that containers hold: `s` contains `o`."""
    return triples.where(F.col("p") == LDP_CONTAINS).select("s", "o")
