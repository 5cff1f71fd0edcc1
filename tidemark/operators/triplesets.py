"""Set operations over triples: insert, delete, replace a pointer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def insert_data(triples: DataFrame, new: DataFrame) -> DataFrame:
    return triples.unionByName(new).dropDuplicates()


def delete_data(triples: DataFrame, gone: DataFrame) -> DataFrame:
    """Without exactly these triples. Both are sets; empty slots equal each other."""
    return triples.select(*gone.columns).subtract(gone)


def replace_pointer(triples: DataFrame, predicate: str, new: DataFrame) -> DataFrame:
    """All present values of the predicate go, the new triples come."""
    return insert_data(triples.where(~F.col("p").eqNullSafe(F.lit(predicate))), new)


def subscribe(subscriptions: DataFrame, new: DataFrame) -> DataFrame:
    """Appends clients to their queries; a client may be listed twice."""
    return subscriptions.unionByName(new)
