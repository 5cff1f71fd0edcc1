"""The part of a query that a table of observations can answer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.model import HAS_VALUE, RELATES_TO_PROPERTY, ContinuousQuery


def value_variables(query: ContinuousQuery) -> set[str]:
    """Variables that stand for measured values."""
    return {p.o[1:] for p in query.patterns if p.p == HAS_VALUE and p.o.startswith("?")}


def asked(query: ContinuousQuery) -> tuple[str | None, tuple[str, ...]]:
    """Stream and properties that a query asks for. Raises for what observations cannot tell.

    A row of observations is one subject with one value and one property. So a query may name
    the value of one subject, and one property at most: two would both have to hold.
    """
    if len(query.windows) != 1:
        raise ValueError("several windows meet in join_windows; give one window here")
    subjects, properties = {p.s for p in query.patterns}, {p.o for p in query.patterns if p.p == RELATES_TO_PROPERTY}
    for p in query.patterns:
        if not p.s.startswith("?") or p.p not in (HAS_VALUE, RELATES_TO_PROPERTY) or (p.p == HAS_VALUE) != p.o.startswith("?"):
            raise ValueError(f"observations cannot answer the pattern {p}; use over_triples")
    if len(subjects) > 1 or len(properties) > 1:
        raise ValueError("observations answer patterns of one subject and one property; use over_triples")
    return query.windows[0].stream, tuple(properties)


def matching(query: ContinuousQuery, observations: DataFrame, properties: Sequence[str] = ()) -> DataFrame:
    """Observations that the query's stream and patterns pick, with its value variables as columns."""
    stream, wanted = asked(query)
    rows = observations.where(F.col("stream") == stream) if stream else observations
    if properties or wanted:
        rows = rows.where(F.col("property").isin(*(properties or wanted)))
    return rows.withColumns({name: F.col("value") for name in sorted(value_variables(query))})
