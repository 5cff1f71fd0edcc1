"""Historical and live input put together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.model import QUERY_MODES
from tidemark.operators.windows import lookback, union_streams

__all__ = ["backfill_gap", "historical_plus_live", "union_streams"]


def historical_plus_live(
    history: DataFrame, live: DataFrame, mode: str, width_ms: int, now, ts: str = "ts"
) -> DataFrame:
    """Input of a query by mode: the horizon `[now - width, now]` of the log and then what
    is live, or only what is live. `phase` tells which a row came from."""
    if mode not in QUERY_MODES:
        raise ValueError(f"the query mode is not supported: {mode!r}")
    tail = live.withColumn("phase", F.lit("live"))
    if mode == "live":
        return tail
    head = lookback(history, width_ms, now, ts).withColumn("phase", F.lit("historical"))
    return head.unionByName(tail)


def backfill_gap(log: DataFrame, seen: DataFrame, ts: str = "ts", key: str = "member_id") -> DataFrame:
    """Members of the log that neither replay nor live brought, in event-time order."""
    return log.join(seen.select(key).distinct(), key, "left_anti").orderBy(ts, key)
