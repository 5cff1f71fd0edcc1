"""From results back to the members they came from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import epoch_us
from tidemark.model import VOCALS_ENDED_AT, VOCALS_STARTED_AT

# Lengths of windows that are taken as they are.
LENGTHS = 16


def window_bounds(result_triples: DataFrame) -> DataFrame:
    """Window of each result event, from its triples: `s`, `timestamp_from`, `timestamp_to`."""
    def stated(p: str):
        # Read as a time before it is aggregated: times are hashed, texts would be sorted.
        return F.max(F.when(F.col("p") == p, F.col("o").try_cast("timestamp").cast("timestamp_ntz")))

    rows = result_triples.where(F.col("p").isin(VOCALS_STARTED_AT, VOCALS_ENDED_AT))
    bounds = rows.groupBy("s").agg(
        stated(VOCALS_STARTED_AT).alias("timestamp_from"), stated(VOCALS_ENDED_AT).alias("timestamp_to")
    )
    return bounds.dropna()


def trace(results: DataFrame, members: DataFrame, bounds: str = "[]") -> DataFrame:
    """Source members of every result: same stream, event time within the result's window.

    Time is cut into cells as long as the window, so a window lies in two cells at most, and a
    member, in one cell of each length, meets at most about twice the windows that hold it.
    Windows of more than LENGTHS lengths are put under the next power of two microseconds.
    (stream, length, cell) also cuts a stream into many keys; the bounds then decide.
    `bounds` is `[]` (both ends in) or `[)`.
    """
    if bounds not in ("[]", "[)"):
        raise ValueError(f"unknown bounds {bounds!r}")
    span = F.greatest(epoch_us("ended_at") - epoch_us("started_at"), F.lit(1))
    windows = results.select("event_id", "stream", "started_at", "ended_at", span.alias("_length")).where(F.col("_length").isNotNull())
    lengths = [r[0] for r in windows.select("_length").distinct().limit(LENGTHS + 1).collect()]
    if len(lengths) > LENGTHS:
        power = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.ceil(F.log2(F.col("_length").cast("double"))).cast("int"))
        windows = windows.withColumn("_length", F.greatest(power, "_length"))  # a rounded logarithm may fall short
        windows = windows.withColumn("_length", F.when(power >= F.col("_length"), power).otherwise(power * 2))
        lengths = [r[0] for r in windows.select("_length").distinct().collect()]  # 64 at most

    def cell(ts: str):
        return F.call_function("div", epoch_us(ts) - F.pmod(epoch_us(ts), F.col("_length")), F.col("_length"))

    laid = windows.select("*", F.explode(F.sequence(cell("started_at"), cell("ended_at"))).alias("_cell"))
    kinds = F.array(*[F.lit(n).cast("bigint") for n in lengths]) if lengths else F.array().cast("array<bigint>")
    rows = members.withColumn("_length", F.explode(kinds)).withColumn("_cell", cell("ts"))
    ts, end = F.col("ts"), F.col("ended_at")
    inside = (ts >= F.col("started_at")) & (ts <= end if bounds == "[]" else ts < end)
    return laid.join(rows, ["stream", "_length", "_cell"]).where(inside).select("event_id", "member_id", "ts")
