"""A replay of the log that goes over into its live tail, each member once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.windows import lookback
from tidemark.streaming.live import dedup_stream, drain, with_watermark
from tidemark.streaming.publish import path_exists


def replay_then_tail(
    history: DataFrame, arrivals: DataFrame, folder: str, width_ms: int, now, delay: str,
    key: str = "member_id", ts: str = "ts",
) -> DataFrame:
    """Members of the horizon `[now - width, now]` of the log, then those that arrive; `phase` tells which.

    `arrivals` is a stream that began before the log was read, so it brings some members again
    and misses none. The replay is written first, and after it, as its commit, the high-water mark:
    the greatest time in it. Arrivals up to the mark are looked up in the replay and dropped
    if they are there; later ones cannot be in it and are not looked up. A member that arrives twice within
    `delay` counts once.

    Run again with the same folder, it goes on where it stopped: a replay without a mark is written
    anew, one with a mark is kept, and the tail continues from its checkpoint. Members without a key are
    never taken for one another by the look-up. Both inputs have the same columns.
    """
    spark, names = arrivals.sparkSession, history.columns
    replayed, mark = f"{folder}/replayed", f"{folder}/mark"
    if not path_exists(spark, f"{mark}/_SUCCESS"):
        lookback(history, width_ms, now, ts).write.mode("overwrite").parquet(replayed)
        reached = spark.read.schema(history.schema).parquet(replayed).agg(F.max(F.col(ts).cast("timestamp")).alias("mark"))
        reached.write.mode("overwrite").parquet(mark)
    upto = spark.read.parquet(mark).first()["mark"]
    seen = spark.read.schema(history.schema).parquet(replayed).select(F.col(key).alias("_seen"))
    fresh = dedup_stream(with_watermark(arrivals.select(*names), delay, ts), [key])
    if upto is not None:
        again = (F.col(key) == F.col("_seen")) & (F.col(ts) <= F.lit(upto))
        fresh = fresh.join(seen, again, "left_anti")
    drain(fresh, folder, "tail")
    return members_so_far(spark, folder, history.schema)


def members_so_far(spark: SparkSession, folder: str, schema) -> DataFrame:
    """What `replay_then_tail` has stored."""
    parts = []
    for name, phase in (("replayed", "historical"), ("tail", "live")):
        rows = spark.read.parquet(f"{folder}/{name}")
        parts.append(rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema], F.lit(phase).alias("phase")))
    return parts[0].unionByName(parts[1])
