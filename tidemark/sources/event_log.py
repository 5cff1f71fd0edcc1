"""Event logs: append-only observations in time buckets, stored as partitioned parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import epoch_ms
from tidemark.model import HAS_TIMESTAMP
from tidemark.operators.buckets import prune_buckets
from tidemark.operators.ordering import sort_in_bucket

EVENT_SCHEMA = (
    "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
)


def write_log(observations: DataFrame, path: str, mode: str = "append") -> None:
    """Stores observations by day and, within a file, by stream and time.

    Ranges over (day, stream, time) give files of even size: a busy stream or day is cut
    over many files, quiet ones share one.
    """
    dated = observations.withColumn("bucket_date", F.to_date("ts"))
    ordered = dated.repartitionByRange("bucket_date", "stream", "ts").sortWithinPartitions(
        "bucket_date", "stream", "ts"
    )
    ordered.write.mode(mode).partitionBy("bucket_date").parquet(path)


def read_log(spark: SparkSession, path: str, frm=None, to=None) -> DataFrame:
    """A stored log. The day partitions that `[frm, to]` misses are not opened."""
    log = spark.read.parquet(path)
    if frm is not None:
        log = log.where(F.col("bucket_date") >= F.to_date(F.lit(frm)))
    if to is not None:
        log = log.where(F.col("bucket_date") <= F.to_date(F.lit(to)))
    return scan_members(log, frm, to, order=False)


def write_bucketed(members: DataFrame, path: str, mode: str = "append") -> None:
    """Stores members (`bucket`, `ts`, ...) in a folder per bucket; a busy bucket is cut over many files."""
    ordered = members.repartitionByRange("bucket", "ts").sortWithinPartitions("bucket", "ts")
    ordered.write.mode(mode).partitionBy("bucket").parquet(path)


def open_buckets(log: DataFrame, index: DataFrame, frm, to, by=("stream",)) -> DataFrame:
    """Members with `frm <= ts <= to` of a log that `write_bucketed` stored; other buckets are not opened.

    The pruned index is only known as the query runs: it reaches the scan as a filter on the folders (dynamic
    partition pruning) as long as Spark sends it to all tasks, which its size threshold decides.
    """
    wanted = prune_buckets(index, frm, to, by).select(F.col("node").alias("_node"))
    opened = log.join(wanted, F.col("bucket") == F.col("_node"), "left_semi")
    return scan_members(opened, frm, to, order=False)


def scan_members(log: DataFrame, frm=None, to=None, ts: str = "ts", seq: str = "seq", order: bool = True):
    """Members with `frm <= ts <= to`, both ends in; a missing end leaves that side open.

    `order` sorts by event time over the whole result, as a range sort.
    """
    rows = log
    if frm is not None:
        rows = rows.where(F.col(ts) >= F.lit(frm))
    if to is not None:
        rows = rows.where(F.col(ts) <= F.lit(to))
    return rows.orderBy(ts, seq) if order else rows


def bucket_index(observations: DataFrame, step: str = "day", path: str = HAS_TIMESTAMP) -> DataFrame:
    """Index of the buckets in use: `stream, node, path, value`, one per stream and step."""
    starts = observations.select("stream", F.date_trunc(step, "ts").cast("timestamp_ntz").alias("value"))
    return starts.distinct().select(
        "stream",
        F.concat("stream", epoch_ms("value").cast("string"), F.lit("/")).alias("node"),
        F.lit(path).alias("path"),
        "value",
    )


def replay(observations: DataFrame, bucket=("bucket",)) -> DataFrame:
    """Members bucket by bucket, in time order within each."""
    return sort_in_bucket(observations, bucket)
