"""Results to the clients that asked for them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Results of one query that one task delivers.
HOT_ROWS = 1_000_000


def fan_out(results: DataFrame, subscriptions: DataFrame, hot_rows: int = HOT_ROWS, spread: str = "event_id"):
    """Every result to every subscriber of its query hash.

    Results are counted by hash, with partial counts. Where a hash has more than `hot_rows`, its
    rows are spread over as many keys as it has such portions, and its subscriptions repeated
    once per key; nothing is repeated for the others. There are at most as many such hashes as
    the table has portions, so their list is sent around.
    """
    counts = results.groupBy("query_hash").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows)
    hot = F.broadcast(counts.select("query_hash", F.ceil(F.col("_n") / hot_rows).cast("int").alias("_salts")))
    salts = F.coalesce("_salts", F.lit(1))
    salted = results.join(hot, "query_hash", "left").withColumn("_salt", F.pmod(F.xxhash64(spread), salts).cast("int")).drop("_salts")
    copies = subscriptions.join(hot, "query_hash", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return salted.join(copies, ["query_hash", "_salt"]).drop("_salt")


def undeliverable(results: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Results that nobody subscribed to."""
    return results.join(subscriptions.select("query_hash").distinct(), "query_hash", "left_anti")
