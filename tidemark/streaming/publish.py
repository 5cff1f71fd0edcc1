"""Streaming results into stored views: batches of results, inserted and deleted rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.model import PUBLISH_BATCH, WindowSpec
from tidemark.operators.ordering import ordinal_batch
from tidemark.operators.windows import r2s
from tidemark.sinks.publish import bucketed
from tidemark.streaming.live import run_counted


_COMMIT = "batch_id bigint, n_published bigint, n_pending bigint"


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _part(folder: str, batch_id: int) -> str:
    return f"{folder}/batch_id={batch_id}"


def _forget(spark: SparkSession, *parts: str) -> None:
    """Removes parts that no micro-batch will read again, also not one that runs a second time."""
    for part in parts:
        where = spark._jvm.org.apache.hadoop.fs.Path(part)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def committed(spark: SparkSession, folder: str, name: str = "buckets") -> DataFrame | None:
    """What micro-batches of `publish_stream` wrote under `name` (`buckets`, `pointers`), of those that have a commit
    record; None before the first. A part that was cut off while it was written has none and is not read."""
    if not path_exists(spark, f"{folder}/commits"):
        return None
    records = spark.read.schema(_COMMIT).parquet(f"{folder}/commits").select("batch_id")
    rows = spark.read.parquet(f"{folder}/{name}").withColumn("batch_id", F.col("batch_id").cast("bigint"))
    return rows.join(records.distinct(), "batch_id", "left_semi")


def latest_pointers(spark: SparkSession, folder: str, group: Sequence[str] = ("query_hash",)) -> DataFrame:
    """Per group the bucket that was published last: the greatest of the committed pointers."""
    return committed(spark, folder, "pointers").groupBy(*group).agg(F.max("bucket_ts").alias("bucket_ts"))


def _run(stream: DataFrame, step: Callable[[DataFrame, int], None], folder: str, name: str) -> None:
    query = (
        stream.writeStream.outputMode("append").foreachBatch(step)
        .option("checkpointLocation", f"{folder}/{name}-checkpoint")
        .trigger(availableNow=True).start()
    )
    run_counted(query)


def publish_stream(
    results: DataFrame, folder: str, group: Sequence[str] = ("query_hash",), size: int = PUBLISH_BATCH,
    ts: str = "emitted_at", ties: Sequence[str] = ("event_id",),
) -> str:
    """Publishes a stream of results in full batches, as bucket rows under `folder/buckets`.

    Every micro-batch takes the rows that the one before left over, publishes what now fills
    batches and writes down the rest, fewer than `size` rows per group. Its output carries
    the micro-batch's number and is overwritten if the micro-batch runs again. Beside the buckets
    it writes pointers, the latest bucket of each group, and last of all a record that commits it;
    `committed` reads only what has one. Of rows that arrived or wait, those of two micro-batches are kept at most.
    """
    arrived, buckets, pending, pointers, commits = (
        f"{folder}/{name}" for name in ("arrived", "buckets", "pending", "pointers", "commits"))

    def commit(spark: SparkSession, batch_id: int) -> None:
        full = spark.read.parquet(_part(buckets, batch_id))
        last = full.groupBy(*group).agg(F.max("bucket_ts").alias("bucket_ts"))
        last.write.mode("overwrite").parquet(_part(pointers, batch_id))
        record = (batch_id, full.count(), spark.read.parquet(_part(pending, batch_id)).count())
        # One file, named by the micro-batch: seen whole or not at all.
        spark.createDataFrame([record], _COMMIT).coalesce(1).write.mode("overwrite").parquet(f"{commits}/part={batch_id}")
        _forget(spark, _part(arrived, batch_id), _part(pending, batch_id - 2))

    def step(batch: DataFrame, batch_id: int) -> None:
        # The batch is stored before it is used more than once: a stateful micro-batch must
        # be computed only one time.
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(_part(arrived, batch_id))
        fresh = spark.read.schema(batch.schema).parquet(_part(arrived, batch_id))
        rows, before = fresh, _part(pending, batch_id - 1)
        if batch_id:
            if not path_exists(spark, before):
                raise RuntimeError(f"{before} is gone: rows that wait for a full batch would be lost")
            rows = fresh.unionByName(spark.read.schema(batch.schema).parquet(before))
        if fresh.isEmpty():
            none = fresh.withColumn("bucket_ts", F.lit(None).cast("bigint"))
            none.write.mode("overwrite").parquet(_part(buckets, batch_id))
            rows.write.mode("overwrite").parquet(_part(pending, batch_id))
            commit(spark, batch_id)
            return
        counted = ordinal_batch(rows, group, size, ts, ties)
        counted.persist()
        full = bucketed(counted.where("full"), group, ts)
        full.drop("full", "ordinal", "batch").write.mode("overwrite").parquet(_part(buckets, batch_id))
        left = counted.where("NOT full").select(*batch.columns)
        left.write.mode("overwrite").parquet(_part(pending, batch_id))
        counted.unpersist()
        commit(spark, batch_id)

    _run(results, step, folder, "publish")
    return buckets


def r2s_stream(results: DataFrame, folder: str, spec: WindowSpec, mode: str) -> str:
    """IStream or DStream of closed windows, in two stages.

    `results` is a windowed aggregate in append mode: a micro-batch brings all rows of the
    windows that closed since the one before. It is stored under `closed` and compared with
    the rows of the last slide before it, which the micro-batch before put under `recent`.
    `done` remembers up to which window end that has come, so that a deletion is also
    reported where the later window is empty.
    """
    closed, recent, done, out = (f"{folder}/{name}" for name in ("closed", "recent", "done", mode.lower()))
    end, slide = F.col("window.end"), F.expr(f"INTERVAL '{spec.slide / 1000:.3f}' SECOND")

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(_part(closed, batch_id))
        rows = spark.read.schema(batch.schema).parquet(_part(closed, batch_id))
        upto, newest = None, rows.agg(F.max(end).alias("upto")).first()["upto"]
        if batch_id:
            if not path_exists(spark, _part(done, batch_id - 1)):
                raise RuntimeError(f"{_part(done, batch_id - 1)} is gone: changes since the last micro-batch would be lost")
            upto = spark.read.schema("upto timestamp").parquet(_part(done, batch_id - 1)).first()["upto"]
            rows = rows.unionByName(spark.read.schema(batch.schema).parquet(_part(recent, batch_id - 1)))
        newest = newest or upto
        changed = r2s(rows, spec, mode).where(end <= F.lit(newest).cast("timestamp"))
        if upto is not None:
            changed = changed.where(end > F.lit(upto))
        changed.write.mode("overwrite").parquet(_part(out, batch_id))
        rows.where(end > F.lit(newest).cast("timestamp") - slide).write.mode("overwrite").parquet(_part(recent, batch_id))
        reached = spark.createDataFrame([(newest,)], "upto timestamp")
        reached.write.mode("overwrite").parquet(_part(done, batch_id))
        _forget(spark, _part(closed, batch_id), _part(recent, batch_id - 2), _part(done, batch_id - 2))

    _run(results, step, folder, mode.lower())
    return out
