"""Live sources, watermarks, windows over live events, and running them to the end."""

from __future__ import annotations

from collections.abc import Sequence
from math import gcd

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.model import Agg, WindowSpec
from tidemark.operators.windows import RUNS_FROM, _direct, _final, _ms, _parts, algebraic, assign_windows
from tidemark.session import fresh_folder

EVENT_TIME = {"spark.watermarkDelayMs": 0}


def live_source(
    spark: SparkSession, path: str, schema, max_files_per_trigger: int = 30, fmt: str = "parquet"
) -> DataFrame:
    """Files that arrive under `path` as a stream, at most so many per trigger."""
    return (
        spark.readStream.format(fmt).schema(schema)
        .option("maxFilesPerTrigger", max_files_per_trigger).load(path)
    )


def with_watermark(stream: DataFrame, delay: str, ts: str = "ts") -> DataFrame:
    """Event time as an instant, with the delay after which an event counts as too late."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def dedup_stream(stream: DataFrame, key: Sequence[str] = ("member_id",)) -> DataFrame:
    """A member brought by replay, gap reading and live counts once. Needs a watermark; the
    keys are kept only as long as it asks."""
    return stream.dropDuplicatesWithinWatermark(list(key))


def live_window(
    stream: DataFrame, spec: WindowSpec, aggs: Sequence[Agg], delay: str | None = None,
    by: Sequence[str] = (), ts: str = "ts",
) -> DataFrame:
    """Windowed aggregates of a stream. `delay` sets the watermark where there is none yet.

    Where many windows overlap, events are aggregated to panes first."""
    if any(a.distinct and a.func not in ("max", "min", "sample") for a in aggs):
        raise ValueError("a stream has no DISTINCT aggregates: drop duplicates before aggregating")
    rows = with_watermark(stream, delay, ts) if delay else stream
    if spec.overlap > RUNS_FROM and spec.slide <= spec.width and all(algebraic(a) for a in aggs):
        return _live_panes(rows, spec, aggs, by, ts)
    return assign_windows(rows, spec, ts).groupBy("window", *by).agg(*[_direct(a) for a in aggs])


def _live_panes(rows: DataFrame, spec: WindowSpec, aggs: Sequence[Agg], by: Sequence[str], ts: str) -> DataFrame:
    """Two chained aggregations in append mode: events to panes, and closed panes to the windows that
    hold them. An event costs one row of state however many windows overlap, and the plan is of
    one size. Panes are as long as the greatest common divisor of width and slide, so a pane ends when
    or before each of its windows does, and none comes too late for one.
    """
    parts = {name: part for a in aggs for name, part in _parts(a).items()}
    panes = rows.groupBy(F.window(ts, _ms(gcd(spec.width, spec.slide))).alias("_pane"), *by).agg(
        *[col.alias(name) for name, (col, _) in parts.items()])
    spread = assign_windows(panes.withColumn("_at", F.col("_pane.start")), spec, "_at", laid_out=False)
    # Windows that are counted back from a pane are event time like it; the mark is what append mode
    # goes by (Spark's own `window` sets it too, but lays every window out in the plan).
    placed = spread.select(F.col("window").alias("window", metadata=EVENT_TIME), *by, *parts)
    whole = placed.groupBy("window", *by).agg(*[getattr(F, how)(name).alias(name) for name, (_, how) in parts.items()])
    return whole.select("window", *by, *[_final(a, {n: F.col(n) for n in _parts(a)}) for a in aggs])


def run_counted(query) -> None:
    """Waits for a query to end, and raises if rows came after the watermark and were left out.
    Progress is looked at as it comes, since a query keeps only the last of it."""
    dropped: dict[int, int] = {}

    def look():
        for p in query.recentProgress:
            late = sum(op["numRowsDroppedByWatermark"] for op in p["stateOperators"])
            dropped[p["batchId"]] = max(late, dropped.get(p["batchId"], 0))

    while not query.awaitTermination(1):
        look()
    look()
    if late := sum(dropped.values()):
        raise RuntimeError(f"{late} rows came after the watermark and were dropped: allow a longer delay")


def drain(stream: DataFrame, folder: str, name: str = "out") -> str:
    """Runs an append-mode stream over what its source holds now, into parquet. Run again
    with the same folder, it goes on where it stopped. Raises if rows were dropped as too late."""
    target = f"{folder}/{name}"
    query = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", f"{folder}/{name}-checkpoint").option("path", target)
        .trigger(availableNow=True).start()
    )
    run_counted(query)
    return target


def closing_source(spark: SparkSession, folder: str, schema) -> DataFrame:
    """A stream that stays silent until `close_windows` moves event time on."""
    end = f"{folder}/end-of-input"
    spark.createDataFrame([], schema).write.mode("ignore").parquet(end)
    return spark.readStream.format("parquet").schema(schema).load(end)


def close_windows(spark: SparkSession, folder: str, schema, ts: str, at: Column, apart: int = 10) -> None:
    """Adds two rows far ahead of all others, empty but for their time. A finite input has no
    later event that would close its last windows; these do. The second, `apart` years later, closes
    the first one's windows too, so that also an empty window is known to have passed.
    Their own results carry empty groups and values; leave those out once results are stored,
    as a filter on a group column would be moved below the watermark and hide these rows."""
    fields = spark.createDataFrame([], schema).schema
    far = spark.range(2).withColumn("_at", at + F.make_ym_interval(F.col("id").cast("int") * apart))
    rows = far.select(*[
        (F.col("_at") if f.name == ts else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields
    ])
    rows.coalesce(1).write.mode("append").parquet(f"{folder}/end-of-input")


def run_to_end(spark, build, folder: str, schema, ts: str, at: Column, run=drain, apart: int = 10):
    """Drains a stream, closes its windows and drains what they emit.

    `build(closing)` returns the streaming result, with `closing` unioned to its source.
    `apart` years must be more than the stream's delay.
    """
    run(build(closing_source(spark, folder, schema)), folder)
    close_windows(spark, folder, schema, ts, at, apart)
    return run(build(closing_source(spark, folder, schema)), folder)


def fresh_run(spark: SparkSession, purpose: str) -> str:
    return fresh_folder(spark, purpose)
