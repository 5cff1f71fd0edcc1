"""Time buckets of an event log: as-of assignment, overflow, rebalancing, first load."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import bucket_url_sibling, epoch_ms, epoch_us, time_cell
from tidemark.operators.ordering import cell_counts, positions
from tidemark.session import stored

NO_BUCKET = "none"
BROADCAST_INDEX_ROWS = 10_000


def with_until(index: DataFrame, by: Sequence[str] = ("stream",)) -> DataFrame:
    """Adds `until`, the lower bound of the bucket that follows."""
    following = Window.partitionBy(*by).orderBy("value")
    return index.withColumn("until", F.lead("value").over(following))


def prune_buckets(index: DataFrame, frm, to, by: Sequence[str] = ("stream",)) -> DataFrame:
    """Buckets whose time range can meet the closed interval `[frm, to]`: those that start
    within it, and the one before, in which `frm` falls.

    That one is the greatest start up to `frm`, a maximum with partial results; the starts of
    a stream need not be sorted.
    """
    value = F.col("value")
    within = index.where((value > F.lit(frm)) & (value <= F.lit(to)))
    earlier = index.where((value <= F.lit(frm)) & (value <= F.lit(to)))
    holding = earlier.groupBy(*by).agg(F.max("value").alias("value"))
    return within.unionByName(earlier.join(holding, [*by, "value"], "left_semi").select(*index.columns))


def _usable(index: DataFrame, by: Sequence[str]) -> DataFrame:
    # Bounds at or before the epoch never win; of equal bounds one node stands for all.
    return index.where(epoch_us("value") > 0).groupBy(*by, "value").agg(F.min("node").alias("node"))


def assign_bucket(
    members: DataFrame,
    index: DataFrame,
    by: Sequence[str] = ("stream",),
    ts: str = "ts",
    cell_ms: int | None = None,
    broadcast_rows: int = BROADCAST_INDEX_ROWS,
) -> DataFrame:
    """Adds `bucket`: the node of the greatest bound `<= ts`, else `none`.

    The index is measured first. Up to `broadcast_rows` bounds it is sent to the members,
    which then stay where they are. A longer index is merged with the members in time order
    instead, cut into time cells so that no stream is sorted in one task.
    """
    bounds = _usable(index, by)
    size = index.agg(
        F.count(F.lit(1)).alias("n"),
        F.approx_count_distinct(F.struct(*by)).alias("groups"),
        F.min(epoch_ms("value")).alias("first"),
        F.max(epoch_ms("value")).alias("last"),
    ).first()
    if size["n"] <= broadcast_rows:
        return _assign_small(members, bounds, by, ts, size)
    return _assign_large(members, bounds, by, ts, cell_ms)


def _assign_small(members, bounds, by, ts, size) -> DataFrame:
    if size["n"] == 0:
        return members.withColumn("bucket", F.lit(NO_BUCKET))
    # As many cells as a group has bounds on average: some three rows per bound at most.
    per_group = max(1, size["n"] // max(1, size["groups"]))
    cell_ms = max(1, (size["last"] - size["first"]) // per_group + 1)
    last_cell = size["last"] // cell_ms
    span = F.sequence(
        time_cell("value", cell_ms),
        F.least(F.coalesce(time_cell("until", cell_ms), F.lit(last_cell)), F.lit(last_cell)),
    )
    cells = with_until(bounds, by).select(
        *[F.col(c).alias(f"_{c}") for c in by], F.explode(span).alias("_cell_of"),
        F.col("value").alias("_value"), F.col("until").alias("_until"), F.col("node").alias("_node"),
    )
    keyed = members.withColumn("_cell", F.least(time_cell(ts, cell_ms), F.lit(last_cell)))
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by] + [
        F.col("_cell") == F.col("_cell_of"),
        F.col(ts) >= F.col("_value"),
        F.col("_until").isNull() | (F.col(ts) < F.col("_until")),
    ]
    joined = keyed.join(F.broadcast(cells), on, "left")
    return joined.select(*members.columns, F.coalesce("_node", F.lit(NO_BUCKET)).alias("bucket"))


def _assign_large(members, bounds, by, ts, cell_ms) -> DataFrame:
    cell = [*by, "_cell"]
    cell_ms, counts = cell_counts(members, by, ts, cell_ms)
    keyed = members.withColumn("_cell", time_cell(ts, cell_ms))
    marks = bounds.withColumn("_cell", time_cell("value", cell_ms))
    # What a cell starts with: the last bound of the cells before it. One row per cell.
    latest = marks.groupBy(*cell).agg(F.max_by("node", "value").alias("_last"))
    used = counts.select(*cell, F.lit(None).cast("string").alias("_last"))
    before = Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        latest.unionByName(used).groupBy(*cell).agg(F.max("_last").alias("_last"))
        .select(*cell, F.last("_last", ignorenulls=True).over(before).alias("node"))
        .where(F.col("node").isNotNull())
        .withColumn("value", F.lit(None).cast(bounds.schema["value"].dataType))
    )
    rows = keyed.withColumns({"_node": F.lit(None).cast("string"), "_row": F.lit(1)})
    others = [f for f in members.schema if f.name not in by and f.name != ts]
    # What is carried has no time and thus comes first in its cell.
    bound_rows = marks.unionByName(carried).select(
        *cell, F.col("value").alias(ts), F.col("node").alias("_node"), F.lit(0).alias("_row"),
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in others],
    )
    so_far = Window.partitionBy(*cell).orderBy(ts, "_row").rowsBetween(Window.unboundedPreceding, 0)
    merged = rows.unionByName(bound_rows).withColumn("_held", F.last("_node", ignorenulls=True).over(so_far))
    return merged.where(F.col("_row") == 1).select(
        *members.columns, F.coalesce("_held", F.lit(NO_BUCKET)).alias("bucket")
    )


def overflow(members: DataFrame, size: int, by: Sequence[str] = ("bucket",)) -> DataFrame:
    """Buckets with more than `size` members, and how many they have."""
    return members.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > size)


def earliest_ts(members: DataFrame, by: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    return members.groupBy(*by).agg(F.min(ts).alias("earliest"))


def rebalance(
    members: DataFrame,
    size: int,
    by: Sequence[str] = ("stream", "bucket"),
    ts: str = "ts",
    ties: Sequence[str] = ("seq",),
) -> DataFrame:
    """Splits overfull buckets: `bucket` becomes the new one, `old_bucket` keeps the former.

    In event-time order the rows at places size, 2*size, ... each start a new bucket, named
    by their time in milliseconds. A row belongs to the last bucket that starts no later
    than its own time; rows before the first start stay. So rows with one event time stay
    together and a bucket may exceed `size`.
    """
    placed = positions(members, by, ts, ties, peers=True)
    chunked = placed.withColumn("_chunk", F.floor(F.col("last_peer") / size).cast("bigint"))
    chunk = [*by, "_chunk"]
    # All rows of a chunk are at or after its first place, so the least time is that of the start.
    starts = Window.partitionBy(*chunk)
    named = chunked.withColumn("_start", F.min(ts).over(starts))
    return named.select(
        *[c for c in members.columns if c != "bucket"],
        F.col("bucket").alias("old_bucket"),
        F.when(F.col("_chunk") == 0, F.col("bucket"))
        .otherwise(bucket_url_sibling("bucket", epoch_ms("_start")))
        .alias("bucket"),
    )


def initial_load(
    members: DataFrame,
    index: DataFrame,
    size: int,
    root: str = "stream",
    ts: str = "ts",
    ties: Sequence[str] = ("seq",),
    cell_ms: int | None = None,
) -> DataFrame:
    """Members into buckets: as-of over the index, one new bucket for what lies before it
    (named by the least time of the load), then rebalanced."""
    # The least time of a stream is one bound more of its index, which takes what no other does: the
    # members meet the index once, and are joined with nothing else.
    first = earliest_ts(members, [root], ts).where(F.col(root).isNotNull() & F.col("earliest").isNotNull())
    new_bucket = F.concat(root, epoch_ms("earliest").cast("string"), F.lit("/"))
    known = _usable(index, (root,)).groupBy(F.col(root).alias("_root")).agg(F.min("value").alias("_least"))
    needed = first.join(known, F.col(root) == F.col("_root"), "left").where(F.col("_least").isNull() | (F.col("earliest") < F.col("_least")))
    added = needed.select(root, new_bucket.alias("node"), F.col("earliest").alias("value"))
    wider = stored(index.select(root, "node", "value").unionByName(added), "wider-index")
    placed = assign_bucket(members, wider, (root,), ts, cell_ms)
    return rebalance(placed, size, (root, "bucket"), ts, ties)
