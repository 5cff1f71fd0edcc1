"""Event-time order, positions within a group, and firsts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import time_cell
from tidemark.session import stored

HOUR_MS = 3_600_000
CELL_ROWS = 2_000_000


def sort_events(df: DataFrame, ts: str = "ts", seq: str = "seq") -> DataFrame:
    """Ascending by event time; equal times keep their arrival order."""
    return df.orderBy(ts, seq)


def sort_in_bucket(df: DataFrame, bucket: Sequence[str], ts: str = "ts", seq: str = "seq") -> DataFrame:
    """Each bucket's rows in event-time order.

    Ranges over (bucket, time) keep the rows of a bucket together as long as they are few
    and cut a bucket that is large over consecutive tasks.
    """
    return df.repartitionByRange(*bucket, ts, seq).sortWithinPartitions(*bucket, ts, seq)


def sort_strings(df: DataFrame, col: str) -> DataFrame:
    return df.orderBy(col)


def cell_counts(
    df: DataFrame, group: Sequence[str], ts: str, cell_ms: int | None = None, cell_rows: int = CELL_ROWS
) -> tuple[int, DataFrame]:
    """A cell length at which no group has more than `cell_rows` rows in one cell, and the
    rows per (group, `_cell`) in `_n`, stored.

    Cells start at an hour. If the fullest holds too many rows, they are cut shorter by as
    much as it is too full, and counted anew. Rows of one group at one instant cannot be
    parted, so there is an end to it. A given `cell_ms` is taken as it is.
    """
    length = cell_ms or HOUR_MS
    while True:
        counts = stored(
            df.groupBy(*group, time_cell(ts, length).alias("_cell")).agg(F.count(F.lit(1)).alias("_n")),
            "cell-counts",
        )
        if cell_ms:
            return length, counts
        fullest = counts.agg(F.max("_n").alias("n")).first()["n"] or 0
        if fullest <= cell_rows or length == 1:
            return length, counts
        length = max(1, length * cell_rows // (2 * fullest))


def positions(
    df: DataFrame, group: Sequence[str], ts: str = "ts", ties: Sequence[str] = ("seq",), peers: bool = False,
) -> DataFrame:
    """Adds `ordinal`, the 0-based place in the group by (ts, ties), and `group_size`;
    with `peers` also `last_peer`, the highest ordinal among rows of the group with its ts.

    Rows are cut into ranges over (group, ts, ties), whatever their groups: a group, and rows of
    one instant, lie in as many ranges as they fill. Ranges are sorted and written, rows are
    counted per (range, group), and a place is the group's rows in the ranges before plus the
    place in its own. The input is read twice, to find the ranges and to fill them. Rows that
    are equal in all of that are told apart by a number drawn for them.
    """
    order = [*group, ts, *ties, "_lot"]
    cut = df.withColumn("_lot", F.rand(0)).repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()  # counts up within a range, and from range to range
    ranged = stored(cut.select(*df.columns, F.spark_partition_id().alias("_range"), at.alias("_at")), "ranges")
    piece = ["_range", *group]
    sizes = stored(ranged.groupBy(*piece).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first")), "range-sizes")
    whole = Window.partitionBy(*group)
    earlier = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(*[F.col(c).alias(f"_of_{c}") for c in piece], "_first",
                          F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("group_size"))
    # The key holds the range, so a group's rows meet in as many tasks as they fill ranges.
    rows = ranged.join(before, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in piece])
    placed = rows.select(*df.columns, (F.col("_before") + F.col("_at") - F.col("_first")).alias("ordinal"), "group_size")
    if not peers:
        return placed
    key = [*group, ts]
    shared = placed.groupBy(*[F.col(c).alias(f"_of_{c}") for c in key]).agg(
        F.max("ordinal").alias("_last"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).drop("_n")
    return placed.join(shared, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in key], "left").select(
        *placed.columns, F.coalesce("_last", "ordinal").alias("last_peer"))


def ordinal_batch(
    df: DataFrame, group: Sequence[str], size: int, ts: str = "ts", ties: Sequence[str] = ("seq",),
) -> DataFrame:
    """Adds `batch` (rows 0..size-1 of a group form batch 0, and so on) and `full`, whether
    the batch has all its rows."""
    placed = positions(df, group, ts, ties)
    return placed.select(
        *df.columns, "ordinal",
        F.floor(F.col("ordinal") / size).cast("bigint").alias("batch"),
        (F.col("ordinal") < F.col("group_size") - F.col("group_size") % size).alias("full"),
    )


def earliest(df: DataFrame, event: Sequence[str], by: Sequence[str] = (), ts: str = "ts", seq: str = "seq"):
    """Earliest event per group, first in among equals; an empty input gives no row.

    The least time is found first, by hashing over two columns. Only rows of that time are
    then compared; taking the whole event along at once would sort all rows.
    """
    least = df.groupBy(*by).agg(F.min(ts).alias(ts))
    least = least.select(*[F.col(c).alias(f"_least_{c}") for c in (*by, ts)])
    on = [F.col(c).eqNullSafe(F.col(f"_least_{c}")) for c in by] + [F.col(ts) == F.col(f"_least_{ts}")]
    nearest = df.join(least, on, "left_semi")
    first = F.min_by(F.struct(*event), seq).alias("_first")
    return nearest.groupBy(*by).agg(first).where(F.col("_first").isNotNull()).select(*by, "_first.*")


def first_object(triples: DataFrame, predicate: str, by: Sequence[str] = (), seq: str = "seq") -> DataFrame:
    """Object of the first triple with this predicate, else an empty text."""
    hits = triples.where(F.col("p") == predicate).groupBy(*by).agg(F.min_by("o", seq).alias("_o"))
    if by:
        keys, hits = triples.select(*by).distinct(), hits.select("_o", *[F.col(c).alias(f"_of_{c}") for c in by])
        found = keys.join(hits, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by], "left")
    else:
        found = hits
    return found.select(*by, F.coalesce("_o", F.lit("")).alias("first_object"))
