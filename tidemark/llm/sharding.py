"""A uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

Every input partition permutes its rows. How many of them go to which shard is drawn beforehand:
the rows of a partition are a draw without replacement from the places that shards have left, so
a matrix row follows the multivariate hypergeometric law and every column adds up to the shard's
size. Partitions then cut their permuted rows at the drawn counts, rows are exchanged, and each
shard permutes what it got. All orders of all rows are equally likely, and shards differ by one
row at most.

Rows are handled by DataFrame functions; the driver only draws the matrix, from one count per
input partition. Permutations are written before rows are counted, so a task that runs again
finds the same places. Rows need no key: nulls in any column, equal ids and equal rows are rows
of their own. An empty table gives no rows. The row as it came is the struct `row`, so its column
names meet no others.
"""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import small
from tidemark.session import stored

SHARDS = 8
# Rows of a shard that one task permutes, on average.
PIECE_ROWS = 20_000
# Matrix rows in one literal.
CHUNK = 5_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of `draws` places, taken without replacement, are among the `good` ones.

    The law is summed up around its mode, twelve deviations to either side, from the ratios of
    neighbouring chances; what lies beyond is less likely than 10^-30.
    """
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    total = good + bad
    spread = math.ceil(12 * math.sqrt(draws * (good / total) * (bad / total)) + 30)
    mode = min(max((draws + 1) * (good + 1) // (total + 2), low), high)
    low, high = max(low, mode - spread), min(high, mode + spread)
    k = np.arange(low, high, dtype=np.float64)
    steps = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1)
    chance = np.concatenate([[0.0], np.cumsum(steps)])
    upto = np.cumsum(np.exp(chance - chance.max()))
    return low + min(int(np.searchsorted(upto, rng.random() * upto[-1], "right")), high - low)


def matrix(rng: np.random.Generator, parts: list[int], shards: list[int]) -> list[list[int]]:
    """Rows from each part to each shard: rows add up to `parts`, columns to `shards`."""
    left, out = list(shards), []
    for rows in parts:
        total, row = sum(left), []
        for places in left:
            total -= places
            taken = hypergeometric(rng, places, total, rows)
            rows -= taken
            row.append(taken)
        left = [a - b for a, b in zip(left, row)]
        out.append(row)
    return out


def _bounds(spark: SparkSession, parts: list[int], drawn: list[list[int]]) -> DataFrame:
    """part, bounds: the places of a part at which its rows for one shard end."""
    rows = [{"part": p, "bounds": np.cumsum(r).tolist()} for p, r in zip(parts, drawn)]
    chunks = [json.dumps(rows[i:i + CHUNK]) for i in range(0, max(len(rows), 1), CHUNK)]
    table = spark.range(1).select(F.explode(F.array(*[F.lit(c) for c in chunks])).alias("text"))
    return table.select(F.inline(F.from_json("text", "array<struct<part:int,bounds:array<bigint>>>")))


def _permuted(df: DataFrame, seed: int) -> DataFrame:
    """`row`, its partition, its place there after a random order, and a number to draw lots by later."""
    lots = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
                     F.rand(seed).alias("_lot"), F.rand(seed + 1).alias("lot"))
    at = F.monotonically_increasing_id()  # partition in the upper 31 bits, place in the lower 33
    placed = lots.sortWithinPartitions("_lot").select("row", "lot", at.alias("_at"))
    return placed.select("row", "lot", F.shiftright("_at", 33).cast("int").alias("part"),
                         F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias("place"))


def shuffled(df: DataFrame, shards: int = SHARDS, seed: int = 0, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """`row`, `shard` and `slot`, the gapless place in the shard.

    A shard is permuted in pieces: a row's lot decides its piece and its place there, and pieces
    are counted so that a slot is the rows of the pieces before plus the place in the piece.
    """
    spark = df.sparkSession
    rows = stored(_permuted(df, seed), "permuted")
    counts = sorted((r["part"], r["n"]) for r in rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())
    total = sum(n for _, n in counts)
    sizes = [total // shards + (s < total % shards) for s in range(shards)]
    drawn = matrix(np.random.default_rng(seed), [n for _, n in counts], sizes)
    bounds = small(stored(_bounds(spark, [p for p, _ in counts], drawn), "matrix"))
    pieces = max(1, math.ceil(total / shards / piece_rows))

    def passed(bound: Column) -> Column:
        return bound <= F.col("place")

    sent = rows.join(bounds, "part").select(
        "row", "lot", "part", "place", F.size(F.filter("bounds", passed)).alias("shard"),
        F.floor(F.col("lot") * pieces).cast("int").alias("piece"))
    sized = stored(sent.groupBy("shard", "piece").agg(F.count(F.lit(1)).alias("n")), "pieces")
    earlier = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    before = sized.select("shard", "piece", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    order = Window.partitionBy("shard", "piece").orderBy("lot", "part", "place")
    ranked = sent.withColumn("own", F.row_number().over(order) - 1)
    return ranked.join(small(before), ["shard", "piece"]).select("row", "shard", (F.col("before") + F.col("own")).alias("slot"))


def sharded(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """doc_id, size (bytes of the text plus 1), text_crc32, law, shard, slot, grown_shard; texts
    themselves are not moved. Null text counts as empty."""
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    narrow = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    return shuffled(narrow, shards, seed).select(
        "row.*", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
