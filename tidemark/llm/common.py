"""What several operators share: tables, measured broadcasts, words and their digests."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows of at most a few dozen bytes each; a table with more is never broadcast.
BROADCAST_ROWS = 500_000
# Whitespace that ends a word: the same six characters at which bytes.split() splits.
WORD = r"[^\x20\x09-\x0D]+"
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df`, marked for broadcasting if it was counted to have `rows` rows at most. Meant for
    written tables of narrow rows; a longer one is joined by shuffling."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def bucket_of(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null without an id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(n))


class Digests(dict):
    """64-bit digests of words, kept while there are few enough to hold and a task runs."""

    limit = 100_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


DIGESTS = Digests()


def digests_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(DIGESTS.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers evenly, one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Digests of all runs of `size` words, in order."""
    n = len(words) - size + 1
    out = np.zeros(max(n, 0), np.uint64)
    for i in range(size):
        out = mixed(out * np.uint64(3) + words[i:i + n]) if n > 0 else out
    return out


def texts(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """UTF-8 of a text column; null gives nothing."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


# What a Python worker keeps while a task runs, besides DIGESTS: functions that forget it.
FORGET: list[Callable[[], None]] = [DIGESTS.clear]
# Bytes of a batch that are Python objects at a time.
SLICE_BYTES = 4 << 20


def sliced(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in stretches of rows of some `SLICE_BYTES`; a longer row is a stretch of its own."""
    rows = max(1, int(batch.num_rows * SLICE_BYTES / max(batch.nbytes, 1)))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _task_over() -> None:
    for forget in FORGET:
        forget()
    pa.default_memory_pool().release_unused()


def over_batches(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """`work` on every Arrow batch of `df`, a stretch of it at a time. Workers outlive tasks, so what they
    kept is forgotten at the end of each, and memory handed back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                for part in sliced(batch):
                    out = work(part)
                    if out is not None:
                        yield out
        finally:
            _task_over()

    return df.mapInArrow(run, schema)
