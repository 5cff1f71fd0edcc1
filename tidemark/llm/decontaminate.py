"""Benchmark decontamination by winnowing.

Of every run of words, the least digest of `GRAM`-word grams in each window of `WINDOW` grams is
kept as a fingerprint. Two texts that share GRAM + WINDOW - 1 = 13 words in a row share a
fingerprint there, so looking the documents' fingerprints up among those of the items finds a
place in every shared span of 13 words; from there the hits are extended over the item's windows
and compared word by word. Items of fewer words are one window each and are looked up whole.

The items go to the tasks in blocks of at most `BLOCK_WORDS` words; a larger benchmark means more
blocks, each joined to all documents. Documents are never shuffled, and a text is held once.
Null and empty texts have no words: n_words 0, not contaminated, and no windows as items. Items
with equal text are counted each; a null item_id is ignored; repeated document rows are judged
one by one. An empty benchmark hits nothing.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import digests_of, over_batches, shingles, texts
from tidemark.session import stored

SPAN, GRAM = 13, 6
WINDOW = SPAN - GRAM + 1
BLOCK_WORDS = 100_000
# ASCII letters and digits make words, lower-cased; so does everything outside ASCII.
_TO_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TO_WORDS).split()


def fingerprints(words: np.ndarray) -> np.ndarray:
    """Places of the winnowed grams: in each window of WINDOW grams the last of the least."""
    grams = shingles(words, GRAM)
    n = len(grams) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(grams, WINDOW)
    least = np.arange(n) + WINDOW - 1 - windows[:, ::-1].argmin(1)
    return np.unique(least)


class Index:
    """One block of items: their fingerprints, and their windows with the items that hold them."""

    def __init__(self, items: list[tuple[int, bytes]]):
        prints: list[np.ndarray] = []
        self.windows: dict[tuple[bytes, ...], set[int]] = {}
        digests: list[np.ndarray] = []
        for item, text in items:
            words = words_of(text)
            if not words:
                continue
            size = min(SPAN, len(words))
            h = digests_of(words)
            digests.append(shingles(h, size))
            if size == SPAN:
                prints.append(shingles(h, GRAM)[fingerprints(h)])
            for i in range(len(words) - size + 1):
                self.windows.setdefault(tuple(words[i:i + size]), set()).add(item)
        self.prints = np.unique(np.concatenate([np.zeros(0, np.uint64), *prints]))
        self.digests = np.unique(np.concatenate([np.zeros(0, np.uint64), *digests]))
        self.short = sorted({len(w) for w in self.windows if len(w) < SPAN})

    def hits(self, words: list[bytes]) -> tuple[np.ndarray, set[int]]:
        """Which words lie in an occurring window, and the items whose windows occur."""
        hit, items = np.zeros(len(words), bool), set()
        h = digests_of(words)
        starts = [(size, np.arange(len(words) - size + 1)) for size in self.short if size <= len(words)]
        if len(words) >= SPAN:
            at = fingerprints(h)
            at = at[_among(shingles(h, GRAM)[at], self.prints)]
            if len(at):  # all windows that a shared gram may lie in
                near = np.unique((at[:, None] - np.arange(WINDOW)[None, :]).ravel())
                starts.append((SPAN, near[(near >= 0) & (near <= len(words) - SPAN)]))
        for size, where in starts:
            for i in where[_among(shingles(h, size)[where], self.digests)]:
                found = self.windows.get(tuple(words[i:i + size]))
                if found:
                    hit[i:i + size] = True
                    items |= found
        return hit, items


def _among(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(x), bool)
    return table[np.minimum(np.searchsorted(table, x), len(table) - 1)] == x


def _blocks(items: DataFrame, item_id: str, text: str, block_words: int) -> list[DataFrame]:
    """`items` cut into parts of about `block_words` words (a longer item is a part of its own)."""
    known = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text"))
    size = F.sum(F.length("text")).alias("n")
    chars = known.agg(size).first()["n"] or 0
    n = max(1, -(-chars // (4 * block_words)))
    return [known.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k) for k in range(n)] if n > 1 else [known]


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of `docs`."""
    sc = docs.sparkSession.sparkContext
    blocks = _blocks(items, item_id, item_text, block_words)
    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    if len(blocks) == 1:
        shared = sc.broadcast(_index_of(blocks[0]))
        return over_batches(picked, lambda batch: _judged(batch, [shared.value.hits(w) for w in map(words_of, texts(batch, "text"))]),
                            SCHEMA)
    # Each block's hits are written; a row's hits of all blocks then meet by its place in the table.
    picked = stored(picked.withColumn("row", F.monotonically_increasing_id()), "documents-in-place")
    parts = []
    for block in blocks:
        shared = sc.broadcast(_index_of(block))

        def work(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch | None:
            found = [shared.value.hits(words_of(t)) for t in texts(batch, "text")]
            keep = [i for i, f in enumerate(found) if f[1]]
            if not keep:
                return None
            return pa.RecordBatch.from_arrays(
                [batch.column("row").take(pa.array(keep)), pa.array([np.flatnonzero(found[i][0]) for i in keep], pa.list_(pa.int64())),
                 pa.array([sorted(found[i][1]) for i in keep], pa.list_(pa.int64()))], ["row", "hit", "items"])

        parts.append(stored(over_batches(picked, work, "row long, hit array<long>, items array<long>"), "block-hits"))
        shared.unpersist()
    hits = reduce(DataFrame.unionAll, parts).groupBy("row").agg(
        F.flatten(F.collect_list("hit")).alias("hit"), F.flatten(F.collect_list("items")).alias("items"))

    def merged(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for t, places, ids in zip(texts(batch, "text"), batch.column("hit").to_pylist(), batch.column("items").to_pylist()):
            hit = np.zeros(len(words_of(t)), bool)
            hit[np.array(places or [], np.int64)] = True
            found.append((hit, set(ids or ())))
        return _judged(batch, found)

    return over_batches(picked.join(hits, "row", "left").select("doc_id", "text", "hit", "items"), merged, SCHEMA)


def _index_of(block: DataFrame) -> Index:
    """Built on the driver from at most a block's words."""
    return Index([(r["item_id"], (r["text"] or "").encode()) for r in block.toLocalIterator()])


SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _contaminated(hit: np.ndarray) -> bool:
    """A twentieth of the words at least, and one at least."""
    n = int(hit.sum())
    return n > 0 and 20 * n >= len(hit)


def _judged(batch: pa.RecordBatch, found: list[tuple[np.ndarray, set[int]]]) -> pa.RecordBatch:
    n_words, n_hit = [len(h) for h, _ in found], [int(h.sum()) for h, _ in found]
    named = [",".join(sorted(map(str, items))) for _, items in found]
    return pa.RecordBatch.from_arrays([
        batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()),
        pa.array([len(items) for _, items in found], pa.int64()),
        pa.array([hashlib.sha256(n.encode()).hexdigest() for n in named], pa.string()),
        pa.array([_contaminated(h) for h, _ in found], pa.bool_()),
    ], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id",
                      item_text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """`docs` without contaminated rows, all columns as they are."""
    blocks = _blocks(items, item_id, item_text, block_words)
    if len(blocks) == 1:
        shared = docs.sparkSession.sparkContext.broadcast(_index_of(blocks[0]))

        def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            keep = [not _contaminated(shared.value.hits(words_of(t))[0]) for t in texts(batch, text)]
            return batch.filter(pa.array(keep, pa.bool_())) if any(keep) else None

        return over_batches(docs, work, docs.schema)
    place = "row"
    while place in docs.columns:
        place += "_"
    kept = stored(docs.withColumn(place, F.monotonically_increasing_id()), "documents-in-place")
    verdicts = contamination(kept, items, place, text, item_id, item_text, block_words)
    bad = verdicts.where("contaminated").select(F.col("doc_id").alias(place))
    return kept.join(bad, place, "left_anti").drop(place)
