"""Vectors to short codes: each of four parts is named by its nearest codebook entry, and
codebooks are found by Lloyd's rounds over cover trees.

Components become integers, floor(1024 * x), and all that follows is exact. Each task cuts its
vectors into groups of TREE_ROWS and builds one cover tree per group and part, once; trees are
written. A node is a stretch of the points in tree order, its first point the centre, with the
largest distance from it as radius; a child covers half of that, and children's centres are
further apart. In a round, a node whose nearest entry is closer than the second by more than
twice the radius goes to that entry whole, by the difference of two cumulative sums (triangle
inequality); others descend, and in the last ones points are compared one by one. Rounding is
on the safe side: in doubt a node descends. Of a task, only sums and counts by entry leave it.

Vectors that are null, empty, or hold null or non-finite components are dropped. Kept vectors must
have one length, which four divides, and components below 65,536: else a ValueError says which. Null ids come
after all others among the first entries, equal ids in the order of their vectors. With fewer
than 256 vectors there are as many entries. Null labels count as one label. An empty table gives
no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import small
from tidemark.session import stored

PARTS, ENTRIES, ROUNDS = 4, 256, 4
SCALE = 1024
LARGEST = 65_536.0
TREE_ROWS = 1024
# Points of a node that is not divided further.
LEAF = 8


def kept_vectors(df: DataFrame, vec_id: str, vector: str, label: str) -> DataFrame:
    v = F.col(vector).cast("array<double>")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.select(F.col(vec_id).alias("vec_id"), v.alias("vector"), F.col(label).alias("label")).where(
        F.col("vector").isNotNull() & (F.size("vector") > 0) & whole)


def integers(vectors: list[list[float]], parts: int) -> np.ndarray:
    lengths = {len(v) for v in vectors}
    if len(lengths) > 1 or any(n % parts for n in lengths):
        raise ValueError(f"vectors need one length that {parts} divides, not {sorted(lengths)}")
    x = np.array(vectors, np.float64)
    if x.size and np.abs(x).max() >= LARGEST:
        raise ValueError(f"components of {LARGEST:g} and more are not supported")
    return np.floor(x * SCALE).astype(np.int64)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x from all rows of y."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(y).max(initial=0)))
    if 4 * x.shape[1] * most * most < 1 << 53:  # whole numbers that doubles hold exactly
        x, y = x.astype(np.float64), y.astype(np.float64)
    return ((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T)).astype(np.int64)


def cover_tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the points, and nodes (from, to, squared radius, first child, end of children),
    the root first and children of a node side by side."""
    apart, order = squared(x, x), np.arange(len(x))
    nodes, at = [[0, len(x), 0, 0, 0]], 0
    while at < len(nodes):
        start, end = nodes[at][:2]
        rest = order[start:end]
        nodes[at][2] = radius = int(apart[rest[0], rest].max())
        if radius and end - start > LEAF:
            nodes[at][3], place, covered = len(nodes), start, []
            while len(rest):
                near = 4 * apart[rest[0], rest] <= radius
                covered.append(rest[near])
                nodes.append([place, place + len(covered[-1]), 0, 0, 0])
                place, rest = place + len(covered[-1]), rest[~near]
            order[start:end] = np.concatenate(covered)
            nodes[at][4] = len(nodes)
        at += 1
    return order, np.array(nodes, np.int64)


def _ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    size = end - start
    return np.arange(size.sum()) + np.repeat(start - np.cumsum(size) + size, size)


def assigned(x: np.ndarray, nodes: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Entry of each point (in tree order), sums and counts by entry, and how many points were
    compared one by one."""
    code = np.empty(len(x), np.int64)
    sums, counts, looked = np.zeros_like(book), np.zeros(len(book), np.int64), 0
    upto = np.concatenate([np.zeros((1, x.shape[1]), np.int64), np.cumsum(x, axis=0)])
    front = nodes[:1]
    while len(front):
        start, end, radius, first, last = front.T
        away = squared(x[start], book)
        best = away.argmin(1)  # of ties the lower entry
        nearest = np.sqrt(away[np.arange(len(front)), best])
        away[np.arange(len(front)), best] = np.iinfo(np.int64).max
        second = np.sqrt(away.min(1).astype(np.float64))
        whole = (radius == 0) | (second - nearest > 2 * np.sqrt(radius) + 1e-6 * (1 + second))
        code[_ranges(start[whole], end[whole])] = np.repeat(best[whole], (end - start)[whole])
        np.add.at(sums, best[whole], upto[end[whole]] - upto[start[whole]])
        np.add.at(counts, best[whole], (end - start)[whole])
        leaf = ~whole & (first == last)
        points = _ranges(start[leaf], end[leaf])
        if len(points):
            own = squared(x[points], book).argmin(1)
            code[points] = own
            np.add.at(sums, own, x[points])
            np.add.at(counts, own, 1)
            looked += len(points)
        deeper = ~whole & (first < last)
        front = nodes[_ranges(first[deeper], last[deeper])]
    return code, sums, counts, looked


def _planted(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """One row per group of vectors: ids, labels and the tree of each part."""

    def row(table: pa.Table) -> pa.RecordBatch:
        x = integers(table.column("vector").to_pylist(), parts)
        trees, wide = [], x.shape[1] // parts
        for k in range(parts):
            own = x[:, k * wide:(k + 1) * wide]
            order, nodes = cover_tree(own)
            trees.append({"points": own[order].astype("<i4").tobytes(), "place": order.astype("<i4").tobytes(), "nodes": nodes.astype("<i8").tobytes()})
        one = lambda name: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.concat_arrays(table.column(name).chunks))
        return pa.RecordBatch.from_arrays([one("vec_id"), one("label"), pa.array([trees], TREES)], ["ids", "labels", "trees"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        while sum(map(len, held)) >= TREE_ROWS:
            table = pa.Table.from_batches(held)
            yield row(table.slice(0, TREE_ROWS))
            held = table.slice(TREE_ROWS).to_batches()
    if sum(map(len, held)):
        yield row(pa.Table.from_batches(held))


TREES = pa.list_(pa.struct([("points", pa.binary()), ("place", pa.binary()), ("nodes", pa.binary())]))


def _tree(row: dict, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    points = np.frombuffer(row["points"], "<i4").reshape(n, -1).astype(np.int64)
    return points, np.frombuffer(row["place"], "<i4"), np.frombuffer(row["nodes"], "<i8").reshape(-1, 5).astype(np.int64)


def trees_of(vectors: DataFrame, parts: int = PARTS) -> DataFrame:
    kind = {f.name: f.dataType.simpleString() for f in vectors.schema}
    schema = f"ids array<{kind['vec_id']}>, labels array<{kind['label']}>, trees array<struct<points:binary,place:binary,nodes:binary>>"
    return vectors.select("vec_id", "vector", "label").mapInArrow(lambda b: _planted(b, parts), schema)


def first_books(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray:
    """parts x entries x width: the vectors of the least ids."""
    rows = vectors.select("vector").orderBy(F.asc_nulls_last("vec_id"), "vector").limit(entries).collect()
    x = integers([r["vector"] for r in rows], parts)
    return x.reshape(len(x), parts, -1).transpose(1, 0, 2).copy() if len(x) else np.zeros((parts, 0, 0), np.int64)


def next_books(trees: DataFrame, books: np.ndarray) -> np.ndarray:
    """Each entry replaced by the mean of what it was assigned, rounded down; unused ones stay."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros_like(books), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            for ids, trees_ in zip(batch.column("ids"), batch.column("trees").to_pylist()):
                for k, tree in enumerate(trees_):
                    points, _, nodes = _tree(tree, len(ids))
                    _, s, c, _ = assigned(points, nodes, books[k])
                    total[k] += s
                    count[k] += c
        part, entry = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([
            pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry], pa.int64()),
            pa.array(list(total[part, entry]), pa.list_(pa.int64())),
        ], ["part", "entry", "n", "sums"])

    found = trees.mapInArrow(sums, "part int, entry int, n long, sums array<bigint>")
    by_place = found.select("part", "entry", "n", F.posexplode("sums").alias("place", "s")).groupBy("part", "entry", "place").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"))
    out = books.copy()
    for r in by_place.collect():  # parts x entries x width numbers at most
        out[r["part"], r["entry"], r["place"]] = r["s"] // r["n"]
    return out


def coded(trees: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code, error by the given codebooks."""
    kind = {f.name: f.dataType.elementType.simpleString() for f in trees.schema if f.name in ("ids", "labels")}

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, labels, trees_ in zip(batch.column("ids"), batch.column("labels"), batch.column("trees").to_pylist()):
                n = len(ids)
                code, error = np.zeros((n, len(books)), np.uint8), np.zeros(n, np.int64)
                for k, tree in enumerate(trees_):
                    points, place, nodes = _tree(tree, n)
                    own = assigned(points, nodes, books[k])[0]
                    code[place, k] = own
                    error[place] += ((points - books[k][own]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([
                    ids.values, labels.values, pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(error, pa.int64()),
                ], ["vec_id", "label", "code", "error"])

    return trees.mapInArrow(codes, f"vec_id {kind['ids']}, label {kind['labels']}, code string, error long")


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compressed(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
               rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, code, error, label_error and codebooks_sha256 of each kept vector; and the
    codebooks, parts x entries x width."""
    vectors = kept_vectors(df, vec_id, vector, label)
    books, trees = first_books(vectors), stored(trees_of(vectors), "cover-trees")
    for _ in range(rounds if books.size else 0):
        books = next_books(trees, books)
    out = stored(coded(trees, books), "vector-codes")
    by_label = out.groupBy(F.col("label").alias("of_label")).agg(F.sum("error").alias("label_error"))
    out = out.join(small(by_label), F.col("label").eqNullSafe(F.col("of_label"))).drop("of_label")
    return out.withColumn("codebooks_sha256", F.lit(books_digest(books))), books
