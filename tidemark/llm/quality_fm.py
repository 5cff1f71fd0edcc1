"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

A text's features are its distinct words, hashed into `BUCKETS` and weighted by length-normalised
counts, one indicator per structure statistic (the statistic's interval), and one for the stated
number of characters. The score is
    sigmoid(b + sum w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]),
which takes the pairwise interactions in linear time. It is fitted on at most `SAMPLE` labelled
documents, those with the least digests of their ids; all documents are scored.

Null and empty texts have structure features only and get a score like any other; a null stated
length is an interval of its own. Rows are scored one by one, so repeated rows agree. Without
labelled rows every score is 0.5. Labels without an id or a value are ignored, and of several
labels of one document the least counts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ASCII_LOWER, bucket_of, digests_of, over_batches, texts

SAMPLE = 6_000  # bound of the labelled rows that the model is fitted on
BUCKETS = 1 << 16
RANK = 8
EPOCHS = 12

_FRACTIONS = np.array([0.001, 0.003, 0.01, 0.02, 0.04, 0.07, 0.12, 0.2, 0.3, 0.45, 0.6, 0.8])
_SIZES = 2.0 ** np.arange(0, 20)
_EDGES = [_SIZES, np.arange(1.5, 14, 0.75), _FRACTIONS, _FRACTIONS, _FRACTIONS, _FRACTIONS, _FRACTIONS, _FRACTIONS,
          _FRACTIONS, 1 - _FRACTIONS[::-1], _FRACTIONS, _SIZES]
_STARTS = BUCKETS + np.cumsum([0] + [len(e) + 1 for e in _EDGES])
_STATED = int(_STARTS[-1])
FEATURES = _STATED + 34
_UPPER, _LOWER = np.arange(65, 91), np.arange(97, 123)
_DIGITS, _MARKS = np.arange(48, 58), np.frombuffer(b"#*$%&|<>", np.uint8)
_SHOUT, _STOPS = np.frombuffer(b"!?", np.uint8), np.frombuffer(b".,;:", np.uint8)


def features(text: bytes, stated: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of one text's features."""
    words = text.translate(ASCII_LOWER).split()
    h = digests_of(words)
    n = max(len(words), 1)
    bytes_ = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    seen = max(int(bytes_.sum() - bytes_[[9, 10, 11, 12, 13, 32]].sum()), 1)
    letters = max(int(bytes_[_UPPER].sum() + bytes_[_LOWER].sum()), 1)
    distinct, counts = np.unique(h, return_counts=True)
    lines = [line for line in text.split(b"\n") if line.strip()]
    stats = (
        len(words), seen / n, bytes_[_UPPER].sum() / letters, bytes_[_DIGITS].sum() / seen, bytes_[_MARKS].sum() / seen,
        bytes_[_SHOUT].sum() / seen, bytes_[_STOPS].sum() / seen, bytes_[124] / n,
        (h[1:] == h[:-1]).sum() / n if len(h) > 1 else 0.0, len(distinct) / n,
        1 - len(set(lines)) / max(len(lines), 1), n / max(len(lines), 1),
    )
    dense = [int(start) + int(np.searchsorted(edges, x, "right")) for start, edges, x in zip(_STARTS, _EDGES, stats)]
    dense.append(_STATED + (33 if stated is None else min(max(int(stated), 0).bit_length(), 32)))
    weight = 1 + np.log(counts)
    weight /= max(float(np.sqrt((weight * weight).sum())), 1e-9)
    return (np.concatenate([(distinct % np.uint64(BUCKETS)).astype(np.int32), np.array(dense, np.int32)]),
            np.concatenate([weight, np.full(len(dense), 0.5)]).astype(np.float32))


@dataclass
class Machine:
    bias: float
    linear: np.ndarray  # FEATURES
    factors: np.ndarray  # FEATURES x RANK

    def raw(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Raw scores of rows that begin at `starts`, and each row's sums of factors."""
        vx = self.factors[index] * value[:, None]
        sums = np.add.reduceat(vx, starts)
        squares = np.add.reduceat((vx * vx).sum(1), starts)
        return self.bias + np.add.reduceat(self.linear[index] * value, starts) + 0.5 * ((sums * sums).sum(1) - squares), sums


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 7) -> Machine:
    """Adagrad on the logistic loss with weight decay, in batches of 64."""
    rng = np.random.default_rng(seed)
    m = Machine(0.0, np.zeros(FEATURES, np.float32), rng.normal(0, 0.02, (FEATURES, RANK)).astype(np.float32))
    if not rows:
        return Machine(0.0, m.linear, np.zeros_like(m.factors))
    rate = np.clip(labels.mean(), 0.01, 0.99)
    m.bias = float(np.log(rate / (1 - rate)))
    g_linear, g_factors = np.full(FEATURES, 1e-3, np.float32), np.full((FEATURES, RANK), 1e-3, np.float32)
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 64):
            picked = order[at:at + 64]
            sizes = np.array([len(rows[i][0]) for i in picked])
            starts = np.cumsum(sizes) - sizes
            index = np.concatenate([rows[i][0] for i in picked])
            value = np.concatenate([rows[i][1] for i in picked])
            z, sums = m.raw(index, value, starts)
            error = (sigmoid(z) - labels[picked]).astype(np.float32)
            m.bias -= 0.02 * float(error.mean())
            e, row = np.repeat(error, sizes) * value, np.repeat(np.arange(len(picked)), sizes)
            used, where = np.unique(index, return_inverse=True)
            d_linear = np.bincount(where, e, len(used)).astype(np.float32) + 1e-3 * m.linear[used]
            v = m.factors[index]
            d = e[:, None] * (sums[row] - v * value[:, None])
            d_factors = np.stack([np.bincount(where, d[:, f], len(used)) for f in range(RANK)], 1).astype(np.float32)
            d_factors += 1e-3 * m.factors[used]
            g_linear[used] += d_linear * d_linear
            g_factors[used] += d_factors * d_factors
            m.linear[used] -= 0.1 * d_linear / np.sqrt(g_linear[used])
            m.factors[used] -= 0.03 * d_factors / np.sqrt(g_factors[used])
    return m


def _picked(docs: DataFrame, doc_id: str, text: str, n_chars: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"),
                       F.col(n_chars).cast("long").alias("stated"))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str = "n_chars",
          label: str = "quality", sample: int = SAMPLE) -> Machine:
    """A model of the labelled documents whose crc32(id as text) mod 3 is not 1."""
    known = (labels.select(F.col(doc_id).cast("long").alias("labelled"), F.col(label).cast("int").alias("y"))
             .where(F.col("labelled").isNotNull() & F.col("y").isNotNull() & (bucket_of("labelled", 3) != 1))
             .groupBy("labelled").agg(F.min("y").alias("y"))
             .orderBy(F.xxhash64("labelled"), "labelled").limit(sample))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [features(t, n) for t, n in zip(texts(batch, "text"), batch.column("stated").to_pylist())]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("y"), pa.array([r[0] for r in rows], pa.list_(pa.int32())),
             pa.array([r[1] for r in rows], pa.list_(pa.float32()))], ["doc_id", "y", "index", "value"])

    picked = _picked(docs, doc_id, text, n_chars)
    labelled = picked.join(F.broadcast(known), picked["doc_id"] == F.col("labelled")).drop("labelled")
    rows = over_batches(labelled, work, "doc_id long, y int, index array<int>, value array<float>")
    # One row for each id, so at most `sample` rows come here even if ids repeat.
    held = rows.groupBy("doc_id").agg(F.min(F.struct("y", "index", "value")).alias("r")).select("doc_id", "r.*").toArrow()
    order = np.argsort(held.column("doc_id").to_numpy())
    index, value = held.column("index").to_pylist(), held.column("value").to_pylist()
    return fit([(np.array(index[i], np.int32), np.array(value[i], np.float32)) for i in order],
               held.column("y").to_numpy()[order].astype(np.float32))


def score(docs: DataFrame, model: Machine, doc_id: str = "doc_id", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        if not batch.num_rows:
            return None
        out = np.zeros(batch.num_rows)
        for i, (t, n) in enumerate(zip(texts(batch, "text"), batch.column("stated").to_pylist())):
            index, value = features(t, n)
            out[i] = shared.value.raw(index, value, np.zeros(1, np.int64))[0][0]
        p = sigmoid(out)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    scored = over_batches(_picked(docs, doc_id, text, n_chars), work, "doc_id long, score double, predicted int")
    return scored.select("doc_id", F.coalesce(bucket_of("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, model: Machine, doc_id: str = "doc_id", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """`docs` without the rows that the model rejects; all columns stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        stated = batch.column(n_chars).to_pylist()
        keep = [bool(shared.value.raw(*features(t, n), np.zeros(1, np.int64))[0][0] >= 0)
                for t, n in zip(texts(batch, text), stated)]
        return batch.filter(pa.array(keep, pa.bool_())) if any(keep) else None

    return over_batches(docs, work, docs.schema)
