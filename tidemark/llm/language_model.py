"""Scores texts by a log-bilinear neural language model over words and word classes.

The vocabulary of the training documents is counted by Spark. The most frequent words are classes
of their own; the others share a class with words of the same ending, the most frequent endings
having one each. The model predicts a word's class from the two words before it, u and v:
    s(c | u, v) = q_c . (A r_class(u) + B r_v) + b_c.
Two steps fit it in numpy by noise-contrastive estimation, neither on draws: the counts of all
training tokens stand for the data, and the noise enters with its expectation.
- A, B, b, q and a vector r per class from the counts of class triples (CLASSES^3 at most);
- then, within Spark tasks, a vector r_v of its own for every word that occurs `SEEN` times or
  more, from the counts of the classes that follow it, drawn towards its class's vector. Those
  vectors and counts grow with the corpus; words that are rarer keep their class's vector.
Scores are normalised: exp s factors into what u and what v contribute, so that matrix products
give the sum over classes for every context. Within a class a word has the share
(count + 1) / (sum of counts + 1 over the class, and 1 for unseen words). Probabilities of
all words and one unseen word per class thus sum to one in every context.

Counts and vectors of the `FREQUENT` most frequent words are sent to the tasks (a bounded table);
counts of other words are joined by shuffling, and such words are never hot. Null and empty texts
consist of the end token alone. Repeated rows are scored one by one and each counts for training.
Rows without an id are not held out. With no training rows every count is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ASCII_LOWER, bucket_of, sliced, texts
from tidemark.session import stored

CLASSES, OWN = 128, 64  # of which OWN are single words (the end token is the first)
FREQUENT = 262_144
SEEN, PULL = 32, 20.0  # tokens from which a word has its own vector, and tokens its class's vector weighs
WIDTH, NOISE, STEPS, WORD_STEPS = 24, 10, 300, 60
END = b""
_WORDS_KEPT = 300_000
_PAIRS_KEPT = 1_000_000
_TOKENS = 1 << 15  # scored at a time
_PUNCTUATION = b".,;:!?\"'()[]{}*%$&#|<>-_/"


def ending(word: bytes) -> int:
    """The last two bytes of a word and the kind of mark after them, as one number."""
    bare = word.rstrip(_PUNCTUATION)
    mark = word[len(bare)] if len(bare) < len(word) else 0
    tail = bare[-2:]
    return mark << 16 | int.from_bytes(tail, "big")


class Words:
    """Numbers words as they come, with digest and ending of each."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.digest: list[int] = []
        self.ending: list[int] = []

    def numbers(self, text: bytes) -> np.ndarray:
        """Numbers of a text's tokens; the end token comes last."""
        words = text.translate(ASCII_LOWER).split()
        words.append(END)
        known = self.number
        for w in words:
            if w not in known:
                known[w] = len(known)
                self.digest.append(xxhash.xxh3_64_intdigest(w))
                self.ending.append(ending(w))
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


class Known:
    """Per word of a `Words`: digest, class, row and count, looked up once while the words are kept."""

    def __init__(self, words: Words, lex: Lexicon):
        self.words, self.lex = words, lex
        self.clear()

    def clear(self) -> None:
        self.digest = self.of = self.rows = self.seen = np.zeros(0, np.int64)

    def catch_up(self) -> None:
        at = len(self.digest)
        digest, lex = _int64(self.words.digest[at:]), self.lex
        of = lex.classes(digest, np.array(self.words.ending[at:], np.int64))
        more = (digest, of, lex.rows(digest, of), _looked_up(lex.frequent, lex.counts, digest, -1))
        self.digest, self.of, self.rows, self.seen = (np.concatenate(x) for x in zip((self.digest, self.of, self.rows, self.seen), more))

    def trim(self) -> None:
        """Forgets the words if they are too many."""
        if len(self.words.digest) > _WORDS_KEPT:
            self.words.clear()
            self.clear()


def _int64(values: list[int] | np.ndarray) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def _picked(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))


def _training(docs: DataFrame) -> DataFrame:
    return docs.where(F.coalesce(bucket_of("doc_id", 7) != 2, F.lit(True)))


def vocabulary(docs: DataFrame) -> DataFrame:
    """word (digest), ending, n over the tokens of `docs` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = Words(), np.zeros(0, np.int64)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(_int64(words.digest)), pa.array(np.array(words.ending, np.int32)), pa.array(counts)], ["word", "ending", "n"])

        for batch in batches:
            all_ = [words.numbers(t) for t in texts(batch, "text")]
            if all_:
                more = np.bincount(np.concatenate(all_), minlength=len(words.digest))
                more[:len(counts)] += counts
                counts = more
            if len(words.digest) > _WORDS_KEPT:
                yield out()
                words.clear()
                counts = np.zeros(0, np.int64)
        if len(counts):
            yield out()

    partial = docs.select("text").mapInArrow(run, "word long, ending int, n long")
    return partial.groupBy("word").agg(F.min("ending").alias("ending"), F.sum("n").alias("n"))


@dataclass
class Lexicon:
    """Bounded tables that every task gets."""

    frequent: np.ndarray  # sorted digests
    counts: np.ndarray  # of those
    frequent_class: np.ndarray  # of those
    own: np.ndarray  # sorted digests of words that are classes
    own_class: np.ndarray
    endings: np.ndarray  # sorted endings that are classes
    ending_class: np.ndarray
    mass: np.ndarray  # per class: sum of counts + 1 over its words, and 1 for unseen ones
    tokens: int
    types: int

    def classes(self, digest: np.ndarray, ending_: np.ndarray) -> np.ndarray:
        by_ending = _looked_up(self.endings, self.ending_class, ending_, CLASSES - 1)
        return np.where(_looked_up(self.own, self.own_class, digest, -1) >= 0,
                        _looked_up(self.own, self.own_class, digest, -1), by_ending)

    def rows(self, digest: np.ndarray, class_: np.ndarray) -> np.ndarray:
        """The words' rows among the vectors: the classes' come first, then those of frequent words."""
        own = _looked_up(self.frequent, np.where(self.counts >= SEEN, np.arange(len(self.counts)), -1), digest, -1)
        return np.where(own >= 0, own + CLASSES, class_)


def _looked_up(keys: np.ndarray, values: np.ndarray, x: np.ndarray, missing: int) -> np.ndarray:
    if not len(keys):
        return np.full(len(x), missing, np.int64)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return np.where(keys[at] == x, values[at], missing)


def lexicon(counted: DataFrame) -> Lexicon:
    """From a written vocabulary. FREQUENT words, OWN classes and the endings' classes come to the driver."""
    total = counted.agg(F.sum("n").alias("N"), F.count(F.lit(1)).alias("V")).first()
    top = counted.orderBy(F.desc("n"), "word").limit(FREQUENT).select("word", "n", "ending").toArrow()
    words, n = top.column("word").to_numpy(), top.column("n").to_numpy()
    end = _int64([xxhash.xxh3_64_intdigest(END)])[0]
    own = [end, *[w for w in words[:OWN] if w != end][:OWN - 1]]
    others = counted.where(~F.col("word").isin([int(w) for w in own]))
    by_ending = others.groupBy("ending").agg(F.sum("n").alias("n"), F.sum(F.col("n") + 1).alias("mass"))
    kinds = by_ending.orderBy(F.desc("n"), "ending").limit(CLASSES - OWN - 1).toArrow()
    endings, masses = kinds.column("ending").to_numpy(), kinds.column("mass").to_numpy()
    rest = others.agg(F.sum(F.col("n") + 1).alias("m")).first()["m"] or 0
    mass = np.ones(CLASSES)
    count_of = dict(zip(words.tolist(), n.tolist()))
    for k, w in enumerate(own):
        mass[k] = count_of.get(int(w), 0) + 1
    mass[OWN:OWN + len(masses)] += masses
    mass[CLASSES - 1] += rest - masses.sum()
    o, e, f = np.argsort(own), np.argsort(endings), np.argsort(words)
    lex = Lexicon(words[f], n[f], np.zeros(0, np.int64), np.array(own)[o], o.astype(np.int64), endings[e].astype(np.int64),
                  (e + OWN).astype(np.int64), mass, int(total["N"] or 0), int(total["V"] or 0))
    lex.frequent_class = lex.classes(lex.frequent, top.column("ending").to_numpy()[f].astype(np.int64))
    return lex


def _before(x: np.ndarray, steps: int, first: int) -> np.ndarray:
    """What stands `steps` tokens before each, `first` where there is none."""
    return np.concatenate([np.full(min(steps, len(x)), first, np.int64), x[:-steps]])


def contexts(docs: DataFrame, lex) -> DataFrame:
    """row (-1: none), of, n over the tokens of `docs`: of class triples (row -1, `of` the triple), and of a word
    with a vector of its own (its row) before a class (`of`)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = Words(), np.zeros(CLASSES ** 3, np.int64)
        known = Known(words, lex.value)
        after, held = [], 0  # (row, class) as one number, with counts

        def out(row: np.ndarray, of: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(of), 100_000):
                part = slice(i, i + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(row[part].astype(np.int32)), pa.array(of[part].astype(np.int32)), pa.array(n[part])],
                                                 ["row", "of", "n"])

        def pairs() -> tuple[np.ndarray, np.ndarray]:
            key, back = np.unique(np.concatenate([k for k, _ in after]), return_inverse=True)
            return key, np.bincount(back, np.concatenate([n for _, n in after])).astype(np.int64)

        for batch in batches:
            numbers = [words.numbers(t) for t in texts(batch, "text")]
            known.catch_up()
            of, rows, fresh = known.of, known.rows, []
            for x in numbers:
                c, v = of[x], _before(rows[x], 1, 0)
                np.add.at(counts, (_before(c, 2, 0) * CLASSES + _before(c, 1, 0)) * CLASSES + c, 1)
                fresh.append((v * CLASSES + c)[v >= CLASSES])
            if fresh:
                after.append(np.unique(np.concatenate(fresh), return_counts=True))
                held += len(after[-1][0])
            if held > _PAIRS_KEPT:
                after = [pairs()]
                held = len(after[0][0])
                if held > _PAIRS_KEPT // 2:
                    yield from out(after[0][0] // CLASSES, after[0][0] % CLASSES, after[0][1])
                    after, held = [], 0
            known.trim()
        if after:
            key, n = pairs()
            yield from out(key // CLASSES, key % CLASSES, n)
        at = np.flatnonzero(counts)
        yield from out(np.full(len(at), -1), at, counts[at])

    return docs.select("text").mapInArrow(run, "row int, of int, n long").groupBy("row", "of").agg(F.sum("n").alias("n"))


@dataclass
class Bilinear:
    """The model. Of `vectors`, the first CLASSES are those of classes; `usual` is what stands before a class, on average."""

    vectors: np.ndarray
    q: np.ndarray
    a: np.ndarray
    b: np.ndarray
    bias: np.ndarray
    noise: np.ndarray
    usual: np.ndarray

    def log10(self, u: np.ndarray, row: np.ndarray, c: np.ndarray) -> np.ndarray:
        """log10 P(c | class u, word of a row of `vectors`), one for each."""
        distinct, at = np.unique(row, return_inverse=True)
        first = self.vectors[:CLASSES] @ (self.a.T @ self.q.T).astype(np.float32)
        second = self.vectors[distinct] @ (self.b.T @ self.q.T).astype(np.float32) + self.bias.astype(np.float32)
        # The greatest is 0 and none so small that a product of two were nothing.
        first, second = (np.maximum(s - s.max(1, keepdims=True), -40) for s in (first, second))
        total = np.einsum("tc,tc->t", np.exp(first)[u], np.exp(second)[at])
        return (first[u, c] + second[at, c] - np.log(total)) / np.log(10)


def _sigmoid(s: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(s, -30, 30)))


class _Adam:
    def __init__(self, params: list[np.ndarray], rate: float, steps: int):
        self.params, self.rate, self.steps, self.step = params, rate, steps, 0
        self.mean, self.square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]

    def move(self, grads: list[np.ndarray]) -> None:
        self.step += 1
        rate = self.rate * (1 - (self.step - 1) / self.steps) + self.rate / 100
        for p, g, m, s in zip(self.params, grads, self.mean, self.square):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            p -= rate * (m / (1 - 0.9 ** self.step)) / (np.sqrt(s / (1 - 0.99 ** self.step)) + 1e-9)


def fit(triple: np.ndarray, n: np.ndarray, seed: int = 3) -> Bilinear:
    """Vectors of classes and all else, from all counts of class triples."""
    rng = np.random.default_rng(seed)
    counts = np.zeros(CLASSES ** 3)
    counts[triple] = n
    counts = counts.reshape(CLASSES, CLASSES, CLASSES)
    tokens = max(counts.sum(), 1)
    noise = counts.sum((0, 1)) + 1.0
    noise /= noise.sum()
    r, q = rng.normal(0, 0.1, (CLASSES, WIDTH)), rng.normal(0, 0.1, (CLASSES, WIDTH))
    a, b, bias = np.eye(WIDTH) * 0.5, np.eye(WIDTH) * 0.5, np.log(noise)
    data = (counts / tokens).astype(np.float32)
    fakes = (data.sum(2, keepdims=True) * (NOISE * noise)).astype(np.float32)
    shift = np.log(NOISE * noise)
    adam = _Adam([r, q, a, b, bias], 0.03, STEPS)
    for _ in range(STEPS if counts.any() else 0):
        h_u, h_v = r @ a.T, r @ b.T
        s = (h_u @ q.T).astype(np.float32)[:, None] + (h_v @ q.T + bias - shift).astype(np.float32)[None]
        g = (data + fakes) * _sigmoid(s) - data
        by_u, by_v = g.sum(1).astype(np.float64), g.sum(0).astype(np.float64)
        g_u, g_v = by_u @ q, by_v @ q
        adam.move([g_u @ a + g_v @ b, by_u.T @ h_u + by_v.T @ h_v, g_u.T @ r, g_v.T @ r, by_u.sum(0)])
    before = counts.sum(2)  # of u by v
    usual = (before / np.maximum(before.sum(0), 1)).T @ (r @ a.T)
    return Bilinear(r, q, a, b, bias, noise, usual)


def word_vectors(counts: np.ndarray, class_: np.ndarray, model: Bilinear) -> np.ndarray:
    """Vectors of words from the counts of the classes that follow them (words x CLASSES), their own classes given."""
    tokens = counts.sum(1, keepdims=True)
    weight = 1 / (tokens + PULL)
    start = model.vectors[class_]
    r = start.copy()
    steady = model.usual[class_] @ model.q.T + model.bias - np.log(NOISE * model.noise)
    to_scores = model.b.T @ model.q.T
    adam = _Adam([r], 0.1, WORD_STEPS)
    for _ in range(WORD_STEPS):
        g = (counts + tokens * (NOISE * model.noise)) * _sigmoid(steady + r @ to_scores) - counts
        adam.move([weight * (g @ to_scores.T + PULL * 0.1 * (r - start))])
    return r


def fitted_words(after: DataFrame, classes: np.ndarray, model) -> DataFrame:
    """row, vector from row, of, n. A row has CLASSES counts at most; `classes` are those of the words by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                lists = part.column("counts")
                flat, ends = lists.flatten(), np.diff(lists.offsets.to_numpy())
                counts = np.zeros((part.num_rows, CLASSES))
                counts[np.repeat(np.arange(part.num_rows), ends), flat.field("of").to_numpy()] = flat.field("n").to_numpy()
                row = part.column("row").to_numpy()
                out = word_vectors(counts, part.column("class").to_numpy(), model.value)
                yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(list(out.astype(np.float32)), pa.list_(pa.float32()))], ["row", "vector"])

    by_row = after.groupBy("row").agg(F.collect_list(F.struct("of", "n")).alias("counts"))
    class_of = after.sparkSession.createDataFrame(pa.table({"of_row": np.arange(CLASSES, CLASSES + len(classes), dtype=np.int32), "class": classes.astype(np.int32)}))
    return by_row.join(class_of, F.col("row") == F.col("of_row")).select("row", "class", "counts").mapInArrow(run, "row int, vector array<float>")


def _scores(model: Bilinear, texts_: list[tuple[np.ndarray, np.ndarray]], log_mass: np.ndarray) -> np.ndarray:
    """Per text, given as classes and rows of its tokens: the sum of log10 P(class | context) less the class's mass."""
    c = np.concatenate([c for c, _ in texts_])
    u, v = (np.concatenate(x) for x in zip(*[(_before(c, 2, 0), _before(rows, 1, 0)) for c, rows in texts_]))
    of = np.repeat(np.arange(len(texts_)), [len(c) for c, _ in texts_])
    value = -log_mass[c]
    for i in range(0, len(c), _TOKENS):
        at = slice(i, i + _TOKENS)
        value[at] += model.log10(u[at], v[at], c[at])
    return np.bincount(of, value, len(texts_))


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of `docs`."""
    sc = docs.sparkSession.sparkContext
    picked = _picked(docs, doc_id, text)
    counted = stored(vocabulary(_training(picked)), "vocabulary")
    lex = lexicon(counted)
    shared = sc.broadcast(lex)
    gathered = stored(contexts(_training(picked), shared), "context-counts")
    counts = gathered.where("row = -1").select("of", "n").toArrow()
    model = fit(counts.column("of").to_numpy(), counts.column("n").to_numpy())
    fitted = fitted_words(gathered.where("row >= 0"), lex.frequent_class, sc.broadcast(model)).toArrow()
    vectors = np.concatenate([model.vectors, model.vectors[lex.frequent_class]]).astype(np.float32)
    vectors[fitted.column("row").to_numpy()] = fitted.column("vector").combine_chunks().flatten().to_numpy().reshape(-1, WIDTH)
    bilinear = sc.broadcast(replace(model, vectors=vectors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, lex, model = Words(), shared.value, bilinear.value
        known, log_mass = Known(words, lex), np.log10(lex.mass)
        for batch in (part for whole in batches for part in sliced(whole)):
            numbers = [words.numbers(t) for t in texts(batch, "text")]
            known.catch_up()
            digest, of, rows, seen = known.digest, known.of, known.rows, known.seen
            logs = np.log10(np.maximum(seen, 0) + 1.0)
            out: list[list] = [[], [], [], [], []]
            for x in numbers:
                rare, tf = np.unique(x[seen[x] < 0], return_counts=True)
                for column, value in zip(out, (len(x), int((seen[x] > 0).sum()), float(logs[x].sum()), digest[rare], tf)):
                    column.append(value)
            scores = _scores(model, [(of[x], rows[x]) for x in numbers], log_mass)
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(o, k) for o, k in zip(out, kinds)], pa.array(scores)],
                                             ["doc_id", "n_tokens", "known", "logs", "rare", "times", "model"])
            known.trim()

    read = picked.mapInArrow(run, "doc_id long, n_tokens long, known long, logs double, rare array<long>, times array<long>, model double")
    read = stored(read.withColumn("row", F.monotonically_increasing_id()), "scored-parts")
    rare = read.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", "x.rare", "x.times")
    found = rare.join(counted.select(F.col("word").alias("rare"), "n"), "rare")
    added = found.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more_logs"), F.sum("times").alias("more_known"))
    logs = F.col("logs") + F.coalesce("more_logs", F.lit(0.0))
    return read.select("row", "doc_id", "n_tokens", "known", "logs", "model").join(added, "row", "left").select(
        "doc_id", F.coalesce(bucket_of("doc_id", 7) == 2, F.lit(False)).alias("held_out"), "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(lex.tokens).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.lit(float(np.log10(float(lex.tokens + lex.types + 1))))).alias("base_score"),
        (logs + F.col("model")).alias("score"),
    )
