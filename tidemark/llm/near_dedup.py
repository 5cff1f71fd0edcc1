"""Near-duplicate documents by HyperMinHash.

A document is the set of its word shingles. The shingles' digests are dealt over `REGISTERS`
buckets; of each bucket's least digest a register keeps the number of leading zeros and `MANTISSA`
bits after them (16 bits in all). An empty register borrows from another by a fixed random
sequence, so that small sets have as selective registers as large ones. Runs of `ROWS` registers
are bands; documents that agree in one band are candidates. Two sets of similarity 0.8 miss each
other in all 42 bands with a chance of 3 in a million.

Candidates are weighed by the share of equal registers, less what equal registers arise by chance,
and what remains is confirmed on the full sets. The estimate rejects no set of fewer than `SMALL`
members, whose registers are mostly borrowed. No group is expanded into all its pairs:

1. Documents with equal sets are folded into one representative.
2. The members of a band's bucket are tied to that of them with the least hash, so that near copies
   which share many buckets are tied to the same few, and not to another one in each band.
   Confirmed ties are joined into components.
3. What is in different components after two such rounds, with two hashes, is compared across components: pair by
   pair in buckets of a few documents, on full sets in blocks where buckets are crowded.

Null texts, and texts without words, have empty sets and are linked with nothing. Rows with
equal ids share their component. Rows without an id are never linked and always kept. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ASCII_LOWER, digests_of, over_batches, shingles, small, texts
from tidemark.llm.graph import components, labelled, merged
from tidemark.session import released, stored

ROWS, BANDS, MANTISSA = 6, 42, 10
REGISTERS = ROWS * BANDS
BITS = 40  # of a digest within its bucket
EMPTY = np.uint16(0xFFFF)
_BORROW = np.random.default_rng(20240611).integers(0, REGISTERS, (96, REGISTERS))
# Whom a register that found none asks next: all others, in an order of its own.
_ORDER = np.random.default_rng(20240612).permuted(np.tile(np.arange(REGISTERS, dtype=np.int16), (REGISTERS, 1)), axis=1)
# Five standard deviations of the share of equal registers below a similarity of 0.8.
LEEWAY = 0.126
SMALL = 32  # sets with fewer members are confirmed whatever their estimate
FEW = 32  # members of a bucket that are compared pair by pair
BLOCK = 500


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """Distinct digests of a text's shingles, sorted; a shorter text is one shingle."""
    words = digests_of(text.translate(ASCII_LOWER).split())
    return np.unique(shingles(words, min(size, len(words)))) if len(words) else np.zeros(0, np.uint64)


def registers(members: np.ndarray) -> np.ndarray:
    """The HyperMinHash registers of a set that is not empty."""
    bucket = ((members >> np.uint64(BITS)) * np.uint64(REGISTERS) >> np.uint64(64 - BITS)).astype(np.int64)
    least = np.full(REGISTERS, 1 << BITS, np.int64)
    np.minimum.at(least, bucket, (members & np.uint64((1 << BITS) - 1)).astype(np.int64))
    full = least < 1 << BITS
    length = np.frexp(np.maximum(least, 1).astype(np.float64))[1]  # position of the first set bit
    zeros = BITS - length
    shifted = np.where(length > MANTISSA + 1, least >> np.maximum(length - MANTISSA - 1, 0), least << np.maximum(MANTISSA + 1 - length, 0))
    packed = (zeros << MANTISSA | shifted & ((1 << MANTISSA) - 1)).astype(np.uint16)
    out = np.where(full, packed, EMPTY)
    todo = np.flatnonzero(~full)
    for source in _BORROW:
        if not len(todo):
            break
        from_ = source[todo]
        ok = full[from_]
        out[todo[ok]] = packed[from_[ok]]
        todo = todo[~ok]
    if len(todo):
        donors = np.flatnonzero(full)
        out[todo] = packed[donors[_ORDER[todo][:, donors].argmin(1)]]
    return out


def chance_of_equal(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """How often registers of unrelated sets of n and m members agree."""
    x, y = np.maximum(n / REGISTERS, 1.0)[:, None], np.maximum(m / REGISTERS, 1.0)[:, None]
    edge = 0.5 ** np.arange(BITS + 1)[None, :]  # the least value lies below the edge or not
    p, q = (1 - edge[:, 1:]) ** x - (1 - edge[:, :-1]) ** x, (1 - edge[:, 1:]) ** y - (1 - edge[:, :-1]) ** y
    return (p * q).sum(1) / (1 << MANTISSA)


def similarity(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Estimated similarity of rows of registers, freed of agreement by chance."""
    chance = chance_of_equal(n, m)
    return ((a == b).mean(1) - chance) / (1 - chance)


def may_reach(j: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether pairs of estimate j, of sets of n and m members, are to be confirmed."""
    return (j >= percent / 100 - LEEWAY) | (np.minimum(n, m) < SMALL)


def signatures(docs: DataFrame, size: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, digest of the whole set, registers; the last two null for empty sets."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, whole, regs = [], [], []
        for t in texts(batch, "text"):
            s = shingle_set(t, size)
            n.append(len(s))
            whole.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            regs.append(registers(s).tobytes() if len(s) else None)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(whole, pa.binary()), pa.array(regs, pa.binary())],
            ["doc_id", "n_shingles", "whole", "registers"])

    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return over_batches(picked, work, "doc_id long, n_shingles long, whole binary, registers binary")


def _weighed(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose estimate may reach the threshold, with it."""
    r = reps.select("rep", "n", "registers")
    both = (pairs.join(r.toDF("a", "n_a", "r_a"), "a").join(r.toDF("b", "n_b", "r_b"), "b")
            .where((100 * F.col("n_a") >= percent * F.col("n_b")) & (100 * F.col("n_b") >= percent * F.col("n_a"))))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        if not batch.num_rows:
            return None
        a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, REGISTERS) for k in ("r_a", "r_b"))
        n, m = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
        j = similarity(a, b, n, m)
        out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(j)], ["a", "b", "j"])
        return out.filter(pa.array(may_reach(j, n, m, percent)))

    return over_batches(both.select("a", "b", "n_a", "n_b", "r_a", "r_b"), work, "a long, b long, j double")


def _sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """id, members of the documents in `ids`."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = [shingle_set(t, size).view(np.int64) for t in texts(batch, "text")]
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(s, pa.list_(pa.int64()))], ["id", "members"])

    picked = docs.join(small(ids), "id", "left_semi")
    return over_batches(picked, work, "id long, members array<long>").dropDuplicates(["id"])


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets are similar enough."""
    both = pairs.join(sets.toDF("a", "s_a"), "a").join(sets.toDF("b", "s_b"), "b")
    shared = F.size(F.array_intersect("s_a", "s_b"))
    return both.where(100 * shared >= percent * (F.size("s_a") + F.size("s_b") - shared)).select("a", "b")


def _ordered(a: Column | str, b: Column | str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _joined(candidates: DataFrame, reps: DataFrame, docs: DataFrame, size: int, percent: int, roots: DataFrame | None) -> DataFrame:
    """Components once the candidates that are confirmed have been added.

    First each document's best candidate is confirmed, which joins most of what belongs together.
    Of the others only those across components are left to look at.
    """
    weighed = stored(_weighed(candidates.distinct(), reps, percent), "weighed")
    ids = stored(weighed.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "weighed-ids")
    sets = stored(_sets(docs, ids, size), "shingle-sets")
    ways = weighed.select("a", "b", "j").unionAll(weighed.select(F.col("b").alias("a"), F.col("a").alias("b"), "j"))
    best = ways.groupBy("a").agg(F.max_by("b", "j").alias("b")).select(*_ordered("a", "b")).distinct()
    found = stored(_confirmed(best, sets, percent), "confirmed")
    roots = merged(roots, found)
    rest = weighed.select("a", "b").join(best, ["a", "b"], "left_anti")
    rest = labelled(labelled(rest, "a", roots, "c_a"), "b", roots, "c_b").where("c_a != c_b").select("a", "b")
    more = stored(_confirmed(rest, sets, percent), "confirmed")
    if not more.isEmpty():
        roots = merged(roots, more)
    released(weighed, ids, sets, found, more)
    return roots


def _shared_counts(queries: list[np.ndarray], others: list[np.ndarray]) -> Iterator[np.ndarray]:
    """For each of `others`, how many members it shares with each of `queries`, by an inverted index."""
    size = np.array([len(q) for q in queries])
    owner, all_ = np.repeat(np.arange(len(queries)), size), np.concatenate(queries)
    order = np.argsort(all_, kind="stable")
    owner, all_ = owner[order], all_[order]
    keys, starts, counts = np.unique(all_, return_index=True, return_counts=True)
    for other in others:
        at = np.minimum(np.searchsorted(keys, other), len(keys) - 1)
        at = at[keys[at] == other]
        n = counts[at]
        ends = np.cumsum(n)
        places = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[at] - (ends - n), n)
        yield np.bincount(owner[places], minlength=len(queries))


def _across_crowds(seats: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) between documents of different components in crowded buckets (key, rep, centre0, c).

    Buckets that share documents form a crowd. Of a crowd, the documents outside its largest
    component are compared with all others on their full sets. Both are cut into blocks of
    `BLOCK` documents; a task has one block of each, and an inverted index of the former counts
    what each pair shares. Only links leave the task.
    """
    ties = stored(seats.select(F.col("rep").alias("a"), F.col("centre0").alias("b")).distinct(), "crowd-ties")
    crowds = stored(components(ties), "crowds").toDF("rep", "crowd")
    people = stored(seats.select("rep", "c").distinct().join(crowds, "rep"), "crowd-members")
    parts = people.groupBy("crowd", "c").agg(F.count(F.lit(1)).alias("k"))
    sizes = stored(parts.groupBy("crowd").agg(F.max_by("c", "k").alias("main"), F.sum("k").alias("n_all"), F.max("k").alias("n_main"))
                   .where("n_all > n_main"), "crowd-sizes")
    sets = _sets(docs, stored(people.select(F.col("rep").alias("id")), "crowd-ids"), size).withColumnRenamed("id", "rep")
    p = people.join(small(sizes), "crowd").join(sets, "rep")
    blocks = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    p = stored(p.select("crowd", "rep", "c", "members", (F.col("c") != F.col("main")).alias("asks"),
                        blocks(F.col("n_all")).alias("n_answers"), blocks(F.col("n_all") - F.col("n_main")).alias("n_asks")), "crowd-sets")
    place = F.xxhash64("rep")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    asking = p.where("asks").select("crowd", F.pmod(place, F.col("n_asks")).cast("int").alias("i"), every(F.col("n_answers")).alias("j"),
                                    F.lit(True).alias("asking"), "rep", "c", "members")
    answering = p.select("crowd", every(F.col("n_asks")).alias("i"), F.pmod(place, F.col("n_answers")).cast("int").alias("j"),
                         F.lit(False).alias("asking"), "rep", "c", "members")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        q, o = group[group["asking"]], group[~group["asking"]]
        out = []
        if len(q) and len(o):
            q_rep, q_c, q_size = q["rep"].to_numpy(), q["c"].to_numpy(), np.array([len(x) for x in q["members"]])
            for rep, c, members, shared in zip(o["rep"], o["c"], o["members"], _shared_counts(list(q["members"]), list(o["members"]))):
                hit = (100 * shared >= percent * (q_size + len(members) - shared)) & (q_c != c)
                out += [(min(rep, x), max(rep, x)) for x in q_rep[hit]]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return stored(asking.unionAll(answering).groupBy("crowd", "i", "j").applyInPandas(compare, "a long, b long"), "crowd-links").distinct()


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of `docs`."""
    signed = stored(signatures(docs, size, doc_id, text), "signatures")
    known = signed.where(F.col("doc_id").isNotNull() & F.col("whole").isNotNull())
    first = stored(known.groupBy("whole").agg(F.min("doc_id").alias("rep")), "representatives")
    members = known.join(first, "whole")
    reps = stored(members.where(F.col("doc_id") == F.col("rep")).select("rep", F.col("n_shingles").alias("n"), "registers")
                  .dropDuplicates(["rep"]), "registers")
    by_id = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))

    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)),
                       lambda k: F.xxhash64(k, F.substring("registers", k * (2 * ROWS) + 1, F.lit(2 * ROWS))))
    banded = reps.select("rep", F.explode(keys).alias("key"))
    buckets = stored(banded.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *[
        F.min_by("rep", F.xxhash64("rep", F.lit(k))).alias(f"centre{k}") for k in range(2)]).where("n > 1"), "buckets")
    seated = stored(banded.join(buckets, "key").select("key", "rep", "n", "centre0", "centre1"), "seated")

    star = seated.where("rep != centre0").select(*_ordered("rep", "centre0"))
    roots = _joined(star, reps, by_id, size, percent, None)
    again = labelled(labelled(seated, "rep", roots, "c"), "centre1", roots, "c1").where((F.col("n") > 2) & (F.col("c") != F.col("c1")))
    roots = _joined(again.select(*_ordered("rep", "centre1")), reps, by_id, size, percent, roots)

    # What is left: members of a bucket outside its largest component, against those of other components.
    by_root = stored(labelled(seated.select("key", "rep", "n", "centre0"), "rep", roots, "c").where("n > 2"), "seated-roots")
    mixed = by_root.groupBy("key").agg(F.min("c").alias("c_lo"), F.max("c").alias("c_hi")).where("c_lo != c_hi").select("key")
    mixed = stored(by_root.join(small(stored(mixed, "mixed-keys")), "key", "left_semi"), "mixed")
    released(by_root, seated, buckets)
    few = mixed.where(F.col("n") <= FEW)
    one, other = few.select("key", "rep", "c").toDF("key", "x", "c_x"), few.select("key", "rep", "c").toDF("key", "y", "c_y")
    pairs = one.join(other, (one["key"] == other["key"]) & (F.col("x") < F.col("y")) & (F.col("c_x") != F.col("c_y")))
    roots = _joined(pairs.select(*_ordered("x", "y")), reps, by_id, size, percent, roots)
    roots = merged(roots, _across_crowds(mixed.where(F.col("n") > FEW), by_id, size, percent))

    placed = labelled(members.select("doc_id", "n_shingles", "rep"), "rep", roots, "component_id").drop("rep")
    rest = signed.where(F.col("doc_id").isNull() | F.col("whole").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return placed.unionAll(rest).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with one document of each group: that with the least id."""
    dropped = stored(near_duplicates(docs, size, percent, doc_id, text).where("not kept").select(F.col("doc_id").alias("dropped_id")).distinct(),
                     "near-duplicates")
    return docs.alias("d").join(small(dropped).alias("x"), F.col(f"d.{doc_id}") == F.col("x.dropped_id"), "left_anti")
