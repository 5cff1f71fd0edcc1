"""Divergence of sources, exact shards and vector codes against brute force, and their odd cases."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_support import SF, rows
from pyspark.sql import functions as F

from tidemark.llm import divergence, sharding, vector_codes
from tidemark.llm.queries import QUERIES

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def audit(docs, top=200):
    """lang, source, part, item -> value, rank, by comparing all terms of all pairs."""
    counts, held = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in docs:
        found = TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        counts[lang or "", source or ""].update(found)
        held[lang or ""].update(set(found))
    out = {}
    for lang in held:
        kept = [t for t, n in held[lang].items() if n >= 3]
        groups = {s: c for (of, s), c in counts.items() if of == lang}

        def shares(c):
            total = sum(c[t] for t in kept) + len(kept)
            return [1 + 10**9 * (c[t] + 1) // total for t in kept]

        p = {s: shares(c) for s, c in groups.items()}
        q = shares(sum(groups.values(), Counter()))
        for s, c in groups.items():
            pairs = [(h, sum((a - b) ** 2 // b for a, b in zip(p[s], p[h]))) for h in groups if h != s]
            terms = [(t, (a - b) ** 2 // b) for t, a, b in zip(kept, p[s], q) if c[t] and a > b]
            for part, found in (("pair", pairs), ("term", terms)):
                order = sorted(found, key=lambda x: (-x[1], x[0].encode()))
                for rank, (item, value) in enumerate(order[:top] if part == "term" else order, 1):
                    out[lang, s, part, item] = (value, rank)
    return out


def audited(df, **options):
    return {tuple(r[:4]): tuple(r[4:]) for r in divergence.audit(df, **options).collect()}


DOCS = "text string, lang string, source string, n long, term string, place int"


def test_audit_of_odd_documents(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 3)
    monkeypatch.setattr(divergence, "STRETCH", 5)
    monkeypatch.setattr(divergence, "BLOCK_POSTINGS", (2, 3))
    monkeypatch.setattr(divergence, "PAIRS", 4)
    texts = ["The cat, the DOG", "a cat 12 a dog's", "Größe größe ÄÖ cat", "", None, "dog\x00cat_the\ttail", "the the the", "ab" * 4000 + " cat", "same", "same"]
    docs = [(t, lang, s) for i, t in enumerate(texts) for lang, s in (("en", f"s{i % 3}"), (None, "only"), ("", "") if i % 2 else ("en", None), ("de", f"t{i}") if i > 5 else ("fr", "alone"))]
    docs += docs[:7] + [("the unseen", "xx", "s"), (None, "xx", "t")]
    df = spark.createDataFrame([(*d, 1, "x", 2) for d in docs], DOCS)
    want = audit(docs)
    assert len({k[0] for k in want}) >= 4 and any(v == (0, 1) for v in want.values())
    assert audited(df) == want
    assert audited(df, top_terms=2) == audit(docs, 2)
    assert divergence.audit(df.limit(0)).count() == 0


def test_shares_are_exact_for_large_counts():
    count = np.array([0, 1, 7, 10**12, 9 * 10**15 - 10**6], np.int64)
    total = np.array([3, 7, 9, 3 * 10**12 + 1, 9 * 10**15], np.int64)
    assert divergence.shares(count, total).tolist() == [1 + 10**9 * (int(c) + 1) // int(t) for c, t in zip(count, total)]


def test_op11_equals_brute_force(spark, documents):
    assert audited(spark.createDataFrame([(d["text"], d["lang"], d["source"]) for d in documents], "text string, lang string, source string")) == audit(
        [(d["text"], d["lang"], d["source"]) for d in documents])


def test_op12_shards_are_exact(spark, documents):
    out = QUERIES["op12_hypergeometric_shards"](spark, SF).collect()
    by_id = {d["doc_id"]: (d["text"] or "").encode() for d in documents}
    assert sorted(r["doc_id"] for r in out) == sorted(by_id)
    slots = defaultdict(list)
    for r in out:
        assert (r["size"], r["text_crc32"]) == (len(by_id[r["doc_id"]]) + 1, zlib.crc32(by_id[r["doc_id"]]))
        assert (r["law"], r["grown_shard"]) == ("rows", None)
        slots[r["shard"]].append(r["slot"])
    assert set(slots) == set(range(8))
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shuffle_of_odd_rows(spark):
    odd = [(None, None, 1, "a"), (None, None, 1, "a"), (1, "", 2, "b"), (1, "", 2, "b"), (2, "Größe 😀", 3, None), (3, "x" * 70_000, 4, "c")]
    df = spark.createDataFrame(odd * 5, "doc_id long, text string, shard int, row string")
    out = sharding.shuffled(df, 4, seed=3, piece_rows=2)
    assert out.columns == ["row", "shard", "slot"]
    got = out.collect()
    assert Counter(tuple(r["row"]) for r in got) == Counter(odd * 5)
    assert sorted(Counter(r["shard"] for r in got).values()) == [7, 7, 8, 8]
    assert sorted((r["shard"], r["slot"]) for r in got) == [(s, i) for s, n in enumerate((8, 8, 7, 7)) for i in range(n)]
    assert sharding.sharded(df).count() == 30
    assert sharding.shuffled(df.limit(0)).count() == 0
    assert sharding.shuffled(df.limit(1)).collect()[0]["slot"] == 0


def test_matrix_rows_and_columns_add_up_and_follow_the_law():
    rng = np.random.default_rng(5)
    parts, shards = [0, 40, 1, 1000, 333], [172, 172, 172, 172, 172, 172, 171, 171]
    drawn = np.array([sharding.matrix(rng, parts, shards) for _ in range(400)])
    assert (drawn.sum(2) == parts).all() and (drawn.sum(1) == shards).all()
    n, k, m = sum(parts), shards[0], parts[3]
    mean, var = m * k / n, m * (k / n) * (1 - k / n) * (n - m) / (n - 1)
    assert abs(drawn[:, 3, 0].mean() - mean) < 4 * (var / 400) ** 0.5
    assert 0.7 < drawn[:, 3, 0].var() / var < 1.35
    big = [sharding.hypergeometric(rng, 10**10, 7 * 10**10, 10**6) for _ in range(200)]
    assert abs(np.mean(big) - 125_000) < 4 * (10**6 * 0.125 * 0.875 / 200) ** 0.5


def test_every_place_is_equally_likely(spark):
    n, shards, rounds = 24, 3, 24
    df = spark.range(n).repartition(5)
    seen = np.zeros((n, n))
    for seed in range(rounds):
        for r in sharding.shuffled(df.coalesce(3), shards, seed=10 * seed, piece_rows=3).collect():
            seen[r["row"]["id"], r["shard"] * 8 + r["slot"]] += 1
    expected = rounds / n
    assert ((seen - expected) ** 2 / expected).sum() < 23 * 23 + 5 * (2 * 23 * 23) ** 0.5


def lloyd(vectors):
    """Codes, errors and codebooks of (id, label, vector) by comparing all with all."""
    kept = sorted((r for r in vectors if r[2] and all(x is not None and np.isfinite(x) for x in r[2])),
                  key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    x = np.array([[int(np.floor(1024 * np.float64(c))) for c in r[2]] for r in kept], np.int64).reshape(len(kept), 4, -1)
    books = x[:256].transpose(1, 0, 2).copy()

    def nearest():
        away = ((x[:, :, None, :] - books[None]) ** 2).sum(3)
        return away.argmin(2), away.min(2)

    for _ in range(4):
        code = nearest()[0]
        for k in range(4):
            for e in set(code[:, k].tolist()):
                books[k, e] = x[code[:, k] == e, k].sum(0) // (code[:, k] == e).sum()
    code, away = nearest()
    by_label = Counter()
    for r, a in zip(kept, away.sum(1)):
        by_label[r[1]] += int(a)
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    return Counter((r[0], "".join(f"{c:02x}" for c in cs), int(a), by_label[r[1]], digest) for r, cs, a in zip(kept, code, away.sum(1)))


def codes(df):
    out = vector_codes.compressed(df)[0]
    return Counter((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in out.collect())


VECTORS = "vec_id long, label int, embedding array<float>, code string, ids int"


@pytest.mark.parametrize("tree_rows", [5, 64, 1024])
def test_codes_equal_brute_force(spark, monkeypatch, tree_rows):
    monkeypatch.setattr(vector_codes, "TREE_ROWS", tree_rows)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 8))
    near = (centres[rng.integers(0, 30, 700)] + rng.normal(size=(700, 8)) * rng.choice([0.002, 0.2], (700, 1))).astype(np.float32)
    data = [(int(i), int(i) % 3 or None, v.tolist()) for i, v in zip(rng.permutation(700), near)]
    same = data[3][2]
    data += [(1000 + i, 1, same) for i in range(300)] + [data[5], (None, None, same), (None, 4, data[9][2])]
    data += [(2000, 1, None), (2001, 1, []), (2002, 1, [0.0] * 7 + [None]), (2003, 1, [float("nan")] + [0.0] * 7), (2004, 1, [float("-inf")] + [0.0] * 7)]
    df = spark.createDataFrame([(*d, "c", 1) for d in data], VECTORS).repartition(4)
    assert codes(df) == lloyd(data)


def test_few_and_no_vectors(spark):
    data = [(3, 1, [0.1, -0.2, 0.3, -0.4]), (3, 1, [0.1, -0.2, 0.3, -0.4]), (None, None, [0.0] * 4)]
    df = spark.createDataFrame([(*d, "c", 1) for d in data], VECTORS)
    assert codes(df) == lloyd(data)
    assert codes(df.limit(0)) == Counter()
    assert codes(df.where("false")) == Counter()
    for bad in ([0.1] * 5, [1e9] * 4):
        with pytest.raises(Exception, match="length that 4 divides|not supported"):
            vector_codes.compressed(spark.createDataFrame([(1, 1, bad, "c", 1)] * 2, VECTORS))


def test_trees_cover_and_spare_comparisons():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.integers(-3, 4, (500, 4)) + c for c in rng.integers(-4000, 4000, (6, 4))])
    order, nodes = vector_codes.cover_tree(x)
    assert sorted(order) == list(range(len(x)))
    for start, end, radius, first, last in nodes:
        away = ((x[order[start:end]] - x[order[start]]) ** 2).sum(1)
        assert away.max() == radius
        if last > first:
            assert nodes[first][0] == start and nodes[last - 1][1] == end
            assert all(a[1] == b[0] for a, b in zip(nodes[first:last - 1], nodes[first + 1:last]))
            centres = x[order[nodes[first:last, 0]]]
            apart = ((centres[:, None] - centres[None]) ** 2).sum(2) + np.eye(len(centres), dtype=np.int64) * radius
            assert (4 * apart > radius).all()
    book = x[::500].copy()
    code, sums, counts, looked = vector_codes.assigned(x[order], nodes, book)
    assert looked < len(x) / 10
    assert (code == vector_codes.squared(x[order], book).argmin(1)).all() and counts.sum() == len(x)
    assert all((sums[e] == x[order][code == e].sum(0)).all() for e in range(len(book)))


def test_op13_equals_brute_force(spark):
    want = lloyd([(r["vec_id"], r["label"], r["embedding"]) for r in rows("embeddings")])
    out = QUERIES["op13_cover_tree_codes"](spark, SF)
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert Counter(tuple(r) for r in out.collect()) == want


def test_extra_columns_do_not_matter(spark):
    df = spark.createDataFrame([("a b", "en", "s", 1, "t", 3)] * 4, DOCS)
    assert divergence.audit(df.withColumn("value", F.lit(1)).withColumn("rank", F.lit("x"))).count() == 0
