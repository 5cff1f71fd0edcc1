"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns, and the ways
that small tables do not take by themselves."""

import io
import math
import random
import re
from dataclasses import replace

import numpy as np
import public_tokenizers
import pytest
from llm_support import components, near_components, words
from pyspark.sql import functions as F

from tidemark.llm import byte_bpe, decontaminate, graph, language_model, licenses, line_dedup, near_dedup, pii, quality_fm, quality_rules, warc_zip
from tidemark.llm.queries import RANKS

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, n long, row string, lines int, h string, dropped_id long"
LONG = " ".join(f"word{i % 4001}" for i in range(40_000))
TEXTS = [None, "", "   \n\t", "one", "one two", "a a a a a a", LONG, "x" * 70_000, "Größe 😀 naïve\n\n\nend", "same text here", "same text here"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", None if i % 3 else "host", len(t or ""), True, 1, "r", 2, "h", 1) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[4], rows[9], (None, "no id", *[None] * 9)], SCHEMA)


def wrapped(fn):
    return {
        "rules": lambda d: quality_rules.judge(d),
        "bpe": lambda d: byte_bpe.round_trip(d, public_tokenizers.path(RANKS), public_tokenizers.PATTERN),
        "licences": lambda d: licenses.scan(d.withColumn("path", F.concat("source", F.lit("/"), "doc_id")), keep=("doc_id",)),
        "fm": lambda d: quality_fm.score(d, quality_fm.train(d, d.select("doc_id", F.lit(1).alias("quality")))),
        "lines": lambda d: line_dedup.judged(d),
        "near": lambda d: near_dedup.near_duplicates(d),
        "windows": lambda d: decontaminate.contamination(d, d.select(F.col("doc_id").alias("item_id"), "text")),
        "lm": lambda d: language_model.score(d),
        "pii": lambda d: pii.pseudonymised(d, "k"),
        "warc": lambda d: warc_zip.archive_and_read(d, page_id="doc_id", url="source", html="text"),
    }[fn]


ALL = ["rules", "bpe", "licences", "fm", "lines", "near", "windows", "lm", "pii", "warc"]


@pytest.mark.parametrize("name", ALL)
def test_odd_rows_and_empty_tables(odd, name):
    run = wrapped(name)
    assert run(odd).count() == odd.count() - (name == "warc")  # a page without an id is not archived
    assert run(odd.limit(0)).count() == 0


def test_stages_keep_columns_and_clean_rows(spark, odd):
    model = quality_fm.fit([], np.zeros(0))
    for out in (quality_fm.keep_good(odd, model), line_dedup.drop_repeated_lines(odd), near_dedup.drop_near_duplicates(odd),
                decontaminate.drop_contaminated(odd, odd.select("doc_id", "text").limit(0), item_id="doc_id")):
        assert out.columns == odd.columns
        assert {r["doc_id"] for r in out.collect()} >= {0, 1, 2, 3, 5, 8, 9, None}


def test_stars_give_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(200)] + [(500, k) for k in range(501, 560)]
    out = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    ids = {x for a, b in links for x in (a, b) if a != b}
    assert out == {i: c for i, c in components(ids, links).items()}


def varied(rng, base, n):
    """Texts with some words of `base` replaced."""
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_crowded_buckets_lose_no_link(spark, monkeypatch):
    rng = random.Random(8)
    texts = varied(rng, [f"w{i}" for i in range(90)], 120) + varied(rng, [f"v{i}" for i in range(70)], 60)
    docs = list(enumerate(texts))
    want = near_components(docs, 2)
    assert 3 < len(set(want.values())) < len(docs)
    monkeypatch.setattr(near_dedup, "BLOCK", 7)
    for few in (2, 1000):
        monkeypatch.setattr(near_dedup, "FEW", few)
        out = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 2).collect()
        assert {r["doc_id"]: r["component_id"] for r in out} == want


def test_estimates_are_close_to_similarities():
    rng = np.random.default_rng(1)
    for shared in (30, 400, 5000):
        common = rng.integers(0, 2**64, shared, np.uint64)
        a, b = (np.unique(np.concatenate([common, rng.integers(0, 2**64, shared // 4, np.uint64)])) for _ in range(2))
        n = np.array([len(a)])
        j = near_dedup.similarity(near_dedup.registers(a)[None], near_dedup.registers(b)[None], n, n)[0]
        assert abs(j - shared / (1.5 * shared)) < 0.12


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def edited(rng, line, n):
    for _ in range(n):
        at = rng.randrange(len(line) + 1)
        line = line[:at] + rng.choice(["", "ü", "x"]) + line[at + rng.choice([0, 1]):]
    return line


@pytest.mark.parametrize("threshold", [1, 2])
def test_edit_links_are_complete(spark, monkeypatch, threshold):
    rng = random.Random(threshold)
    bases = ["".join(rng.choice("abcdeé ") for _ in range(rng.randrange(31, 60))) for _ in range(12)]
    lines = sorted({edited(rng, b, rng.randrange(0, 5)) for b in bases for _ in range(25)})
    want = {(i, j) for i in range(len(lines)) for j in range(i + 1, len(lines))
            if abs(len(lines[i]) - len(lines[j])) <= threshold and edits(lines[i], lines[j]) <= threshold}
    assert len(want) > 50
    table = spark.createDataFrame(list(enumerate(lines)), "id long, line string")
    for crowded in (3, 10_000):
        monkeypatch.setattr(line_dedup, "CROWDED", crowded)
        assert {tuple(r) for r in line_dedup.edit_links(table, threshold).collect()} == want


def test_line_classes_are_those_of_all_links(spark, monkeypatch):
    rng = random.Random(12)
    bases = ["".join(rng.choice("abcdeé ") for _ in range(rng.randrange(31, 60))) for _ in range(8)]
    chain = ["".join(rng.choice("abcde") for _ in range(40))]
    for _ in range(12):
        chain.append(edited(rng, chain[-1], 2))
    lines = sorted({edited(rng, b, rng.randrange(0, 5)) for b in bases for _ in range(30)} | set(chain))
    links = [(i, j) for i in range(len(lines)) for j in range(i + 1, len(lines)) if abs(len(lines[i]) - len(lines[j])) <= 2 and edits(lines[i], lines[j]) <= 2]
    want = {i: c for i, c in components(range(len(lines)), links).items() if any(i in x for x in links)}
    table = spark.createDataFrame(list(enumerate(lines)), "id long, line string")
    for crowded in (3, 10_000):
        monkeypatch.setattr(line_dedup, "CROWDED", crowded)
        assert {r["node"]: r["root"] for r in line_dedup.line_roots(table).collect()} == want


def test_pairs_of_a_large_class_are_not_written(spark, monkeypatch):
    """Twice the lines of a class are about twice the pairs that are compared, not four times."""
    kept, real = [], line_dedup._verified
    monkeypatch.setattr(line_dedup, "_verified", lambda pairs, texts_, threshold: kept.append(pairs.count()) or real(pairs, texts_, threshold))
    compared = []
    for n in (150, 300):
        base = "a line that stands in very many documents, with small changes at one place only: "
        rows = [(i, base + chr(0x4E00 + i)) for i in range(n)]
        kept.clear()
        assert {r["root"] for r in line_dedup.line_roots(spark.createDataFrame(rows, "id long, line string")).collect()} == {0}
        compared.append(sum(kept))
    assert compared[0] < 8 * 150 and compared[1] < 2.5 * compared[0]


def test_components_grow_by_contraction(spark):
    rng = random.Random(9)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(260)]
    roots = None
    for at in (0, 80, 90, 260):
        roots = graph.merged(roots, spark.createDataFrame(links[at:{0: 80, 80: 90, 90: 260, 260: 260}[at]], "a long, b long"))
    out = {r["node"]: r["root"] for r in roots.collect()}
    assert out == {i: c for i, c in components({x for a, b in links for x in (a, b) if a != b}, links).items()}


def test_repeated_lines_leave_later_documents(spark):
    a, b, c = ("the quick brown fox jumps over the dog " * 2, "another line that is long enough to count here", "a third line, which nobody has seen before now")
    docs = [(1, f"{a}\nshort\n{b}", 1), (2, f"{a[:-2]}X\nshort\n{c}", 2), (3, f"{b}\n\n{a}", 3), (4, "short\nshort", 4), (5, f"{c}\n{c}\nshort", 5)]
    out = {r["doc_id"]: r["text"] for r in line_dedup.drop_repeated_lines(spark.createDataFrame(docs, "doc_id long, text string, places long")).collect()}
    assert out == {1: docs[0][1], 2: f"short\n{c}", 4: "short\nshort", 5: "short"}


def test_rows_of_one_id_lose_their_own_lines(spark):
    a, b, c = (x * 40 for x in "abc")
    docs = [(1, f"{a}\n{b}"), (2, f"{c}\nshort\n{b}"), (2, f"short\n{a}\n{a}\n{a}"), (None, a), (3, None), (4, "")]
    out = line_dedup.judged(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    got = {(r["row"]["doc_id"], r["row"]["text"]): (r["kept_text"], r["n_lines"], r["n_dropped"], r["emptied"]) for r in out}
    assert got == {docs[0]: (docs[0][1], 2, 0, False), docs[1]: (f"{c}\nshort", 2, 1, False), docs[2]: ("short", 3, 3, False),
                   docs[3]: (a, 1, 0, False), docs[4]: (None, 0, 0, False), docs[5]: ("", 0, 0, False)}


def test_character_groups_are_disjoint_and_complete():
    groups = [re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: rf"\U{int(m[1], 16):08X}", x)) for x in line_dedup.character_groups(5)]
    for c in [*range(0x2000), 0x4E2D, 0xFFFF, 0x10000, 0x1F600, 0x10FFFF]:
        assert sum(not g.fullmatch(chr(c)) for g in groups) == 1


def test_blocks_of_items_agree_with_one_block(spark, documents):
    rows = [(d["doc_id"], d["text"]) for d in documents[:300]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(i, t[40:400]) for i, t in rows[::7]] + [(9999, rows[0][1][:20]), (9998, None)], "item_id long, text string")
    one = sorted(map(tuple, decontaminate.contamination(docs, items).collect()))
    many = sorted(map(tuple, decontaminate.contamination(docs, items, block_words=200).collect()))
    assert one == many and sum(r[5] for r in one) > 20
    left = {r["doc_id"] for r in decontaminate.drop_contaminated(docs, items, block_words=200).collect()}
    assert left == {r[0] for r in one if not r[5]} == {r["doc_id"] for r in decontaminate.drop_contaminated(docs, items).collect()}


def test_winnowing_marks_every_window():
    rng = np.random.default_rng(2)
    for n in (13, 14, 60, 500):
        h = rng.integers(0, 5, n).astype(np.uint64)
        at = set(decontaminate.fingerprints(h))
        assert all(at & set(range(i, i + decontaminate.WINDOW)) for i in range(n - decontaminate.SPAN + 1))


@pytest.mark.parametrize("zip64", [False, True])
def test_zip_members_are_found(zip64):
    import zipfile

    sink = io.BytesIO()
    z = warc_zip.StoredZip(sink, zip64)
    parts = {"a.bin": b"x" * 1000, "b/ü.txt": b"", "c": b"PK\x05\x06" + b"y" * 30}
    for name, data in parts.items():
        z.add(name, data)
    z.close()
    raw = sink.getvalue()
    found = warc_zip.members(io.BytesIO(raw), len(raw))
    assert {k: raw[at:at + n] for k, (at, n) in found.items()} == parts
    with zipfile.ZipFile(io.BytesIO(raw)) as other:
        assert {i.filename: other.read(i) for i in other.infolist()} == parts


def test_offsets_name_bytes_and_characters():
    c = byte_bpe.codec(public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    text = "né 😀😀 漢字  x\n\n end"
    ids = c.encode(text)
    starts, chars = c.offsets(text, ids)
    assert c.decode(ids).decode() == text and starts[0] == 0 and list(starts) == sorted(starts)
    assert all(len(text[:k].encode()) <= s < len(text[:k + 1].encode()) for s, k in zip(starts, chars))


def test_encoded_tables_decode(spark, odd):
    args = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    want = {r["doc_id"]: r["text"] or "" for r in odd.collect()}
    assert {r["doc_id"]: r["text"] for r in byte_bpe.decode(byte_bpe.encode(odd, *args), *args).collect()} == want


def test_class_probabilities_sum_to_one():
    k = language_model.CLASSES
    model = language_model.fit(np.arange(0, 2000, dtype=np.int64) * 7, np.ones(2000))
    counts = np.zeros((2, k))
    counts[0, 5], counts[1, 9] = 900, 40
    own = language_model.word_vectors(counts, np.array([3, 3]), model)
    model = replace(model, vectors=np.concatenate([model.vectors, own]).astype(np.float32))
    u, row, c = (x.reshape(-1) for x in np.meshgrid(np.arange(k), np.arange(k + 2), np.arange(k), indexing="ij"))
    p = 10.0 ** model.log10(u, row, c).astype(float).reshape(k, k + 2, k)
    assert np.allclose(p.sum(2), 1, atol=1e-4)
    # A word's own vector makes likelier what follows it, as far as the classes' vectors can tell it apart.
    assert (p[:, k, 5] > 3 * p[:, 3, 5]).all() and (p[:, k + 1, 9] > 2 * p[:, 3, 9]).all()


def test_surrogates_are_consistent_distinct_and_in_format(spark):
    docs = [(i, f"mail a{i}@b.com or A{i}@B.com, call +1 (743) 555-{i:04d} or +1-743-555-{i:04d}, card 4539578763621486, from 10.0.0.{i % 250}. "
                f"Mrs. Ana Lopez met Mr Lopez. Г-жа Анна Иванова.") for i in range(300)]
    out = [r["replaced"] for r in pii.pseudonymised(spark.createDataFrame(docs, "doc_id long, text string"), "key").orderBy("row.doc_id").collect()]
    again = [r["replaced"] for r in pii.pseudonymised(spark.createDataFrame(docs[::-1], "doc_id long, text string"), "key").orderBy("row.doc_id").collect()]
    assert out == again
    emails = [o.split()[1] for o in out]
    assert len(set(emails)) == 300 and all(o.split()[3].rstrip(",").lower() == e.lower() for o, e in zip(out, emails))
    assert not set(emails) & {f"a{i}@b.com" for i in range(300)}
    phones = [o.split(" call ")[1].split(" or ")[0] for o in out]
    assert len(set(phones)) == 300 and all(p.startswith("+1 (") and len(p) == 17 for p in phones)
    card = out[0].split("card ")[1].split(",")[0]
    digits = [int(x) for x in card]
    assert card[0] == "4" and card != "4539578763621486" and sum(d if i % 2 else (2 * d - 9 * (d > 4)) for i, d in enumerate(digits)) % 10 == 0
    tail = out[0].split(". ", 1)[1] if ". Mrs" in out[0] else out[0]
    ladies = out[0][out[0].index("Mrs."):].split()
    assert ladies[2] == ladies[5].rstrip(".") and ladies[1][-1] == "a" and tail and "Lopez" not in out[0]
    assert "Г-жа" in out[0] and "Иванова" not in out[0] and all("Ѐ" <= c <= "ӿ" for c in ladies[7])


def test_inheritance_takes_the_nearest_directory(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    files = [("a/LICENSE", mit), ("a/b/COPYING", apache), ("a/x.py", "code"), ("a/b/c/y.py", "code"), ("z/q.py", "code"), (None, "code"),
             ("a/b/own.py", f"{mit}\n" + "code " * 50), ("LICENSE2", None)]
    out = {r["path"]: (r["license"], r["how"], r["origin"]) for r in licenses.scan(spark.createDataFrame(files, "path string, text string")).collect()}
    assert out["a/x.py"] == ("MIT", "inherited", "a") and out["a/b/c/y.py"] == ("Apache-2.0", "inherited", "a/b")
    assert out["a/b/own.py"] == ("MIT", "stated", None) and out["z/q.py"] == out[None] == (None, "none", None)


def test_statements_are_cosines(spark, documents):
    """Scores of all lines against all templates, by brute force."""
    import re

    token = re.compile(r"[^\W_]+(?:\.\d+)*")
    tok = lambda s: token.findall(s.lower())
    docs = [(f"s/{d['doc_id']}", d["text"]) for d in documents[:400]]
    known = {t for n in licenses.TEMPLATES.values() for t in tok(n)}
    df = {t: sum(t in set(tok(x)) for _, x in docs) for t in known}
    idf = lambda t: 1 + math.log((1 + len(docs)) / (1 + df.get(t, 0)))

    def vector(s):
        t = tok(s)
        return {x: t.count(x) * idf(x) for x in set(t)}

    def cosine(a, b):
        return sum(a[x] * b.get(x, 0) for x in a) / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))

    templates = {k: vector(v) for k, v in licenses.TEMPLATES.items()}
    want = {}
    for path, text in docs:
        best = [max((cosine(vector(line), v), k) for k, v in templates.items()) for line in text.split("\n") if tok(line)]
        hits = [b for b in best if b[0] >= licenses.THRESHOLD]
        want[path] = len(hits)
    out = {r["path"]: r["n_statements"] for r in licenses.scan(spark.createDataFrame(docs, "path string, text string")).collect()}
    assert out == want and sum(want.values()) > 5


def test_tiny_sets_are_not_lost(spark):
    """6,000 pairs that share 4 of 5 shingles: in a band, past the estimate, and linked in the end."""
    rng = np.random.default_rng(5)
    lost = 0
    for _ in range(6000):
        s = np.sort(rng.integers(0, 2 ** 63, 5).astype(np.uint64) * np.uint64(2))
        a, b = near_dedup.registers(s), near_dedup.registers(np.delete(s, rng.integers(5)))
        j = near_dedup.similarity(a[None], b[None], np.array([5]), np.array([4]))
        banded = (a == b).reshape(near_dedup.BANDS, near_dedup.ROWS).all(1).any()
        lost += not (banded and near_dedup.may_reach(j, np.array([5]), np.array([4]), 80)[0])
    assert lost <= 2
    texts = [t for i in range(2000) for t in (f"a{i} b{i} c{i} d{i} e{i}", f"a{i} b{i} c{i} d{i} e{i} f{i}")]
    out = near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), size=2)
    assert sum(r["doc_id"] % 2 and r["component_id"] == r["doc_id"] for r in out.collect()) == 0


def test_statements_do_not_hang_on_the_number_of_files(spark):
    """Common and rare words around a notice, and unrelated files: the verdict on a line stays the same."""
    said = {
        "common": ("Content licensed under the Apache License, Version 2.0", "Apache-2.0"),
        "rare": ("Copyright 2021 Zyxwvut Qponmlk. Licensed under the Apache License, Version 2.0 (the \"License\");", "Apache-2.0"),
        "heading": ("MIT License", "MIT"),
        "text": ("Permission is hereby granted, free of charge, to any person obtaining a copy", "MIT"),
        "tag": ("// SPDX-License-Identifier: BSD-2-Clause", "BSD-2-Clause"),
        "with": ("# SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note)", "GPL-2.0"),
        "none": ("This content came under the hammer in 2021", None),
    }
    files = spark.createDataFrame([(f"d{i}/{k}", v[0]) for i, (k, v) in enumerate(said.items())], "path string, text string")
    words_ = F.concat(F.lit("word content 2021 "), F.col("id").cast("string"))
    for n in (10, 20_000):
        more = spark.range(n).select(F.concat(F.lit("x/"), "id").alias("path"), words_.alias("text"))
        out = {r["path"].split("/")[1]: r["license"] for r in licenses.scan(files.unionAll(more)).where("path like 'd%'").collect()}
        assert out == {k: v[1] for k, v in said.items()}, n


def test_repeated_three_word_windows(spark):
    texts = ["a b c d a b c", "a b c b c a b c x", "x y", "a a a a", "p q r"]
    out = {r["doc_id"]: r["n_repeat_words"] for r in quality_rules.document_counts(
        spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")).collect()}
    for i, t in enumerate(texts):
        w = words(t)
        grams = [tuple(w[k:k + 3]) for k in range(len(w) - 2)]
        assert out[i] == len({k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)})


def test_near_copies_are_tied_to_few_centres(spark, monkeypatch):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    docs = [(i, " ".join([f"x{i}" if k == j else w for k, w in enumerate(base)])) for i, j in enumerate(rng.choices(range(150), k=300))]
    ties, joined = [], near_dedup._joined
    monkeypatch.setattr(near_dedup, "_joined", lambda candidates, *rest: ties.append(candidates.distinct().count()) or joined(candidates, *rest))
    out = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 2).collect()
    assert {r["component_id"] for r in out} == {0} and ties[0] < 10 * len(docs)


def test_words_are_merged_as_the_whole_tokenizer_does():
    c = byte_bpe.Codec(public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    pieces = ["the", " the", " zqxv", "Straße", " naïveté", " ŵord", "don't", " it's", " x1", "a\nb", " 漢字", " end.", "", " "]
    want = [c.tokenizer.encode(p, add_special_tokens=False).ids for p in pieces]
    assert c.words_match and [c.encode(p) for p in pieces] == want
    other = byte_bpe.Codec(public_tokenizers.path(RANKS), r"\p{L}| ?\p{L}+|\s+")
    assert not other.words_match and other.encode("the") == [other.encode(x)[0] for x in "the"]
