"""The numbered queries over whole tables against brute force, exact round trips or held-out accuracy."""

import base64
import hashlib
import math
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from llm_support import SF, bucket, lower, near_components, rows, shingle_set, words

import __spark_entry__ as entry
from tidemark.llm.queries import QUERIES, RANKS, SQL


def result(spark, name):
    return {r[0]: r for r in QUERIES[name](spark, SF).collect()}


def test_all_numbers_are_there():
    assert {int(n[2:].split("_")[0]) for n in entry.queries() if re.match(r"op\d", n)} == set(range(1, 14))
    assert "pipeline" in entry.queries()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_twin(spark, name):
    from compare import connect, difference

    assert difference(QUERIES[name](spark, SF).toPandas(), connect(SF).execute(SQL[name]).df()) is None


@pytest.mark.parametrize("name", [n for n in QUERIES if re.match(r"op(1|3|5|10|12)_", n)])
def test_native_queries_run_no_python(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct", plan)


def test_op2_encodes_as_tiktoken(spark, documents):
    with open(public_tokenizers.path(RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = result(spark, "op2_byte_bpe")
    assert len(out) == len(documents)
    for d in documents:
        ids = enc.encode_ordinary(d["text"] or "")
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((d["text"] or "").encode()).hexdigest())
        assert tuple(out[d["doc_id"]])[1:] == want


def test_op4_is_right_on_held_out_labels(spark, documents):
    out = result(spark, "op4_factorisation_machine")
    assert len(out) == len(documents)
    assert all(r["held_out"] == (bucket(i, 3) == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for i, r in out.items())
    labels = {r["doc_id"]: r["quality"] for r in rows("labels")}
    held = [(out[i]["score"], y) for i, y in labels.items() if i in out and out[i]["held_out"]]
    assert np.mean([(s >= 0.5) == y for s, y in held]) > 0.95
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([g > b for g in good for b in bad]) > 0.95


def test_op6_reads_what_was_written(spark):
    first = {}
    for p in sorted(rows("pages"), key=lambda p: p["page_id"]):
        first.setdefault((p["html"] or ""), p["page_id"])
    out = result(spark, "op6_zip_warc")
    assert len(out) == len(rows("pages"))
    for p in rows("pages"):
        raw, r = (p["html"] or "").encode(), out[p["page_id"]]
        of = first[p["html"] or ""]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if of == p["page_id"] else ("revisit", of))


def test_op7_finds_all_components(spark, documents):
    want = near_components([(d["doc_id"], d["text"]) for d in documents], 2)
    out = result(spark, "op7_hyperminhash")
    assert len(out) == len(documents)
    for d in documents:
        r = out[d["doc_id"]]
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(shingle_set(d["text"], 2)), want[d["doc_id"]], want[d["doc_id"]] == d["doc_id"])


def test_op8_finds_all_windows(spark, documents):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for b in rows("benchmark"):
        w = pattern.findall(lower(b["text"]))
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i:i + n]), set()).add(b["item_id"])
    sizes = {len(w) for w in windows}
    out = result(spark, "op8_winnowing")
    assert any(r["contaminated"] for r in out.values())
    for d in documents:
        w = pattern.findall(lower(d["text"]))
        hit, items = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    hit |= set(range(i, i + n))
                    items |= windows[tuple(w[i:i + n])]
        named = hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
        assert tuple(out[d["doc_id"]])[1:] == (len(w), len(hit), len(items), named, bool(hit) and 20 * len(hit) >= len(w))


def test_op9_beats_its_base_on_held_out_texts(spark, documents):
    end = object()
    texts = {d["doc_id"]: [*words(d["text"]), end] for d in documents}
    c = Counter(t for i, x in texts.items() if bucket(i, 7) != 2 for t in x)
    n, v = sum(c.values()), len(c)
    out = result(spark, "op9_log_bilinear")
    assert len(out) == len(texts)
    for i, x in texts.items():
        r = out[i]
        base = sum(math.log10((c[t] + 1) / (n + v + 1)) for t in x)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (bucket(i, 7) == 2, len(x), sum(c[t] > 0 for t in x), n)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)
    held = [r for r in out.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
