"""The pipeline as `run` chains it: each stage's rows against brute force on what the stage before left."""

import base64
import hashlib
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import tiktoken
from llm_support import components, lower, near_components, rows
from test_edges import edits

import corpus_pipeline
from tidemark.llm import line_dedup, quality_fm

SF = "/root/testdata/sf0.001"
BLANK = re.compile(r"[ \t\n\x0b\f\r\x1c-\x1f]*")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def ran(spark):
    """Tables between the stages, the documents first, and the rows that come out."""
    paths, plain = [], corpus_pipeline.fresh_folder

    def noted(*args):
        paths.append(plain(*args))
        return paths[-1]

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(corpus_pipeline, "fresh_folder", noted)
        out = [r.asDict() for r in corpus_pipeline.run(spark, SF).collect()]
    assert len(paths) == len(corpus_pipeline.STAGES) - 1
    return [rows("documents", SF), *[pq.read_table(p).to_pylist() for p in paths]], out


def by_id(table):
    assert len({d["doc_id"] for d in table}) == len(table)
    return {d["doc_id"]: d for d in table}


def test_classifier_drops_what_all_pairs_of_features_reject(spark, ran):
    (before, after, *_), _ = ran
    model = quality_fm.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    kept, close = by_id(after), 0
    for d in before:
        index, value = quality_fm.features((d["text"] or "").encode(), d["n_chars"])
        v = model.factors[index].astype(np.float64) * value[:, None]
        raw = model.bias + (model.linear[index].astype(np.float64) * value).sum() + np.triu(v @ v.T, 1).sum()
        if abs(raw) < 1e-3:
            close += 1
        else:
            assert (d["doc_id"] in kept) == (raw > 0)
        assert kept.get(d["doc_id"], d) == d
    assert close < len(before) / 50 and 0 < len(after) < len(before)


def test_lines_go_as_comparing_all_pairs_says(ran):
    (_, before, after, *_), _ = ran
    first = {}
    for d in sorted(before, key=lambda d: d["doc_id"]):
        for place, line in enumerate((d["text"] or "").split("\n")):
            if len(line) >= line_dedup.MIN_CHARS and not BLANK.fullmatch(line):
                first.setdefault(line, (d["doc_id"], place))
    lines = sorted(first, key=len)
    counts = [Counter(x) for x in lines]
    linked = []
    for i, a in enumerate(lines):
        for j in range(i + 1, len(lines)):
            if len(lines[j]) - len(a) > line_dedup.THRESHOLD:
                break
            # An edit changes two counts at most.
            apart = (counts[i] - counts[j]).total() + (counts[j] - counts[i]).total()
            if apart <= 2 * line_dedup.THRESHOLD and edits(a, lines[j]) <= line_dedup.THRESHOLD:
                linked.append((i, j))
    root = components(range(len(lines)), linked)
    least = {}
    for i, line in enumerate(lines):
        least[root[i]] = min(least.get(root[i], first[line]), first[line])
    stays = set(least.values())
    want = {}
    for d in before:
        all_ = (d["text"] or "").split("\n")
        left = [x for place, x in enumerate(all_) if x not in first or (d["doc_id"], place) in stays]
        if len(left) == len(all_):
            want[d["doc_id"]] = d
        elif not all(BLANK.fullmatch(x) for x in left):
            want[d["doc_id"]] = d | {"text": "\n".join(left)}
    assert by_id(after) == want
    assert any(want[i]["text"] != d["text"] for i, d in by_id(before).items() if i in want)


def test_one_document_of_each_group_stays(ran):
    (_, _, before, after, _), _ = ran
    group = near_components([(d["doc_id"], d["text"]) for d in before], 5)
    assert by_id(after) == {i: d for i, d in by_id(before).items() if group[i] == i}
    assert len(after) < len(before)


def test_contaminated_documents_go(ran):
    (_, _, _, before, after), _ = ran
    windows = set()
    for item in rows("benchmark", SF):
        w = ITEM_WORD.findall(lower(item["text"]))
        n = min(13, len(w))
        windows |= {tuple(w[i:i + n]) for i in range(len(w) - n + 1) if n}
    want = {}
    for i, d in by_id(before).items():
        w, hit = ITEM_WORD.findall(lower(d["text"])), set()
        for n in {len(x) for x in windows}:
            for at in range(len(w) - n + 1):
                if tuple(w[at:at + n]) in windows:
                    hit |= set(range(at, at + n))
        if not hit or 20 * len(hit) < len(w):
            want[i] = d
    assert by_id(after) == want


def test_ids_are_those_of_what_is_left(ran):
    tables, out = ran
    with open(public_tokenizers.path(corpus_pipeline.RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = by_id(out)
    assert set(got) == set(by_id(tables[-1]))
    for d in tables[-1]:
        ids, r = enc.encode_ordinary(d["text"] or ""), got[d["doc_id"]]
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((d["text"] or "").encode()).hexdigest()
