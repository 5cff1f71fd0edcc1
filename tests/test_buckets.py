import random
from bisect import bisect_right
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import buckets, ordering, provenance
from tidemark.operators.provenance import trace
from tidemark.sources.event_log import bucket_index, read_log, write_log

EPOCH = datetime(1970, 1, 1)
START = datetime(2024, 1, 1)


def at(seconds):
    return START + timedelta(seconds=seconds)


@pytest.fixture(scope="module")
def skewed(spark):
    """One stream holds a third of the rows, half of them within one minute, with equal times."""
    rng = random.Random(7)
    data = []
    for i in range(6000):
        stream = "s0" if i % 3 == 0 else f"s{rng.randint(1, 40)}"
        when = rng.randint(100, 160) if stream == "s0" and i % 2 else rng.randint(0, 100_000)
        data.append((stream, f"m{i}", i, at(when)))
    df = spark.createDataFrame(data, "stream string, member_id string, seq long, ts timestamp_ntz").repartition(8)
    return data, df


INDEX = "stream string, node string, path string, value timestamp_ntz"


def index(spark, rows):
    return spark.createDataFrame([(s, n, "p", v) for s, n, v in rows], INDEX)


@pytest.mark.parametrize("broadcast_rows", [10_000, 0])
def test_as_of_edges(spark, broadcast_rows):
    idx = index(spark, [("a", "n1", at(10)), ("a", "n2", at(20)), ("a", "n2b", at(20)), ("a", "old", EPOCH), ("b", "n3", at(15))])
    members = spark.createDataFrame(
        [("a", "before", at(9.9)), ("a", "on", at(10)), ("a", "between", at(19)), ("a", "last", at(10**7)),
         ("b", "first", at(14)), ("b", "in", at(16)), ("c", "unknown", at(50))],
        "stream string, member_id string, ts timestamp_ntz",
    )
    out = buckets.assign_bucket(members, idx, cell_ms=5000, broadcast_rows=broadcast_rows)
    assert {r["member_id"]: r["bucket"] for r in out.collect()} == {
        "before": "none", "on": "n1", "between": "n1", "last": "n2", "first": "none", "in": "n3", "unknown": "none",
    }


@pytest.mark.parametrize("broadcast_rows", [10_000, 0])
def test_as_of_with_empty_index(spark, skewed, broadcast_rows):
    out = buckets.assign_bucket(skewed[1], index(spark, []), broadcast_rows=broadcast_rows)
    assert out.where("bucket = 'none'").count() == len(skewed[0])


@pytest.mark.parametrize("broadcast_rows", [10_000, 0])
def test_as_of_on_skewed_streams(spark, skewed, broadcast_rows):
    data, df = skewed
    rng = random.Random(3)
    bounds = [(s, f"{s}/{v}", at(v)) for s in ("s0", "s1", "s2") for v in sorted(rng.sample(range(100_000), 200))]
    known = defaultdict(list)
    for s, n, v in bounds:
        known[s].append((v, n))
    expected = {}
    for stream, member, _, ts in data:
        i = bisect_right([v for v, _ in known[stream]], ts)
        expected[member] = known[stream][i - 1][1] if i else "none"
    out = buckets.assign_bucket(df, index(spark, bounds), broadcast_rows=broadcast_rows)
    assert {r["member_id"]: r["bucket"] for r in out.collect()} == expected


@pytest.mark.parametrize("frm,to,expected", [(12, 25, ["n1", "n2"]), (20, 20, ["n2"]), (0, 5, []), (30, 40, ["n2"]), (0, 10, ["n1"])])
def test_pruned_buckets(spark, frm, to, expected):
    idx = index(spark, [("a", "n1", at(10)), ("a", "n2", at(20))])
    out = buckets.prune_buckets(idx, F.lit(at(frm)).cast("timestamp_ntz"), F.lit(at(to)).cast("timestamp_ntz"))
    assert sorted(r["node"] for r in out.collect()) == expected


@pytest.fixture
def many_parts(spark):
    """Small partitions are not put together."""
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(setting, "false")
    yield
    spark.conf.unset(setting)


@pytest.mark.parametrize("limit", [0, 10_485_760])
def test_positions_on_skewed_groups(spark, skewed, many_parts, limit):
    data, df = skewed
    groups = defaultdict(list)
    for stream, member, seq, ts in data:
        groups[stream].append((ts, seq, member))
    expected = {}
    for rows in groups.values():
        rows.sort()
        last = {ts: i for i, (ts, _, _) in enumerate(rows)}
        expected.update({m: (i, last[ts], len(rows)) for i, (ts, _, m) in enumerate(rows)})
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        out = ordering.positions(df, ["stream"], peers=True).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {r["member_id"]: (r["ordinal"], r["last_peer"], r["group_size"]) for r in out} == expected


def test_one_group_at_one_instant_is_many_tasks(spark, many_parts, tmp_path, monkeypatch):
    df = spark.range(4000).select(F.lit("g").alias("stream"), F.lit(at(1)).cast("timestamp_ntz").alias("ts"), F.col("id").alias("seq")).repartition(5)
    kept = []
    real = ordering.stored
    monkeypatch.setattr(ordering, "stored", lambda d, purpose: kept.append(real(d, purpose)) or kept[-1])
    for ties in (["seq"], []):
        out = {r["seq"]: r["ordinal"] for r in ordering.positions(df, ["stream"], ties=ties).collect()}
        assert sorted(out.values()) == list(range(4000))
        assert not ties or all(k == v for k, v in out.items())
        sizes = [r["count"] for r in kept[-2].groupBy("_range").count().collect()]
        assert len(sizes) == 8 and max(sizes) < 1000


def test_positions_keep_empty_groups_and_times(spark):
    df = spark.createDataFrame(
        [(None, 1, at(5)), (None, 0, at(4)), ("a", 2, None), ("a", 3, at(1)), ("a", 4, at(9000))],
        "stream string, seq long, ts timestamp_ntz",
    )
    out = ordering.positions(df, ["stream"]).collect()
    assert {r["seq"]: (r["ordinal"], r["group_size"]) for r in out} == {
        0: (0, 2), 1: (1, 2), 2: (0, 3), 3: (1, 3), 4: (2, 3),
    }


def test_cells_shrink_until_they_fit(spark, skewed):
    data, df = skewed
    hour, _ = ordering.cell_counts(df, ["stream"], "ts")
    assert hour == 3_600_000
    length, counts = ordering.cell_counts(df, ["stream"], "ts", cell_rows=100)
    assert length < hour
    assert counts.agg(F.max("_n")).first()[0] <= 100
    assert counts.agg(F.sum("_n")).first()[0] == len(data)
    # Rows at one instant stay together, and the search ends.
    same = spark.createDataFrame([("a", at(1))] * 50, "stream string, ts timestamp_ntz")
    assert ordering.cell_counts(same, ["stream"], "ts", cell_rows=10)[0] == 1
    assert ordering.cell_counts(df.where("seq < 0"), ["stream"], "ts")[0] == 3_600_000


def brute_rebalance(rows, size):
    """rows: (ts, seq, member); new bucket start per member, None where it stays."""
    rows = sorted(rows)
    starts = [rows[i][0] for i in range(size, len(rows), size)]
    return {m: (max((s for s in starts if s <= ts), default=None)) for ts, _, m in rows}


@pytest.mark.parametrize("size", [1, 7, 20, 100_000])
def test_rebalance(skewed, size):
    data, df = skewed
    named = df.withColumn("bucket", F.concat(F.lit("http://h/"), "stream", F.lit("/0/")))
    out = buckets.rebalance(named, size).collect()
    assert len(out) == len(data)
    groups = defaultdict(list)
    for stream, member, seq, ts in data:
        groups[stream].append((ts, seq, member))
    for stream, rows in groups.items():
        starts = brute_rebalance(rows, size)
        for r in (r for r in out if r["stream"] == stream):
            start = starts[r["member_id"]]
            tail = 0 if start is None else int((start - EPOCH).total_seconds() * 1000)
            assert r["bucket"] == f"http://h/{stream}/{tail}/"
            assert r["old_bucket"] == f"http://h/{stream}/0/"


def test_overflow(skewed):
    data, df = skewed
    counts = Counter(s for s, *_ in data)
    out = buckets.overflow(df, 150, ["stream"]).collect()
    assert {r["stream"]: r["n"] for r in out} == {s: n for s, n in counts.items() if n > 150}


def test_initial_load_keeps_all(spark, skewed):
    data, df = skewed
    idx = index(spark, [("s0", "s0" + "/9/", at(50_000))])
    out = buckets.initial_load(df, idx, 50).collect()
    assert sorted(r["member_id"] for r in out) == sorted(m for _, m, *_ in data)
    assert all(r["bucket"] != "none" for r in out)


@pytest.mark.parametrize("bounds", ["[]", "[)"])
def test_trace(spark, bounds):
    results = spark.createDataFrame(
        [("r1", "a", at(0), at(7200)), ("r2", "a", at(3600), at(10_800)), ("r3", "b", at(0), at(10))],
        "event_id string, stream string, started_at timestamp_ntz, ended_at timestamp_ntz",
    )
    members = spark.createDataFrame(
        [("a", "m0", at(0)), ("a", "m1", at(3600)), ("a", "m2", at(7200)), ("a", "m3", at(10_801)), ("b", "m4", at(5))],
        "stream string, member_id string, ts timestamp_ntz",
    )
    got = {(r["event_id"], r["member_id"]) for r in trace(results, members, bounds).collect()}
    closed = {("r1", "m0"), ("r1", "m1"), ("r1", "m2"), ("r2", "m1"), ("r2", "m2"), ("r3", "m4")}
    assert got == (closed if bounds == "[]" else closed - {("r1", "m2")})
    with pytest.raises(ValueError):
        trace(results, members, "()")


@pytest.mark.parametrize("lengths", [16, 1])
def test_trace_of_windows_of_many_lengths(spark, monkeypatch, lengths):
    monkeypatch.setattr(provenance, "LENGTHS", lengths)
    rng = random.Random(5)
    spans = [(f"r{i}", f"s{i % 2}", a, a + d) for i in range(150) for a, d in [(rng.randint(-50, 500), rng.choice([0, 1, 2, 7, 60, 64, 400]))]]
    members = [(f"s{i % 2}", f"m{i}", rng.randint(-60, 900)) for i in range(200)]
    out = trace(
        spark.createDataFrame([(e, s, at(a), at(b)) for e, s, a, b in spans], "event_id string, stream string, started_at timestamp_ntz, ended_at timestamp_ntz"),
        spark.createDataFrame([(s, m, at(t)) for s, m, t in members], "stream string, member_id string, ts timestamp_ntz"))
    got = Counter((r["event_id"], r["member_id"]) for r in out.collect())
    assert got == Counter((e, m) for e, s, a, b in spans for of, m, t in members if s == of and a <= t <= b)


def test_log_opens_only_the_days_it_needs(spark, skewed, tmp_path):
    data, df = skewed
    path = str(tmp_path / "log")
    write_log(df, path)
    frm, to = F.lit(at(90_000)).cast("timestamp_ntz"), F.lit(at(95_000)).cast("timestamp_ntz")
    found = read_log(spark, path, frm, to)
    assert found.count() == sum(at(90_000) <= ts <= at(95_000) for *_, ts in data)
    plan = found._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "bucket_date" in filters


def test_bucket_index(spark, skewed):
    idx = bucket_index(skewed[1], "hour")
    assert idx.count() == len({(s, ts.replace(minute=0, second=0)) for s, _, _, ts in skewed[0]})
