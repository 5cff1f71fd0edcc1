import pytest

from tidemark.operators import ordering

QUEUE = [(1, 100), (2, 200), (3, 50), (4, 150), (5, 250), (6, 300), (7, 250), (8, 200)]


@pytest.fixture
def queue(spark):
    rows = [(e, t, i) for i, (e, t) in enumerate(QUEUE)]
    return spark.createDataFrame(rows, "event long, ts long, seq long").repartition(3)


def test_sorted_by_time_and_arrival(queue):
    assert [r["event"] for r in ordering.sort_events(queue).collect()] == [3, 1, 4, 2, 8, 5, 7, 6]


def test_earliest(queue):
    assert [tuple(r) for r in ordering.earliest(queue, ["event", "ts"]).collect()] == [(3, 50)]


def test_earliest_of_nothing(queue):
    assert ordering.earliest(queue.where("ts < 0"), ["event", "ts"]).collect() == []


def test_earliest_of_equals_is_the_first_in(spark):
    df = spark.createDataFrame([("b", 5, 1), ("a", 5, 0), ("c", 5, 2)], "event string, ts long, seq long")
    assert ordering.earliest(df, ["event"]).first()["event"] == "a"


def test_strings(spark):
    df = spark.createDataFrame([(w,) for w in "test hello world a b c".split()], "w string")
    assert [r["w"] for r in ordering.sort_strings(df, "w").collect()] == ["a", "b", "c", "hello", "test", "world"]


def test_first_object(spark):
    df = spark.createDataFrame([("x", "p", "late", 2), ("x", "p", "early", 1), ("y", "q", "z", 0)], "pod string, p string, o string, seq long")
    assert {r["pod"]: r["first_object"] for r in ordering.first_object(df, "p", ["pod"]).collect()} == {"x": "early", "y": ""}


def test_batches(spark):
    from datetime import datetime, timedelta

    rows = [("q", datetime(2024, 1, 1) + timedelta(hours=i), i) for i in range(45)]
    df = spark.createDataFrame(rows, "query_hash string, ts timestamp_ntz, seq long")
    out = ordering.ordinal_batch(df, ["query_hash"], 20).collect()
    assert [(r["batch"], r["full"]) for r in sorted(out, key=lambda r: r["seq"])] == (
        [(0, True)] * 20 + [(1, True)] * 20 + [(2, False)] * 5
    )
