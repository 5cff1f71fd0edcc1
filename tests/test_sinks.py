from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.operators import delivery, discovery, triplesets
from tidemark.operators.registry import query_catalog
from tidemark.sinks import publish
from tidemark.sinks.results import result_triples, to_ntriples
from tidemark.sources.modes import historical_plus_live
from tidemark.sources.ntriples import parse_ntriples
from tidemark.sources.notifications import parse_notifications, route_notifications
from test_registry import Q_MAX, table

from tidemark.model import RELATES_TO_PROPERTY

import pytest

T0 = datetime(2024, 1, 1)


def results(spark, n, query="q"):
    rows = [(f"e{i:03d}", query, float(i), T0 + timedelta(minutes=i)) for i in range(n)]
    return spark.createDataFrame(rows, "event_id string, query_hash string, value double, emitted_at timestamp_ntz")


@pytest.mark.parametrize("n,published", [(19, 0), (20, 20), (45, 40)])
def test_only_full_batches(spark, n, published):
    assert publish.publish_batches(results(spark, n)).count() == published
    assert publish.publish_batches(results(spark, n), flush=True).count() == n


def test_buckets_are_named_by_their_last_element_and_written_once(spark, tmp_path):
    path = str(tmp_path / "buckets")
    batches = publish.publish_batches(results(spark, 45))
    publish.write_buckets(batches, path)
    first = spark.read.parquet(path)
    ends = {T0 + timedelta(minutes=19), T0 + timedelta(minutes=39)}
    assert {r["bucket_ts"] for r in first.select("bucket_ts").distinct().collect()} == {
        int((e - datetime(1970, 1, 1)).total_seconds() * 1000) for e in ends
    }
    publish.write_buckets(publish.publish_batches(results(spark, 60)), path, existing=spark.read.parquet(path))
    assert spark.read.parquet(path).count() == 60


def test_result_triples(spark):
    one = spark.createDataFrame(
        [("http://e/1", 1.5, T0, T0, T0 + timedelta(seconds=180), "http://agg", ["http://s1", "http://s2"])],
        "event_id string, value double, emitted_at timestamp_ntz, started_at timestamp_ntz, ended_at timestamp_ntz,"
        " derived_from string, streams array<string>",
    )
    made = result_triples(one)
    assert made.count() == 8
    text = [r["value"] for r in to_ntriples(made).collect()]
    assert '<http://e/1> <https://saref.etsi.org/core/hasValue> "1.5"^^<http://www.w3.org/2001/XMLSchema#float> .' in text
    assert '<http://e/1> <http://w3id.org/rsp/vocals-sd#endedAt> "2024-01-01T00:03:00.000Z"^^<http://www.w3.org/2001/XMLSchema#dateTime> .' in text
    assert parse_ntriples(to_ntriples(made)).exceptAll(made).count() == 0


def test_annotation(spark):
    text = Q_MAX.replace("core:kind", f"<{RELATES_TO_PROPERTY}>")
    when = F.col("registered_at")
    note = publish.annotate_queries(query_catalog(table(spark, text)), when, when, when)
    row = note.first()
    assert (row["window_size"], row["window_slide"], row["projection_variable"]) == (90000, 15000, "peak")
    assert row["focus"] == "http://plant.test/kinds/pressure.upper"
    triples = publish.annotation_triples(note)
    assert triples.count() == 29
    stated = {r["p"]: r["o"] for r in triples.collect()}
    assert stated["http://www.example.org/has_query_hash"] == row["query_hash"]
    assert stated["http://www.example.org/has_query_string"] == text


def test_index_triples_and_latest_bucket(spark):
    rows = [("http://h/log/", f"http://h/log/{n}/", "p", T0 + timedelta(days=i)) for i, n in enumerate([900, 9000, 10000])]
    idx = spark.createDataFrame(rows, "stream string, node string, path string, value timestamp_ntz")
    assert publish.bucket_index_triples(idx).count() == 6 + 5 * 3
    assert publish.latest_bucket(idx).first()["o"] == "http://h/log/10000/"


def test_triple_sets(spark):
    schema = "s string, p string, o string, o_lang string"
    have = spark.createDataFrame([("a", "inbox", "1", None), ("a", "inbox", "2", None), ("a", "q", "x", "en")], schema)
    gone = spark.createDataFrame([("a", "inbox", "1", None)], schema)
    assert triplesets.delete_data(have, gone).count() == 2
    assert triplesets.insert_data(have, have).count() == 3
    new = spark.createDataFrame([("a", "inbox", "3", None)], schema)
    got = sorted((r["p"], r["o"]) for r in triplesets.replace_pointer(have, "inbox", new).collect())
    assert got == [("inbox", "3"), ("q", "x")]


def test_delivery(spark):
    subs = spark.createDataFrame([("q", "c1"), ("q", "c2"), ("q", "c1"), ("z", "c3")], "query_hash string, client_id string")
    both = results(spark, 30).unionByName(results(spark, 5, "nobody"))
    out = delivery.fan_out(both, subs)
    assert out.count() == 90
    assert out.groupBy("client_id").count().where("client_id = 'c1'").first()["count"] == 60
    assert delivery.undeliverable(both, subs).count() == 5


def test_only_hot_queries_are_spread(spark):
    subs = spark.createDataFrame([("hot", f"c{i}") for i in range(3)] + [("cold", "c9")], "query_hash string, client_id string")
    both = results(spark, 900, "hot").unionByName(results(spark, 30, "cold"))
    out = delivery.fan_out(both, subs, hot_rows=100)
    assert out.count() == 2730 and set(out.columns) == {*both.columns, "client_id"}
    assert out.groupBy("event_id", "client_id").count().where("count > 1").isEmpty()


def test_batches_of_one_instant_are_all_stored(spark, tmp_path):
    path, at_once = str(tmp_path / "buckets"), results(spark, 40).withColumn("emitted_at", F.lit(T0).cast("timestamp_ntz"))
    batches = publish.publish_batches(at_once)
    publish.write_buckets(batches.where("batch = 0"), path)
    for _ in range(2):
        publish.write_buckets(batches, path, existing=spark.read.parquet(path))
    assert spark.read.parquet(path).count() == 40


def test_discovery(spark):
    rel, view = "https://saref.etsi.org/core/relatesToProperty", "https://w3id.org/tree#view"
    rows = [("p1", "d1", rel, "bvp", 1), ("p1", "d1", view, "v1", 2), ("p1", "d2", view, "v2", 3), ("p2", "d3", rel, "skt", 1),
            ("p2", "d3", view, "v3", 2), ("p3", "d4", rel, "skt", 1)]
    idx = spark.createDataFrame(rows, "pod string, s string, p string, o string, seq long")
    assert sorted(r["stream"] for r in discovery.find_streams(idx, ["bvp"]).collect()) == ["v1", "v2"]
    assert {r["pod"]: r["stream"] for r in discovery.locate_stream(idx, "bvp").collect()} == {"p1": "d1", "p2": "v3", "p3": None}
    assert {r["pod"]: r["relevant"] for r in discovery.exists_metric(idx, ["skt"]).collect()} == {"p1": False, "p2": True, "p3": True}


def test_notifications(spark):
    bodies = [('{"type": "Add", "target": "http://h/log/1700000000000/", "object": "http://h/log/1700000000000/x"}',),
              ('{"type": "Update", "target": "http://h/log/1/", "object": "o"}',), ("no json",)]
    out = route_notifications(parse_notifications(spark.createDataFrame(bodies, "body string")))
    assert [tuple(r) for r in out.collect()] == [("http://h/log/", "http://h/log/1700000000000/x")]


def test_modes(spark):
    log = results(spark, 10).withColumnRenamed("emitted_at", "ts")
    now = F.lit(T0 + timedelta(minutes=6)).cast("timestamp_ntz")
    live = log.where(F.col("ts") > now)
    assert historical_plus_live(log, live, "historical+live", 120_000, now).count() == 3 + 3
    assert historical_plus_live(log, live, "live", 120_000, now).count() == 3
    with pytest.raises(ValueError):
        historical_plus_live(log, live, "historical", 120_000, now)
