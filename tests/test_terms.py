import hashlib

import pytest
from pyspark.sql import functions as F

from tidemark import functions as fn


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text", ["test", " t e\ts\nt ", "t e﻿st", "te s\r\nt　"])
def test_hash_ignores_white_space(spark, text):
    assert value(spark, fn.query_hash(F.lit(text))) == "098f6bcd4621d373cade4e832627b4f6"


def test_hash_keeps_what_only_looks_like_space(spark):
    assert value(spark, fn.query_hash(F.lit("te​st"))) == hashlib.md5("te​st".encode()).hexdigest()


@pytest.mark.parametrize("term,expected", [
    ("saref:hasValue", "https://saref.etsi.org/core/hasValue"),
    ("<https://saref.etsi.org/core/hasValue>", "https://saref.etsi.org/core/hasValue"),
    ("hasValue", ""), ("other:x", ""), (":w1", "http://w/w1"), ("saref:a:b", "https://saref.etsi.org/core/a"),
])
def test_expand_iri(spark, term, expected):
    prefixes = F.create_map(F.lit("saref"), F.lit("https://saref.etsi.org/core/"), F.lit(""), F.lit("http://w/"))
    assert value(spark, fn.expand_iri(F.lit(term), prefixes)) == expected


def test_expand_iri_without_prefixes(spark):
    nothing = F.lit(None).cast("map<string,string>")
    assert value(spark, fn.expand_iri(F.lit("saref:hasValue"), nothing)) == ""


@pytest.mark.parametrize("column,expected", [
    (lambda: fn.bucket_url_child(F.lit("http://h/log/"), F.lit(5)), "http://h/log/5/"),
    (lambda: fn.bucket_url_child(F.lit("http://h/log/x"), F.lit(5)), "http://h/log/5/"),
    (lambda: fn.bucket_url_child(F.lit("log/"), F.lit(5)), "none"),
    (lambda: fn.bucket_url_sibling(F.lit("http://h/log/17/"), F.lit(5)), "http://h/log/5/"),
    (lambda: fn.stream_of_inbox(F.lit("http://h/log/1700000000000/")), "http://h/log/"),
    (lambda: fn.stream_of_inbox(F.lit("http://h/log/1700/x")), "http://h/log/1700/x"),
    (lambda: fn.storage_root(F.lit("http://h:3000/a/b")), "http://h:3000"),
    (lambda: fn.meta_url(F.lit("http://h/a/b")), "http://h/a/.meta"),
    (lambda: fn.retarget_query(F.lit("<p/> <p/>"), F.lit("p/"), F.lit("p/$1/")), "<p/$1/> <p/>"),
    (lambda: fn.retarget_query(F.lit("<q/>"), F.lit("p/"), F.lit("z")), "<q/>"),
    (lambda: fn.bucket_ts_of_url(F.lit("http://h/log/1700000000000/")), 1700000000000),
    (lambda: fn.bucket_ts_of_url(F.lit("http://h/log/")), None),
    (lambda: fn.is_container(F.lit("http://h/log/")), True),
    (lambda: fn.epoch_ms(F.lit("2024-01-01T00:00:00.123Z")), 1704067200123),
    (lambda: fn.iso_ms(F.timestamp_millis(F.lit(1704067200123))), "2024-01-01T00:00:00.123Z"),
])
def test_url_and_time_terms(spark, column, expected):
    assert value(spark, column()) == expected


def test_times_do_not_depend_on_the_zone(spark):
    from tidemark.functions import epoch_ms, epoch_us

    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "Europe/Brussels", "America/St_Johns"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            row = spark.sql("SELECT TIMESTAMP_NTZ'2024-03-31 02:30:00.123456' AS a, TIMESTAMP_NTZ'1969-12-31 23:59:59.9995' AS b, "
                            "'2024-07-01T00:00:00.250Z' AS c").select(
                epoch_us("a").alias("a"), epoch_ms("a").alias("am"), epoch_us("b").alias("b"), epoch_ms("b").alias("bm"), epoch_ms("c").alias("c")).first()
            assert tuple(row) == (1711852200123456, 1711852200123, -500, -1, 1719792000250)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
