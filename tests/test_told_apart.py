"""Queries, results and rows that look alike and are not: each keeps its own answer."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import joined_text
from tidemark.model import HAS_VALUE, RELATES_TO_PROPERTY, Agg, ContinuousQuery, Pattern, WindowSpec
from tidemark.operators import query_text
from tidemark.operators.buckets import assign_bucket, initial_load
from tidemark.operators.ordering import earliest, first_object
from tidemark.operators.patterns import to_triples
from tidemark.operators.registry import dedup_queries, equivalence_key, query_catalog
from tidemark.plans.continuous import over_observations, over_triples
from tidemark.sources.ntriples import malformed_lines, parse_ntriples
from tidemark.streaming.shared import run_shared

MINUTE = WindowSpec(60_000, 60_000)
OBSERVED = "stream string, member_id string, seq long, ts timestamp_ntz, property string, value double"


@pytest.fixture(scope="module")
def obs(spark):
    at = datetime(2024, 1, 1)
    return spark.createDataFrame([("s1", "m1", 1, at, "a", 1.5), ("s2", "m2", 2, at, "b", 9.0)], OBSERVED)


def query(stream, property_, having=None, **more):
    spec = WindowSpec(60_000, 60_000, stream=stream)
    patterns = (Pattern("?s", HAS_VALUE, "?o"), Pattern("?s", RELATES_TO_PROPERTY, property_))
    return ContinuousQuery((Agg("max", "o", "top"),), (spec,), patterns, having=having, **more)


def test_shared_queries_keep_stream_property_and_having(obs):
    queries = {"a": query("s1", "a"), "b": query("s2", "b", "top > 100"), "c": query("s2", "b", "top > 5"), "d": query("s1", "b")}
    got = {(r["query_hash"], r["var"], r["value"]) for r in run_shared(obs, queries).collect()}
    assert got == {("a", "top", 1.5), ("c", "top", 9.0)}


def test_what_cannot_be_shared_is_refused(obs):
    with pytest.raises(ValueError):
        run_shared(obs, {"a": query("s1", "a", r2s="IStream")})
    two = ContinuousQuery((Agg("max", "value", "top"),), (MINUTE, MINUTE))
    both = ContinuousQuery((Agg("max", "o", "top"),), (MINUTE,), (
        Pattern("?s", RELATES_TO_PROPERTY, "a"), Pattern("?s", RELATES_TO_PROPERTY, "b")))
    for q in (two, both, ContinuousQuery((Agg("max", "o", "top"),), (MINUTE,), (Pattern("?s", "?p", "?o"),))):
        with pytest.raises(ValueError):
            run_shared(obs, {"q": q})
        with pytest.raises(ValueError):
            over_observations(q, obs)


def test_means_over_any_object_count_numbers_only(obs):
    q = ContinuousQuery((Agg("avg", "o", "mean"),), (MINUTE,), (Pattern("?s", "?p", "?o"),))
    assert [r["mean"] for r in over_triples(q, to_triples(obs)).collect()] == [pytest.approx(5.25)]


def test_joined_texts_differ_when_values_do(spark):
    rows = [("a|b", "c"), ("a", "b|c"), (None, "a"), ("a", None), ("\\N", "a"), ("", "a"), ("a", ""), ("a\\", "|b"), ("a\\|", "b")]
    d = spark.createDataFrame(rows, "x string, y string").select(joined_text("x", "y").alias("t"))
    assert d.distinct().count() == len(rows)
    assert spark.range(1).select(joined_text(F.lit("plain"), F.lit("text")).alias("t")).first()["t"] == "plain|text"


BASE = """PREFIX m: <http://metrics.test/>
REGISTER RStream <out> AS
SELECT (SUM(?load) AS ?total)
FROM NAMED WINDOW <w1> ON STREAM <http://site.test/load> [RANGE 9000 STEP 3000]
WHERE {
WINDOW <w1> { ?machine m:load ?load . }
}"""


def test_queries_that_differ_anywhere_are_not_merged(spark):
    texts = [BASE, BASE + " GROUP BY ?machine", BASE + " GROUP BY ?machine HAVING (SUM(?load) > 7)",
             BASE.replace("?load . }", "?load . FILTER(?load > 2) }"), BASE.replace("}\n}", "}\n?machine m:site ?where .\n}"),
             BASE.replace("m:load", "m:heat"), BASE.replace("?machine", "?node").replace("    ", " ").replace("WHERE {\n", "WHERE  {\n\n")]
    rows = [(i, t, datetime(2024, 1, 1, 0, i)) for i, t in enumerate(texts)]
    out = dedup_queries(spark.createDataFrame(rows, "query_id long, query_text string, registered_at timestamp")).collect()
    assert {r["query_id"]: r["registrations"] for r in out} == {0: 2, 1: 1, 2: 1, 3: 1, 4: 1, 5: 1}


def test_null_groups_stay(spark):
    at = datetime(2024, 1, 1)
    members = spark.createDataFrame([(None, "m1", 1, at), ("s", "m2", 2, at)], "stream string, member_id string, seq long, ts timestamp_ntz")
    index = spark.createDataFrame([(None, "nul/", at), ("s", "one/", at)], "stream string, node string, value timestamp_ntz")
    for limit in (0, 10):
        got = {r["member_id"]: r["bucket"] for r in assign_bucket(members, index, broadcast_rows=limit).collect()}
        assert got == {"m1": "nul/", "m2": "one/"}
    assert initial_load(members, index.limit(0), 10).count() == 2
    assert {r["stream"] for r in earliest(members, ["member_id"], ["stream"]).collect()} == {None, "s"}
    triples = spark.createDataFrame([(None, "p", "o1", 1), ("s", "q", "o2", 2)], "g string, p string, o string, seq long")
    assert {(r["g"], r["first_object"]) for r in first_object(triples, "p", ["g"]).collect()} == {(None, "o1"), ("s", "")}


def test_comments_hold_no_triples(spark):
    lines = ["# <a> <b> <c> .", "<a#x> <b> \"t # no\" . # <x> <y> <z> .", "  # only", "<a> <b> <c> . <d> <e> <f> .", "junk # <a> <b> <c> ."]
    table = spark.createDataFrame([(x,) for x in lines], "value string")
    assert {(r["s"], r["o"]) for r in parse_ntriples(table).collect()} == {("a#x", "t # no"), ("a", "c"), ("d", "f")}
    assert [r["value"] for r in malformed_lines(table).collect()] == [lines[4]]


def merged(spark, *texts):
    """Which of the texts count as one query: the least place of each."""
    rows = [(i, t) for i, t in enumerate(texts)]
    keys = {r["query_id"]: r["equivalence_key"] for r in equivalence_key(spark.createDataFrame(rows, "query_id long, query_text string")).collect()}
    return [min(j for j in keys if keys[j] == keys[i]) for i in range(len(texts))]


def body(text, head="PREFIX ex: <http://one.test/>\n", select="(AVG(?a) AS ?m)", rest=""):
    return (f"{head}REGISTER RStream <o> AS SELECT {select} FROM NAMED WINDOW <w> ON STREAM <s> [RANGE 10 STEP 5] "
            f"WHERE {{ WINDOW <w> {{ {text} }} }} {rest}")


def test_prefixes_count_wherever_they_are_used(spark):
    one = body("?s ex:v ?a . FILTER(?s = ex:a)")
    other, long = one.replace("http://one", "http://two"), body("?s <http://one.test/v> ?a . FILTER(?s = <http://one.test/a>)", "")
    typed = [body(f'?s ex:v ?a . FILTER(?s = "1"^^{t})') for t in ("ex:a", "<http://one.test/a>", "ex:b")]
    assert merged(spark, one, other, long, *typed) == [0, 1, 0, 3, 3, 5]


def test_variables_are_one_graph_over_all_clauses(spark):
    a = body("?s ex:v ?a ; ex:w ?b . FILTER(?a > 5)")
    b = body("?s ex:v ?b ; ex:w ?a . FILTER(?a > 5)", select="(AVG(?b) AS ?m)")
    same = body("?x ex:w ?z . ?x ex:v ?y . FILTER(?y > 5)", select="(AVG(?y) AS ?n)")
    grouped = [body("?s ex:v ?a ; ex:w ?b", rest=r) for r in ("GROUP BY ?b", "GROUP BY ?s", "GROUP BY ?b HAVING (?m > 2)", "GROUP BY ?b HAVING (?b > 2)")]
    assert merged(spark, a, b, same, *grouped) == [0, 1, 0, 3, 4, 5, 6]


def test_literals_are_kept_as_written(spark):
    texts = [body(f"?s ex:v ?a . FILTER(?s = {x})") for x in (
        '"a b"', '"ab"', '"a  b"', "'a b'", '"a b"@en', '"# PREFIX ex: <http://one.test/>"', '"# "', '"} WINDOW <w> {"', r'"a\"b"', '"""a\nb"""')]
    assert merged(spark, *texts) == list(range(len(texts)))
    assert merged(spark, texts[0], texts[0].replace("FILTER", "# a note\n FILTER")) == [0, 0]


def test_symmetric_patterns(spark):
    def rings(*sizes, names="abcdef", back=False):
        out, at = [], 0
        for n in sizes:
            ring = [f"?{names[at + i]} ex:p ?{names[at + (i + 1) % n]}" for i in range(n)]
            out, at = out + (ring[::-1] if back else ring), at + n
        return body(" . ".join(out), select="(COUNT(*) AS ?k)")

    texts = [rings(6), rings(6, names="fbdace", back=True), rings(3, 3), rings(3, 3, names="cafbed"), rings(2, 4), rings(4, 2, names="bcdefa")]
    assert merged(spark, *texts) == [0, 0, 2, 2, 4, 4]
    same = body("?a ex:p ?o . ?b ex:p ?o . ?c ex:p ?o . ?d ex:p ?o", select="(COUNT(?o) AS ?k)")
    assert merged(spark, same, same.replace("?d", "?z").replace("?a", "?d"), same.replace("?a ex:p ?o", "?a ex:p ?b")) == [0, 0, 2]


def test_lists_and_what_is_not_understood(spark):
    texts = [body("?s ex:v ?a ; a ex:T , ex:U ."), body("?s ex:v ?a . ?s a ex:U . ?s a ex:T"), body("?s ex:v ?a ; a ex:T . ?t a ex:U"),
             body("?s ex:v ?a . OPTIONAL { ?s a ex:T }"), body("?s ex:v ?a OPTIONAL { ?s a ex:T } ."), body("?s ex:v [ ex:w ?a ]"),
             body("?s ex:v/ex:w ?a"), body("?s ex:v ?a", rest="ORDER BY ?s LIMIT 3"), body("?s ex:v ?a", rest="ORDER BY ?s LIMIT 4")]
    assert merged(spark, *texts) == [0, 0, 2, 3, 4, 5, 6, 7, 8]
    rows = query_catalog(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "query_id long, query_text string")).orderBy("query_id").collect()
    assert [r["understood"] for r in rows] == [True] * 3 + [False] * 6
    assert {(p["s"], p["p"].rsplit("/")[-1], p["o"]) for p in rows[0]["patterns"]} == {
        ("?s", "v", "?a"), ("?s", "22-rdf-syntax-ns#type", "http://one.test/T"), ("?s", "22-rdf-syntax-ns#type", "http://one.test/U")}


def test_clauses_become_columns(spark):
    text = body('?s ex:v ?a . FILTER(?a > 5 && ?s != "x y"@en)', select="?s (COUNT(*) AS ?n) (SUM(DISTINCT ?a) AS ?t)", rest="GROUP BY ?s HAVING (COUNT(*) > 3)")
    row = query_catalog(spark.createDataFrame([(1, text)], "query_id long, query_text string")).first()
    assert row["understood"] and [tuple(a) for a in row["aggregates"]] == [("count", False, "*", "n"), ("sum", True, "a", "t")]
    assert row["filters"] == ['FILTER ( ?a > 5 && ?s != "x y"@en )'] and row["having"] == "( COUNT ( * ) > 3 )"
    assert (row["selected"], row["group_by"]) == (["s"], ["s"])


def test_groups_of_clauses_are_those_of_a_search_of_the_whole_text(spark):
    texts = ["xPREFIX no: <http://n> prefix a:<http://a>, _PREFIX no: <u> .PREFIX\n: <http://b>PREFIX c: <>", "éprefix d: <http://d> (count( distinct ?a) as ?n)(Sum($b) AS ?m)",
             "FROM NAMED WINDOW :w ON STREAM <s> [RANGE 5 STEP 2]from named window <v> on x:y [range PT1S] aFROM NAMED WINDOW :w ON :s [RANGE 5]", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for regex, names in ((query_text.PREFIX_CLAUSE, "ab"), (query_text.AGGREGATE_ITEM, "abcd"), (query_text.WINDOW_CLAUSE, "abcd")):
        whole = F.arrays_zip(*[F.regexp_extract_all("t", F.lit(regex.replace("P(?<=\\bP)", r"\bP").replace("F(?<=\\bF)", r"\bF")), F.lit(i + 1)).alias(n)
                               for i, n in enumerate(names)])
        got = rows.select(query_text.groups(F.col("t"), regex, *names).alias("got"), whole.alias("want")).collect()
        assert [r["got"] for r in got] == [r["want"] for r in got] and any(r["got"] for r in got)
