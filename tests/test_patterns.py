from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark import Pattern
from tidemark.model import FOCUS_PREDICATES, HAS_TIMESTAMP, HAS_VALUE, RDF_TYPE, TREE_MEMBER, VANN_PREFIX
from tidemark.operators import patterns
from tidemark.sinks.publish import compact_triples
from tidemark.sinks.results import to_ntriples
from tidemark.sources.members import assemble_members
from tidemark.sources.ntriples import malformed_lines, parse_ntriples, read_ntriples

SCHEMA = "member_id string, s string, p string, o string, o_type string, o_datatype string, o_lang string"


def graph(spark, *rows):
    return spark.createDataFrame([(*r, *[None] * (7 - len(r))) for r in rows], SCHEMA)


def rows(df, *cols):
    return sorted(map(tuple, (df.select(*cols) if cols else df).collect()), key=repr)


def test_repeated_variable_asks_for_equal_terms(spark):
    g = graph(spark, ("m", "a", "p", "a", "iri"), ("m", "a", "p", "b", "iri"))
    assert rows(patterns.match(g, Pattern("?x", "p", "?x"))) == [("a",)]


def test_graph_pattern_joins_over_members_of_a_window(spark):
    g = graph(spark, ("m1", "a", "v", "1", "literal"), ("m2", "a", "rel", "x", "iri"), ("m2", "b", "rel", "x", "iri"))
    found = patterns.bgp(g.withColumn("window", F.lit(1)), [Pattern("?s", "v", "?o"), Pattern("?s", "rel", "x")], ["window"])
    assert rows(found, "s", "o") == [("a", "1")]


def test_graph_pattern_orders_patterns_by_shared_variables(spark):
    g = graph(spark, ("m", "a", "p", "b", "iri"), ("m", "b", "q", "c", "iri"), ("m", "c", "r", "d", "iri"))
    chain = [Pattern("?x", "p", "?y"), Pattern("?z", "r", "?w"), Pattern("?y", "q", "?z")]
    assert rows(patterns.bgp(g, chain, ["member_id"]), "x", "y", "z", "w") == [("a", "b", "c", "d")]


def test_graph_pattern_without_shared_variable_is_refused(spark):
    g = graph(spark, ("m", "a", "p", "b", "iri"))
    with pytest.raises(ValueError):
        patterns.bgp(g, [Pattern("?x", "p", "?y"), Pattern("?z", "q", "?w")], ["member_id"])


def test_two_values_of_one_subject_are_two_solutions(spark):
    g = graph(spark, ("m", "a", "v", "1", "literal"), ("m", "a", "v", "2", "literal"), ("m", "a", "rel", "x", "iri"),
              ("m", "a", "v", "1", "literal"))
    found = patterns.bgp(patterns.dedup_triples(g), [Pattern("?s", "v", "?o"), Pattern("?s", "rel", "x")], ["member_id"])
    assert rows(found, "o") == [("1",), ("2",)]


def test_blank_nodes(spark):
    g = graph(
        spark, ("m", "a", "p", "_:b", "bnode"), ("m", "_:b", "q", "1", "literal", "int"), ("m", "_:b", "r", "2", "literal"),
        ("m", "a", "p", "_:gone", "bnode"), ("m", "a", "t", "x", "iri"), ("other", "_:b", "q", "9", "literal"),
    )
    assert rows(patterns.inline_bnodes(g), "s", "via", "p", "o") == [
        ("a", "p", "q", "1"), ("a", "p", "r", "2"), ("a", "p", None, None), ("a", None, "t", "x"),
    ]


def test_compact_folds_shortens_and_drops_repeats(spark):
    g = graph(spark, ("m", "http://x/a", "http://x/p", "http://x/o/1", "iri"), ("m", "http://x/a", "http://x/p", "http://x/o/1", "iri"))
    out = compact_triples(g, {"x": "http://x/", "o": "http://x/o/"})
    assert rows(out, "s", "p", "o") == [("x:a", "x:p", "o:1")]


def test_prefixes_are_plain_literals_only(spark):
    g = graph(
        spark, ("m", "http://a#", VANN_PREFIX, "a", "literal"), ("m", "http://b#", VANN_PREFIX, "b", "literal", None, "en"),
        ("m", "http://c#", VANN_PREFIX, "c", "literal", "t"), ("m", "http://d#", VANN_PREFIX, "http://d", "iri"),
    )
    assert rows(patterns.prefix_table(g, "http://me")) == [("", "http://me#"), ("a", "http://a#")]


def test_focus(spark):
    rel, rng = FOCUS_PREDICATES
    df = spark.createDataFrame(
        [(1, rel, "x", "iri"), (1, rng, "y", "iri"), (1, "other", "z", "iri"), (2, "?p", "q", "variable")],
        "query_id int, p string, o string, p_type string",
    )
    assert rows(patterns.extract_focus(df)) == [(1, "x"), (1, "y")]


def test_member_without_time_drops_out(spark):
    g = graph(
        spark, ("m", "a", HAS_TIMESTAMP, "2024-01-01T00:00:01.500Z", "literal"), ("m", "a", HAS_VALUE, "1", "literal"),
        ("n", "b", HAS_VALUE, "2", "literal"), ("k", "c", HAS_TIMESTAMP, "no time", "literal"),
    )
    out = patterns.share_event_time(g)
    assert rows(out, "member_id", "ts") == [("m", datetime(2024, 1, 1, 0, 0, 1, 500000))] * 2


def test_documents_to_members(spark):
    schema = "doc string, s string, p string, o string"
    docs = spark.createDataFrame([
        ("d1", "log", TREE_MEMBER, "a"), ("d1", "log", TREE_MEMBER, "b"), ("d1", "a", HAS_VALUE, "1"),
        ("d1", "b", HAS_VALUE, "2"), ("d1", "c", HAS_VALUE, "3"),
        ("d2", "x", HAS_TIMESTAMP, "t"), ("d2", "x", HAS_VALUE, "4"), ("d2", "y", RDF_TYPE, "z"),
    ], schema)
    assert rows(assemble_members(docs), "doc", "member_id", "s", "o") == [
        ("d1", "a", "a", "1"), ("d1", "b", "b", "2"),
        ("d2", "x", "x", "4"), ("d2", "x", "x", "t"), ("d2", "x", "y", "z"),
    ]


LINES = [
    '<http://s> <http://p> <http://o> .',
    '_:b0 <http://p> _:b1.',
    '<http://s> <http://p> "a \\"quoted\\" \\\\ back\\nline \\u00e9" .',
    '<http://s> <http://p> "1.5"^^<http://t> . # note',
    '<http://s> <http://p> "chat"@fr-BE .',
    '<http://s> <http://p> "" .',
    '<http://s> <http://p> "<http://not> <http://a> <http://triple> ." .',
    '<http://s> <http://p> <http://o1> .<http://s> <http://p> <http://o2> .',
    '<http://s> <http://p> "' + "long " * 100_000 + '" .',
    "<http://s> <http://p> \"it\\'s\" .",
    '<http://s> <http://p> "mark\u0001and\u0002" .',
    "# comment", "", "   ", "no statement", "<http://s> <http://p> .", '<http://s> <http://p> "open .',
]


def test_ntriples(spark):
    lines = spark.createDataFrame([(x,) for x in LINES], "value string")
    got = [tuple(r) for r in parse_ntriples(lines).collect()]
    assert ("http://s", "http://p", "http://o", "iri", None, None) in got
    assert ("_:b0", "http://p", "_:b1", "bnode", None, None) in got
    assert ("http://s", "http://p", 'a "quoted" \\ back\nline é', "literal", None, None) in got
    assert ("http://s", "http://p", "1.5", "literal", "http://t", None) in got
    assert ("http://s", "http://p", "chat", "literal", None, "fr-BE") in got
    assert ("http://s", "http://p", "", "literal", None, None) in got
    assert ("http://s", "http://p", "it's", "literal", None, None) in got
    assert ("http://s", "http://p", "mark\u0001and\u0002", "literal", None, None) in got
    assert any(len(o) == 500_000 for _, _, o, *_ in got)
    assert len(got) == 12
    assert [r[0] for r in malformed_lines(lines).collect()] == LINES[-3:]


def test_text_written_is_read_back(spark, tmp_path):
    g = graph(
        spark, ("m", "http://s", "http://p", 'tab\t "q" \\ \n end', "literal"), ("m", "_:b", "http://p", "x", "literal", "http://t"),
        ("m", "http://s", "http://p", "bon", "literal", None, "fr"), ("m", "http://s", "http://p", "_:b", "bnode"),
    ).drop("member_id")
    to_ntriples(g).write.text(str(tmp_path / "nt"))
    assert rows(read_ntriples(spark, str(tmp_path / "nt"))) == rows(g)
