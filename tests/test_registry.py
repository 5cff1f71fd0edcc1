from datetime import datetime, timedelta

import pytest

from tidemark.operators import registry

HEAD = """prefix core: <https://vocabulary.test/core/>
Prefix kinds: <http://plant.test/kinds/> PREFIX : <http://plant.test/windows/>
"""
Q_MAX = HEAD + """REGISTER RStream <peaks> AS
    SELECT (MAX(?level) as ?peak)
    FROM NAMED WINDOW :recent ON STREAM <http://plant.test:81/tank/>
        [RANGE 90000   STEP 15000]
    WHERE {
        WINDOW :recent {
            ?reading core:amount ?level .
            ?reading core:kind kinds:pressure.upper .
        }
    }"""
Q_AVG = HEAD + """register rstream :means as
    SELECT (AVG(?level) as ?mean)
    from named window :w ON <http://plant.test/flow> [ RANGE PT1.5S ]
    WHERE {
        WINDOW :w{
            ?reading core:amount ?level
        }
    }"""
Q_AVG_ANY = Q_AVG.replace("?reading core:amount ?level", "?any ?thing ?level")
TWO_WINDOWS = HEAD + """REGISTER IStream <pairs> AS
    SELECT (AVG(?level) AS ?m) (COUNT(DISTINCT ?reading) AS ?k)
    FROM NAMED WINDOW :left ON STREAM <http://plant.test/one/> [RANGE 60000 STEP 20]
    FROM NAMED WINDOW :right ON STREAM <http://plant.test/two/> [RANGE 60000 STEP 20]
    WHERE{
        WINDOW :left { ?reading core:amount ?level .
                     ?reading core:kind kinds:heat.lower .}
        WINDOW :right { ?reading core:amount ?level .
                     ?reading core:kind kinds:heat.lower .}
    }"""


def table(spark, *texts):
    start = datetime(2024, 1, 1)
    rows = [(i, t, start + timedelta(minutes=i)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "query_id long, query_text string, registered_at timestamp_ntz")


def accepted(spark, *texts):
    return sorted(r["query_id"] for r in registry.dedup_queries(table(spark, *texts)).collect())


def test_catalog_of_representative_query(spark):
    row = registry.query_catalog(table(spark, Q_MAX)).first()
    assert (row["r2s_operator"], row["r2s_name"]) == ("RStream", "peaks")
    assert [tuple(w) for w in row["windows"]] == [("http://plant.test/windows/recent", "http://plant.test:81/tank/", 90000, 15000)]
    assert [tuple(a) for a in row["aggregates"]] == [("max", False, "level", "peak")]
    assert len(row["prefixes"]) == 3
    assert [(p["s"], p["p"], p["o"]) for p in row["patterns"]] == [
        ("?reading", "https://vocabulary.test/core/amount", "?level"),
        ("?reading", "https://vocabulary.test/core/kind", "http://plant.test/kinds/pressure.upper"),
    ]


def test_catalog_of_a_loosely_written_query(spark):
    row = registry.query_catalog(table(spark, Q_AVG)).first()
    assert (row["r2s_operator"], row["r2s_name"]) == ("RStream", ":means")
    assert [tuple(w)[1:] for w in row["windows"]] == [("http://plant.test/flow", 1500, 1500)]



def test_catalog_of_two_windows(spark):
    row = registry.query_catalog(table(spark, TWO_WINDOWS)).first()
    assert row["r2s_operator"] == "IStream"
    assert [w["stream"] for w in row["windows"]] == ["http://plant.test/one/", "http://plant.test/two/"]
    assert [tuple(a) for a in row["aggregates"]] == [("avg", False, "level", "m"), ("count", True, "reading", "k")]
    assert [p["window"].rsplit("/", 1)[1] for p in row["patterns"]] == ["left", "left", "right", "right"]


def test_catalog_of_a_text_that_is_no_query(spark):
    row = registry.query_catalog(table(spark, "no query at all")).first()
    assert (row["r2s_operator"], row["windows"], row["aggregates"], row["patterns"]) == ("RStream", [], [], [])


def test_reformatted_query_is_rejected_and_another_pattern_accepted(spark):
    assert accepted(spark, Q_AVG, Q_AVG.replace("\n        ", "\n  "), Q_AVG_ANY) == [0, 2]


def test_renaming_and_reordering_do_not_make_a_new_query(spark):
    renamed = Q_MAX.replace("?level", "?much").replace("?reading ", "?x ").replace("core:", "c:").replace(":recent", ":now")
    lines = Q_MAX.split("\n")
    at = next(i for i, line in enumerate(lines) if "core:amount" in line)
    lines[at], lines[at + 1] = lines[at + 1], lines[at]
    assert accepted(spark, Q_MAX, renamed, "\n".join(lines)) == [0]


@pytest.mark.parametrize("old,new", [
    ("MAX(?level)", "MIN(?level)"), ("STEP 15000", "STEP 30000"), ("pressure.upper", "heat.lower"), ("RStream", "DStream"),
    ("plant.test:81", "plant.test:82"), ("MAX(?level)", "MAX(?reading)"),
])
def test_a_different_query_is_accepted(spark, old, new):
    assert accepted(spark, Q_MAX, Q_MAX.replace(old, new)) == [0, 1]


def test_swapped_windows_of_a_symmetric_query(spark):
    swapped = TWO_WINDOWS.replace("/one/", "/tmp/").replace("/two/", "/one/").replace("/tmp/", "/two/")
    assert accepted(spark, TWO_WINDOWS, swapped) == [0]


def test_summary(spark):
    got = {r["status"]: r["n"] for r in registry.registry_summary(table(spark, Q_AVG, Q_AVG, Q_AVG_ANY)).collect()}
    assert got == {"registered": 3, "executing": 2}
    empty = {r["status"]: r["n"] for r in registry.registry_summary(table(spark, Q_AVG).where("query_id < 0")).collect()}
    assert empty == {"registered": 0, "executing": 0}
