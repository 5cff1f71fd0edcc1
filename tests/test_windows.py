from datetime import datetime, timedelta
from math import ceil

import pytest
from pyspark.sql import functions as F

from tidemark import Agg, ContinuousQuery, Pattern, WindowSpec
from tidemark.model import HAS_VALUE, RELATES_TO_PROPERTY
from tidemark.operators import windows
from tidemark.operators.patterns import to_triples
from tidemark.plans.continuous import over_observations, over_triples
from tidemark.plans.inputs import AGGS, observations

HOUR = 3_600_000


def rows(df):
    return sorted(map(tuple, df.collect()))


def at(seconds):
    return datetime(2024, 1, 1) + timedelta(seconds=seconds)


@pytest.fixture(scope="module")
def obs(spark, sf_dir):
    return observations(spark, sf_dir).cache()


@pytest.mark.parametrize("spec", [WindowSpec(180_000, 30_000), WindowSpec(7 * HOUR, 3 * HOUR), WindowSpec(HOUR, HOUR),
                                  WindowSpec(180_000, 30_001), WindowSpec(2 * HOUR + 1, 2 * HOUR)])
def test_panes_agree_with_direct(obs, spec):
    aggs = [*AGGS, Agg("sum", "value", "total", exact=2), Agg("count", "value", "n"), Agg("sample", "value", "s")]
    direct = windows.windowed(obs, spec, aggs, ["property"], panes=False)
    assert rows(windows.flat(direct)) == rows(windows.flat(windows.windowed(obs, spec, aggs, ["property"], panes=True)))


@pytest.mark.parametrize("spec", [WindowSpec(180_000, 30_000), WindowSpec(7 * HOUR, 3 * HOUR), WindowSpec(30 * HOUR, HOUR), WindowSpec(100_000, 30_001)])
def test_runs_and_differences_agree_with_direct(spark, spec, monkeypatch):
    import random

    rng = random.Random(3)
    near = [0, 30, 59.98, 60, 90.000001, 5000]
    data = [(rng.choice("ab") if i % 7 else None, at(rng.choice(near) if i % 3 else rng.uniform(-90_000, 90_000)),
             rng.choice([None, 1.25, 2.5, 2.5, -3.0])) for i in range(400)] + [("a", None, 1.0)]
    df = spark.createDataFrame(data, "k string, ts timestamp_ntz, value double").repartition(4)
    plain = [Agg("max"), Agg("min"), Agg("count"), Agg("count", "*"), Agg("sum", exact=2), Agg("avg", exact=2), Agg("sample")]
    distinct = [Agg("count", "value", "dc", distinct=True), Agg("sum", "value", "ds", distinct=True, exact=2), Agg("avg", "value", "da", distinct=True, exact=2),
                Agg("count", "k", "dk", distinct=True), Agg("group_concat", "k", "ks"), Agg("sum", "value", "df", distinct=True)]
    monkeypatch.setattr(windows, "RUNS_FROM", 1)
    for aggs in (plain, [*plain, *distinct]):
        for by in ([], ["k"]):
            direct = windows.windowed(df, spec, aggs, by, panes=False)
            assert rows_of(direct) == rows_of(windows.windowed(df, spec, aggs, by))


def rows_of(df):
    return sorted(map(repr, windows.flat(df).collect()))


def test_runs_do_not_grow_with_the_overlap(spark):
    df = spark.createDataFrame([(at(i * 0.7), float(i % 5)) for i in range(200)], "ts timestamp_ntz, value double")
    out = windows.windowed_runs(df, WindowSpec(HOUR, 20), [Agg("count"), Agg("max")]).collect()
    assert len(out) <= 2 * 200 + 2
    assert sum(r["n_windows"] for r in out) == (HOUR + 139_300) // 20
    assert sum(r["n_windows"] * r["count_value"] for r in out) == 200 * HOUR // 20


def test_two_windows_meet_as_bags(spark):
    """Pairs of solutions that agree are counted one by one, as in nested loops."""
    obs = spark.createDataFrame(
        [("l", "m1", 1, at(1), "a", 5.0), ("l", "m2", 2, at(2), "a", 5.0), ("l", "m3", 3, at(3), "b", 7.0), ("l", "m3", 3, at(3), "b", 7.0),
         ("r", "n1", 4, at(4), "a", 5.0), ("r", "n2", 5, at(5), "a", 5.0), ("r", "n3", 6, at(6), "a", 6.0), ("r", "n4", 7, at(70), "b", 7.0), ("r", "n5", 8, at(9), "b", 7.0)],
        "stream string, member_id string, seq long, ts timestamp_ntz, property string, value double")
    specs = (WindowSpec(60_000, 60_000, "w1", "l"), WindowSpec(120_000, 60_000, "w2", "r"))
    patterns = tuple(Pattern(m, p, o, w) for m, w in (("?x", "w1"), ("?y", "w2")) for p, o in ((RELATES_TO_PROPERTY, "?s"), (HAS_VALUE, "?o")))
    aggs = (Agg("count", "*", "n"), Agg("avg", "o", "mean"), Agg("sum", "o", "total"), Agg("max", "o", "top"), Agg("count", "y", "ys", distinct=True))
    out = rows(windows.flat(over_triples(ContinuousQuery(aggs, specs, patterns), to_triples(obs))))
    assert out == [(at(0), at(60), 5, 27 / 5, 27.0, 7.0, 3)]
    by_sensor = over_triples(ContinuousQuery(aggs[:2], specs, patterns, group_by=("s",), having="n > 1"), to_triples(obs)).collect()
    assert [(r["s"], r["n"], r["mean"]) for r in by_sensor] == [("a", 4, 5.0)]
    for bad in (patterns[:2], (*patterns, Pattern("?z", "p", "?q", "w9")), (patterns[0], Pattern("?q", "p", "?z", "w2"))):
        with pytest.raises(ValueError):
            over_triples(ContinuousQuery(aggs[:1], specs, bad), to_triples(obs))
    with pytest.raises(ValueError):
        Agg("sum", "*")


@pytest.mark.parametrize("width,slide", [(7 * HOUR, 3 * HOUR), (HOUR, HOUR), (HOUR, 4 * HOUR)])
def test_number_of_windows_per_member(obs, width, slide):
    spec = WindowSpec(width, slide)
    most = windows.assign_windows(obs, spec).groupBy("member_id").count().agg(F.max("count")).first()[0]
    assert most <= ceil(width / slide)


def test_windows_are_aligned_and_half_open(spark):
    df = spark.createDataFrame([(at(0),), (at(59.999),), (at(60),)], "ts timestamp_ntz")
    out = windows.flat(windows.windowed(df.withColumn("value", F.lit(1.0)), WindowSpec(60_000, 60_000), [Agg("count")]))
    assert rows(out) == [(at(0), at(60), 2), (at(60), at(120), 1)]


def test_gap_between_windows_belongs_to_none(spark):
    df = spark.createDataFrame([(at(s), 1.0) for s in (0, 9.999, 10, 59, 60)], "ts timestamp_ntz, value double")
    out = windows.flat(windows.windowed(df, WindowSpec(10_000, 60_000), [Agg("count")]))
    assert rows(out) == [(at(0), at(10), 2), (at(60), at(70), 1)]


def test_width_below_a_second(spark):
    df = spark.createDataFrame([(at(0.05), 1.0), (at(0.75), 3.0)], "ts timestamp_ntz, value double")
    out = windows.windowed(df, WindowSpec(800, 100), [Agg("avg", "value", "a")])
    assert out.count() == 15
    assert out.where("window.start = timestamp_ntz'2024-01-01 00:00:00'").first()["a"] == 2.0


def test_plan_does_not_grow_with_the_overlap(spark):
    df = spark.createDataFrame([(at(0), 2.0), (at(7200), 3.0), (None, 9.0)], "ts timestamp_ntz, value double")
    few, many = [[WindowSpec(n * 20, 20) for n in (2, windows.RUNS_FROM)], [WindowSpec(n * 20, 20) for n in (windows.RUNS_FROM + 1, HOUR // 20)]]
    for specs in (few, many):  # panes spread over windows, and runs of windows
        out = [windows.windowed(df, spec, [Agg("max")]) for spec in specs]
        assert len({len(o._jdf.queryExecution().optimizedPlan().toString().splitlines()) for o in out}) == 1
    assert out[1].count() == 2 * HOUR // 20
    ends = out[1].where("max_value = 2").agg(F.min("window.start"), F.max("window.start"), F.count_distinct("window")).first()
    assert tuple(ends) == (at(-3599.98), at(0), HOUR // 20)


def test_windows_agree_with_those_of_spark(obs):
    for width, slide in [(180_000, 30_001), (5000, 5000), (7 * HOUR, 3 * HOUR)]:
        ours = windows.assign_windows(obs.select("seq", "ts"), WindowSpec(width, slide)).select("seq", "window")
        theirs = obs.select("seq", F.window("ts", f"{width} milliseconds", f"{slide} milliseconds").alias("window"))
        assert ours.exceptAll(theirs).isEmpty() and theirs.exceptAll(ours).isEmpty()


def test_relation_to_stream_balance(obs):
    """A window's result is the one before, less what went, plus what came."""
    spec = WindowSpec(6 * HOUR, HOUR)
    result = windows.windowed(obs, spec, [Agg("max")], ["property"])
    step = F.expr("INTERVAL '3600' SECOND")
    ends = windows.flat(result).withColumn("w_start", F.col("w_start") + step).withColumn("w_end", F.col("w_end") + step)
    came, went = (windows.flat(windows.r2s(result, spec, m)) for m in ("IStream", "DStream"))
    assert rows(ends.subtract(went).union(came)) == rows(windows.flat(result))


def test_relation_to_stream_with_empty_values(spark):
    schema = "window struct<start:timestamp_ntz,end:timestamp_ntz>, k string, v double"
    data = [((at(0), at(60)), None, None), ((at(60), at(120)), None, None), ((at(180), at(240)), "a", 1.0)]
    df, spec = spark.createDataFrame(data, schema), WindowSpec(60_000, 60_000)
    came, went = windows.istream(df, spec), windows.dstream(df, spec)
    assert sorted(r["window"]["start"] for r in came.collect()) == [at(0), at(180)]
    assert sorted(r["window"]["start"] for r in went.collect()) == [at(120), at(240)]


def test_cross_window_counts_repeats_once(spark):
    many = spark.createDataFrame([(at(i % 50), "s", 1) for i in range(2000)], "ts timestamp_ntz, s string, o int")
    spec = WindowSpec(60_000, 60_000)
    assert rows(windows.join_windows(many, many, spec, spec, ["s", "o"])) == [(at(60), "s", 1)]


def test_idle_periods_over_cells(spark):
    """Stretches that cross cells are joined, and a gap of exactly the given length parts them."""
    seconds = [0, 4, 8, 13, 3598, 3601, 7200]
    df = spark.createDataFrame([("a", at(s)) for s in seconds], "k string, ts timestamp_ntz")
    out = windows.idle_periods(df, 5000, ["k"]).orderBy("active_from").collect()
    assert [(r["active_from"], r["idle_from"], r["n"]) for r in out] == [
        (at(0), at(13), 3), (at(13), at(18), 1), (at(3598), at(3606), 2), (at(7200), at(7205), 1),
    ]


@pytest.mark.parametrize("mode", ["RStream", "IStream", "DStream"])
def test_triples_and_observations_answer_alike(obs, mode):
    metric = "http://sensor.example/click"
    query = ContinuousQuery(
        (Agg("max", "o", "top"), Agg("avg", "o", "mean", exact=2)), (WindowSpec(6 * HOUR, HOUR),),
        (Pattern("?s", HAS_VALUE, "?o"), Pattern("?s", RELATES_TO_PROPERTY, metric)), r2s=mode,
    )
    assert rows(windows.flat(over_triples(query, to_triples(obs)))) == rows(windows.flat(over_observations(query, obs)))


def test_specs_reject_nonsense():
    with pytest.raises(ValueError):
        WindowSpec(0, 10)
    with pytest.raises(ValueError):
        Agg("median")
    with pytest.raises(ValueError):
        ContinuousQuery((), (WindowSpec(1, 1),))
    with pytest.raises(ValueError):
        ContinuousQuery((Agg("max"),), (WindowSpec(1, 1),), r2s="XStream")
