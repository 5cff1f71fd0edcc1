"""A continuous query spec to a DataFrame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.model import TRIPLE, ContinuousQuery, Pattern, WindowSpec
from tidemark.operators.observed import matching, value_variables
from tidemark.operators.patterns import bgp, scope
from tidemark.operators.windows import aggregate, assign_windows, join_bags, r2s, weighted, windowed

NUMERIC = ("max", "min", "avg", "sum")


def _solutions(query: ContinuousQuery, spec: WindowSpec, patterns: Sequence[Pattern], triples: DataFrame) -> DataFrame:
    """Solutions of the patterns in the graph of each window, numbers read as such."""
    rows = scope(triples, spec.stream) if spec.stream else triples
    named = [p.p for p in patterns if not p.p.startswith("?")]
    if len(named) == len(patterns):
        rows = rows.where(F.col("p").isin(*named))
    graph = assign_windows(rows.select("ts", *TRIPLE), spec).select("window", *TRIPLE).distinct()
    solutions = bgp(graph, patterns, ["window"])
    # Means and sums are of numbers; the least and greatest may also be an IRI or a text.
    numbers = {a.var for a in query.aggregates if a.func in ("avg", "sum") or a.func in NUMERIC and a.var in value_variables(query)}
    return solutions.withColumns({v: F.col(v).try_cast("double") for v in sorted(numbers & set(solutions.columns))})


def over_triples(query: ContinuousQuery, triples: DataFrame) -> DataFrame:
    """Answers a query over triples: each window's triples form one graph (a set), the
    pattern is matched over all of it, and its solutions are aggregated. Solutions of several
    windows that end together meet on the variables that they share."""
    if len(query.windows) > 1:
        return _over_windows(query, triples)
    spec = query.windows[0]
    solutions = _solutions(query, spec, query.patterns, triples)
    found = aggregate(solutions, query.aggregates, ["window", *query.group_by], query.having)
    return r2s(found, spec, query.r2s)


def _over_windows(query: ContinuousQuery, triples: DataFrame) -> DataFrame:
    first, names = query.windows[0], [w.name for w in query.windows]
    of = {w.name: [p for p in query.patterns if (p.window or first.name) == w.name] for w in query.windows}
    if len(set(names)) < len(names) or not all(of.values()) or sum(map(len, of.values())) < len(query.patterns):
        raise ValueError("each window needs a name of its own and a pattern, and each pattern one of the windows")
    if query.r2s != "RStream" and len({w.slide for w in query.windows}) > 1:
        raise ValueError(f"{query.r2s} compares neighbouring windows; windows with different steps have none in common")
    used = {n: {v for p in of[n] for v in p.variables} for n in names}
    shared = {v for v in set().union(*used.values()) if sum(v in u for u in used.values()) > 1}
    needed = shared | set(query.group_by) | {a.var for a in query.aggregates if a.var != "*"}
    met, bound, todo = None, set(), list(query.windows)
    while todo:
        spec = next((w for w in todo if met is None or bound & used[w.name]), None)
        if spec is None:
            raise ValueError("windows without a shared variable would pair every row with every row")
        todo.remove(spec)
        own = sorted(used[spec.name] & needed)
        bag = _solutions(query, spec, of[spec.name], triples).groupBy(F.col("window.end").alias("w_end"), *own).agg(F.count(F.lit(1)).alias("_n"))
        met = bag if met is None else join_bags(met, bag, ["w_end", *sorted(bound & set(own))])
        bound |= set(own)
    start = F.col("w_end") - F.expr(f"INTERVAL '{first.width / 1000:.3f}' SECOND")
    placed = met.withColumn("window", F.struct(start.alias("start"), F.col("w_end").alias("end"))).drop("w_end")
    found = weighted(placed, query.aggregates, ["window", *query.group_by], query.having)
    return r2s(found, first, query.r2s)


def over_observations(query: ContinuousQuery, observations: DataFrame, properties: Sequence[str] = ()):
    """The same over observations, for patterns that ask for the value of given properties.

    One row per member holds both value and property, so there is nothing to join: the
    properties filter, which reaches the scan, and the windows aggregate. Raises for several
    windows and for patterns that observations cannot answer.
    """
    rows, spec = matching(query, observations, properties), query.windows[0]
    found = windowed(rows, spec, query.aggregates, query.group_by, having=query.having)
    return r2s(found, spec, query.r2s)
