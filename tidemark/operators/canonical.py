"""One name for all queries that differ by the names of their variables and windows only.

A query is a graph: clauses are its edges, and their variables and window names the nodes that
may be renamed. Nodes are coloured by what stands where around them, round after round, until
colours tell no more nodes apart. Nodes that are left with one colour are tried one after the
other: the one which gives the least picture is set apart, and colouring goes on until each node
has a colour of its own. The key is that of the whole query with colours for names, so two
queries with one key are the same query; nothing else merges. Colours are numbers; they order
and name nodes, and decide nothing by themselves. All of it happens within the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_HERE = -1


def _bound(value: Column, use) -> Column:
    """`use(value)` with the value computed once: within a lambda it would be computed each time."""
    return F.transform(F.array(value), use)[0]


def _colour(colours: Column, node: Column) -> Column:
    return F.element_at(colours, node)


def _picture(clauses: Column, colours: Column) -> Column:
    """A number for the query under given colours."""
    return F.xxhash64(F.sort_array(F.transform(clauses, lambda c: F.xxhash64(F.transform(
        c, lambda x: F.when(x["v"] == 0, x["h"]).otherwise(_colour(colours, x["v"])))))))


def _n(colours: Column) -> Column:
    return F.size(F.array_distinct(colours))


def _refined(around: Column, nodes: Column, colours: Column) -> Column:
    """Colours once another round tells no more nodes apart. `around` has each node's clauses."""

    def seen(old: Column, n: Column) -> Column:
        return F.xxhash64(_colour(old, n), F.sort_array(F.transform(F.element_at(around, n), lambda c: F.xxhash64(F.transform(
            c, lambda x: F.when(x["v"] == 0, x["h"]).when(x["v"] == n, F.lit(_HERE)).otherwise(_colour(old, x["v"])))))))

    def round_(z: Column, _: Column) -> Column:
        new = F.transform(nodes, lambda n: seen(z["colours"], n))
        return F.when(z["done"], z).otherwise(_bound(new, lambda c: F.struct(
            c.alias("colours"), (_n(c) == _n(z["colours"])).alias("done"))))

    return F.aggregate(nodes, F.struct(colours.alias("colours"), F.lit(False).alias("done")), round_, lambda z: z["colours"])


def _set_apart(clauses: Column, around: Column, nodes: Column, colours: Column) -> Column:
    """Colours with one node of the least colour that several share made different."""
    several = F.array_min(F.filter(colours, lambda c: F.size(F.filter(colours, lambda d: d == c)) > 1))

    def tried(n: Column) -> Column:
        marked = F.transform(colours, lambda c, i: F.when(i + 1 == n, F.xxhash64(c)).otherwise(c))
        return _bound(_refined(around, nodes, marked), lambda r: F.struct(_picture(clauses, r).alias("picture"), r.alias("colours")))

    of_colour = _bound(several, lambda shared: F.filter(nodes, lambda n: _colour(colours, n) == shared))
    return F.array_min(F.transform(of_colour, tried))["colours"]


def canonical_key(df: DataFrame, clauses: str, key: str) -> DataFrame:
    """Adds `key`, a digest, for a column of clauses (lists of tokens; `?x` and `!x` are names)."""
    is_name = lambda t: t.startswith("?") | t.startswith("!")
    named = df.withColumn("_names", F.array_distinct(F.filter(F.flatten(clauses), is_name)))
    graph = named.withColumns({
        "_graph": F.transform(clauses, lambda c: F.transform(c, lambda t: F.struct(
            t.alias("t"), F.xxhash64(t).alias("h"), F.array_position("_names", t).cast("int").alias("v")))),
        "_nodes": F.transform("_names", lambda _, i: i + 1),
        "_kinds": F.transform("_names", lambda t: F.xxhash64(F.substring(t, 1, 1))),
    }).withColumn("_around", F.transform("_nodes", lambda n: F.filter("_graph", lambda c: F.exists(c, lambda x: x["v"] == n))))
    edges, around, nodes = F.col("_graph"), F.col("_around"), F.col("_nodes")
    coloured = graph.withColumn("_colours", _refined(around, nodes, F.col("_kinds")))
    apart = F.aggregate(nodes, F.col("_colours"), lambda old, _: F.when(
        _n(old) == F.size(old), old).otherwise(_set_apart(edges, around, nodes, old)))
    whole = _bound(apart, lambda colours: F.md5(F.to_json(F.sort_array(F.transform(edges, lambda c: F.transform(
        c, lambda x: F.when(x["v"] == 0, F.concat(F.lit("="), x["t"])).otherwise(F.concat(F.lit("~"), _colour(colours, x["v"]).cast("string")))))))))
    return coloured.withColumn(key, whole).drop("_names", "_graph", "_nodes", "_kinds", "_around", "_colours")
