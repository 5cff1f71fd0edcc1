"""Connected components of links that are too many for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import released, stored


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of a node, and the node, are tied to the least of its neighbourhood."""
    ways = _both_ways(edges)
    least = ways.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return (ways.where(F.col("b") > F.col("a")).join(least, "a")
            .select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of a node, and the node, are tied to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    tied = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.unionAll(least.select("a", F.col("m").alias("b"))).where(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root for each node of `links` (a, b): root is the least node that it reaches.

    Alternating large and small stars end in one star per component after a number of rounds
    that grows with the logarithm of its size. A hub's neighbours are folded by map-side minimum
    and spread over tasks, never gathered. Self links and repeats are ignored; each round is
    written, so a lost executor costs one round.
    """
    edges, before = stored(links.select("a", "b").where(F.col("a") != F.col("b")).distinct(), "links"), None
    while True:
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            break
        before, last = mark, edges
        edges = stored(_small_star(_large_star(last)), "stars")
        released(last)
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(roots)


def labelled(df: DataFrame, node: str, roots: DataFrame | None, label: str) -> DataFrame:
    """`df` with the component of `node`; a node without links is its own."""
    if roots is None:
        return df.withColumn(label, F.col(node))
    return (df.join(roots.toDF("_node", "_root"), F.col(node) == F.col("_node"), "left")
            .withColumn(label, F.coalesce("_root", node)).drop("_node", "_root"))


def merged(roots: DataFrame | None, links: DataFrame, purpose: str = "roots") -> DataFrame:
    """node, root once `links` (a, b) are added to components known so far; written.

    Components are contracted first: only links between different ones take part, as links of
    their roots, so what is joined already is not gone through again.
    """
    across = labelled(labelled(links, "a", roots, "c_a"), "b", roots, "c_b").where("c_a != c_b")
    up = stored(components(across.select(F.col("c_a").alias("a"), F.col("c_b").alias("b"))), "contracted")
    if roots is None:
        return up
    moved = labelled(roots.select("node", F.col("root").alias("was")), "was", up, "root").select("node", "root")
    new = up.join(roots.select("node"), "node", "left_anti")
    return stored(moved.unionAll(new.select("node", "root")), purpose)
