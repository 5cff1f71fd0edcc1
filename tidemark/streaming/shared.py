"""Many continuous queries over one input."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import joined_text
from tidemark.model import Agg, ContinuousQuery, WindowSpec
from tidemark.operators.observed import asked, matching, value_variables
from tidemark.operators.windows import union_streams, windowed

Evaluate = Callable[[DataFrame, WindowSpec, list[Agg], tuple[str, ...]], DataFrame]


def run_shared(observations: DataFrame, queries: dict[str, ContinuousQuery], evaluate: Evaluate = windowed):
    """Queries with the same input, window and grouping share one aggregation; rows carry the
    hash of the query they answer: `query_hash, window, group, var, value`.

    The input is what stream and patterns of a query pick; HAVING is applied to each query's own
    aggregates. IStream and DStream compare windows of one query, so they are refused here and run
    by themselves, as are several windows and patterns that observations cannot answer.
    `group` holds the grouping values as one text, with nulls and separators told apart.
    `evaluate` is `windowed` for a table and `live_window` for a stream.
    """
    alike: dict = defaultdict(list)
    for query_hash, query in queries.items():
        if query.r2s != "RStream":
            raise ValueError(f"{query_hash} is an {query.r2s}; run it by itself")
        window, input_ = query.windows[0], (*asked(query), tuple(sorted(value_variables(query))))
        alike[(input_, window.width, window.slide, query.group_by)].append((query_hash, query))
    parts = []
    for (_, width, slide, by), members in alike.items():
        # Equal aggregates of two queries are computed once.
        wanted = {(a.func, a.var, a.distinct, a.exact, a.separator): a for _, q in members for a in q.aggregates}
        names = {key: f"_a{i}" for i, key in enumerate(wanted)}
        aggs = [a.alias(names[key]) for key, a in wanted.items()]
        rows = evaluate(matching(members[0][1], observations), WindowSpec(width, slide), aggs, by)
        tagged = []
        for i, (query_hash, q) in enumerate(members):
            own = {a.out: F.col(names[(a.func, a.var, a.distinct, a.exact, a.separator)]) for a in q.aggregates}
            passes = F.lit(True)
            if q.having:
                # The condition speaks of the query's own names, which exist for this step only.
                kept = rows.columns
                rows = rows.withColumns(own).withColumn(f"_having{i}", F.coalesce(F.expr(q.having), F.lit(False)))
                rows = rows.select(*kept, f"_having{i}")
                passes = F.col(f"_having{i}")
            tagged += [
                F.struct(F.lit(query_hash).alias("query_hash"), F.lit(out).alias("var"), F.when(passes, value.cast("double")).alias("value"))
                for out, value in own.items()
            ]
        parts.append(rows.select("window", joined_text(*by).alias("group"), F.inline(F.array(*tagged))))
    return union_streams(*parts).where(F.col("value").isNotNull())
