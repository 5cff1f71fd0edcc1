"""Time windows, aggregates over them, and relation-to-stream operators."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import epoch_us, time_cell
from tidemark.model import Agg, WindowSpec


# Above so many windows that overlap, windows are computed by runs; below, panes are spread over them.
RUNS_FROM = 16


def _ms(n: int) -> str:
    return f"{n} milliseconds"


def _span(n: int) -> Column:
    return F.expr(f"INTERVAL '{n / 1000:.3f}' SECOND")


def assign_windows(df: DataFrame, spec: WindowSpec, ts: str = "ts", laid_out: bool = True) -> DataFrame:
    """One row per (row, window it falls in), with a `window` struct of start and end.

    Windows are `[k*slide, k*slide + width)`, counted from the epoch. Where the slide
    exceeds the width, the instants between two windows belong to none. Rows without a time
    are in no window.

    The plan is of one size whatever the overlap: windows are counted back from the last one
    that holds the row. Only a stream keeps Spark's own sliding windows, which carry its
    watermark but are laid out one by one in the plan, unless `laid_out` is false.
    """
    if df.isStreaming and laid_out and spec.slide <= spec.width:
        return df.withColumn("window", F.window(ts, _ms(spec.width), _ms(spec.slide)))
    start, hop = F.col("_hop.start"), df.withColumn("_hop", F.window(ts, _ms(spec.slide)))
    if spec.overlap > 1:
        hop = hop.withColumn("_back", F.explode(F.sequence(F.lit(0), F.lit(spec.overlap - 1))))
        start = start - _span(spec.slide) * F.col("_back")
    hop = hop.withColumn("window", F.struct(start.alias("start"), (start + _span(spec.width)).alias("end")))
    return hop.where(F.col(ts) < F.col("window.end")).drop("_hop", "_back")


def _measure(agg: Agg) -> Column:
    col = F.col(agg.var)
    if agg.exact is None:
        return col
    return F.round(col * F.lit(float(10**agg.exact))).cast("bigint")


def _scaled(col: Column, agg: Agg, count: Column | None = None) -> Column:
    divisor = 10**agg.exact if agg.exact is not None else 1
    if count is not None:
        return F.when(count > 0, col.cast("double") / (count * F.lit(divisor)))
    return col if divisor == 1 else col.cast("double") / F.lit(divisor)


def _counted(agg: Agg) -> Column:
    return F.lit(1) if agg.var == "*" else F.col(agg.var)


def _parts(agg: Agg) -> dict[str, tuple[Column, str]]:
    """Partial columns of an aggregate: name -> (over rows, how parts combine)."""
    if agg.func == "count":
        return {f"_{agg.out}": (F.count(_counted(agg)), "sum")}
    out, col = agg.out, F.col(agg.var)
    if agg.func in ("max", "min"):
        return {f"_{out}": (getattr(F, agg.func)(col), agg.func)}
    if agg.func == "sample":
        return {f"_{out}": (F.min(col), "min")}
    if agg.func == "sum":
        return {f"_{out}": (F.sum(_measure(agg)), "sum")}
    return {f"_{out}": (F.sum(_measure(agg)), "sum"), f"_{out}_n": (F.count(col), "sum")}


def _final(agg: Agg, parts: dict[str, Column]) -> Column:
    value = parts[f"_{agg.out}"]
    if agg.func == "sum":
        value = _scaled(value, agg)
    elif agg.func == "avg":
        value = _scaled(value, agg, parts[f"_{agg.out}_n"])
    return value.alias(agg.out)


def _direct(agg: Agg) -> Column:
    col = _counted(agg)
    if agg.func == "group_concat":
        values = F.collect_set(col) if agg.distinct else F.collect_list(col)
        return F.array_join(F.sort_array(values.cast("array<string>")), agg.separator).alias(agg.out)
    if agg.distinct and agg.func == "count":
        return F.count_distinct(col).alias(agg.out)
    if agg.distinct and agg.func == "sum":
        return _scaled(F.sum_distinct(_measure(agg)), agg).alias(agg.out)
    if agg.distinct and agg.func == "avg":
        return _scaled(F.sum_distinct(_measure(agg)), agg, F.count_distinct(col)).alias(agg.out)
    return _final(agg, {name: col for name, (col, _) in _parts(agg).items()})


def algebraic(agg: Agg) -> bool:
    """Whether the aggregate of a window follows from those of its panes."""
    return agg.func != "group_concat" and (not agg.distinct or agg.func in ("max", "min", "sample"))


def aggregate(df: DataFrame, aggs: Sequence[Agg], by: Sequence[str] = (), having: str | None = None):
    """Aggregates per group; `having` filters on their aliases."""
    out = df.groupBy(*by).agg(*[_direct(a) for a in aggs])
    return out.where(having) if having else out


def windowed(
    df: DataFrame,
    spec: WindowSpec,
    aggs: Sequence[Agg],
    by: Sequence[str] = (),
    ts: str = "ts",
    having: str | None = None,
    panes: bool | None = None,
) -> DataFrame:
    """Aggregates per window and group: `window`, the group columns, one column per aggregate.

    With `panes`, rows are first aggregated per pane (the stretches between one window
    boundary and the next, two per slide at most) and only the panes are spread over the
    windows that cover them. Each row is then handled once instead of width/slide times, for
    one more shuffle, of aggregated rows only. They are the default wherever windows overlap
    and the aggregates allow it.
    """
    overlapping = spec.slide <= spec.width and spec.overlap > 1 and panes is not False
    usable = overlapping and all(algebraic(a) for a in aggs)
    if overlapping and not df.isStreaming and any(_by_differences(a) for a in aggs):
        out = _side_by_side(df, spec, aggs, by, ts)
    elif usable and panes is not False:
        far = spec.overlap > RUNS_FROM and not df.isStreaming
        out = _expanded(windowed_runs(df, spec, aggs, by, ts), spec) if far else _over_panes(df, spec, aggs, by, ts)
    else:
        rows = assign_windows(df, spec, ts)
        out = rows.groupBy("window", *by).agg(*[_direct(a) for a in aggs])
    return out.where(having) if having else out


def _by_differences(agg: Agg) -> bool:
    """DISTINCT aggregates that whole numbers can be added to and taken from."""
    return agg.distinct and (agg.func == "count" or agg.func in ("sum", "avg") and agg.exact is not None)


def distinct_runs(df: DataFrame, spec: WindowSpec, value: Column, by: Sequence[str] = (), ts: str = "ts",
                  total: bool = False) -> DataFrame:
    """Number (`_n`) and, with `total`, sum (`_s`) of the distinct values in each window, as runs of
    equal neighbours (`window`, the first, and `n_windows`). Windows without a value are left out.

    A value is in the windows around each of its panes; where they overlap those of the pane
    before, only the windows that are new count. Each stretch of windows adds one where it
    begins and takes one where it has ended, and running sums over these differences are the
    results. Windows are numbered, and cut into blocks as many as overlap: pieces of work are
    (group, value, block) and (group, block), neither longer than two blocks.
    """
    width, slide, most = spec.width * 1000, spec.slide * 1000, spec.overlap

    def whole(a: Column, n: int) -> Column:
        return F.call_function("div", a - F.pmod(a, F.lit(n)), F.lit(n).cast("bigint"))

    us = epoch_us(ts)
    panes = df.where(value.isNotNull() & F.col(ts).isNotNull()).select(
        *by, value.alias("_v"), (whole(us - width, slide) + 1).alias("_low"), whole(us, slide).alias("_high")).distinct()
    cut = panes.select("*", F.explode(F.sequence(whole(F.col("_low"), most), whole(F.col("_high"), most))).alias("_block"))
    last = (F.col("_block") + 1) * most - 1
    cut = cut.withColumns({"_low": F.greatest("_low", F.col("_block") * most), "_high": F.least("_high", last)})
    order = Window.partitionBy(*by, "_v", "_block").orderBy("_low", "_high")
    reached = F.max("_high").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = cut.withColumn("_low", F.greatest("_low", reached + 1)).where(F.col("_low") <= F.col("_high"))
    ends = F.array(F.struct(F.col("_low").alias("_k"), F.lit(1).alias("_d")), F.struct((F.col("_high") + 1).alias("_k"), F.lit(-1).alias("_d")))
    step = fresh.select(*by, "_block", "_v", F.inline(ends)).where(F.col("_k") <= last)
    sums = {"_n": F.sum("_d")} | ({"_s": F.sum(F.col("_d") * F.col("_v"))} if total else {})
    changes = step.groupBy(*by, "_block", "_k").agg(*[c.alias(n) for n, c in sums.items()])
    along = Window.partitionBy(*by, "_block").orderBy("_k")
    upto = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = changes.select(*by, "_k", *[F.sum(n).over(upto).alias(n) for n in sums],
                          (F.coalesce(F.lead("_k").over(along), last + 1) - F.col("_k")).alias("n_windows")).where(F.col("_n") > 0)
    start = F.timestamp_micros(F.col("_k") * slide)
    if df.schema[ts].dataType.simpleString() == "timestamp_ntz":
        start = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'") + F.make_dt_interval(
            F.lit(0), F.lit(0), F.lit(0), (F.col("_k") * slide / F.lit(1_000_000)).cast("decimal(18,6)"))
    return runs.select(F.struct(start.alias("start"), (start + _span(spec.width)).alias("end")).alias("window"), "n_windows", *by, *sums)


def _side_by_side(df, spec, aggs, by, ts) -> DataFrame:
    """Aggregates of different kinds, each computed its own way, met on window and group."""
    key = ["window", *by]
    out = windowed(df, spec, [*[a for a in aggs if algebraic(a)], Agg("count", "*", "_rows")], by, ts)

    def beside(out, part, names):
        part = part.select(*[F.col(c).alias(f"_of_{c}") for c in key], *[F.col(c).alias(n) for c, n in names.items()])
        met = out.join(part, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in key], "left")
        return met.drop(*[f"_of_{c}" for c in key])

    numbers, kinds = {}, {}
    for a in (a for a in aggs if _by_differences(a)):
        kinds[a.out] = needs = {}
        if a.func != "sum":
            needs["_n"] = (a.var, None)
        if a.func != "count":
            needs["_s"] = (a.var, a.exact)
        for what, (var, exact) in needs.items():
            if (var, exact) not in numbers:
                value = _measure(a) if exact is not None else F.col(var)
                names = {"_n": f"_n{len(numbers)}"} | ({"_s": f"_s{len(numbers)}"} if exact is not None else {})
                runs = distinct_runs(df, spec, value, by, ts, exact is not None)
                out, numbers[var, exact] = beside(out, _expanded(runs, spec), names), names
    rest = [a for a in aggs if not algebraic(a) and not _by_differences(a)]
    if rest:
        out = beside(out, windowed(df, spec, rest, by, ts, panes=False), {a.out: a.out for a in rest})

    def found(a: Agg) -> Column:
        if not _by_differences(a):
            return F.col(a.out)
        at = {what: F.col(numbers[need][what]) for what, need in kinds[a.out].items()}
        if a.func == "count":
            return F.coalesce(at["_n"], F.lit(0)).alias(a.out)
        return _scaled(at["_s"], a, at.get("_n")).alias(a.out)

    return out.select(*key, *[found(a) for a in aggs])


def _in_panes(df, spec, aggs, by, ts, extra: Sequence[Column] = ()) -> tuple[DataFrame, dict]:
    parts = {name: part for a in aggs for name, part in _parts(a).items()}
    # Windows start at multiples of the slide and end `cut` after one.
    at, cut = F.col("_hop.start"), spec.width % spec.slide
    if cut:
        at = F.when(F.col(ts) < at + _span(cut), at).otherwise(at + _span(cut))
    hop = df.withColumn("_hop", F.window(ts, _ms(spec.slide)))
    pane = hop.groupBy(at.alias("_at"), *by).agg(*[col.alias(name) for name, (col, _) in parts.items()], *extra)
    return pane, parts


def _over_panes(df, spec, aggs, by, ts) -> DataFrame:
    pane, parts = _in_panes(df, spec, aggs, by, ts)
    # A pane lies wholly inside or outside a window, so its start stands for all its rows.
    spread = assign_windows(pane, spec, "_at")
    combined = spread.groupBy("window", *by).agg(
        *[getattr(F, how)(name).alias(name) for name, (_, how) in parts.items()]
    )
    return combined.select(
        "window", *by, *[_final(a, {n: F.col(n) for n in _parts(a)}) for a in aggs]
    )


def windowed_runs(
    df: DataFrame, spec: WindowSpec, aggs: Sequence[Agg], by: Sequence[str] = (), ts: str = "ts"
) -> DataFrame:
    """As `windowed`, with neighbouring windows that hold the same rows as one row: `window` is
    the first of them and `n_windows` their number. Work and rows grow with the panes that
    hold rows, whatever the overlap.

    Time is cut into blocks as long as a window. A window that starts in a block holds the end of
    that block and the beginning of the next: extremes and sums from each pane to the end of its
    block, and from the beginning of a block to each pane, are two running aggregates. Between
    one pane's place in either block and the next nothing changes. A (group, block) is one
    piece of work; it has no more rows than panes fit into two windows.
    """
    if not all(algebraic(a) for a in aggs) or spec.slide > spec.width:
        raise ValueError("runs need overlapping windows and aggregates that panes can carry")
    pane, parts = _in_panes(df, spec, aggs, by, ts, [F.lit(1).alias("_held")])
    parts = parts | {"_held": (None, "max")}
    width, slide = spec.width * 1000, spec.slide * 1000
    us, kinds = F.col("_us"), {f.name: f.dataType for f in pane.schema}
    placed = pane.withColumn("_us", epoch_us("_at")).withColumn("_place", F.pmod("_us", F.lit(width)))
    block = F.call_function("div", us - F.col("_place"), F.lit(width))

    def role(ends: bool):
        """Part of windows that start in its own block, or in the one before."""
        own = {n: F.col(n) for n in parts}
        none = {n: F.lit(None).cast(kinds[n]) for n in parts}
        return F.struct((block if ends else block - 1).alias("_block"),
                        *[(own if ends else none)[n].alias(f"_e{n}") for n in parts],
                        *[(none if ends else own)[n].alias(f"_b{n}") for n in parts])

    rows = placed.select(*by, "_at", "_us", "_place", F.inline(F.array(role(True), role(False))))
    piece = [*by, "_block"]
    up = Window.partitionBy(*piece).orderBy("_place")
    upto = up.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    since = Window.partitionBy(*piece).orderBy(F.desc("_place")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    run = rows.select(*piece, "_at", "_us", "_place",
                      *[getattr(F, how)(f"_e{n}").over(since).alias(f"_e{n}") for n, (_, how) in parts.items()],
                      *[getattr(F, how)(f"_b{n}").over(upto).alias(f"_b{n}") for n, (_, how) in parts.items()])
    run = run.select("*", F.lag("_place").over(up).isNull().alias("_first"), F.lead("_place").over(up).alias("_next"),
                     *[F.lead(f"_e{n}").over(up).alias(f"_s{n}") for n in parts])

    def joined(how: str, a: Column, b: Column) -> Column:
        if how in ("max", "min"):
            return (F.greatest if how == "max" else F.least)(a, b)
        return F.coalesce(a + b, a, b)

    def stretch(after: Column, upto_: Column, end: str, begin: bool):
        """Windows whose start lies after one place of the block and not after another."""
        low = F.floor((F.col("_block") * width + after) / slide) + 1
        high = F.floor((F.col("_block") * width + upto_) / slide)
        return F.struct(low.cast("bigint").alias("_low"), (high - low + 1).cast("bigint").alias("n_windows"), *[
            (joined(how, F.col(f"{end}{n}"), F.col(f"_b{n}")) if begin else F.col(f"{end}{n}")).alias(n) for n, (_, how) in parts.items()])

    last = F.col("_next").isNull() | (F.col("_next") > F.col("_place"))  # of panes at one place
    after = F.when(last, stretch(F.col("_place"), F.coalesce("_next", F.lit(width - 1)), "_s", True))
    before = F.when(F.col("_first"), stretch(F.lit(-1), F.col("_place"), "_e", False))
    found = run.select(*by, "_at", "_us", F.explode(F.array(before, after)).alias("_run")).where(
        F.col("_run").isNotNull() & (F.col("_run.n_windows") > 0) & F.col("_run._held").isNotNull())
    away = ((F.col("_run._low") * slide - us) / F.lit(1_000_000)).cast("decimal(18,6)")
    start = F.col("_at") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), away)
    return found.select(
        F.struct(start.alias("start"), (start + _span(spec.width)).alias("end")).alias("window"),
        F.col("_run.n_windows").alias("n_windows"), *by,
        *[_final(a, {n: F.col(f"_run.{n}") for n in _parts(a)}) for a in aggs],
    )


def _expanded(runs: DataFrame, spec: WindowSpec) -> DataFrame:
    """One row per window."""
    each = runs.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_windows") - 1)))
    start = F.col("window.start") + _span(spec.slide) * F.col("_k")
    return each.withColumn("window", F.struct(start.alias("start"), (start + _span(spec.width)).alias("end"))).drop("_k", "n_windows")


def flat(windowed_df: DataFrame) -> DataFrame:
    """`window` struct to two columns `w_start` and `w_end`."""
    rest = [c for c in windowed_df.columns if c != "window"]
    return windowed_df.select(
        F.col("window.start").alias("w_start"), F.col("window.end").alias("w_end"), *rest
    )


def rstream(results: DataFrame) -> DataFrame:
    """Every window's full result."""
    return results


def _against_previous(results: DataFrame, spec: WindowSpec, new: bool) -> DataFrame:
    # A solution stands for its own window and, one slide later, for "held before". One
    # grouping over both tells insertions from deletions; there is no join.
    rest = [F.col(c) for c in results.columns if c != "window"]
    step = F.expr(f"INTERVAL '{spec.slide / 1000:.3f}' SECOND")

    def held(shift: bool):
        start, end = F.col("window.start"), F.col("window.end")
        if shift:
            start, end = start + step, end + step
        return F.struct(F.struct(start.alias("start"), end.alias("end")).alias("window"),
                        F.lit(not shift).alias("_now"))

    both = results.select(F.explode(F.array(held(False), held(True))).alias("_held"), *rest)
    state = both.groupBy(F.col("_held.window").alias("window"), *rest).agg(
        F.bool_or("_held._now").alias("_in"), F.bool_and("_held._now").alias("_only_in")
    )
    keep = F.col("_only_in") if new else ~F.col("_in")
    return state.where(keep).select("window", *rest)


def istream(results: DataFrame, spec: WindowSpec) -> DataFrame:
    """Solutions of a window that the window one slide before did not have."""
    return _against_previous(results, spec, new=True)


def dstream(results: DataFrame, spec: WindowSpec) -> DataFrame:
    """Solutions of the window one slide before that are gone; stamped with the later window."""
    return _against_previous(results, spec, new=False)


def r2s(results: DataFrame, spec: WindowSpec, mode: str = "RStream") -> DataFrame:
    if mode == "RStream":
        return rstream(results)
    if mode == "IStream":
        return istream(results, spec)
    if mode == "DStream":
        return dstream(results, spec)
    raise ValueError(f"unknown relation-to-stream operator {mode!r}")


def join_windows(
    left: DataFrame,
    right: DataFrame,
    left_spec: WindowSpec,
    right_spec: WindowSpec,
    on: Sequence[str],
) -> DataFrame:
    """Solutions shared by two windows that close at the same time.

    Both sides are sets within a window: repeats of a solution are folded before the join,
    so that a solution seen often in both streams still meets itself only once. The fold
    and the join use the same keys and thus the same partitioning.
    """
    keys = ["w_end", *on]

    def side(df, spec):
        rows = assign_windows(df, spec).withColumn("w_end", F.col("window.end"))
        return rows.select(*keys).distinct()

    return side(left, left_spec).join(side(right, right_spec), keys)


def join_bags(left: DataFrame, right: DataFrame, on: Sequence[str], n: str = "_n") -> DataFrame:
    """Solutions that agree on `on`, where a row stands for `n` equal ones: numbers multiply. A side
    is folded to what is still asked for before it is joined, so repeats never meet one by one."""
    return left.join(right.withColumnRenamed(n, "_times"), list(on)).withColumn(n, F.col(n) * F.col("_times")).drop("_times")


def weighted(df: DataFrame, aggs: Sequence[Agg], by: Sequence[str], having: str | None = None, n: str = "_n") -> DataFrame:
    """As `aggregate`, where a row stands for `n` equal ones."""

    def one(a: Agg) -> Column:
        col = _counted(a)
        held = F.sum(F.when(col.isNotNull(), F.col(n)))
        if a.distinct or a.func in ("max", "min", "sample"):
            return _direct(a)
        if a.func == "count":
            return F.coalesce(held, F.lit(0)).alias(a.out)
        if a.func == "group_concat":
            each = F.flatten(F.collect_list(F.array_repeat(col.cast("string"), F.col(n).cast("int"))))
            return F.array_join(F.sort_array(each), a.separator).alias(a.out)
        return _scaled(F.sum(_measure(a) * F.col(n)), a, held if a.func == "avg" else None).alias(a.out)

    out = df.groupBy(*by).agg(*[one(a) for a in aggs])
    return out.where(having) if having else out


def lookback(df: DataFrame, width_ms: int, now, ts: str = "ts") -> DataFrame:
    """Rows of the query horizon `[now - width, now]`; `now` is a timestamp literal or column."""
    now = F.lit(now) if not isinstance(now, Column) else now
    return df.where(F.col(ts).between(now - F.expr(f"INTERVAL '{width_ms / 1000:.3f}' SECOND"), now))


def explode_bindings(results: DataFrame, aggs: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row per bound aggregate: `var`, `value` as a number where it is one, `lexical` as text."""
    texts = results.select(*keep, *[F.col(a).cast("string").alias(a) for a in aggs], *[
        F.col(a).try_cast("double").alias(f"_{a}") for a in aggs])
    each = F.array(*[F.struct(F.lit(a).alias("var"), F.col(f"_{a}").alias("value"), F.col(a).alias("lexical")) for a in aggs])
    return texts.select(*keep, F.inline(each)).where(F.col("lexical").isNotNull())


def idle_periods(df: DataFrame, gap_ms: int, by: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """Stretches of activity; a stretch ends once nothing came for `gap_ms`, and idleness
    counts from its last row plus that gap.

    Rows within one slot as long as the gap are always of one stretch, so they are folded to
    first, last and count, with partial results. What is left to put in order per group is
    one row per slot, bounded by time and not by the number of rows.
    """
    slots = df.groupBy(*by, time_cell(ts, gap_ms).alias("_slot")).agg(
        F.min(ts).alias("_first"), F.max(ts).alias("_last"), F.count(F.lit(1)).alias("_n")
    )
    order = Window.partitionBy(*by).orderBy("_first")
    apart = epoch_us("_first") - epoch_us(F.lag("_last").over(order)) >= F.lit(gap_ms * 1000)
    numbered = slots.withColumn("_new", F.coalesce(apart, F.lit(True)).cast("int")).withColumn(
        "_no", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    )
    stretch = numbered.groupBy(*by, "_no").agg(
        F.min("_first").alias("active_from"), F.max("_last").alias("_last"), F.sum("_n").alias("n")
    )
    idle = F.col("_last") + F.expr(f"INTERVAL '{gap_ms / 1000:.3f}' SECOND")
    return stretch.select(*by, "active_from", idle.alias("idle_from"), "n")


def union_streams(*dfs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), dfs)
