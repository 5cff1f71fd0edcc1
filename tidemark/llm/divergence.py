"""How far the sources of a language differ from each other and from the language, term by term.

Each (language, source) group and each language gives a kept term with count c the share
p = 1 + floor(10^9 * (c + 1) / (N + V)): N occurrences of kept terms, V kept terms. A group with
share p differs from one with share q by floor((p - q)^2 / q), summed over the kept terms.

Gustavson's row accumulation: a block of the term-major index lists, for each of its terms, the
groups that hold it and their shares. Each group runs through its own terms and scatters what
each peer on a term's list adds into one dense row with a place per peer; no pair of postings
leaves the block. Most terms are missing from most groups, so a row starts with what all terms
would add if no term were shared, from the few distinct shares of either side, and a shared term
adds only its difference from that. Rows of blocks are summed by Spark.

Null text, language or source count as ''. Groups without terms take part with N = 0; a language
without kept terms gives pairs of value 0; repeated rows are documents of their own; an empty
table gives no rows. Other columns are not read. Numbers are exact integers throughout; counts
of a group and of a language may reach 9 * 10^15.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import small, texts
from tidemark.session import stored

MIN_DOCS = 3
ONE = 1_000_000_000
# Distinct terms that a task holds before it hands its counts on.
HELD = 200_000
# Characters of a text that are cut into words at a time.
STRETCH = 1 << 20
# Postings in a block of the index: so many that a block's rows of S x S sums do not outweigh
# them, within these bounds.
BLOCK_POSTINGS = (20_000, 1_000_000)
# Pairs of postings that a group works on at a time.
PAIRS = 500_000
# Letters and all that is not ASCII make terms; A-Z are lower-cased.
TO_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _words(text: bytes) -> Iterator[list[bytes]]:
    """Terms of a text, a stretch at a time."""
    text, at = text.translate(TO_TERMS), 0
    while at < len(text):
        end = text.find(b" ", at + STRETCH)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term by group, folded within the task."""
    groups: dict[tuple, tuple[Counter, Counter]] = {}

    def handed_on() -> Iterator[pa.RecordBatch]:
        for (lang, source), (found, docs) in groups.items():
            k = len(found)
            yield pa.RecordBatch.from_arrays([
                pa.repeat(pa.scalar(lang, pa.string()), k), pa.repeat(pa.scalar(source, pa.string()), k),
                pa.array(found.keys(), pa.binary()).cast(pa.string()),
                pa.array(found.values(), pa.int64()), pa.array((docs[t] for t in found), pa.int64(), size=k),
            ], ["lang", "source", "term", "n", "docs"])
        groups.clear()

    held = 0
    for batch in batches:
        for text, lang, source in zip(texts(batch, "text"), batch.column("lang").to_pylist(), batch.column("source").to_pylist()):
            found, docs = groups.setdefault((lang, source), (Counter(), Counter()))
            before, own = len(found), set()
            for words in _words(text):
                found.update(words)
                own.update(words)
            docs.update(own)
            held += len(found) - before
            if held > HELD:
                yield from handed_on()
                held = 0
    yield from handed_on()


def term_index(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, term, n and postings (source, n) of the terms in at least MIN_DOCS documents of a
    language. A list holds a source once, so it is no longer than the language has sources."""
    d = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(name) for c, name in ((text, "text"), (lang, "lang"), (source, "source"))])
    counted = d.mapInArrow(_counts, "lang string, source string, term string, n long, docs long")
    by_group = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return by_group.groupBy("lang", "term").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("postings"),
    ).where(F.col("docs") >= MIN_DOCS).drop("docs")


def group_totals(docs: DataFrame, index: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, place (of the source among those of its language), total (N + V), lang_total
    and blocks (into how many the language's index is cut) of every group that occurs."""
    groups = docs.select(F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.coalesce(F.col(source), F.lit("")).alias("source")).distinct()
    held = index.select("lang", F.inline("postings")).groupBy("lang", "source").agg(F.sum("n").alias("own"))
    by_lang = index.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("n").alias("all"), F.sum(F.size("postings")).alias("postings"))
    whole = Window.partitionBy("lang")
    numbered = groups.join(held, ["lang", "source"], "left").join(by_lang, "lang", "left").select(
        "lang", "source", (F.row_number().over(whole.orderBy("source")) - 1).alias("place"), F.count(F.lit(1)).over(whole).alias("peers"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("own", "terms", "all", "postings")])
    of_block = F.least(F.greatest(F.col("peers") * F.col("peers") / 4, F.lit(BLOCK_POSTINGS[0])), F.lit(BLOCK_POSTINGS[1]))
    return numbered.select("lang", "source", "place", (F.col("own") + F.col("terms")).alias("total"),
                           (F.col("all") + F.col("terms")).alias("lang_total"),
                           F.greatest(F.ceil(F.col("postings") / of_block), F.lit(1)).cast("int").alias("blocks"))


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 * (count + 1) / total), by long division, so that nothing overflows."""
    rest, out = count + 1, np.zeros_like(count)
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // total, rest % total
    return out + 1


def _differ(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of the ranges, one range after the other."""
    before = np.cumsum(size) - size
    return np.arange(size.sum()) + np.repeat(start - before, size)


def block_rows(places: np.ndarray, counts: np.ndarray, starts: np.ndarray, totals: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The row of sums over a block's terms for each group. `starts` cuts postings (place, count)
    into terms; `totals` has N + V by place."""
    peers, sizes = len(totals), np.diff(starts)
    p, none = shares(counts, totals[places]), shares(np.zeros(peers, np.int64), np.maximum(totals, 1))
    term = np.repeat(np.arange(len(sizes)), sizes)
    own = np.argsort(places, kind="stable")
    bounds = np.searchsorted(places[own], np.arange(peers + 1))
    held = np.diff(bounds)
    distinct = [np.unique(p[own[bounds[g]:bounds[g + 1]]], return_counts=True) for g in range(peers)]
    all_p, all_n = (np.concatenate([d[i] for d in distinct]) if peers else np.zeros(0, np.int64) for i in (0, 1))
    of_peer = np.repeat(np.arange(peers), [len(d[0]) for d in distinct])
    for g in range(peers):
        # As if no term were shared: the group's own, each peer's own, and those of neither.
        row = _differ(none[g], none) * (len(sizes) - held[g] - held)
        np.add.at(row, of_peer, _differ(none[g], all_p) * all_n)
        for value, n in zip(*distinct[g]):
            row += _differ(value, none) * n
        mine, done = own[bounds[g]:bounds[g + 1]], 0
        upto = np.cumsum(sizes[term[mine]])
        while done < len(mine):
            end = max(done + 1, int(np.searchsorted(upto, (upto[done - 1] if done else 0) + PAIRS, "right")))
            part = mine[done:end]
            at = _ranges(starts[term[part]], sizes[term[part]])
            a, b, h = np.repeat(p[part], sizes[term[part]]), p[at], places[at]
            np.add.at(row, h, _differ(a, b) - _differ(a, none[h]) - _differ(none[g], b) + _differ(none[g], none[h]))
            done = end
        yield g, row


def _block(key: tuple, index: pa.Table, groups: pa.Table) -> pa.Table:
    groups = groups.sort_by("place")
    lists = index.column("postings").combine_chunks()
    lists = lists if isinstance(lists, pa.ListArray) else pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], index.schema.field("postings").type)
    flat = lists.flatten()
    places = pc.index_in(flat.field("source"), value_set=groups.column("source").combine_chunks()).to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    counts = flat.field("n").to_numpy(zero_copy_only=False).astype(np.int64)
    rows = list(block_rows(places, counts, starts, groups.column("total").to_numpy().astype(np.int64)))
    return pa.table({
        "lang": pa.repeat(pa.scalar(key[0].as_py(), pa.string()), len(rows)), "place": pa.array([g for g, _ in rows], pa.int32()),
        "row": pa.array([r for _, r in rows], pa.list_(pa.int64())),
    })


def peer_divergence(index: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (another source of the language), value."""
    lang_blocks = small(groups.groupBy("lang").agg(F.first("blocks").alias("blocks")))
    blocks = index.join(lang_blocks, "lang").select("lang", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"), "postings")
    spread = groups.select("lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "source", "place", "total")
    rows = blocks.groupBy("lang", "block").cogroup(spread.groupBy("lang", "block")).applyInArrow(_block, "lang string, place int, row array<bigint>")
    sums = rows.select("lang", "place", F.posexplode("row").alias("peer", "value")).where("place <> peer").groupBy("lang", "place", "peer").agg(F.sum("value").alias("value"))
    names = small(groups.select("lang", "place", "source"))
    return sums.join(names, ["lang", "place"]).join(
        names.select("lang", F.col("place").alias("peer"), F.col("source").alias("item")), ["lang", "peer"]
    ).select("lang", "source", "item", "value")


def _share(count: str, total: str) -> F.Column:
    return F.expr(f"1 + (CAST({ONE} AS DECIMAL(10,0)) * CAST({count} + 1 AS DECIMAL(19,0))) div CAST({total} AS DECIMAL(19,0))")


def term_divergence(index: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (a term that the group holds more of than the language), value."""
    held = index.select("lang", "term", F.col("n").alias("all"), F.inline("postings"))
    p = held.join(small(groups.select("lang", "source", "total", "lang_total")), ["lang", "source"]).select(
        "lang", "source", "term", _share("n", "total").alias("p"), _share("`all`", "lang_total").alias("q"))
    return p.where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr("((p - q) * (p - q)) div q").alias("value"))


def _ranked(df: DataFrame, part: str, most: int | None = None) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    out = df.withColumn("rank", F.row_number().over(order))
    out = out.where(F.col("rank") <= most) if most else out
    return out.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", top_terms: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank: for every group all its peers (`pair`), and the
    `top_terms` terms by which it stands out from its language (`term`)."""
    index = stored(term_index(docs, text, lang, source), "term-index")
    groups = stored(group_totals(docs, index, lang, source), "group-totals")
    return _ranked(peer_divergence(index, groups), "pair").unionByName(_ranked(term_divergence(index, groups), "term", top_terms))
