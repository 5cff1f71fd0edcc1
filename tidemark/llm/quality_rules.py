"""Quality rules judged by host: failures are counted per host, shrunk towards the rate of all
hosts by a beta prior fitted to them, and the hosts' verdicts are joined back to documents.

Everything is computed by DataFrame functions. Documents with null text have no words and fail;
a null host is a host of its own; rows with equal ids are judged one by one; an empty table
gives an empty result. Columns other than id, text and host are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, small
from tidemark.session import stored

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\f\r"
RULES = ("base_failed", "symbols_failed", "lines_failed")


def _removed(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def document_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """Counts of each document: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words.

    Repeated three-word windows are found by sorting the windows' digests within the row, so the
    cost of a text is that of a sort of its words and nothing leaves the row.
    """
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).alias("host"),
                    F.coalesce(F.col(text), F.lit("")).alias("text"))
    d = d.select("doc_id", "host", "text", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"),
                 F.filter(F.split("text", "\n", -1), lambda x: _removed(x, SPACES) > 0).alias("lines"))
    window = F.transform(
        F.sequence(F.lit(0), F.size("words") - 3),
        lambda i: F.struct(F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)).alias("h"),
                           i.alias("i")),
    )
    d = d.select(
        "doc_id", "host",
        F.size("words").cast("long").alias("n_words"),
        _removed(F.col("text"), SPACES).cast("long").alias("word_chars"),
        (F.length("text") - _removed(F.col("text"), SYMBOLS)).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("words") >= 3, F.sort_array(window)).alias("windows"),
    )
    repeated = F.filter("windows", lambda w, j: F.coalesce(F.get("windows", j - 1)["h"] == w["h"], F.lit(False))
                        | F.coalesce(F.get("windows", j + 1)["h"] == w["h"], F.lit(False)))
    covered = F.aggregate(
        F.sort_array(F.transform(repeated, lambda w: w["i"])),
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, i: F.struct((i + 3).alias("end"), (a["n"] + i + 3 - F.greatest(i, a["end"])).alias("n")),
        lambda a: a["n"],
    )
    return d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("windows")


def with_rules(counts: DataFrame, min_words: int = 50, max_repeat: int = 50, max_symbols: int = 10,
               max_dup_lines: int = 30) -> DataFrame:
    """Which rules a document fails; limits but the first are percentages."""
    return counts.withColumns({
        "base_failed": (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words")),
        "symbols_failed": 100 * F.col("n_symbols") > max_symbols * F.col("word_chars"),
        "lines_failed": 100 * F.col("n_dup_lines") > max_dup_lines * F.col("n_lines"),
    })


def host_verdicts(judged: DataFrame, max_rate: float = 0.5) -> DataFrame:
    """Per host its shrunk rate of each rule, and host_failed if one is above `max_rate`.

    A prior Beta(m*s, (1-m)*s) has the mean m of all documents and the spread of the hosts'
    rates; hosts that do not differ give a strong prior (s up to 10^6). A small host thus
    stays near the mean.
    """
    hosts = judged.groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.col(r).cast("long")).alias(r) for r in RULES])
    total = hosts.agg(F.sum("n").alias("all_n"), *[F.sum(r).alias(f"all_{r}") for r in RULES])
    hosts = hosts.join(F.broadcast(total))  # one row
    spread = hosts.agg(F.first("all_n").alias("all_n"), *[F.first(f"all_{r}").alias(f"all_{r}") for r in RULES], *[
        F.sum(F.col("n") * F.pow(F.col(r) / F.col("n") - F.col(f"all_{r}") / F.col("all_n"), 2)).alias(f"S_{r}") for r in RULES])
    prior = []
    for r in RULES:
        m, v = F.col(f"all_{r}") / F.col("all_n"), F.col(f"S_{r}") / F.col("all_n")
        s = F.when(v > 0, F.least(F.lit(1e6), F.greatest(F.lit(1.0), m * (1 - m) / v - 1))).otherwise(F.lit(1e6))
        prior += [m.alias(f"m_{r}"), s.alias(f"s_{r}")]
    hosts = hosts.select("host", "n", *RULES).join(F.broadcast(spread.select(*prior)))  # one row
    rates = {f"{r}_rate": (F.col(r) + F.col(f"m_{r}") * F.col(f"s_{r}")) / (F.col("n") + F.col(f"s_{r}")) for r in RULES}
    out = hosts.withColumns(rates)
    failed = F.greatest(*[F.col(k) for k in rates]) > max_rate
    return out.select("host", F.col("n").alias("host_documents"), *rates, failed.alias("host_failed"))


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", **limits) -> DataFrame:
    """Counts, rules and host verdict of every document, and `kept`."""
    max_rate = limits.pop("max_rate", 0.5)
    judged = stored(with_rules(document_counts(docs, doc_id, text, host), **limits), "quality-counts")
    verdicts = stored(host_verdicts(judged, max_rate), "host-verdicts")
    v = small(verdicts.withColumnRenamed("host", "of_host"))
    out = judged.join(v, F.col("host").eqNullSafe(F.col("of_host")), "left").drop("of_host")
    return out.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(F.col("host_failed"), F.lit(False)))
