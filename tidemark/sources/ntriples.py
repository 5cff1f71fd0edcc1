"""N-Triples text to triples, with built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The N-Triples grammar, one statement. Groups: subject (IRI, blank node),
# predicate, object (IRI, blank node, quoted text with its datatype or language).
_BNODE = r"_:[^\s<>\"]*[^\s<>\".]"
_QUOTED = r"\"[^\"\\]*+(?:\\.[^\"\\]*+)*+\""
STATEMENT = (
    rf"\s*(?:<([^<>\"\s]*)>|({_BNODE}))\s+<([^<>\"\s]*)>\s+"
    rf"(?:<([^<>\"\s]*)>|({_BNODE})|({_QUOTED})(?:\^\^<([^<>\"\s]*)>|@([A-Za-z]+(?:-[A-Za-z0-9]+)*))?)"
    r"\s*\."
)
# A sign outside of terms begins a comment that ends with the line.
COMMENT = r"^((?:[^#<\"]++|<[^<>\"\s]*+>|" + _QUOTED + r")*+)#.*$"
COMMENT_OR_BLANK = r"^\s*(?:#.*)?$"
_EDGE, _GAP = "\u0001", "\u0002"


def _unescape(text: Column) -> Column:
    """Backslash escapes of a quoted text. They are those of a JSON text, but for the quote sign."""
    plain = F.regexp_replace(text, r"(?<!\\)((?:\\\\)*)\\'", "$1'")
    read = F.from_json(
        F.concat(F.lit("["), plain, F.lit("]")), "array<string>", {"allowUnquotedControlChars": "true"}
    )
    bare = F.substring(text, F.lit(2), F.length(text) - 2)
    return F.when(text.contains("\\"), F.coalesce(read[0], bare)).otherwise(bare)


def _pieces(col: str) -> Column:
    """The line cut at its statements: what lies between them at even places, the statements
    with their groups at odd ones. One pass of the grammar over the line does both."""
    # The two marks may occur in a text; as escapes they mean the same there.
    line = F.col(col)
    for mark in (_EDGE, _GAP):
        line = F.replace(line, F.lit(mark), F.lit(f"\\u{ord(mark):04X}"))
    line = F.regexp_replace(line, COMMENT, "$1")
    groups = _GAP.join(f"${i}" for i in range(1, 9))
    return F.split(F.regexp_replace(line, STATEMENT, f"{_EDGE}{groups}{_EDGE}"), _EDGE)


def parse_ntriples(lines: DataFrame, col: str = "value") -> DataFrame:
    """Statements of each line as `s, p, o, o_type, o_datatype, o_lang`, other columns kept.

    A line may hold several statements, and a comment after them. What is no statement yields nothing here; see
    `malformed_lines`.
    """
    keep = [c for c in lines.columns if c != col]
    cut = lines.select(*keep, F.posexplode(_pieces(col)).alias("_at", "_piece"))
    found = cut.where(F.col("_at") % 2 == 1).select(*keep, F.split("_piece", _GAP).alias("_g"))
    s_iri, s_node, p, iri, node, quoted, datatype, lang = (F.get("_g", F.lit(i)) for i in range(8))
    is_text = quoted != ""
    return found.select(
        *keep,
        F.when(s_node != "", s_node).otherwise(s_iri).alias("s"),
        p.alias("p"),
        F.when(is_text, _unescape(quoted)).when(node != "", node).otherwise(iri).alias("o"),
        F.when(is_text, F.lit("literal")).when(node != "", F.lit("bnode")).otherwise(F.lit("iri")).alias("o_type"),
        F.when(datatype != "", datatype).alias("o_datatype"),
        F.when(lang != "", lang).alias("o_lang"),
    )


def malformed_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """Lines with something that is neither a statement nor a comment."""
    between = F.array_join(F.filter(_pieces(col), lambda piece, at: at % 2 == 0), "")
    return lines.where(~F.regexp_like(between, F.lit(COMMENT_OR_BLANK)))


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    return parse_ntriples(spark.read.text(path))
