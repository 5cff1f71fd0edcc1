"""Query texts as data: literals set aside, prefixes resolved, clauses as lists of tokens.

Everything is an expression over the text of one row. A clause is a list of tokens; variables
are `?name`, window names `!<iri>`, IRIs `<iri>` with their prefix resolved, literals a quoted
code of what was written, keywords in upper case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import expand_iri
from tidemark.model import RDF_TYPE

# Clauses of a query text as the published grammar has them: any white space, keywords in any
# case, names as IRIs or prefixed names, durations in milliseconds or as ISO 8601. The word boundary
# before a keyword is looked for behind its first letter: few places of a text have that letter.
_NAME = r"(?:<[^<>\s]*>|[^\s<>\[\]{}()]*:[^\s<>\[\]{}()]*)"
REGISTER_CLAUSE = rf"(?i)R(?<=\bR)EGISTER\s+([RID]STREAM)\s+({_NAME})\s+AS\b"
WINDOW_CLAUSE = (
    rf"(?i)F(?<=\bF)ROM\s+NAMED\s+WINDOW\s+({_NAME})\s+ON\s+(?:STREAM\s+)?({_NAME})\s*"
    r"\[\s*RANGE\s+([^\s\]]+)(?:\s+(?:STEP|SLIDE)\s+([^\s\]]+)|\s+TUMBLING)?\s*\]"
)
PREFIX_CLAUSE = r"(?i)P(?<=\bP)REFIX\s+([^\s:<>]*):\s*<([^<>\s]*)>"
AGGREGATE_ITEM = (
    r"(?i)\(\s*(COUNT|SUM|MIN|MAX|AVG|SAMPLE|GROUP_CONCAT)\s*\(\s*(DISTINCT\s+)?(\*|[?$]\w+)\s*\)\s*AS\s+[?$](\w+)\s*\)"
)
WINDOW_BLOCK = rf"(?i)W(?<=\bW)INDOW\s+({_NAME})\s*\{{([^{{}}]*)\}}"
SELECT_CLAUSE = r"(?i)S(?<=\bS)ELECT((?:\s+[?$]\w+)*)"
GROUP_CLAUSE = r"(?i)G(?<=\bG)ROUP\s+BY((?:\s+[?$]\w+)+)"
HAVING_CLAUSE = r"(?i)H(?<=\bH)AVING\s*(\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\))"
_ISO_DURATION = r"(?i)^P(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d{1,3})?)S)?)?$"
# A text from left to right: literals, IRIs, comments, and stretches of anything else.
_PIECE = (
    r'"""[\s\S]*?"""|' r"'''[\s\S]*?'''|" r'"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"|' r"'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'|"
    r"""<[^<>\s]*>|#[^\n]*|[^"'<#]+|[\s\S]"""
)
_PREFIXED = r"(?:[^\W\d_][\w-]*(?:\.[\w-]+)*)?:(?:[\w%-](?:[\w.:%-]*[\w:%-])?)?"
_TOKEN = (
    rf'(?U)"[0-9A-F]*"(?:@[A-Za-z0-9-]+|\^\^(?:<[^<>\s]*>|{_PREFIXED}))?|<[^<>\s]*>|[?$]\w+|_:\w+|{_PREFIXED}'
    r"|[+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|\w+|&&|\|\||!=|<=|>=|\S"
)
_TERM = r'^[?<"]|^[+-]?\d|:|^(?:TRUE|FALSE)$'
_STATE = (
    "struct<pos:int,s:string,p:string,patterns:array<struct<s:string,p:string,o:string>>,"
    "others:array<array<string>>,open:array<string>,depth:int>"
)


def every(text: Column, regex: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(regex), F.lit(group))


def groups(text: Column, regex: str, *names: str) -> Column:
    """The groups of each match by name. The text is searched once; then each match by itself."""
    return F.transform(every(text, regex), lambda m: F.struct(
        *[F.regexp_extract(m, regex, i + 1).alias(n) for i, n in enumerate(names)]))


def duration_ms(text: Column) -> Column:
    """Milliseconds of a count of them or of an ISO 8601 duration; null for anything else."""
    part = [F.coalesce(F.regexp_extract(text, _ISO_DURATION, i).try_cast("decimal(18,3)"), F.lit(0)) for i in range(1, 5)]
    total = sum((p * ms for p, ms in zip(part, (86_400_000, 3_600_000, 60_000, 1000))), F.lit(0)).cast("bigint")
    return F.when(text.rlike(_ISO_DURATION) & text.rlike(r"\d"), total).otherwise(text.try_cast("bigint"))


def without_literals(text: Column) -> Column:
    """The text with each literal's characters as a code, in which no clause can be found, and
    without comments."""
    quoted = lambda p: (p.startswith('"') | p.startswith("'")) & (F.length(p) > 1)
    return F.array_join(F.transform(every(text, _PIECE), lambda p: (
        F.when(quoted(p), F.concat(F.lit('"'), F.hex(p), F.lit('"'))).when(p.startswith("#"), F.lit(" ")).otherwise(p)
    )), "")


def as_written(token: Column) -> Column:
    """A literal as it stood in the text; IRIs without brackets, unknown prefixes as nothing."""
    code = F.regexp_extract(token, '^"([0-9A-F]*)"', 1)
    return (
        F.when(token.startswith('"'), F.concat(F.unhex(code).cast("string"), F.regexp_replace(token, '^"[0-9A-F]*"', "")))
        .when(token.startswith("<"), F.substring(token, F.lit(2), F.length(token) - 2))
        .when(token.contains(":") & ~token.startswith("_:"), F.lit("")).otherwise(token)
    )


def tokens(text: Column, prefixes: Column) -> Column:
    def resolved(name: Column) -> Column:
        space = F.try_element_at(prefixes, F.substring_index(name, ":", 1))
        return F.coalesce(F.concat(F.lit("<"), space, F.regexp_replace(name, "^[^:]*:", ""), F.lit(">")), name)

    typed = r'^("[0-9A-F]*"\^\^)([^<].*)$'
    return F.transform(every(text, _TOKEN), lambda t: (
        F.when(t.startswith("$"), F.concat(F.lit("?"), F.substring(t, F.lit(2), F.length(t))))
        .when(t.startswith('"') & t.rlike(typed), F.concat(F.regexp_extract(t, typed, 1), resolved(F.regexp_extract(t, typed, 2))))
        .when(t.rlike('^[?<"]|^_:'), t)
        .when(t.contains(":"), resolved(t))
        .when((t != "a") & t.rlike(r"^[A-Za-z]\w*$"), F.upper(t)).otherwise(t)
    ))


def folded(block: Column) -> Column:
    """Triples and other clauses of a block's tokens, with lists after `;` and `,` written out.

    `pos` says what may come: 0 a subject, 1 a predicate, 2 an object, 3 a sign after a
    triple, 4 a predicate or an end after `;`, -1 nothing that is known here.
    """

    none = F.array().cast("array<string>")

    def state(z: Column, **new: Column) -> Column:
        return F.struct(*[new.get(k, z[k]).alias(k) for k in ("pos", "s", "p", "patterns", "others", "open", "depth")])

    def step(z: Column, x: Column) -> Column:
        t, pos, inside = x["t"], z["pos"], F.size(z["open"]) > 0
        opens = x["word"] & pos.isin(0, 3)
        so_far = F.concat(z["open"], F.array(t))
        held = F.when(~inside, state(z, pos=F.lit(0), open=so_far, depth=F.lit(0))).when(
            (t == ")") & (z["depth"] == 1), state(z, others=F.concat(z["others"], F.array(so_far)), open=none, depth=F.lit(0))
        ).otherwise(state(z, open=so_far, depth=z["depth"] + F.when(t == "(", 1).when(t == ")", -1).otherwise(0)))
        term = x["term"] | ((t == "a") & pos.isin(1, 4))
        read_ = F.when(
            term & (pos == 0), state(z, pos=F.lit(1), s=t, open=none, depth=F.lit(0))
        ).when(
            term & pos.isin(1, 4),
            state(z, pos=F.lit(2), p=F.when(t == "a", F.lit(f"<{RDF_TYPE}>")).otherwise(t), open=none, depth=F.lit(0))
        ).when(
            term & (pos == 2),
            state(z, pos=F.lit(3), patterns=F.concat(z["patterns"], F.array(F.struct(z["s"].alias("s"), z["p"].alias("p"), t.alias("o")))),
                  open=none, depth=F.lit(0))
        ).otherwise(state(
            z, open=none, depth=F.lit(0),
            pos=F.when((t == ".") & pos.isin(0, 3, 4), 0).when((t == ";") & pos.isin(3, 4), 4).when((t == ",") & (pos == 3), 2).otherwise(-1)))
        return F.when(inside | opens, held).otherwise(read_)

    # What a token is by itself is asked once, not in each branch of a step.
    block = F.transform(block, lambda t: F.struct(
        t.alias("t"), t.rlike(_TERM).alias("term"), (t.rlike(r"^[A-Z]\w*$") & ~t.isin("TRUE", "FALSE")).alias("word")))
    start = F.from_json(F.lit('{"pos":0,"patterns":[],"others":[],"open":[],"depth":0}'), _STATE)
    return F.aggregate(block, start, step, lambda z: F.struct(
        z["patterns"].alias("patterns"), z["others"].alias("others"),
        (z["pos"].isin(0, 3, 4) & (F.size(z["open"]) == 0) & ~F.exists(z["others"], lambda o: o[0] != "FILTER")).alias("plain"),
    ))


def _last_per_key(pairs: Column) -> Column:
    """Of entries with one key only the last, as in a map that is written in order."""
    return F.filter(pairs, lambda x, i: F.size(F.filter(
        pairs, lambda y, j: (j > i) & (y["key"] == x["key"])
    )) == 0)


def read(queries: DataFrame) -> DataFrame:
    """Adds the parts of the texts: `_w` windows, `_a` aggregates, `_blocks`, `_selected`, `_grouped`,
    `_having` and `_rest`, and `r2s_operator`, `r2s_name`, `prefixes`.

    Each array is read from the text once, in a step of its own, and then used by name.
    """
    text = F.col("_text")
    register = F.regexp_extract(text, REGISTER_CLAUSE, 0)
    operator = F.regexp_extract(register, REGISTER_CLAUSE, 1)
    rest = text
    for clause in (REGISTER_CLAUSE, WINDOW_CLAUSE, PREFIX_CLAUSE, AGGREGATE_ITEM):
        rest = F.regexp_replace(rest, clause, " ")
    parts = queries.withColumn("_text", without_literals(F.col("query_text"))).withColumns({
        "r2s_operator": F.when(operator == "", F.lit("RStream")).otherwise(
            F.concat(F.upper(F.substring(operator, 1, 1)), F.lit("Stream"))),
        "r2s_name": F.regexp_replace(F.regexp_extract(register, REGISTER_CLAUSE, 2), "^<|>$", ""),
        "_k": groups(text, PREFIX_CLAUSE, "key", "value"),
        "_w": groups(text, WINDOW_CLAUSE, "name", "stream", "width", "slide"),
        "_a": groups(text, AGGREGATE_ITEM, "func", "distinct", "var", "alias"),
        "_b": groups(text, WINDOW_BLOCK, "name", "body"),
        "_rest": rest,
    }).withColumn("prefixes", F.map_from_entries(_last_per_key(F.col("_k"))))
    prefixes = F.col("prefixes")
    left = F.regexp_replace(F.col("_rest"), WINDOW_BLOCK, " WINDOW $1 ")
    for clause in (SELECT_CLAUSE, GROUP_CLAUSE, HAVING_CLAUSE):
        left = F.regexp_replace(left, clause, " ")
    return parts.withColumns({
        "_blocks": F.transform("_b", lambda b: F.struct(
            b["name"].alias("name"), tokens(b["body"], prefixes).alias("tokens"))),
        "_selected": tokens(F.regexp_extract("_rest", SELECT_CLAUSE, 1), prefixes),
        "_grouped": tokens(F.regexp_extract("_rest", GROUP_CLAUSE, 1), prefixes),
        "_having": tokens(F.regexp_extract("_rest", HAVING_CLAUSE, 1), prefixes),
        "_rest": tokens(left, prefixes),
    }).withColumns({
        "_blocks": F.transform("_blocks", lambda b: F.struct(
            b["name"].alias("name"), b["tokens"].alias("tokens"), folded(b["tokens"]).alias("held"))),
        # Brackets, points and the blocks' own names say nothing by themselves.
        "_unread": F.filter("_rest", lambda t, i: ~t.isin("WHERE", "{", "}", ".", "WINDOW") & (
            F.coalesce(F.get("_rest", i - 1), F.lit("")) != "WINDOW")),
    })


PARTS = ("_text", "_k", "_w", "_a", "_b", "_blocks", "_selected", "_grouped", "_having", "_rest", "_unread")


def catalog_columns(prefixes: Column) -> dict[str, Column]:
    """Typed columns over what `read` adds."""
    windows = F.transform("_w", lambda w: F.struct(
        expand_iri(w["name"], prefixes).alias("name"), expand_iri(w["stream"], prefixes).alias("stream"),
        duration_ms(w["width"]).alias("width"),
        duration_ms(F.when(w["slide"] == "", w["width"]).otherwise(w["slide"])).alias("slide"),
    ))
    return {
        "windows": windows,
        "aggregates": F.transform("_a", lambda a: F.struct(
            F.lower(a["func"]).alias("func"), (a["distinct"] != "").alias("distinct"),
            F.regexp_replace(a["var"], "^[?$]", "").alias("var"), a["alias"].alias("alias"))),
        "patterns": F.flatten(F.transform("_blocks", lambda b: F.transform(b["held"]["patterns"], lambda p: F.struct(
            expand_iri(b["name"], prefixes).alias("window"),
            *[as_written(p[k]).alias(k) for k in ("s", "p", "o")])))),
        "filters": F.flatten(F.transform("_blocks", lambda b: F.transform(
            b["held"]["others"], lambda o: F.array_join(F.transform(o, as_written), " ")))),
        "selected": F.transform("_selected", lambda t: F.regexp_replace(t, r"^\?", "")),
        "group_by": F.transform("_grouped", lambda t: F.regexp_replace(t, r"^\?", "")),
        "having": F.when(F.size("_having") > 0, F.array_join(F.transform("_having", as_written), " ")),
        "understood": (F.size("_unread") == 0) & (F.size("_w") > 0) & F.forall("_blocks", lambda b: b["held"]["plain"])
        & F.forall(windows, lambda w: w["width"].isNotNull() & w["slide"].isNotNull()),
    }


def clauses() -> Column:
    """All that a text says, as a list of clauses in which order does not count.

    A block that is not understood, and what stands outside of all clauses, are kept as whole
    sequences of tokens: texts that differ there are taken to differ.
    """
    def window(name: Column) -> Column:
        return F.concat(F.lit("!"), F.get(tokens(name, F.col("prefixes")), F.lit(0)))

    def ms(raw: Column) -> Column:
        return F.coalesce(duration_ms(raw).cast("string"), raw)

    def whole(mark: str, held: Column) -> Column:
        return F.when(F.size(held) > 0, F.array(F.concat(F.array(F.lit(mark)), held))).otherwise(F.array().cast("array<array<string>>"))

    def of_block(b: Column) -> Column:
        at = window(b["name"])
        plain = F.concat(
            F.transform(b["held"]["patterns"], lambda p: F.array(F.lit("pattern"), at, p["s"], p["p"], p["o"])),
            F.transform(b["held"]["others"], lambda o: F.concat(F.array(F.lit("filter"), at), o)))
        return F.when(b["held"]["plain"], plain).otherwise(F.array(F.concat(F.array(F.lit("block"), at), b["tokens"])))

    placed = F.transform("_rest", lambda t, i: F.when(
        F.coalesce(F.get("_rest", i - 1), F.lit("")) == "WINDOW", F.concat(F.lit("!"), t)).otherwise(t))
    return F.array_distinct(F.concat(
        F.array(F.array(F.lit("operator"), F.col("r2s_operator"))),
        F.transform("_w", lambda w: F.array(
            F.lit("window"), window(w["name"]), F.get(tokens(w["stream"], F.col("prefixes")), F.lit(0)),
            ms(w["width"]), ms(F.when(w["slide"] == "", w["width"]).otherwise(w["slide"])))),
        F.transform("_a", lambda a: F.array(
            F.lit("aggregate"), F.upper(a["func"]), (a["distinct"] != "").cast("string"),
            F.regexp_replace(a["var"], r"^\$", "?"), F.concat(F.lit("?"), a["alias"]))),
        F.flatten(F.transform("_blocks", of_block)),
        F.transform("_selected", lambda t: F.array(F.lit("selected"), t)),
        F.transform("_grouped", lambda t: F.array(F.lit("group"), t)),
        whole("having", F.col("_having")),
        F.when(F.size("_unread") > 0, whole("rest", placed)).otherwise(F.array().cast("array<array<string>>")),
    ))
