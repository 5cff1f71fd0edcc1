"""Replaces personal data by keyed surrogates, in DataFrame functions only.

E-mail addresses, phone numbers, payment cards, IPv4 addresses, hexadecimal secrets and titled
names are found by one pattern. An entity's canonical form (lower case, or digits alone) and a key
give its surrogate through SHA-256, so one entity has one surrogate wherever and however it is
written. Surrogates keep type and format: separators, letter case, digits for digits, the country
code, the card's first digit and valid check digit, the domain's ending, title and gender of a
name, and its script.

Surrogates of different entities may collide with each other, or be somebody's real data. All
distinct entities are therefore checked against each other: of those that share a surrogate, one
keeps it, and the others draw again until all are distinct and none is an entity of the corpus.
The few that drew again are joined to the documents that hold them; all others need no look-up.

Null texts stay null, and texts without entities unchanged. Rows with equal or null ids are
replaced one by one. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import small
from tidemark.session import stored

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
TYPES = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32})(?![0-9A-Za-z])",
    "card": r"(?<!\d)(?:\d{4}[ -]?){3}\d{4}(?!\d)",
    "phone": r"(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3}[ .-]?\d{4}(?!\d)|\+\d{1,3}[ .-]\d{2,4}[ .-]\d{3}[ .-]\d{4}(?!\d)",
    "ip": rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\d|\.\d)",
    "name": r"(?<!\p{L})(?:Mrs|Mr|Ms|Herr|Frau|Señora|Señor|Madame|Monsieur|Г-жа|Г-н|Κα|Κος)\.? \p{Lu}\p{L}+(?: \p{Lu}\p{L}+)?",
}
PATTERN = "|".join(f"(?:{p})" for p in TYPES.values())
# What every entity has something of: one cheap look spares most texts the patterns.
HINT = r"[0-9@]|[a-f]{32}|(?:Mrs|Mr|Ms|Herr|Frau|Señora|Señor|Madame|Monsieur|Г-жа|Г-н|Κα|Κος)\.? \p{Lu}"
FEMALE = r"^(?:Mrs|Ms|Frau|Señora|Madame|Г-жа|Κα)\.? "
# Beginnings, middles and endings from which names are put together: endings of given names by gender.
SYLLABLES = {
    "latin": (["Al", "Be", "Ca", "Do", "El", "Fi", "Ga", "Ha", "Jo", "Ka", "Li", "Ma", "No", "Ra", "Sa", "To"],
              ["ba", "den", "fi", "gor", "ka", "lin", "mar", "na", "ro", "sil", "ta", "ver"], ["n", "r", "s", "to"], ["a", "na", "ia", "la"]),
    "cyrillic": (["Ал", "Бо", "Ва", "Га", "Да", "Ев", "За", "Ки", "Ла", "Ми", "Ни", "Ро"],
                 ["би", "ва", "го", "ди", "ка", "ли", "ма", "на", "ро", "си", "та"], ["н", "р", "с", "в"], ["а", "на", "ия", "ла"]),
    "greek": (["Αλ", "Βα", "Γε", "Δη", "Ελ", "Ζω", "Θε", "Κα", "Λε", "Μα", "Νι", "Ρο"],
              ["βα", "γι", "δω", "κα", "λι", "μα", "νο", "ρα", "σι", "τα"], ["ς", "ν", "ος", "ης"], ["α", "να", "ια", "η"]),
}


def type_of(entity: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(list(TYPES.items())):
        out = F.when(F.rlike(entity, F.lit(f"^(?:{pattern})$")), name).otherwise(out)
    return out


def canonical(kind: Column, entity: Column) -> Column:
    return (F.when(kind.isin("phone", "card"), F.regexp_replace(entity, r"\D", ""))
            .when(kind == "name", F.regexp_replace(F.lower(entity), r"\.", "")).otherwise(F.lower(entity)))


def _draw(key: Column, kind: Column, canon: Column, attempt: Column, i: Column) -> Column:
    """A keyed number from 0 to 65535 for place `i`: 16 places to a digest."""
    block = F.sha2(F.concat_ws("\x1f", key, kind, canon, attempt.cast("string"), F.floor(i / 16).cast("string")), 256)
    return F.conv(F.substring(block, (i % 16).cast("int") * 4 + 1, F.lit(4)), 16, 10).cast("int")


def _pick(pool: list[str], n: Column) -> Column:
    return F.get(F.array(*map(F.lit, pool)), n % len(pool))


def _letters(text: Column, draw, hexadecimal: bool = False) -> Column:
    """Letters for letters, digits for digits, and the rest as it is."""
    alphabet = "0123456789abcdef" if hexadecimal else "abcdefghijklmnopqrstuvwxyz"
    swapped = F.transform(F.split(text, ""), lambda c, i: (
        F.when(F.rlike(c, F.lit("[0-9a-f]")), F.substring(F.lit(alphabet), draw(i) % 16 + 1, F.lit(1))) if hexadecimal
        else F.when(F.rlike(c, F.lit("[0-9]")), (draw(i) % 10).cast("string"))
        .when(F.rlike(c, F.lit("[a-z]")), F.substring(F.lit(alphabet), draw(i) % 26 + 1, F.lit(1)))).otherwise(c))
    return F.array_join(swapped, "")


def _luhn(digits: Column) -> Column:
    """Sum by which a 16-digit number is valid (a multiple of ten)."""
    def add(total, i):
        d = F.substring(digits, i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.lit(16)), F.lit(0), add)


def surrogate(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """The canonical form's surrogate: itself in canonical form."""
    def draw(i):
        return _draw(F.lit(key), kind, canon, attempt, F.lit(i) if isinstance(i, int) else i)

    local, domain = F.regexp_extract(canon, r"^([^@]*)@", 1), F.regexp_extract(canon, r"@(.*)\.[a-z]+$", 1)
    # A short local part has few surrogates: it grows when it has drawn often.
    more = F.when(attempt > 8, F.concat(F.lit("x"), (draw(200) % 10000).cast("string"))).otherwise("")
    email = F.concat(_letters(local, draw), more, F.lit("@"), _letters(domain, lambda i: draw(i + 100)), F.lit("."), F.regexp_extract(canon, r"\.([a-z]+)$", 1))
    digits = F.array_join(F.transform(F.split(canon, ""), lambda c, i: (draw(i) % 10).cast("string")), "")
    head = F.concat(F.substring(canon, 1, 1), F.substring(digits, F.lit(2), F.lit(14)))
    valid = F.pmod(10 - _luhn(F.concat(head, F.lit("0"))) % 10, F.lit(10)).cast("string")
    card = F.concat(head, F.when(_luhn(canon) % 10 == 0, valid).otherwise(F.substring(digits, 16, 1)))
    # The national number is the last ten digits; what stands before is the country code.
    national = F.least(F.length(canon), F.lit(10))
    phone = F.concat(F.substring(canon, F.lit(1), F.length(canon) - national), F.substring(digits, F.length(canon) - national + 1, national))
    ip = F.concat_ws(".", *[(draw(i) % 254 + 1).cast("string") for i in range(4)])
    title, rest = F.regexp_extract(canon, r"^(\S+) ", 1), F.split(F.regexp_replace(canon, r"^\S+ ", ""), " ")
    female = F.rlike(F.initcap(title), F.lit(FEMALE.rstrip(" ").replace(r"\.?", "$")))

    def word(w, i):
        def of(j):  # drawn by the word alone, so that one family name stays one
            return _draw(F.lit(key), F.lit("word"), w, attempt, F.lit(j) if isinstance(j, int) else j)

        given = (i == 0) & (F.size(rest) > 1)
        built = None
        for script, (starts, middles, male, fem) in SYLLABLES.items():
            end = F.when(~given, _pick(middles, of(3))).when(female, _pick(fem, of(3))).otherwise(_pick(male, of(3)))
            made = F.lower(F.concat(_pick(starts, of(0)), _pick(middles, of(1)), _pick(middles, of(2)), end))
            # Names grow with every further draw, so there is always room for one more.
            longer = F.transform(F.sequence(F.lit(4), F.greatest(attempt - 1, F.lit(4))), lambda j: _pick(middles, of(j)))
            more_ = F.when(attempt > 4, F.lower(F.array_join(longer, ""))).otherwise("")
            made = F.concat(made, more_)
            in_script = {"latin": None, "cyrillic": r"\p{IsCyrillic}", "greek": r"\p{IsGreek}"}[script]
            built = made if in_script is None else F.when(F.rlike(w, F.lit(in_script)), made).otherwise(built)
        return built

    name = F.concat_ws(" ", title, F.array_join(F.transform(rest, word), " "))
    return (F.when(kind == "email", email).when(kind == "secret", _letters(canon, draw, True)).when(kind == "card", card)
            .when(kind == "phone", phone).when(kind == "ip", ip).otherwise(name))


def in_format(kind: Column, entity: Column, sur: Column) -> Column:
    """A canonical surrogate written as the entity was."""
    place = lambda i: F.length(F.regexp_replace(F.substring(entity, F.lit(1), i + 1), r"\D", ""))
    digits = F.array_join(F.transform(F.split(entity, ""), lambda c, i: F.when(F.rlike(c, F.lit(r"\d")), F.substring(sur, place(i), F.lit(1))).otherwise(c)), "")
    cased = F.array_join(F.transform(F.split(sur, ""), lambda c, i: F.when(F.rlike(F.substring(entity, i + 1, F.lit(1)), F.lit("[A-Z]")), F.upper(c)).otherwise(c)), "")
    title = F.regexp_extract(entity, r"^(\S+ )", 1)
    name = F.concat(title, F.initcap(F.regexp_replace(sur, r"^\S+ ", "")))
    return F.when(kind.isin("phone", "card"), digits).when(kind == "name", name).otherwise(cased)


def entities(text: Column) -> Column:
    """Entities of a text in order: entity, kind, canon."""
    found = F.when(F.rlike(text, F.lit(HINT)), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(
        F.array().cast("array<string>"))
    typed = F.transform(found, lambda e: F.struct(e.alias("entity"), type_of(e).alias("kind")))
    return F.transform(typed, lambda x: F.struct(x["entity"].alias("entity"), x["kind"].alias("kind"), canonical(x["kind"], x["entity"]).alias("canon")))


def redrawn(distinct: DataFrame, key: str) -> DataFrame:
    """kind, canon, attempt of the entities whose first surrogates were taken. `distinct`: kind, canon, written."""
    drawn = stored(distinct.select("kind", "canon", F.lit(0).alias("attempt")), "entity-draws")
    taken = distinct.select(F.col("kind").alias("real_kind"), F.col("canon").alias("real"))
    while True:
        d = drawn.withColumn("sur", surrogate(key, F.col("kind"), F.col("canon"), F.col("attempt")))
        d = stored(d, "entity-surrogates")
        # Whoever drew less often keeps a surrogate, and of those the least digest.
        order = F.struct("attempt", F.xxhash64("canon").alias("h"), "canon")
        crowded = d.groupBy("kind", "sur").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first")).where("n > 1")
        keeps = crowded.select(F.col("kind").alias("k"), F.col("sur").alias("s"), F.col("first.canon").alias("keeper"))
        real = taken.select(F.col("real_kind").alias("rk"), F.col("real").alias("rs"))
        again = (d.join(keeps, (F.col("kind") == F.col("k")) & (F.col("sur") == F.col("s")), "left")
                 .join(real, (F.col("kind") == F.col("rk")) & (F.col("sur") == F.col("rs")), "left")
                 .select("kind", "canon", "attempt", (F.col("rs").isNotNull() | (F.coalesce("keeper", "canon") != F.col("canon"))).alias("again")))
        drawn = stored(again.select("kind", "canon", (F.col("attempt") + F.col("again").cast("int")).alias("attempt"), "again"), "entity-draws")
        if drawn.where("again").isEmpty():
            return drawn.where("attempt > 0").select("kind", "canon", "attempt")
        drawn = drawn.drop("again")


def pseudonymised(docs: DataFrame, key: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """row (all columns), n_entities by kind, and `replaced`, the text with surrogates."""
    d = docs.select(F.struct(*docs.columns).alias("row"), F.col(doc_id).alias("id"), F.col(text).alias("t"))
    seen = d.select("id", F.explode(entities(F.col("t"))).alias("e")).select("id", "e.kind", "e.canon")
    distinct = stored(seen.groupBy("kind", "canon").agg(F.count(F.lit(1)).alias("times")), "entities")
    again = stored(redrawn(distinct, key), "entities-redrawn")
    mark = F.concat_ws("\x1f", "kind", "canon")
    held = (seen.join(small(again), ["kind", "canon"]).groupBy("id")
            .agg(F.map_from_entries(F.collect_set(F.struct(mark.alias("k"), "attempt"))).alias("attempts")))
    held = stored(held.withColumnRenamed("id", "of"), "redrawn-by-document")
    d = d.join(small(held), F.col("id").eqNullSafe(F.col("of")), "left").select(
        "row", "attempts", "t", entities(F.col("t")).alias("found"))
    d = d.withColumn("between", F.when(F.size("found") > 0, F.split("t", PATTERN, -1)).otherwise(F.array("t")))

    def new(x):
        tries = F.coalesce(F.element_at("attempts", F.concat_ws("\x1f", x["kind"], x["canon"])), F.lit(0))
        return in_format(x["kind"], x["entity"], surrogate(key, x["kind"], x["canon"], tries))

    d = d.withColumn("swapped", F.transform("found", new))
    pieces = F.zip_with("between", "swapped", lambda p, e: F.concat(p, F.coalesce(e, F.lit(""))))
    kinds = F.transform("found", lambda x: x["kind"])
    counts = [F.coalesce(F.size(kinds) - F.size(F.array_remove(kinds, k)), F.lit(0)).cast("long").alias(f"n_{k}") for k in TYPES]
    return d.select("row", *counts, F.when(F.col("t").isNotNull(), F.array_join(pieces, "")).alias("replaced"))
