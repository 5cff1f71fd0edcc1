"""Near-duplicate lines by a segment-partition edit join, in DataFrame functions only.

Lines of `min_chars` characters or more that differ by at most `threshold` edits are linked.
A line of l characters is cut into threshold + 1 segments; if another line is within the
threshold, one segment occurs in it unchanged, at a place that the lengths narrow to a few. So
each line is entered under its segments, and probes, for each length it may be linked with, the
few substrings that can be such a segment. Of candidates cut into `PIECES` pieces, all but
`threshold` must be found again; what passes is verified by banded bit-parallel edit distance.

Segments held by many lines would make all pairs candidates. An edit changes the counts of at
most two characters, so of 2 * threshold + 1 groups of characters one keeps all its counts:
under a crowded segment, lines are entered once more for each group with its counts, and only
lines that agree there meet. Of those, only pairs whose letter counts differ by 2 * threshold in
all come out of the join (an edit changes two counts by one). Nothing is left out, and no bucket is cut.

Of each class of linked lines the first, in the order of (id, place), stays; the other lines are
taken out of their documents. Lines that are shorter stay, as do texts of documents without an id.
A document that loses all its lines (but blank ones) is dropped; null and empty texts stay as
they are. Rows with equal ids count as one document. Other columns are not touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import small
from tidemark.llm.graph import labelled, merged
from tidemark.session import released, stored

THRESHOLD, MIN_CHARS = 2, 30
CROWDED = 24
PIECES = 16
MARKS = 16
_SPACE = r"^[\s\x1c-\x1f]*$"
PLACES = 1 << 31


def entries(lines: DataFrame, threshold: int) -> DataFrame:
    """id, key, own: each line under its own segments, and what it probes."""
    parts = threshold + 1
    looks = []  # characters fewer than the line, segment, shift
    for less in range(threshold + 1):
        for i in range(parts):
            # Shifts that leave no more edits on either side of the segment than there are.
            lo, hi = max(-i, less - (threshold - i)), min(i, less + (threshold - i))
            looks += [(less, i, shift) for shift in range(lo, hi + 1)]
    # Exploded, not transformed: rows of a constant table run in compiled code, lambdas do not.
    specs = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(("less", "i", "shift"), look)]) for look in looks])
    e = lines.select("id", "line", F.length("line").alias("own_length"), F.explode(specs).alias("s")).select("id", "line", "own_length", "s.*")
    length = F.col("own_length") - F.col("less")
    size, first_longer = F.floor(length / parts).cast("int"), parts - length % parts
    e = e.select("id", "line", "own_length", "less", "i", "shift", length.alias("length"),
                 (F.col("i") * size + F.greatest(F.lit(0), F.col("i") - first_longer) + 1 + F.col("shift")).alias("place"),
                 (size + (F.col("i") >= first_longer).cast("int")).alias("size"))
    e = e.where((F.col("place") >= 1) & (F.col("place") + F.col("size") - 1 <= F.col("own_length")))
    key = F.xxhash64("length", "i", F.substring("line", F.col("place"), F.col("size")))
    return e.select("id", key.alias("key"), ((F.col("less") == 0) & (F.col("shift") == 0)).alias("own"))


def character_groups(groups: int) -> list[str]:
    """Regular expressions of what is not in a group; each code point is in one of the groups.

    ASCII is dealt out one by one, further letters by blocks of 16 and from U+0600 by blocks of 256;
    what lies beyond the basic plane is in the first group.
    """
    blocks = [(c, c) for c in range(0x80)] + [(c, c + 15) for c in range(0x80, 0x600, 16)] + [(c, c + 255) for c in range(0x600, 0x10000, 256)]
    of = [""] * groups
    for k, (lo, hi) in enumerate(blocks):
        of[k % groups] += rf"\x{{{lo:X}}}" + (rf"-\x{{{hi:X}}}" if hi > lo else "")
    of[0] += r"\x{10000}-\x{10FFFF}"
    return [f"[^{x}]+" for x in of]


def group_counts(line: Column, groups: int) -> list[Column]:
    """Per group of characters, a digest of the counts of each of its characters."""
    out = []
    for g, other in enumerate(character_groups(groups)):
        kept = F.translate(line, "".join(chr(c) for c in range(0x80) if c % groups != g), "")
        kept = F.when(F.octet_length(line) == F.length(line), kept).otherwise(F.regexp_replace(kept, other, ""))
        out.append(F.xxhash64(F.lit(g), F.array_join(F.sort_array(F.split(kept, "")), "")))
    return out


def letter_marks(line: Column) -> Column:
    """How many characters the line has of each of `MARKS` groups, up to U+052F (Latin, Greek, Cyrillic)."""
    n = F.length(line)
    of = ["".join(chr(c) for c in range(g, 0x530, MARKS)) for g in range(MARKS)]
    return F.array(*[n - F.length(F.translate(line, x, "")) for x in of])


def marks_near(a: str, b: str, threshold: int) -> Column:
    """False if the counts differ by more than `threshold` edits can make them; true if there are none."""
    apart = F.lit(0)
    for g in range(MARKS):
        apart = apart + F.abs(F.col(a)[g] - F.col(b)[g])
    return F.coalesce(apart <= 2 * threshold, F.lit(True))


def pieces_found(a: Column, b: Column, pieces: int, reach: int) -> Column:
    """How many of the `pieces` equal parts of `a` occur in `b` unchanged, `reach` places away at most."""
    n = F.length(a)

    def found(k: int) -> Column:
        start, end = F.floor(n * k / pieces).cast("int"), F.floor(n * (k + 1) / pieces).cast("int")
        part = F.substring(a, start + 1, end - start)
        return F.contains(F.substring(b, F.greatest(F.lit(1), start + 1 - reach), end - start + 2 * reach), part).cast("int")

    out = found(0)
    for k in range(1, pieces):
        out = out + found(k)
    return out


def cores(pairs: DataFrame, pieces: int) -> DataFrame:
    """a, b, and as arrays of characters what is left of line_a and line_b without what they begin and end with
    alike, to the nearest of `pieces` cuts. Their edit distance is that of the lines."""
    n, m = F.col("n"), F.col("m")
    cuts = [F.floor(n * k / pieces).cast("int") for k in range(1, pieces + 1)]
    p = pairs.withColumns({"n": F.length("line_a"), "m": F.length("line_b")})
    head = [F.when(F.substring("line_a", F.lit(1), c) == F.substring("line_b", F.lit(1), c), c).otherwise(0) for c in cuts]
    p = p.withColumn("head", F.greatest(*head))
    room = F.least(n, m) - F.col("head")
    tail = [F.when((c <= room) & (F.substring("line_a", n - c + 1, c) == F.substring("line_b", m - c + 1, c)), c).otherwise(0) for c in cuts]
    p = p.withColumn("tail", F.greatest(*tail))

    def core(line: str, length: Column) -> Column:
        rest = length - F.col("head") - F.col("tail")
        return F.when(rest > 0, F.split(F.substring(line, F.col("head") + 1, rest), "")).otherwise(F.array().cast("array<string>"))

    return p.select("a", "b", core("line_a", n).alias("chars_a"), core("line_b", m).alias("chars_b"))


def banded_distance(a: Column, b: Column, threshold: int) -> Column:
    """Edit distance of two arrays of characters whose sizes differ by `threshold` at most; exact up
    to the threshold, and threshold + 1 above it.

    A band of 2 * threshold + 1 diagonals is kept as bits: after i characters of `a`, bit k of level e
    is set if b[1 .. i + k - threshold] is reached with e edits. One character moves all diagonals of
    all levels at once by and, or and shift; no cell is visited.
    """
    k = threshold
    full = (1 << (2 * k + 1)) - 1

    def insertions(levels: list[Column]) -> list[Column]:
        # A character only in b: one diagonal up, one edit more.
        out = [levels[0]]
        for e in range(1, k + 1):
            out.append(levels[e].bitwiseOR(F.shiftleft(out[e - 1], 1).bitwiseAND(F.lit(full))))
        return out

    def equal(i: Column) -> Column:
        bits = F.lit(0)
        for d in range(2 * k + 1):  # beyond the ends get() gives null, which equals nothing
            bits = bits.bitwiseOR(F.when(F.get(a, i - 1) == F.get(b, i - 1 + (d - k)), 1 << d).otherwise(0))
        return bits

    def step(acc: Column, bits: Column) -> Column:
        levels = [acc[f"l{e}"] for e in range(k + 1)]
        moved = [levels[0].bitwiseAND(bits)]
        for e in range(1, k + 1):
            # Equal characters, another character, or one only in a.
            moved.append(levels[e].bitwiseAND(bits).bitwiseOR(levels[e - 1]).bitwiseOR(F.shiftright(levels[e - 1], 1)))
        return F.struct(*[x.alias(f"l{e}") for e, x in enumerate(insertions(moved))])

    start = insertions([F.lit(1 << k)] + [F.lit(0)] * k)
    first = F.struct(*[x.alias(f"l{e}") for e, x in enumerate(start)])
    at_end = F.pow(F.lit(2), F.size(b) - F.size(a) + k).cast("int")

    def least(acc: Column) -> Column:
        out = F.lit(k + 1)
        for e in range(k, -1, -1):
            out = F.when(acc[f"l{e}"].bitwiseAND(at_end) != 0, e).otherwise(out)
        return out

    return F.when(F.size(a) == 0, F.size(b)).otherwise(
        F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest(F.size(a), F.lit(1))), equal), first, step, least))


def _seats(lines: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame]:
    """Written: id, own, key, marks of lines that may have a partner under a key, and their texts. A key that was
    crowded has marks (letter counts) with all its lines, any other key has none."""
    groups = 2 * threshold + 1
    entered = entries(lines, threshold)
    shared = stored(entered.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_if("own").alias("n_own"))
                    .where("n > 1 and n_own > 0"), "shared-segments")
    met = stored(entered.join(small(shared.select("key", "n")), "key"), "segment-entries")
    rare = met.where(F.col("n") <= CROWDED).select("id", "own", "key", F.lit(None).cast("array<int>").alias("marks"))
    crowded = met.where(F.col("n") > CROWDED).select("id", "own", "key")
    ids = stored(met.select("id").distinct(), "segment-lines")
    texts_ = stored(lines.join(small(ids), "id", "left_semi"), "segment-texts")
    counts = texts_.join(small(stored(crowded.select("id").distinct(), "crowded-lines")), "id", "left_semi")
    counts = stored(counts.select(F.col("id").alias("of"), F.array(*group_counts(F.col("line"), groups)).alias("counts"),
                                  letter_marks(F.col("line")).alias("marks")), "character-counts")
    finer = (crowded.join(counts, F.col("id") == F.col("of"))
             .select("id", "own", "key", "marks", F.posexplode("counts").alias("g", "count"))
             .select("id", "own", F.xxhash64("key", "g", "count").alias("key"), "marks"))
    return stored(rare.unionAll(finer), "seats"), texts_


def _pairs(seats: DataFrame, threshold: int, apart: str = "true") -> DataFrame:
    """(a, b) of lines that meet under a key, one of them by an entry of its own. `apart` is a condition on x and y."""
    own = seats.where("own").select(*[F.col(c).alias(f"{c}_x") for c in seats.columns])
    probe = seats.select(*[F.col(c).alias(f"{c}_y") for c in seats.columns])
    # Two own entries of one key meet once; a probe meets the own entries of shorter or other lines.
    met = own.join(probe, (F.col("key_x") == F.col("key_y")) & (F.col("id_x") != F.col("id_y"))
                   & (~F.col("own_y") | (F.col("id_x") < F.col("id_y"))) & F.expr(apart)
                   & marks_near("marks_x", "marks_y", threshold))
    return met.select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b")).distinct()


def _verified(pairs: DataFrame, texts_: DataFrame, threshold: int) -> DataFrame:
    """Those of the pairs that are within the threshold."""
    both = pairs.join(texts_.toDF("a", "line_a"), "a").join(texts_.toDF("b", "line_b"), "b")
    # An edit touches one piece at most; all others are found again.
    both = both.where((F.abs(F.length("line_a") - F.length("line_b")) <= threshold)
                      & (pieces_found(F.col("line_a"), F.col("line_b"), PIECES, threshold) >= PIECES - threshold))
    both = cores(both, PIECES)
    # Written before it is filtered: a filter would be moved below, and split both lines anew for every character.
    far = stored(both.select("a", "b", banded_distance(F.col("chars_a"), F.col("chars_b"), threshold).alias("far")), "line-distances")
    return far.where(F.col("far") <= threshold).select("a", "b")


def edit_links(lines: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(a, b) with a < b for all distinct lines (id, line) within `threshold` edits; `lines` is a written table."""
    seats, texts_ = _seats(lines, threshold)
    return _verified(stored(_pairs(seats, threshold), "line-pairs"), texts_, threshold)


def line_roots(lines: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """node, root: the classes that `edit_links` would give, without writing all pairs of a class.

    Under each key, lines are first compared with one of them: the least, and in a second round, where
    it is of another class by then, one that differs from key to key. What belongs together is
    one class after that, nearly always; only keys that still hold several classes are gone
    through pair by pair, across classes.
    """
    seats, texts_ = _seats(lines, threshold)
    one = F.struct("id", "marks")
    centres = seats.where("own").groupBy("key").agg(
        F.min_by(one, "id").alias("first"), F.min_by(one, F.xxhash64("id", "key")).alias("other"))
    centres = centres.select("key", F.col("first.id").alias("first"), F.col("first.marks").alias("first_marks"),
                             F.col("other.id").alias("other"), F.col("other.marks").alias("other_marks"))
    seated = seats.join(centres, "key").withColumns({
        "near_first": marks_near("marks", "first_marks", threshold), "near_other": marks_near("marks", "other_marks", threshold)})
    seated = stored(seated.drop("first_marks", "other_marks"), "seated-lines")
    tested = stored(seated.where("id != first and near_first").select(F.least("id", "first").alias("a"), F.greatest("id", "first").alias("b")).distinct(), "line-pairs")
    roots = merged(None, stored(_verified(tested, texts_, threshold), "line-links"))
    again = labelled(labelled(seated, "id", roots, "c"), "other", roots, "c_other").where("c != c_other and first != other and near_other")
    again = again.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
    again = stored(again.join(tested, ["a", "b"], "left_anti"), "line-pairs")
    roots = merged(roots, stored(_verified(again, texts_, threshold), "line-links"))
    by_class = stored(labelled(seated.select("id", "own", "key", "marks"), "id", roots, "c"), "lines-by-class")
    released(seated)
    mixed = by_class.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count(F.lit(1)).alias("n")).where("low != high and n > 2")
    mixed = stored(by_class.join(small(stored(mixed.select("key"), "mixed-keys")), "key", "left_semi"), "mixed-lines")
    rest = _pairs(mixed, threshold, "c_x != c_y").join(tested.unionAll(again), ["a", "b"], "left_anti")
    return merged(roots, stored(_verified(stored(rest, "line-pairs"), texts_, threshold), "line-links"))


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def takes_part(line: Column, min_chars: int) -> Column:
    """Long enough, and not blank."""
    return (F.length(line) >= min_chars) & ~F.rlike(line, F.lit(_SPACE))


def line_classes(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, doc_id: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """id, line, first (its first occurrence) of each distinct line, and root: its class, null if nothing is near."""
    d = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), split_lines(F.col(text)).alias("lines"))
    found = d.select("doc_id", F.posexplode("lines").alias("place", "line")).where(takes_part(F.col("line"), min_chars))
    at = F.col("doc_id").cast("decimal(20,0)") * F.lit(PLACES) + F.col("place")
    first = found.groupBy("line").agg(F.min(at.cast("decimal(38,0)")).alias("first"))
    lines = stored(first.withColumn("id", F.monotonically_increasing_id()), "distinct-lines")
    roots = line_roots(lines.select("id", "line"), threshold)
    return lines.join(small(roots).withColumnRenamed("node", "id"), "id", "left")


def kept_places(classes: DataFrame) -> DataFrame:
    """kept_id, places: where the first line of each class stands."""
    alone = classes.where("root is null").select("first")
    linked = classes.where("root is not null").groupBy("root").agg(F.min("first").alias("first")).select("first")
    place = F.pmod("first", F.lit(PLACES)).cast("int")
    return (alone.unionAll(linked)
            .select(((F.col("first") - place) / PLACES).cast("decimal(20,0)").cast("long").alias("kept_id"), place.alias("place"))
            .groupBy("kept_id").agg(F.collect_list("place").alias("places")))


def judged(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, doc_id: str = "doc_id",
           text: str = "text") -> DataFrame:
    """row (all columns), kept_text, n_lines (that take part), n_dropped, emptied for every row of `docs`."""
    kept = kept_places(line_classes(docs, threshold, min_chars, doc_id, text).select("first", "root"))
    d = docs.select(F.struct(*docs.columns).alias("row"), F.col(doc_id).cast("long").alias("own_id"))
    d = d.join(kept, F.col("own_id") == F.col("kept_id"), "left").withColumn("lines", split_lines(F.col("row").getField(text)))
    none = F.array().cast("array<int>")
    at = F.filter(F.transform("lines", lambda x, i: F.when(takes_part(x, min_chars), i)), lambda i: i.isNotNull())
    d = d.select("row", "lines", F.coalesce(at, none).alias("at"), F.coalesce("places", none).alias("places"), "own_id")
    lost = F.when(F.col("own_id").isNull(), none).otherwise(F.array_except("at", "places"))
    d = d.select("row", "lines", F.size("at").cast("long").alias("n_lines"), lost.alias("lost"))
    # Most documents lose nothing, and their lines are not gone through again.
    stays = F.when(F.size("lost") > 0, F.filter("lines", lambda x, i: ~F.array_contains("lost", i)))
    d = d.select("row", "n_lines", F.size("lost").cast("long").alias("n_dropped"), stays.alias("stays"))
    return d.select(
        "row", F.when(F.col("n_dropped") > 0, F.array_join("stays", "\n")).otherwise(F.col("row").getField(text)).alias("kept_text"),
        "n_lines", "n_dropped",
        F.when(F.col("n_dropped") > 0, ~F.exists("stays", lambda x: ~F.rlike(x, F.lit(_SPACE)))).otherwise(F.lit(False)).alias("emptied"),
    )


def drop_repeated_lines(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, doc_id: str = "doc_id",
                        text: str = "text") -> DataFrame:
    """`docs` without repeated lines in `text`, and without documents that lost all their lines."""
    done = judged(docs, threshold, min_chars, doc_id, text).where("not emptied")
    return done.select(*[F.col("kept_text").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns])
