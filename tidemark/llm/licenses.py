"""Licence scans: statements of licence in files, and licences inherited from directories.

Lines are compared with licence templates as sparse TF-IDF vectors. The weight of a token is
1 + ln((1 + N) / (1 + df)) over the N files scanned, with df counted for every token of theirs.
A line can reach the cosine `threshold` only if it shares one of a template's `lead` tokens: the
heaviest ones, such that the others are too light to reach it together. Only such lines are
weighed, and this loses none. Besides the whole line, each stretch of it that is as long as a
notice is weighed: words before and after a notice, which weigh more the more files there are,
then do not hide it. Headings are looked for as whole lines only. SPDX tags are read as they are.

A file with a line that reaches the threshold states that licence (the best one; of equal ones
the first by name). A file that consists of such lines by half or more of its tokens, or is named
like one, is a licence file, and speaks for its directory. A file that states none inherits from
the nearest ancestor directory that has a licence: paths are cut into ancestors, which are joined
to the directories with licence files. Everything is done by DataFrame functions.

Null texts have no lines and can only inherit; a null path lies nowhere, and neither gives nor
inherits. Several rows of one path are one file each. If licence files of a directory disagree,
the best score decides, then the name. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import small
from tidemark.session import stored

THRESHOLD = 0.75
# Licence names and the usual words of their notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "MIT": "Released under the MIT License",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC0-1.0": "Released under CC0 1.0 Universal",
}
# More notices of these licences and others: first lines of permission texts and file headers.
NOTICES = {
    "Apache-2.0": ("Licensed to the Apache Software Foundation under one or more contributor license agreements",),
    "MIT": ("Permission is hereby granted, free of charge, to any person obtaining a copy", "Licensed under the MIT License"),
    "GPL-3.0": ("Licensed under the GNU General Public License, version 3",),
    "GPL-2.0": ("Licensed under the GNU General Public License, version 2",),
    "LGPL-3.0": ("Licensed under the GNU Lesser General Public License, version 3",),
    "MPL-2.0": ("Licensed under the Mozilla Public License, Version 2.0",),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License",),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",),
    "CC-BY-4.0": ("Licensed under a Creative Commons Attribution 4.0 International License",),
    "CC-BY-SA-4.0": ("Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",),
    "CC-BY-NC-4.0": ("Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",),
    "Unlicense": ("This is free and unencumbered software released into the public domain",),
}
HEADINGS = {
    "Apache-2.0": ("Apache License Version 2.0",),
    "MIT": ("MIT License", "The MIT License (MIT)"),
    "GPL-3.0": ("GNU General Public License Version 3",),
    "GPL-2.0": ("GNU General Public License Version 2",),
    "LGPL-3.0": ("GNU Lesser General Public License Version 3",),
    "MPL-2.0": ("Mozilla Public License Version 2.0",),
    "BSD-3-Clause": ("BSD 3-Clause License",),
    "ISC": ("ISC License",),
    "CC-BY-4.0": ("Creative Commons Attribution 4.0 International",),
    "CC-BY-SA-4.0": ("Creative Commons Attribution-ShareAlike 4.0 International",),
    "CC-BY-NC-4.0": ("Creative Commons Attribution-NonCommercial 4.0 International",),
    "CC0-1.0": ("CC0 1.0 Universal",),
}
_SPDX = r"SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+ ()-]*[A-Za-z0-9.+)])"
_FILE_NAME = r"(?i)(^|/)(licen[cs]e|copying|unlicense)[^/]*$"


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits; version numbers stay whole."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+(?:\.[\p{N}]+)*"), F.lit(0))


def template_tokens(spark, templates: dict[str, str], more: bool = True) -> DataFrame:
    """notice (a number), license, heading, length, token, tf of each notice; with `more`, of NOTICES and HEADINGS too."""
    all_ = [(k, v, False) for k, v in sorted(templates.items())]
    for known, heading in ((NOTICES, False), (HEADINGS, True)) if more else ():
        all_ += [(k, v, heading) for k, vs in sorted(known.items()) for v in vs]
    rows = [F.struct(F.lit(i).alias("notice"), F.lit(k).alias("license"), F.lit(h).alias("heading"), tokens(F.lit(v)).alias("t"))
            for i, (k, v, h) in enumerate(all_)]
    t = spark.range(1).select(F.explode(F.array(*rows)).alias("x")).select("x.*")
    t = t.select("notice", "license", "heading", F.size("t").alias("length"), F.explode("t").alias("token"))
    return t.groupBy("notice", "license", "heading", "length", "token").agg(F.count(F.lit(1)).alias("tf"))


def weights(files: DataFrame, template: DataFrame) -> DataFrame:
    """token, idf of every token of the files, and of the templates."""
    seen = files.select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("token"), F.lit(1).alias("files"))
    df = seen.unionAll(template.select("token", F.lit(0)).distinct()).groupBy("token").agg(F.sum("files").alias("df"))
    n = files.agg(F.count(F.lit(1)).alias("n"))
    return df.join(F.broadcast(n)).select("token", (1 + F.log((1 + F.col("n")) / (1 + F.col("df")))).alias("idf"))  # n is one row


def template_vectors(template: DataFrame, w: DataFrame, threshold: float) -> DataFrame:
    """notice, license, heading, length, norm, vector (token, weight; heaviest first), leads."""
    t = w.join(F.broadcast(template), "token").withColumn("x", F.col("tf") * F.col("idf"))  # as long as the templates
    t = t.groupBy("notice", "license", "heading", "length").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"),
                                                                F.sort_array(F.collect_list(F.struct("x", "token")), False).alias("vector"))

    def tail(i):  # what token i and those after it can add at most
        rest = F.slice("vector", i + 1, F.size("vector"))
        return F.sqrt(F.aggregate(rest, F.lit(0.0), lambda a, y: a + y["x"] * y["x"]))

    heavy = F.filter("vector", lambda y, i: tail(i) >= (threshold - 1e-9) * F.col("norm"))
    return t.withColumn("leads", F.transform(heavy, lambda y: y["token"]))


def _stretches(lines: DataFrame, vectors: DataFrame, w: DataFrame, threshold: float) -> DataFrame:
    """file, line, size, license, score of stretches (as long as a notice) of longer lines.

    A stretch begins where it can still reach a lead token: at most so many places per lead token
    as the notice has tokens.
    """
    v = vectors.where("not heading").select("license", "length", "norm", "leads", "vector")
    near = lines.join(F.broadcast(v), (F.col("size") > F.col("length")) & F.arrays_overlap("t", "leads"))  # a row per notice
    at = F.transform("t", lambda x, i: F.when(F.array_contains("leads", x), i))
    starts = F.flatten(F.transform(F.filter(at, lambda i: i.isNotNull()), lambda i: F.sequence(
        F.greatest(F.lit(0), i - F.col("length") + 1), F.least(i, F.col("size") - F.col("length")))))
    near = near.select("file", "line", "license", "length", "norm", "vector", "t", F.explode(F.array_distinct(starts)).alias("start"))
    part = near.select("file", "line", "license", "length", "norm", "vector", "start", F.slice("t", F.col("start") + 1, F.col("length")).alias("part"))
    # Tokens that are not the notice's only add to the length of the stretch: without them a bound is left.
    inside = F.filter("vector", lambda y: F.array_contains("part", y["token"]))
    part = part.where(F.sqrt(F.aggregate(inside, F.lit(0.0), lambda a, y: a + y["x"] * y["x"])) >= (threshold - 1e-9) * F.col("norm"))
    tf = (part.select("file", "line", "license", "length", "norm", "vector", "start", F.explode("part").alias("token"))
          .groupBy("file", "line", "license", "length", "norm", "vector", "start", "token").agg(F.count(F.lit(1)).alias("tf")))
    y = F.col("tf") * F.col("idf")
    x = F.coalesce(F.get(F.filter("vector", lambda z: z["token"] == F.col("token")), F.lit(0))["x"], F.lit(0.0))
    sums = tf.join(w, "token").select("file", "line", "license", "length", "norm", "start", x.alias("x"), y.alias("y"))
    sums = sums.groupBy("file", "line", "license", "length", "norm", "start").agg(F.sum(F.col("x") * F.col("y")).alias("dot"), F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("own"))
    score = F.round(F.col("dot") / (F.col("own") * F.col("norm")), 9)
    return sums.select("file", "line", F.col("length").alias("size"), "license", score.alias("score")).where(F.col("score") >= threshold)


def statements(files: DataFrame, vectors: DataFrame, w: DataFrame, threshold: float) -> DataFrame:
    """file, line, size, license, score of lines that state a licence, `size` being the tokens that do.
    `files`: file, lines (line, t, spdx)."""
    lines = files.select("file", F.explode("lines").alias("l")).select("file", "l.line", "l.t", F.size("l.t").alias("size"), "l.spdx")
    tf = (lines.select("file", "line", "size", F.explode("t").alias("token")).groupBy("file", "line", "size", "token")
          .agg(F.count(F.lit(1)).alias("tf")))
    tf = tf.join(w, "token").withColumn("y", F.col("tf") * F.col("idf"))
    by_token = (vectors.select("notice", "license", "norm", F.explode("vector").alias("v")).groupBy("v.token")
                .agg(F.collect_list(F.struct("notice", "license", (F.col("v.x") / F.col("norm")).alias("x"))).alias("in")))
    dots = tf.join(F.broadcast(by_token), "token", "left").groupBy("file", "line", "size").agg(
        F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("own"),
        F.flatten(F.collect_list(F.transform("in", lambda z: F.struct(z["notice"].alias("notice"), z["license"].alias("license"), (z["x"] * F.col("y")).alias("p"))))).alias("p"))
    found = (dots.select("file", "line", "size", "own", F.explode("p").alias("p"))
             .groupBy("file", "line", "size", "own", F.col("p.notice").alias("notice"), F.col("p.license").alias("license")).agg(F.sum("p.p").alias("dot")))
    whole = found.select("file", "line", "size", "license", F.round(F.col("dot") / F.col("own"), 9).alias("score")).where(F.col("score") >= threshold)
    # SPDX expressions: licences only, without what follows WITH.
    ids = F.split(F.regexp_replace("spdx", r"(?i)\bWITH\s+\S+|[()]", " "), r"(?i)\s+(?:AND|OR)\s+")
    ids = F.transform(ids, lambda x: F.regexp_replace(F.trim(x), r"(?:-only|-or-later|\+)$", ""))
    tagged = (lines.where("spdx != ''").select("file", "line", "size", F.explode(ids).alias("license"))
              .where("license != ''").withColumn("score", F.lit(1.0)))
    found = whole.unionByName(_stretches(lines, vectors, w, threshold)).unionByName(tagged)
    best = F.min(F.struct((-F.col("score")).alias("less"), "license", (-F.col("size")).alias("size")))
    return found.groupBy("file", "line").agg(best.alias("b")).select("file", "line", (-F.col("b.size")).alias("size"), "b.license", (-F.col("b.less")).alias("score"))


def _ancestors(directory: Column) -> Column:
    """A directory and those above it, with their depths."""
    parts = F.split(directory, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(
        F.array_join(F.slice(parts, 1, k), "/").alias("at"), k.alias("depth")))


def scan(files: DataFrame, threshold: float = THRESHOLD, templates: dict[str, str] = TEMPLATES, path: str = "path",
         text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """path, `keep`, license, score, n_statements, how (stated, inherited, none) and origin (whose directory) per row."""
    f = files.select(F.struct(*keep).alias("kept") if keep else F.lit(None).alias("kept"), F.col(path).alias("path"),
                     F.coalesce(F.col(text), F.lit("")).alias("text"))
    template = template_tokens(files.sparkSession, templates, templates is TEMPLATES)
    w = small(stored(weights(f, template), "licence-weights"))
    vectors = stored(template_vectors(template, w, threshold), "licence-vectors")
    leads = vectors.agg(F.array_distinct(F.flatten(F.collect_list("leads"))).alias("leads"))
    lines = F.transform(F.split("text", "\n", -1), lambda s, i: F.struct(i.alias("line"), tokens(s).alias("t"), F.regexp_extract(s, _SPDX, 1).alias("spdx")))
    f = f.join(F.broadcast(leads)).withColumn("all_lines", lines)  # one row, as long as the templates
    f = stored(f.select(F.monotonically_increasing_id().alias("file"), "kept", "path",
                        F.aggregate("all_lines", F.lit(0), lambda n, x: n + F.size(x["t"])).alias("n_tokens"),
                        F.filter("all_lines", lambda x: F.arrays_overlap(x["t"], "leads") | (x["spdx"] != "")).alias("lines")), "licence-files")
    said = stored(statements(f, vectors, w, threshold), "licence-statements")
    own = said.groupBy("file").agg(F.min(F.struct((-F.col("score")).alias("less"), "license")).alias("b"), F.sum("size").alias("said"),
                                   F.count(F.lit(1)).alias("n_statements"))
    f = stored(f.drop("lines").join(own, "file", "left").select(
        "kept", "path", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("directory"), F.col("b.license").alias("own"),
        (-F.col("b.less")).alias("own_score"), F.coalesce("n_statements", F.lit(0)).cast("long").alias("n_statements"),
        (F.rlike("path", F.lit(_FILE_NAME)) | (2 * F.col("said") >= F.col("n_tokens"))).alias("speaks")), "licence-own")
    spoken = (f.where("speaks and own is not null and path is not null").groupBy("directory")
              .agg(F.min(F.struct((-F.col("own_score")).alias("less"), F.col("own").alias("license"))).alias("b")))
    spoken = stored(spoken.select(F.col("directory").alias("at"), F.col("b.license").alias("license"), (-F.col("b.less")).alias("score")), "licence-directories")
    asking = f.where("own is null and path is not null").select("directory").distinct()
    found = (asking.select("directory", F.explode(_ancestors(F.col("directory"))).alias("a")).select("directory", "a.*")
             .join(small(spoken), "at").groupBy("directory").agg(F.max(F.struct("depth", "at", "license", "score")).alias("b")))
    found = stored(found.select(F.col("directory").alias("of"), "b.at", "b.license", "b.score"), "licence-inherited")
    out = f.join(small(found), (F.col("directory") == F.col("of")) & F.col("own").isNull() & F.col("path").isNotNull(), "left")
    return out.select(*([F.col("kept").getField(k).alias(k) for k in keep]), "path", F.coalesce("own", "license").alias("license"),
                      F.coalesce("own_score", "score").alias("score"), "n_statements",
                      F.when(F.col("own").isNotNull(), "stated").when(F.col("license").isNotNull(), "inherited").otherwise("none").alias("how"),
                      F.when(F.col("own").isNull(), F.col("at")).alias("origin"))
