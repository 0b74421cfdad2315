"""Licences of files: TF-IDF cosine to templates, and inheritance from the nearest directory above.

Units are a file's lines (headers and notices stand in lines) and the file as a whole (a licence file).
Tokens are runs of a-z and 0-9 in lower case. Weights are token counts times the smoothed inverse
document frequency over the templates; tokens of no template weigh as much as the rarest. A line counts from
``line_least`` on, a whole file from ``file_least``; the file then is a licence file of its directory. A
file's own licence is that of its best unit. A file without one takes that of the nearest directory above, or
its own, that has a licence file, the best of them. Files with a licence of their own are written, so a text is
read once.

Before a text is cut into lines and tokens, its counts of the templates' tokens tell whether it can have a hit,
and nearly all others drop out; the filter loses nothing. By Cauchy-Schwarz, a line that reaches the threshold has
tokens that carry at least its square of a template's weight. For a whole file the numerator is exact, and its norm
is at least what results if no other token occurred twice. Ahead of that, a file must have one of the tokens that
are left when the most common ones, as far as they carry too little to reach a threshold, are taken from each
template.

Only DataFrame functions are used. What is broadcast are the templates' weights. Directories are joined by
their names, each file bringing one row per directory above it; a directory brings one row, however many files
it has.

Null text has no licence of its own. Files with a null path are left out; rows that repeat a path are one
file, with the lines of all. Texts of any length are read to the end; an empty table gives no rows; other columns are not
read. Ties go to the higher cosine, then to the name that comes first.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordercast.llm.common import stage

#: Notices by which the licences are commonly given.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)
LINE_LEAST, FILE_LEAST = 0.8, 0.6
#: Words that any text may have; they are poor anchors (see :meth:`Weights.anchors`).
COMMON = ("the", "of", "to", "a", "is", "this", "any", "by", "under", "use", "work", "form", "code", "0", "2", "3", "4", "v")


def tokens_of(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


class Weights:
    """Token weights of the templates."""

    def __init__(self, templates: tuple[tuple[str, str], ...]):
        counts = [Counter(tokens_of(t)) for _, t in templates]
        df = Counter(w for c in counts for w in c)
        n = len(templates)
        self.idf = {w: math.log((1 + n) / (1 + k)) + 1 for w, k in df.items()}
        self.unknown = math.log(1 + n) + 1
        self.rows = []  # number, licence, token, weight divided by the template's norm
        for k, ((licence, _), c) in enumerate(zip(templates, counts)):
            norm = math.sqrt(sum((m * self.idf[w]) ** 2 for w, m in c.items()))
            self.rows += [(k, licence, w, m * self.idf[w] / norm) for w, m in c.items()]

    def anchors(self, least: float) -> list[str]:
        """Tokens of which every unit that reaches ``least`` has one: all but some that carry too little."""
        out = set()
        rank = {w: k for k, w in enumerate(COMMON)}
        for k in {r[0] for r in self.rows}:
            carried = 0.0
            mine = ((rank.get(token, len(COMMON)), token, weight) for number, _, token, weight in self.rows if number == k)
            for _, token, weight in sorted(mine):
                carried += weight**2
                if carried >= least**2 - 1e-6:
                    out.add(token)
        return sorted(out)


def _may_have_one(files: DataFrame, weights: Weights, line_least: float, file_least: float) -> DataFrame:
    """(path, text) of the files that may have a licence of their own; the text in lower case."""
    vocabulary = sorted(weights.idf)
    pattern = f"(?<![a-z0-9])({'|'.join(vocabulary)})(?![a-z0-9])"
    text = F.col("text")
    anchors = "|".join(weights.anchors(min(line_least, file_least)))
    files = files.where(text.rlike(f"(?<![a-z0-9])(?:{anchors})(?![a-z0-9])"))
    # Generated columns are computed once, however often the conditions use them.
    known = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("found"),
        F.regexp_count(text, F.lit("[a-z0-9]+")).alias("tokens"),
    )
    files = files.select("path", "text", F.explode(F.array(known)).alias("k"))
    counts = F.array(*(F.size("k.found") - F.size(F.array_remove("k.found", w)) for w in vocabulary))
    files = files.where(F.size("k.found") > 0).select("path", "text", "k", F.explode(F.array(counts)).alias("n"))
    idf = F.array(*(F.lit(weights.idf[w]) for w in vocabulary))
    added = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    squares = added(F.zip_with("n", idf, lambda n, w: n * w * n * w))
    others = (F.col("k.tokens") - F.size("k.found")) * weights.unknown**2
    lines, whole = F.lit(False), F.lit(False)
    norm = F.sqrt(squares + others)
    for k in sorted({r[0] for r in weights.rows}):
        mine = {token: w for number, _, token, w in weights.rows if number == k}
        places = [(vocabulary.index(t), t) for t in mine]
        carried = sum((F.when(F.col("n")[i] > 0, mine[t] ** 2).otherwise(0.0) for i, t in places), F.lit(0.0))
        dot = sum((F.col("n")[i] * (weights.idf[t] * mine[t]) for i, t in places), F.lit(0.0))
        lines = lines | (carried >= line_least**2 - 1e-6)
        whole = whole | (dot >= (file_least - 1e-6) * norm)
    return files.where(lines | whole).select("path", "text")


def _parents(path: Column) -> Column:
    """The directories above a path, the nearest last: of a/b/c these are '', a, a/b."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def own_licences(
    files: DataFrame,
    templates: tuple[tuple[str, str], ...] = TEMPLATES,
    line_least: float = LINE_LEAST,
    file_least: float = FILE_LEAST,
) -> DataFrame:
    """(path, licence, cosine, is_file) of the files with a licence of their own."""
    spark = files.sparkSession
    weights = Weights(templates)
    found = files.where(F.col("path").isNotNull()).select("path", F.lower("text").alias("text"))
    found = _may_have_one(found, weights, line_least, file_least)
    # Line 0 is the file as a whole: each token of a line counts for the line, and for the file.
    lines = found.select("path", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    words = lines.select("path", "line", F.explode(F.split("text", "[^a-z0-9]+")).alias("token")).where(F.col("token") != "")
    units = words.select("path", F.explode(F.array(F.col("line") + 1, F.lit(0))).alias("line"), "token")
    counts = units.groupBy("path", "line", "token").agg(F.count(F.lit(1)).alias("n"))
    # One small row for each token of a template, with its weights in all of them.
    values = ", ".join(
        f"('{token}', {idf!r}D, map({', '.join(f'{k}, {w!r}D' for k, _, t, w in weights.rows if t == token)}))"
        for token, idf in sorted(weights.idf.items())
    )
    table = spark.sql(f"SELECT * FROM VALUES {values} AS known(token, idf, weights)")
    weighed = counts.join(F.broadcast(table), "token", "left")
    weight = F.col("n") * F.coalesce("idf", F.lit(weights.unknown))
    share = lambda k: F.coalesce(F.try_element_at("weights", F.lit(k)), F.lit(0.0))
    dots = [F.sum(weight * share(k)).alias(f"dot{k}") for k in range(len(templates))]
    units = weighed.groupBy("path", "line").agg(F.sum(weight * weight).alias("square"), *dots)
    names = [t[0] for t in templates]
    scored = F.array(
        *(F.struct((F.col(f"dot{k}") / F.sqrt("square")).alias("cosine"), F.lit(names[k]).alias("licence")) for k in range(len(names)))
    )
    units = units.select("path", "line", F.explode(scored).alias("s")).select("path", "line", F.round("s.cosine", 9).alias("cosine"), "s.licence")
    least = F.when(F.col("line") == 0, file_least).otherwise(line_least)
    hits = units.where(F.col("cosine") >= least)
    best = F.min(F.struct((-F.col("cosine")).alias("minus"), "licence"))
    picked = hits.groupBy("path").agg(best.alias("b"), F.max(F.col("line") == 0).alias("is_file"))
    return picked.select("path", F.col("b.licence").alias("licence"), (-F.col("b.minus")).alias("cosine"), "is_file")


def licences(files: DataFrame, **options) -> DataFrame:
    """(path, licence, origin, cosine, directory) for every file: origin own, inherited or null."""
    # Read twice below, a few rows; written, so that texts are gone through once.
    own = stage(own_licences(files, **options), "own_licences")
    parent = F.element_at(_parents(F.col("path")), -1)
    best = F.min(F.struct((-F.col("cosine")).alias("minus"), "licence"))
    directories = own.where("is_file").groupBy(parent.alias("directory")).agg(best.alias("b"))
    directories = directories.select("directory", F.col("b.licence").alias("given"), (-F.col("b.minus")).alias("given_cosine"))
    paths = files.where(F.col("path").isNotNull()).select("path").distinct()
    above = paths.select("path", F.posexplode(_parents(F.col("path"))).alias("depth", "directory"))
    nearest = above.join(directories, "directory").groupBy("path")
    nearest = nearest.agg(F.max(F.struct("depth", "directory", "given", "given_cosine")).alias("near"))
    joined = paths.join(own, "path", "left").join(nearest, "path", "left")
    inherited = F.col("licence").isNull()
    return joined.select(
        "path",
        F.coalesce("licence", "near.given").alias("licence"),
        F.when(~inherited, "own").when(F.col("near").isNotNull(), "inherited").alias("origin"),
        F.round(F.coalesce("cosine", "near.given_cosine"), 6).alias("cosine"),
        F.when(inherited, F.col("near.directory")).alias("directory"),
    )


def oracle(path: str, table: str, templates=TEMPLATES, line_least: float = LINE_LEAST, file_least: float = FILE_LEAST) -> str:
    """The same as SQL; ``path`` is an SQL expression over ``table``, which has the texts."""
    values = ", ".join(f"({k}, '{name}', '{text}')" for k, (name, text) in enumerate(templates))
    split = "unnest(string_split_regex({}, '[^a-z0-9]+'))"
    return f"""
WITH templates(number, licence, body) AS (VALUES {values}),
template_counts AS (
    SELECT number, licence, token, count(*) AS n
    FROM (SELECT number, licence, {split.format("lower(body)")} AS token FROM templates) WHERE token <> '' GROUP BY ALL),
idf AS (SELECT token, ln((1 + {len(templates)}) / (1.0 + count(*))) + 1 AS idf FROM template_counts GROUP BY token),
norms AS (SELECT number, sqrt(sum((n * idf) * (n * idf))) AS norm FROM template_counts JOIN idf USING (token) GROUP BY number),
files AS (SELECT {path} AS path, lower(text) AS body FROM {table}),
lines AS (
    SELECT path, line, string_split(body, chr(10))[line] AS body
    FROM (SELECT path, body, unnest(range(1, len(string_split(body, chr(10))) + 1)) AS line FROM files WHERE path IS NOT NULL)),
units AS (SELECT path, line, body FROM lines UNION ALL SELECT path, 0 AS line, body FROM files WHERE path IS NOT NULL),
counts AS (
    SELECT path, line, token, count(*) AS n
    FROM (SELECT path, line, {split.format("body")} AS token FROM units) WHERE token <> '' GROUP BY ALL),
weighed AS (SELECT path, line, token, n * coalesce(idf, ln(1 + {len(templates)}) + 1) AS w FROM counts LEFT JOIN idf USING (token)),
squares AS (SELECT path, line, sqrt(sum(w * w)) AS size FROM weighed GROUP BY ALL),
dots AS (
    SELECT path, line, number, licence, sum(w * c.n * idf / norm) AS dot
    FROM weighed JOIN template_counts c USING (token) JOIN idf USING (token) JOIN norms USING (number) GROUP BY ALL),
hits AS (
    SELECT path, line, licence, round(dot / size, 9) AS cosine FROM dots JOIN squares USING (path, line)
    WHERE round(dot / size, 9) >= CASE WHEN line = 0 THEN {file_least} ELSE {line_least} END),
own AS (
    SELECT path, arg_min(licence, (-cosine, licence)) AS licence, max(cosine) AS cosine, bool_or(line = 0) AS is_file
    FROM hits GROUP BY path),
parents AS (
    SELECT path, depth, array_to_string(string_split(path, '/')[1:depth], '/') AS directory
    FROM (SELECT path, unnest(range(0, len(string_split(path, '/')))) AS depth FROM (SELECT DISTINCT path FROM files WHERE path IS NOT NULL))),
directories AS (
    SELECT directory, arg_min(licence, (-cosine, licence)) AS given, max(cosine) AS given_cosine
    FROM own JOIN (SELECT path, arg_max(directory, depth) AS directory FROM parents GROUP BY path) USING (path)
    WHERE is_file GROUP BY directory),
near AS (
    SELECT path, arg_max(directory, depth) AS directory, arg_max(given, depth) AS given, arg_max(given_cosine, depth) AS given_cosine
    FROM parents JOIN directories USING (directory) GROUP BY path)
SELECT path, coalesce(licence, given) AS licence,
    CASE WHEN licence IS NOT NULL THEN 'own' WHEN given IS NOT NULL THEN 'inherited' END AS origin,
    round(coalesce(cosine, given_cosine), 6) AS cosine, CASE WHEN licence IS NULL THEN directory END AS directory
FROM (SELECT DISTINCT path FROM files WHERE path IS NOT NULL) LEFT JOIN own USING (path) LEFT JOIN near USING (path)
"""

