"""Licence scan with DataFrame functions only: notices by TF-IDF cosine, then inheritance.

Each line or sentence of a text, one that is wrapped over lines too, is a possible header.  Its terms and those of the templates are
weighed by TF-IDF, with document frequencies counted over all texts, and the line gets the
template of the highest cosine if that reaches ``threshold``; a file gets that of its best line.
A line without any of a template's heaviest terms, whose removal leaves too little for the
threshold, can't reach it, so a few pieces that such terms hold find the lines to be weighed, exactly.

A file is a licence file if its name says so or if at least ``share`` of its terms stand in
notices.  It declares its licence for its directory; of several in one directory the best cosine
and then the least path counts.  A file without a notice of its own inherits from the nearest
directory above it that declares one, by joining its ancestor paths with the declaring ones.

Null or empty texts have no notice; null parts of a path are ``_``; files of equal paths get
equal inheritance; ties between templates go to the lesser name; an empty table gives an empty
result; very long texts are read whole; columns named as the new ones are replaced, and columns
of any other names stay as they are.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, renamed

# Notices of common licences, their headers and the sentences that grant them.
TEMPLATES = [
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    *((x, f"SPDX-License-Identifier: {x}") for x in ("AGPL-3.0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-4.0", "CC-BY-SA-4.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-3.0", "MIT", "MPL-2.0", "Unlicense")),
]
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|notice|unlicense)([._-].*)?$"
THRESHOLD, SHARE = 0.75, 0.2
#: Directories with a licence beyond which their table is joined by shuffle.
BROADCAST_DIRS = 10_000
TERM = "[a-z0-9]+(?:[.-][a-z0-9]+)*"
#: The same terms, without a state for each letter to go back to.
WHOLE_TERM = "[a-z0-9]++(?:[.-][a-z0-9]++)*+"
SENTENCE_END = r"([.!?])[ \t]+"
#: A line that is whole by itself.
TAG = r"(SPDX-License-Identifier:[^\n]*)\n"
#: A sentence that goes on in the next line: after comment signs, with a small letter or a digit.
WRAP = r"([^.!?\n])[ \t]*\n[ \t#*/;%-]*([a-z0-9(])"
MADE = ("license", "cosine", "origin", "declared_in")


def terms(text: Column) -> Column:
    """Lower-case terms of letters, digits and inner dots and hyphens."""
    return F.regexp_extract_all(F.lower(text), F.lit(WHOLE_TERM), F.lit(0))


def template_terms() -> dict[tuple[str, int], dict[str, int]]:
    """Counts of the terms of each template, by name and number."""
    return {(name, i): Counter(re.findall(TERM, text.lower())) for i, (name, text) in enumerate(TEMPLATES)}


def frequencies(docs: DataFrame) -> tuple[int, dict[str, int]]:
    """Texts, and in how many of them each term of a template stands, over all texts."""
    known = sorted({x for tf in template_terms().values() for x in tf})
    row = docs.select(F.array_intersect(terms(F.col("text")), F.array(*map(F.lit, known))).alias("t"))
    counts = row.select(F.explode(F.concat(F.array(F.lit("")), F.coalesce("t", F.array().cast("array<string>")))).alias("t")).groupBy("t").count().collect()
    have = {r["t"]: r["count"] for r in counts}
    return have.get("", 0), {x: have.get(x, 0) for x in known}


def idf(n: int, df: int) -> float:
    return math.log((1 + n) / (1 + df)) + 1


def vectors(n: int, df: dict[str, int]) -> list[tuple[str, dict[str, float]]]:
    """Templates as unit vectors."""
    out = []
    for (name, _), tf in template_terms().items():
        v = {x: k * idf(n, df[x]) for x, k in tf.items()}
        norm = math.sqrt(sum(w * w for w in v.values()))
        out.append((name, {x: w / norm for x, w in v.items()}))
    return out


def needed(v: list[tuple[str, dict[str, float]]], threshold: float, n: int, df: dict[str, int]) -> list[str]:
    """Pieces of which a line that reaches the threshold with any template must hold one.

    A line without a piece has no term that holds it.  Pieces are terms, chosen one by one by what they take from the templates
    and by how many texts may hold them; any choice is exact if it leaves no template enough.
    """
    left = [dict(w) for _, w in v]
    over = lambda w: max(0.0, sum(x * x for x in w.values()) - (threshold - 1e-6) ** 2)
    texts = {x: sum(k for y, k in df.items() if x in y) / max(n, 1) + 10.0 ** (2 - len(x)) for x in df}
    out = []
    while any(map(over, left)):

        def worth(piece: str) -> float:
            return sum(min(over(w), sum(x * x for y, x in w.items() if piece in y)) for w in left) / (1 + 300 * texts[piece])

        out.append(max(sorted(df), key=worth))
        left = [{y: x for y, x in w.items() if out[-1] not in y} for w in left]
    return out


def scan(files: DataFrame, path: str = "path", threshold: float = THRESHOLD, share: float = SHARE, keep: list[str] | None = None) -> DataFrame:
    """``files`` with license, cosine, origin (notice, inherited or null) and declared_in.

    ``keep``: the columns of ``files`` that are given, all if there is none.  Without the text among them the marks of all files are
    a table, so lines are weighed once and not again for the result.
    """
    given = files.select(*[c for c in files.columns if c not in MADE])
    kept = [c for c in given.columns if keep is None or c in keep]
    files, names = renamed(given)
    files = files.withColumn("text", F.col(names["text"])).withColumn("path", F.col(names[path]))
    path = "path"
    n, df = frequencies(files)
    v = vectors(n, df)
    pieces = needed(v, threshold, n, df)
    hinted = lambda low: reduce(or_, (F.contains(low, F.lit(x)) for x in pieces), F.lit(False))
    weight = F.create_map(*[F.lit(x) for k, c in sorted(df.items()) for x in (k, idf(n, c))])
    rare = F.lit(idf(n, 0))
    joined = F.regexp_replace(F.regexp_replace("text", TAG, "$1.\n"), WRAP, "$1 $2")
    lines = F.filter(F.split(F.lower(F.regexp_replace(joined, SENTENCE_END, "$1\n")), "\n"), hinted)
    held = F.transform(lines, terms)
    known = F.array(*[F.struct(F.lit(k).alias("name"), F.create_map(*[F.lit(x) for p in sorted(w.items()) for x in p]).alias("w")) for k, w in v])

    def total(xs: Column, f) -> Column:
        return F.aggregate(xs, F.lit(0.0), lambda a, x: a + f(x))

    def count(xs: Column, x: Column) -> Column:
        return F.size(F.filter(xs, lambda y: y == x)).cast("double")

    # each step gives structs of its own, as what a lambda's body names is worked out wherever it stands
    def weighed(line: Column) -> Column:
        bag = F.transform(F.array_distinct(line), lambda x: F.struct(x.alias("x"), (count(line, x) * F.coalesce(F.element_at(weight, x), rare)).alias("w")))
        return F.struct(bag.alias("bag"), F.size(line).alias("terms"))

    def shared(line: Column) -> Column:
        norm = F.sqrt(total(line["bag"], lambda b: F.pow(b["w"], F.lit(2.0))))
        return F.struct(F.filter(line["bag"], lambda b: F.map_contains_key(weight, b["x"])).alias("bag"), norm.alias("norm"), line["terms"].alias("terms"))

    def best(line: Column) -> Column:
        dot = F.transform(known, lambda t: F.struct(F.round(-total(line["bag"], lambda b: b["w"] * F.coalesce(F.element_at(t["w"], b["x"]), F.lit(0.0))) / line["norm"], 9).alias("cosine"), t["name"].alias("name")))
        return F.struct(F.array_min(dot).alias("top"), line["terms"].alias("terms"))

    weighty = F.transform(F.transform(F.transform(F.filter(held, lambda x: F.size(x) > 0), weighed), shared), best)
    told = F.transform(weighty, lambda b: F.struct((-b["top"]["cosine"]).alias("cosine"), b["top"]["name"].alias("name"), b["terms"].alias("terms")))
    found = F.filter(told, lambda b: b["cosine"] >= threshold)
    # the lowered text is a column, so it isn't lowered for each piece
    marked = files.withColumn("_low", F.lower("text")).withColumn("_hinted", hinted(F.col("_low")))
    marked = marked.withColumn("_found", F.coalesce(F.when(F.col("_hinted"), found), F.array().cast(FOUND)))
    top = F.array_min(F.transform("_found", lambda b: F.struct((-b["cosine"]).alias("c"), b["name"].alias("name"))))
    in_notices = F.aggregate("_found", F.lit(0), lambda a, b: a + b["terms"])
    mostly = F.when(F.size("_found") > 0, in_notices >= F.lit(share) * F.size(terms(F.col("text")))).otherwise(False)
    marked = marked.withColumn("_own", top["name"]).withColumn("_cosine", -top["c"]).withColumn("_dir", F.regexp_replace(path, "/?[^/]*$", ""))
    marked = marked.withColumn("_file", F.col("_own").isNotNull() & (F.element_at(F.split(path, "/"), -1).rlike(LICENCE_FILE) | mostly)).drop("_found")
    if "text" not in kept:
        marked = checkpoint(marked.select(*{names[c]: None for c in kept}, path, "_own", "_cosine", "_dir", "_file"))
    declares = F.when(F.col("_file"), F.struct((-F.col("_cosine")).alias("c"), F.col(path).alias("p"), F.col("_own").alias("name")))
    dirs = checkpoint(marked.groupBy("_dir").agg(F.min(declares).alias("_t"), F.max(F.col("_own").isNull()).alias("_bare")))
    declared = dirs.filter("_t is not null").select(F.col("_dir").alias("_from"), F.col("_t.name").alias("_name"))
    inherited = nearest(dirs.filter("_bare").select("_dir"), declared)
    if inherited.count() <= BROADCAST_DIRS:
        inherited = F.broadcast(inherited)
    out = marked.join(inherited.withColumnRenamed("_dir", "_of"), F.col("_own").isNull() & (F.col("_dir") == F.col("_of")), "left")
    return out.select(
        *(F.col(names[c]).alias(c) for c in kept),
        F.coalesce("_own", "_name").alias("license"),
        F.col("_cosine").alias("cosine"),
        F.when(F.col("_own").isNotNull(), "notice").when(F.col("_name").isNotNull(), "inherited").alias("origin"),
        F.when(F.col("_own").isNull(), F.col("_from")).alias("declared_in"),
    )


FOUND = "array<struct<cosine:double,name:string,terms:int>>"


def nearest(dirs: DataFrame, declared: DataFrame) -> DataFrame:
    """(_dir, _from, _name): for each directory the nearest one above or itself that declares."""
    parts = F.split("_dir", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    paths = dirs.select("_dir", F.explode(F.concat(F.array(F.lit("")), above)).alias("_from")).distinct()
    found = paths.join(declared, "_from").groupBy("_dir").agg(F.max(F.struct(F.length("_from").alias("n"), "_from", "_name")).alias("t"))
    return checkpoint(found.select("_dir", F.col("t._from").alias("_from"), F.col("t._name").alias("_name")))


def document_paths(docs: DataFrame) -> DataFrame:
    """Documents as files: source/lang/doc_id.txt."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("_"))
    return docs.withColumn("path", F.concat_ws("/", part("source"), part("lang"), F.concat(part("doc_id"), F.lit(".txt"))))


ORACLE = (
    "WITH template(name, number, text) AS (VALUES "
    + ", ".join(f"('{k}', {i}, '{v}')" for i, (k, v) in enumerate(TEMPLATES))
    + r"""),
known AS (SELECT name, number, term, count(*) AS k FROM (SELECT name, number, unnest(regexp_extract_all(lower(text), '{TERM}')) AS term FROM template) GROUP BY ALL),
files AS (SELECT row_number() OVER () AS id, doc_id, text, coalesce(source, '_') || '/' || coalesce(lang, '_') AS dir, coalesce(doc_id::VARCHAR, '_') || '.txt' AS base FROM documents),
bags AS (SELECT id, regexp_extract_all(lower(text), '{TERM}') AS bag FROM files),
df AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT id, unnest(bag) AS term FROM bags) WHERE term IN (SELECT term FROM known) GROUP BY term),
total AS (SELECT count(*) AS n FROM files),
idf AS (SELECT term, ln((1 + n) / (1 + coalesce(df, 0))) + 1 AS idf FROM (SELECT DISTINCT term FROM known) LEFT JOIN df USING (term), total),
told AS (SELECT name, number, term, k * idf / sqrt(sum(k * idf * k * idf) OVER (PARTITION BY number)) AS w FROM known JOIN idf USING (term)),
lines AS (SELECT id, line, unnest(regexp_extract_all(lower(t), '{TERM}')) AS term FROM (
  SELECT id, unnest(l) AS t, generate_subscripts(l, 1) AS line FROM (SELECT id, string_split(regexp_replace(regexp_replace(regexp_replace(text, '{TAG}', '\1.' || chr(10), 'g'), '{WRAP}', '\1 \2', 'g'), '([.!?])[ \t]+', '\1' || chr(10), 'g'), chr(10)) AS l FROM files))),
tf AS (SELECT id, line, term, count(*) AS k FROM lines GROUP BY ALL),
weighed AS (SELECT id, line, term, k, k * coalesce(idf, ln(1 + n) + 1) AS w FROM tf LEFT JOIN idf USING (term), total),
norms AS (SELECT id, line, sqrt(sum(w * w)) AS norm, sum(k) AS terms FROM weighed GROUP BY ALL),
cosines AS (SELECT id, line, name, number, round(sum(x.w * told.w) / any_value(norm), 9) AS c, any_value(terms) AS terms FROM weighed x JOIN told USING (term) JOIN norms USING (id, line) GROUP BY ALL),
best AS (SELECT id, line, name, c, terms FROM cosines QUALIFY row_number() OVER (PARTITION BY id, line ORDER BY c DESC, name) = 1),
notice AS (SELECT id, sum(terms) AS told, arg_min(name, (-c, name)) AS own, max(c) AS cosine FROM best WHERE c >= {THRESHOLD} GROUP BY id),
marked AS (SELECT f.id, doc_id, dir, base, own, cosine, own IS NOT NULL AND (regexp_matches(base, '(?i)^(licen[cs]e|copying|notice|unlicense)([._-].*)?$') OR told >= {SHARE}::DOUBLE * len(bag)) AS file
  FROM files f LEFT JOIN notice USING (id) LEFT JOIN bags USING (id)),
dirs AS (SELECT dir AS source_dir, arg_min(own, (-cosine, dir || '/' || base)) AS name FROM marked WHERE file GROUP BY dir),
above AS (SELECT DISTINCT dir, unnest([dir, split_part(dir, '/', 1), '']) AS source_dir FROM marked WHERE own IS NULL),
nearest AS (SELECT dir, arg_max(source_dir, length(source_dir)) AS source_dir, arg_max(name, length(source_dir)) AS name FROM above JOIN dirs USING (source_dir) GROUP BY dir)
SELECT doc_id, marked.dir || '/' || base AS path, coalesce(own, name) AS license, round(cosine, 6) AS cosine,
  CASE WHEN own IS NOT NULL THEN 'notice' WHEN name IS NOT NULL THEN 'inherited' END AS origin, CASE WHEN own IS NULL THEN source_dir END AS declared_in
FROM marked LEFT JOIN nearest ON own IS NULL AND nearest.dir = marked.dir
""".replace("{TERM}", TERM).replace("{WRAP}", WRAP).replace("{TAG}", TAG).replace("{THRESHOLD}", str(THRESHOLD)).replace("{SHARE}", str(SHARE))
)
