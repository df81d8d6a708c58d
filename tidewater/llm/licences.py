"""Licence scan with Spark expressions only: lines of files, and passages as long as a template, against licence templates
by sparse TF-IDF cosine, and inheritance from the licence file of the nearest ancestor directory.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import stash, table

#: Letters and digits, with dots, plus signs and hyphens inside: the full stop of a sentence is not part of its last token.
TOKEN = r"[\p{L}\p{N}](?:[\p{L}\p{N}.+-]*[\p{L}\p{N}+])?"
#: Least cosine of a line that is no longer than the template, and the largest share of it that one token may bring.
COSINE, ALONE = 0.5, 0.8
#: Least cosine of a passage amid other text. Above the root of two thirds, so that two of three equally rare words are not enough.
PASSAGE = 0.85
#: Names of files that speak for their directory.
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|notice|unlicense)([._-].*)?$"

# Licence names; the sentences by which files refer to them, the titles, and the passages that tell their texts apart.
TEMPLATES = [
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "GNU Affero General Public License, version 3"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("AGPL-3.0", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Artistic-2.0", "The Artistic License 2.0"),
    ("Artistic-2.0", "Licensed under the Artistic License, version 2.0."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International Public License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International Public License"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("CC0-1.0", "CC0 1.0 Universal"),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("EUPL-1.2", "European Union Public Licence v. 1.2"),
    ("EUPL-1.2", "Licensed under the EUPL, Version 1.2 only (the Licence);"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "GNU General Public License, version 3"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("GPL-3.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "GNU Lesser General Public License, version 3"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT-0", "MIT No Attribution"),
    ("MS-PL", "Microsoft Public License (Ms-PL)"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("Proprietary", "All rights reserved."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("WTFPL", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
]
#: Words without which a text is not that licence's, where a template has them.
TELLING = {
    "AGPL-3.0": ["affero", "agpl-3.0"], "Apache-2.0": ["apache", "apache-2.0"], "Artistic-2.0": ["artistic", "artistic-2.0"], "BSD-2-Clause": ["bsd-2-clause"], "BSD-3-Clause": ["bsd-3-clause", "endorse"],
    "BSL-1.0": ["boost", "bsl-1.0"], "CC-BY-4.0": ["cc-by-4.0", "creative"], "CC-BY-NC-4.0": ["by-nc", "cc-by-nc-4.0", "attribution-noncommercial"], "CC-BY-SA-4.0": ["by-sa", "cc-by-sa-4.0", "attribution-sharealike"],
    "CC0-1.0": ["waived", "cc0", "cc0-1.0"], "EPL-2.0": ["eclipse", "epl-2.0"], "EUPL-1.2": ["eupl", "european", "eupl-1.2"], "GPL-2.0": ["gnu", "2", "gpl-2.0"], "GPL-3.0": ["gnu", "gpl-3.0"], "ISC": ["isc", "granted"],
    "LGPL-2.1": ["lesser", "2.1", "lgpl-2.1"], "LGPL-3.0": ["lesser", "lgpl-3.0"], "MIT": ["mit", "granted"], "MIT-0": ["mit", "attribution", "mit-0"], "MPL-2.0": ["mozilla", "mpl-2.0"], "MS-PL": ["microsoft", "ms-pl"],
    "Unlicense": ["unencumbered", "unlicense"], "WTFPL": ["fuck", "wtfpl"], "Zlib": ["warranty", "zlib"],
}
#: Licences whose text holds another's: where both match a file, the latter is not its licence. Any licence beats "Proprietary".
HOLDS = {"BSD-3-Clause": ["BSD-2-Clause"], "MIT-0": ["MIT"], "AGPL-3.0": ["GPL-3.0"], "LGPL-3.0": ["GPL-3.0"]}
#: Every licence is also known by its tag.
TEMPLATES += [(name, f"SPDX-License-Identifier: {name}") for name in dict(TEMPLATES) if name != "Proprietary"]


def template_tokens(text: str) -> list[str]:
    return re.findall(r"[^\W_](?:(?:[^\W_]|[.+-])*(?:[^\W_]|\+))?", text.lower())


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def document_frequencies(files: DataFrame) -> DataFrame:
    """t, df: in how many rows of ``files`` each token occurs, for every token of every text."""
    each = files.select(F.explode_outer(F.array_distinct(tokens(F.col("text")))).alias("t")).filter("t is not null")
    return each.groupBy("t").agg(F.count(F.lit(1)).alias("df"))


def marks(vector: dict[str, float], cosine: float) -> list[str]:
    """Tokens of which a text must have one to reach ``cosine`` with a template: without them too little of the template's length is left."""
    out = []
    left = total = sum(x * x for x in vector.values())
    for t in sorted(vector, key=lambda t: (-vector[t], t)):
        if left < cosine * cosine * total * (1 - 1e-9):
            break
        out.append(t)
        left -= vector[t] * vector[t]
    return out


def passages(near: DataFrame, templates: list[list[str]], line_marks: list[str], anchors: list[tuple[str, int, int]]) -> DataFrame:
    """path, version, template, span (line, place in the line and text of each token) of what is to be scored.

    A line with one of ``line_marks`` is a passage for all templates (template -1). An anchor (token, template, place)
    makes a passage of a template's length, over line ends, wherever its token stands: the one in which it has that place.
    """
    longest = max(map(len, templates))
    lines = F.split("text", "\n", -1)
    spans = F.transform(lines, lambda x, k: F.transform(tokens(x), lambda t, i: F.struct(k.alias("line"), i.alias("place"), t.alias("t"))))
    spans = near.select("path", "version", spans.alias("spans"))
    listed = F.array(*map(F.lit, line_marks))
    whole = spans.select("path", "version", F.lit(-1).alias("template"), F.explode("spans").alias("span")).filter(F.arrays_overlap("span.t", listed))
    listed = F.array(*map(F.lit, sorted({t for t, _, _ in anchors})))
    flat = spans.select("path", "version", F.flatten("spans").alias("all"))
    hits = F.filter(F.transform("all", lambda x, i: F.struct(x["t"].alias("t"), i.alias("i"))), lambda h: F.array_contains(listed, h["t"]))
    # The tokens round a hit, so that a long text is not copied for each of its hits.
    round_it = lambda h: F.struct(h["t"].alias("t"), F.least(h["i"], F.lit(longest)).alias("at"), F.slice("all", F.greatest(h["i"] - longest, F.lit(0)) + 1, 2 * longest + 1).alias("near"))
    met = flat.withColumn("hits", hits).select("path", "version", F.explode(F.transform("hits", round_it)).alias("h")).select("path", "version", "h.*")
    rows = [(t, k, place, len(templates[k])) for t, k, place in anchors]
    found = met.join(F.broadcast(near.sparkSession.createDataFrame(rows, "t string, template int, place int, n int")), "t")
    begin = F.col("at") - F.col("place")
    span = F.slice("near", F.greatest(begin, F.lit(0)) + 1, F.col("n") + F.least(begin, F.lit(0)))
    return whole.union(found.select("path", "version", "template", span.alias("span")))


def matches(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, cosine: float = COSINE, passage: float = PASSAGE) -> tuple[DataFrame, DataFrame]:
    """Sizes (path, version, n tokens) and matches (path, version, span, licence, score): best template of each line that reaches
    ``cosine`` and of each passage that reaches ``passage``; ties by name.

    A line counts for templates that are no shorter (the rest of a longer one is other text, and its passages are scored),
    and only if no single token brings more than ALONE of the cosine. What is scored must hold the template's telling words (TELLING). A token weighs its count times its inverse document frequency over all files. A full notice is a passage equal to
    its template, so it scores 1 whatever stands round it and however many files there are.
    """
    spark = files.sparkSession
    files = files.select("path", F.xxhash64("text").alias("version"), F.coalesce("text", F.lit("")).alias("text"))
    words = [template_tokens(text) for _, text in templates]
    vocabulary = sorted({t for own in words for t in own})
    total, df = files.count(), stash(document_frequencies(files))
    seen = {r.t: r.df for r in df.filter(F.col("t").isin(vocabulary)).collect()}  # a row for each template token at most
    idf = {t: math.log((total + 1) / (seen.get(t, 0) + 1)) + 1 for t in vocabulary}
    vectors = [{t: own.count(t) * idf[t] for t in own} for own in words]
    norms = [math.sqrt(sum(x * x for x in v.values())) for v in vectors]
    must = [{t for t in TELLING.get(name, []) if t in v} for (name, _), v in zip(templates, vectors, strict=True)]
    unit = spark.createDataFrame([(t, k, name, len(words[k]), len(must[k]), int(t in must[k]), x / norms[k]) for k, ((name, _), v) in enumerate(zip(templates, vectors, strict=True)) for t, x in v.items()], "t string, u int, licence string, longest int, must int, telling int, x double")

    line_marks = sorted({t for v in vectors for t in marks(v, cosine)})
    anchors = [(t, k, place) for k, v in enumerate(vectors) for needed in [set(marks(v, passage))] for place, t in enumerate(words[k]) if t in needed]
    either = F.array(*map(F.lit, sorted({*line_marks, *(t for t, _, _ in anchors)})))
    # One pass over all texts; the text stays where a token says that it may match.
    read = files.withColumn("all", tokens(F.col("text"))).select("path", "version", F.size("all").alias("n"), F.when(F.arrays_overlap("all", either), F.col("text")).alias("text"))
    read = stash(read)
    near = read.filter("text is not null").dropDuplicates(["path", "version"])
    held = stash(passages(near, words, line_marks, anchors))

    # Passages of the same tokens are scored once.
    contents = stash(held.select("template", F.col("span.t").alias("words")).distinct().withColumn("c", F.monotonically_increasing_id()))
    counted = contents.select("c", "template", F.explode("words").alias("t")).groupBy("c", "template", "t").agg(F.count(F.lit(1)).alias("k"))
    weigh = F.col("k") * (F.log((F.lit(total) + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1)
    weighed = stash(counted.join(df, "t", "left").select("c", "template", "t", "k", weigh.alias("w")))
    length = weighed.groupBy("c").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"), F.sum("k").alias("n"))
    product = F.col("w") * F.col("x")
    dot = weighed.join(F.broadcast(unit), "t").filter("template in (-1, u)").groupBy("c", "template", "u", "licence", "longest", "must").agg(F.sum(product).alias("dot"), F.max(product).alias("most"), F.sum("telling").alias("told")).filter("told = must")
    line = (F.col("template") < 0) & (F.col("n") <= F.col("longest")) & (F.col("score") >= cosine) & (F.col("most") <= ALONE * F.col("dot"))
    scored = dot.join(length, "c").withColumn("score", F.round(F.col("dot") / F.col("length"), 9)).filter(line | ((F.col("template") >= 0) & (F.col("score") >= passage)))
    best = scored.groupBy("c").agg(F.min(F.struct((-F.col("score")).alias("less"), "licence")).alias("b"))
    told = contents.join(best, "c").select("template", "words", "b.licence", (-F.col("b.less")).alias("score"))
    found = held.withColumn("words", F.col("span.t")).join(told, ["template", "words"]).select("path", "version", "span", "licence", "score")
    return read.groupBy("path", "version").agg(F.max("n").alias("n")), found


def scan(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, cosine: float = COSINE) -> DataFrame:
    """path, licence, score, found ('own', 'inherited' or null), origin (path of the match's file), licence_file, for each path.

    ``files`` has path (parts joined by /) and text. A file's own licence is that of its best matching line or passage, but for licences
    that another matching one's text holds (HOLDS). A file is its
    directory's licence file by its name, or if at least half of its tokens lie in matching lines and passages; of several
    in a directory the best score speaks, ties by path. A file without an own licence inherits from the nearest ancestor
    directory that has a licence file. Null or empty texts match nothing; rows that repeat a path are one file, whose
    different texts are all read; rows with a null path are left out; extra columns are ignored; an empty table gives no row.
    """
    files = files.select("path", "text").filter("path is not null")
    sizes, found = matches(files, templates, cosine)
    found = stash(found)
    covered = found.select("path", "version", F.explode("span").alias("s")).select("path", "version", "s.line", "s.place").distinct().groupBy("path").agg(F.count(F.lit(1)).alias("matched"))
    # Of a file's licences, a row each at most, those that another one's text holds go.
    named = found.groupBy("path", "licence").agg(F.max("score").alias("score")).groupBy("path").agg(F.collect_list(F.struct((-F.col("score")).alias("less"), "licence")).alias("all"))
    inside = F.create_map(*[x for name in dict(templates) for x in (F.lit(name), F.array(*[F.lit(h) for h in [*HOLDS.get(name, []), *(["Proprietary"] if name != "Proprietary" else [])]]).cast("array<string>"))])
    held = F.flatten(F.transform("all", lambda x: inside[x["licence"]]))
    own = named.select("path", F.array_min(F.filter("all", lambda x: ~F.array_contains(held, x["licence"]))).alias("b")).join(covered, "path")
    sizes = sizes.groupBy("path").agg(F.sum("n").alias("n"))
    name = F.element_at(F.split("path", "/"), -1)
    directory = F.regexp_replace("path", r"/?[^/]*$", "")
    all_of = sizes.join(own, "path", "left").select("path", directory.alias("dir"), F.col("b.licence").alias("own"), (-F.col("b.less")).alias("own_score"), (F.col("b.licence").isNotNull() & (name.rlike(LICENCE_FILE) | (2 * F.col("matched") >= F.col("n")))).alias("licence_file"))
    speaks = all_of.filter("licence_file").groupBy("dir").agg(F.min(F.struct((-F.col("own_score")).alias("less"), "path", "own")).alias("l"))
    depth = F.size(F.split("dir", "/"))
    up = all_of.select("dir").distinct().select("dir", F.explode(F.transform(F.sequence(F.lit(0), depth), lambda k: F.array_join(F.slice(F.split("dir", "/"), 1, k), "/"))).alias("above"))
    nearest = up.distinct().join(speaks.withColumnRenamed("dir", "above"), "above").groupBy("dir").agg(F.max_by("l", F.length("above")).alias("l"))
    told = all_of.join(nearest, "dir", "left")
    return told.select(
        "path",
        F.coalesce("own", "l.own").alias("licence"),
        F.coalesce("own_score", -F.col("l.less")).alias("score"),
        F.when(F.col("own").isNotNull(), "own").when(F.col("l").isNotNull(), "inherited").alias("found"),
        F.when(F.col("own").isNotNull(), F.col("path")).otherwise(F.col("l.path")).alias("origin"),
        F.coalesce("licence_file", F.lit(False)).alias("licence_file"),
    )


def document_files(docs: DataFrame) -> DataFrame:
    """Documents as files: source / language / hundreds of the id / id.txt."""
    return docs.select(F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("unknown")), F.expr("doc_id div 100").cast("string"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), "text")


def op9_license_scan(spark, sf_dir: str) -> DataFrame:
    found = scan(document_files(table(spark, sf_dir, "documents").filter("doc_id is not null")))
    return found.select(F.regexp_extract("path", r"(-?\d+)\.txt$", 1).cast("long").alias("doc_id"), *found.columns)
