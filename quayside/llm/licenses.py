"""License scans: sparse TF-IDF cosine of notices to templates, then inheritance from the nearest directory."""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, written

# fixed values: licence names and notices of them
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or any later version"),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-2-Clause", "Released under the BSD License, two clauses."),
    ("EPL-2.0", "Licensed under the Eclipse Public License 2.0"),
    ("EPL-2.0", "This program is made available under the terms of the Eclipse Public License 2.0"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("CC-BY-3.0", "Licensed under CC BY 3.0"),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Released under the BSD License, three clauses."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC0-1.0", "CC0 1.0 Universal public domain dedication"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "Copyright. All rights reserved."),
)
#: A notice is a line with one of these words.
CUE = r"(?i:licen[cs]e|copyright|copying|public domain|permission|redistribut|rights reserved|creative commons|\bcc0?\b|spdx)"
#: Names of licence files.
FILE_NAME = r"(?i)^(licen[cs]e|copying|unlicense)([._-].*)?$"
#: Least cosine of a notice to a template.
LEAST_COSINE = 0.6
#: Words that tell licences of one family apart; a notice has those of its template, and no other of them.
MARKS = ("affero", "lesser", "nc", "nd", "sa", "two", "three")
TERM = r"[^a-z0-9]+"


def terms(text: str) -> list[str]:
    return [t for t in re.split(TERM, text.lower()) if t]


def marks(text: str) -> list[str]:
    """The numbers and MARKS of a text, which a notice shares with its template."""
    return sorted({t for t in terms(text) if t.isdigit() or t in MARKS})


def term_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[dict[str, int], int]:
    """Documents that hold each term of the templates, over all documents, and the number of documents.

    The result has one row for each term of the fixed templates, so collecting it is bounded.
    """
    vocabulary = sorted({t for _, text in TEMPLATES for t in terms(text)})
    held = F.array_intersect(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), TERM), F.array(*map(F.lit, vocabulary)))
    counts = docs.select(F.explode(F.concat(held, F.array(F.lit("")))).alias("term")).groupBy("term").count().collect()
    found = {r["term"]: r["count"] for r in counts}
    return found, found.pop("", 0)


def vectors(df: dict[str, int], n: int) -> tuple[dict[str, float], float, list[tuple[str, dict[str, float]]]]:
    """idf of the templates' terms, idf of any other term, and the templates as unit vectors."""
    idf = {t: math.log((1 + n) / (1 + df.get(t, 0))) + 1 for _, text in TEMPLATES for t in terms(text)}
    units = []
    for name, text in TEMPLATES:
        own = {t: c * idf[t] for t, c in Counter(terms(text)).items()}
        norm = math.sqrt(sum(x * x for x in own.values()))
        units.append((name, {t: x / norm for t, x in own.items()}))
    return idf, math.log(1 + n) + 1, units


def cue_lines(text: Column) -> Column:
    """The lines of a text that have a cue, with their numbers."""
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("line"), x.alias("said")))
    none = F.array().cast("array<struct<line:int,said:string>>")
    return F.when(text.rlike(CUE), F.filter(lines, lambda x: x["said"].rlike(CUE))).otherwise(none)


def notices(cues: DataFrame, weights, row_col: str = "row") -> DataFrame:
    """(row, line, license, cosine, terms) of every line with a cue, of those in cues, that is near enough to a template.

    A line with a number that the template has not, or without one that it has, is another licence's, as it is with MARKS; a
    template without any takes lines with numbers, as years and names may hold them.
    """
    idf, other, units = weights
    lines = cues.select(row_col, F.explode("cues").alias("cue")).select(row_col, "cue.*")
    each = lines.select(row_col, "line", F.explode(F.split(F.lower("said"), TERM)).alias("term")).where("term <> ''").groupBy(row_col, "line", "term").count()
    known = F.create_map(*(F.lit(x) for pair in idf.items() for x in pair))
    x = F.col("count") * F.coalesce(F.element_at(known, F.col("term")), F.lit(other))
    per_template = [F.sum(x * F.coalesce(F.element_at(F.create_map(*(F.lit(v) for p in unit.items() for v in p)), F.col("term")), F.lit(0.0))).alias(f"t{k}") for k, (_, unit) in enumerate(units)]
    own = F.collect_set(F.when(F.col("term").rlike("^[0-9]+$") | F.col("term").isin(*MARKS), F.col("term"))).alias("marks")
    summed = each.groupBy(row_col, "line").agg(*per_template, own, F.sqrt(F.sum(x * x)).alias("norm"), F.sum("count").alias("terms"))
    agrees = [_agrees(marks(text)) for _, text in TEMPLATES]
    best = F.array_max(F.array(*(F.when(agree, F.struct(F.round(F.col(f"t{k}") / F.col("norm"), 9).alias("cosine"), F.lit(name).alias("license"))) for k, ((name, _), agree) in enumerate(zip(units, agrees, strict=True)))))
    return summed.select(row_col, "line", best.alias("best"), "terms").select(row_col, "line", "best.license", "best.cosine", "terms").where(F.col("cosine") >= LEAST_COSINE)


def _agrees(due: list[str]) -> Column:
    """Whether a line's marks go with those of a template: all of them, and none of MARKS beside."""
    held = F.lit(True)
    for t in due:
        held = held & F.array_contains("marks", t)
    for t in MARKS:
        if t not in due:
            held = held & ~F.array_contains("marks", t)
    return held


def scan(docs: DataFrame, path_col: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, path, own_license, cosine, license_file, inherited_license, inherited_from, license) for every row.

    own_license is that of the nearest notice in the row's text, of equals the earliest. A licence file is one
    with a notice that has such a name, or half of whose terms are in notices; its licence holds for its
    directory (of several the least path) and, unless a nearer directory has its own, for all below. license
    is the own, else the inherited. Null and empty texts have no notices; rows with a null path neither give
    nor inherit. Repeated rows keep their rows; other columns are not looked at. Texts of any length are read whole, line by
    line; an empty table gives no rows.
    """
    size = F.when(F.col("text").rlike(CUE), F.size(F.filter(F.split(F.lower("text"), TERM), lambda t: t != "")))
    named = docs.select(F.col(id_col).alias("id"), F.col(path_col).cast("string").alias("path"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # written once: the texts are cut into their cue lines in one pass, and row numbers stay what they are
    rows = written(named.select(F.monotonically_increasing_id().alias("row"), "id", "path", size.alias("size"), cue_lines(F.col("text")).alias("cues")), "cues")
    weights = vectors(*term_frequencies(docs, text_col))
    best = F.max(F.struct("cosine", (-F.col("line")).alias("line"), "license"))
    per_row = notices(rows.select("row", "cues"), weights).groupBy("row").agg(best.alias("best"), F.sum("terms").alias("noticed"))
    known = written(rows.select("row", "id", "path", "size").join(per_row, "row", "left").select(
        "id", "path", _folder(F.col("path")).alias("folder"), F.col("best.license").alias("own_license"), F.col("best.cosine").alias("cosine"),
        F.coalesce(F.col("best").isNotNull() & (_name(F.col("path")).rlike(FILE_NAME) | (2 * F.col("noticed") >= F.col("size"))), F.lit(False)).alias("license_file"),
    ), "notices")
    given = known.where("license_file AND path IS NOT NULL").groupBy(F.col("folder").alias("above")).agg(F.min(F.struct("path", "own_license")).alias("file"))
    folders = known.where("folder IS NOT NULL").select("folder").distinct()
    chain = folders.select("folder", F.posexplode(_ancestors(F.col("folder"))).alias("depth", "above"))
    nearest = chain.join(given, "above").groupBy("folder").agg(F.max(F.struct("depth", F.col("above"), F.col("file.own_license").alias("license"))).alias("from"))
    inherited = written(nearest.select("folder", F.col("from.license").alias("inherited_license"), F.col("from.above").alias("inherited_from")), "inherited")
    return known.join(inherited, "folder", "left").select("id", "path", "own_license", "cosine", "license_file", "inherited_license", "inherited_from", F.coalesce("own_license", "inherited_license").alias("license"))


def _folder(path: Column) -> Column:
    """The directory of a path, '' at the top."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def _name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*$", 0)


def _ancestors(folder: Column) -> Column:
    """A directory's ancestors from the top, '', down to itself."""
    steps = F.filter(F.split(folder, "/"), lambda s: s != "")
    return F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.greatest(F.size(steps), F.lit(1))), lambda k: F.array_join(F.slice(steps, 1, k), "/")))


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    """documents has no paths: each is taken as the file source/lang/doc_id."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    found = scan(docs.select("doc_id", "text", path.alias("path")), "path")
    return found.withColumnRenamed("id", "doc_id")
