"""Licence scan: sparse TF-IDF cosine of headers and licence files to templates, then inheritance along directories.

Units are the lines and sentences of a file, and its paragraphs of several lines, so that wrapped licence texts are whole.
Each distinct unit is a TF-IDF vector, with document frequencies counted over all files, and takes the template with the
highest cosine, if it reaches LEAST. Candidates come by an index that holds of each template its heaviest terms: without
one of them the rest of the template cannot reach LEAST. Of these, units stay whose terms hold enough of some template's
weight: a bound of the cosine that needs no weights of the unit, so no unit that could reach LEAST is left out and the
terms of few others are counted. Each matched unit votes with
its weight for the licences of its template; a file has the licence with the most. A file is a licence file if its name
says so or if all its lines and sentences are matched, by themselves or in a matched paragraph; it speaks for its
directory. Files without a licence of their own take that of the nearest ancestor directory that has one. All work is
DataFrame work.

Null texts count as empty, a null path as an empty one: such files have no directory to inherit from. Long texts are read
whole. Repeated rows get equal results each. Ties between templates go to the first in the list, those between licences to
the first name in order. Extra columns pass through, but for those with the name of an output column.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut_lineage, lookup, written

LEAST = 0.55
LICENCE_NAME = r"(?i)(?:^|/)(?:un)?(?:licen[cs]e|copying|notice)(?:[.-][^/]*)?$"
UNITS = r"\n|(?<=[.!?;])[ \t]+"
PARAGRAPHS = r"\n[ \t\r]*\n"
TERM = r"[a-z]+|[0-9]+(?:\.[0-9]+)*"

# Licences, and the words by which headers name them or the paragraphs of their texts and notices.
TEMPLATES = [
    (["AGPL-3.0"], "This program is licensed under the GNU Affero General Public License, version 3."),
    (["AGPL-3.0"], "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    (["Apache-2.0"], "Licensed under the Apache License, Version 2.0."),
    (["Apache-2.0"], "SPDX-License-Identifier: Apache-2.0"),
    (["Apache-2.0"], "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    (["Apache-2.0"], "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    (["BSD-2-Clause"], "Released under the BSD 2-Clause License."),
    (["BSD-3-Clause"], "Released under the BSD 3-Clause License."),
    (["BSD-2-Clause", "BSD-3-Clause"], "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    (["BSD-2-Clause", "BSD-3-Clause"], "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    (["BSD-2-Clause", "BSD-3-Clause"], "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    (["BSD-3-Clause"], "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    (["BSD-2-Clause", "BSD-3-Clause"], "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    (["CC-BY-4.0"], "Licensed under CC BY 4.0."),
    (["CC-BY-4.0"], "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    (["CC-BY-NC-4.0"], "Licensed under CC BY-NC 4.0."),
    (["CC-BY-NC-4.0"], "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    (["CC-BY-SA-4.0"], "Licensed under CC BY-SA 4.0."),
    (["CC-BY-SA-4.0"], "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    (["CC0-1.0"], "Dedicated to the public domain under CC0 1.0."),
    (["GPL-2.0"], "This work is licensed under the GNU General Public License, version 2."),
    (["GPL-2.0"], "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    (["GPL-3.0"], "This work is licensed under the GNU General Public License, version 3."),
    (["GPL-3.0"], "SPDX-License-Identifier: GPL-3.0-only"),
    (["GPL-3.0"], "GPL-3.0-only"),
    (["GPL-3.0"], "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    (["ISC"], "Released under the ISC License."),
    (["ISC"], "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    (["LGPL-3.0"], "This library is licensed under the GNU Lesser General Public License, version 3."),
    (["MIT"], "Released under the MIT License."),
    (["MIT"], "SPDX-License-Identifier: MIT"),
    (["MIT"], "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    (["MIT"], "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    (["MIT"], "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    (["MIT"], "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    (["MPL-2.0"], "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    (["Proprietary"], "All rights reserved."),
    (["Unlicense"], "This is free and unencumbered software released into the public domain."),
    (["Unlicense"], "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
]


def terms(text: str | Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def templates(spark: SparkSession) -> DataFrame:
    """template (a number), licences and unit of the fixed list."""
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(TEMPLATES)], "template int, licences array<string>, unit string")


def frequencies(files: DataFrame) -> tuple[DataFrame, Column]:
    """df: the number of files that have each term; and the weight of a term with ``df``."""
    counted = written(files.select(F.explode(F.array_distinct(terms("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df")))
    return counted, F.log(F.lit(1.0 + files.count()) / (1 + F.coalesce("df", F.lit(0)))) + 1


def template_index(spark: SparkSession, counted: DataFrame, idf: Column) -> DataFrame:
    """term, template and its weight in the template's unit vector; ``leads``: units without the leading terms can't match."""
    own = templates(spark).select("template", F.explode(terms("unit")).alias("term")).groupBy("template", "term").agg(F.count("*").alias("tf"))
    # The templates are a list of this module: a few hundred rows, whatever the input.
    weighed = counted.join(F.broadcast(own.select("term").distinct()), "term").join(own, "term", "right").withColumn("w", F.col("tf") * idf)
    unit = weighed.withColumn("v", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("template"))))
    up_to = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("template").orderBy("v", "term")))
    return cut_lineage(unit.select("term", "template", "v", (up_to >= LEAST - 1e-6).alias("leads")))


def may_match(index: DataFrame) -> Callable[[Column], Column]:
    """Whether a unit can reach LEAST: its cosine to a template is at most the norm of the template's weights on the unit's terms."""
    squares: dict[str, list[float]] = {}
    leading = set()
    for r in index.collect():  # of the list of templates
        squares.setdefault(r["term"], [0.0] * len(TEMPLATES))[r["template"]] += r["v"] * r["v"]
        leading.update([r["term"]] * r["leads"])
    listed = lambda found: F.array(*[F.lit(t) for t in sorted(found)])
    every, leads, of_term = listed(squares), listed(leading), F.from_json(F.lit(json.dumps(squares)), "map<string,array<double>>")
    add = lambda sums, term: F.zip_with(sums, F.element_at(of_term, term), lambda a, b: a + b)

    def able(own: Column) -> Column:
        bounds = F.aggregate(F.array_intersect(own, every), F.array_repeat(F.lit(0.0), len(TEMPLATES)), add)
        return F.arrays_overlap(own, leads) & (F.array_max(bounds) >= LEAST * LEAST - 1e-6)

    return lambda unit: F.exists(F.array(terms(unit)), able)


def matched_units(units: DataFrame, counted: DataFrame, idf: Column, index: DataFrame) -> DataFrame:
    """unit_key, template, cosine and weight of the distinct units (unit_key, unit) that reach LEAST."""
    own = units.select("unit_key", F.explode(terms("unit")).alias("term")).groupBy("unit_key", "term").agg(F.count("*").alias("tf"))
    side = own.join(counted, "term").select("unit_key", "term", (F.col("tf") * idf).alias("w"))
    norm = side.groupBy("unit_key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dot = side.join(F.broadcast(index), "term").groupBy("unit_key", "template").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    cosine = dot.join(norm, "unit_key").select("unit_key", "template", F.round(F.col("dot") / F.col("norm"), 9).alias("cosine"), "norm").filter(F.col("cosine") >= LEAST)
    best = F.min(F.struct((-F.col("cosine")).alias("order"), "template", "norm")).alias("best")
    return cosine.groupBy("unit_key").agg(best).select("unit_key", "best.template", (-F.col("best.order")).alias("cosine"), (-F.col("best.order") * F.col("best.norm")).alias("weight"))


def directories(path: str) -> Column:
    """The ancestor directories of a path, the root (empty) first."""
    parts = F.split(F.col(path), "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def pieces(text: str) -> Column:
    """The units of a text: paragraph (its number), lines (units that the paragraph has), whole (the paragraph itself), unit."""
    cut = lambda p: F.filter(F.transform(F.split(p, UNITS, -1), lambda u: F.trim(u)), lambda u: u != "")

    def of_paragraph(lines: Column, number: Column) -> Column:
        one = lambda u, whole: F.struct(number.alias("paragraph"), F.size(lines).alias("lines"), F.lit(whole).alias("whole"), u.alias("unit"))
        joined = F.filter(F.array(F.array_join(lines, " ")), lambda u: F.size(lines) > 1)
        return F.concat(F.transform(lines, lambda u: one(u, False)), F.transform(joined, lambda u: one(u, True)))

    return F.flatten(F.transform(F.transform(F.split(text, PARAGRAPHS, -1), cut), of_paragraph))


def own_licences(said: DataFrame, of_unit: DataFrame, known: DataFrame) -> DataFrame:
    """row_key, licence, cosine and ``whole`` (a licence file) of the files (row_key, n_units, units) with a matched unit."""
    speaking = said.filter(F.size("units") > 0).dropDuplicates(["row_key"]).select("row_key", "n_units", F.inline("units")).withColumn("unit_key", unit_key("unit"))
    hits = lookup(speaking.drop("unit"), of_unit, ["unit_key"], "inner").drop("unit_key")
    votes = hits.join(F.broadcast(known.select("template", F.explode("licences").alias("licence"))), "template")
    counted = votes.groupBy("row_key", "licence").agg(F.round(F.sum("weight"), 6).alias("votes"), F.max("cosine").alias("cosine"))
    best = counted.groupBy("row_key").agg(F.min(F.struct((-F.col("votes")).alias("order"), "licence", "cosine")).alias("best"))
    covered = hits.groupBy("row_key", "n_units", "paragraph", "lines").agg(F.max("whole").alias("whole"), F.count_if(~F.col("whole")).alias("n"))
    covered = covered.groupBy("row_key", "n_units").agg(F.sum(F.when(F.col("whole"), F.col("lines")).otherwise(F.col("n"))).alias("n"))
    speaks_for_all = F.col("row_key.path").rlike(LICENCE_NAME) | (F.col("n") == F.col("n_units"))
    return best.join(covered, "row_key").select("row_key", "best.licence", "best.cosine", speaks_for_all.alias("for_all"))


def unit_key(unit: str) -> Column:
    return F.struct(F.md5(F.col(unit).cast("binary")).alias("a"), F.xxhash64(unit).alias("b"))


def nearest_folders(said: DataFrame, own: DataFrame) -> DataFrame:
    """own_folder, n (files in it), and the nearest directory at or above it that a licence file speaks for."""
    folder = F.when(F.col("row_key.path").contains("/"), F.expr("substring(row_key.path, 1, length(row_key.path) - length(substring_index(row_key.path, '/', -1)) - 1)")).otherwise(F.lit(""))
    of_folder = own.filter("for_all").withColumn("folder", folder).groupBy("folder").agg(F.min(F.struct((-F.col("cosine")).alias("order"), "licence")).alias("best"))
    of_folder = of_folder.select("folder", F.col("best.licence").alias("above"), (-F.col("best.order")).alias("above_cosine"))
    # Nearest ancestor for each distinct directory, not for each file.
    holding = said.filter("path != ''").groupBy(F.element_at(directories("path"), -1).alias("own_folder")).agg(F.count("*").alias("n"))
    upward = cut_lineage(holding.withColumn("file", F.concat("own_folder", F.lit("/x"))).select("own_folder", "n", F.posexplode(directories("file")).alias("depth", "folder")))
    below = upward.groupBy("folder").agg(F.count("*").alias("n"))  # the root lies above every directory
    nearest = lookup(upward.withColumnRenamed("n", "files"), of_folder.join(below, "folder"), ["folder"], "inner")
    nearest = nearest.groupBy("own_folder", "files").agg(F.max(F.struct("depth", "folder", "above", "above_cosine")).alias("near"))
    return nearest.select("own_folder", F.col("files").alias("n"), F.col("near.folder").alias("from_folder"), "near.above", "near.above_cosine")


def scan(files: DataFrame) -> DataFrame:
    """``files`` (path, text, other columns) without text, with licence, cosine, evidence and licence_from.

    evidence: ``header``, ``file`` (a licence file), ``inherited`` or ``none``; licence_from: the directory it comes from.
    """
    spark = files.sparkSession
    columns = [c for c in files.columns if c not in ("path", "text", "licence", "cosine", "evidence", "licence_from")]
    path = F.coalesce("path", F.lit(""))
    known = templates(spark)
    counted, idf = frequencies(files)
    index = template_index(spark, counted, idf)
    able = may_match(index)
    # Other columns travel in one struct, so that their names clash with none of the steps below.
    rows = files.select(F.struct(F.col("path"), *[F.col(f"`{c}`") for c in columns]).alias("kept"), path.alias("path"), F.struct(path.alias("path"), F.xxhash64("text").alias("hash")).alias("row_key"), pieces("text").alias("units"))
    said = cut_lineage(rows.select("kept", "path", "row_key", F.coalesce(F.size(F.filter("units", lambda u: ~u["whole"])), F.lit(0)).alias("n_units"), F.coalesce(F.filter("units", lambda u: able(u["unit"])), F.array()).alias("units")))
    distinct = said.select(F.explode("units.unit").alias("unit")).groupBy(unit_key("unit").alias("unit_key")).agg(F.first("unit").alias("unit"), F.count("*").alias("n"))
    distinct = cut_lineage(distinct)
    of_unit = matched_units(distinct.drop("n"), counted, idf, index).join(distinct.select("unit_key", "n"), "unit_key")
    own = cut_lineage(own_licences(said, of_unit, known))
    nearest = nearest_folders(said, own)
    slim = said.select("kept", "row_key", F.when(F.col("path") != "", F.element_at(directories("path"), -1)).alias("own_folder"))
    repeated = said.groupBy("row_key").agg(F.count("*").alias("n"))
    both = lookup(lookup(slim, own.join(repeated, "row_key"), ["row_key"]), nearest, ["own_folder"])
    has = F.col("licence").isNotNull()
    evidence = F.when(has & F.col("for_all"), "file").when(has, "header").when(F.col("above").isNotNull(), "inherited").otherwise("none")
    return both.select(
        "kept.*", F.coalesce("licence", "above").alias("licence"), F.coalesce("cosine", "above_cosine").alias("cosine"),
        evidence.alias("evidence"), F.when(~has, F.col("from_folder")).alias("licence_from"),
    )


def of_documents(documents: DataFrame) -> DataFrame:
    """The documents as files: a directory for each source and language."""
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return documents.select("doc_id", path.alias("path"), "text")
