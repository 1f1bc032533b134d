"""Licence scans: sparse TF-IDF cosine to licence templates, inherited by directory.

A file is compared with each template as a header and, if it is named like a licence file
(``LICENSE``, ``COPYING``), as a whole. A header is a run of 1, 2, 4 .. 32 lines without their comment marks, so a
notice wrapped over several lines, or in the midst of other text, is one vector. Terms weigh (1 + ln frequency) times
inverse document frequency over all files and template wordings; the best template above the threshold whose
version terms are all there is the file's licence. A file without one takes that of its nearest
ancestor directory with a licence file, found by joining the ancestors with the licensed directories.

Which runs can match follows from the threshold: a vector without any of a wording's heaviest terms, those
that leave less than ``least`` of its norm, has a lower cosine (Cauchy-Schwarz). Only runs from a line
with such an anchor are formed. A run that begins earlier has the same anchor in a shorter run.

Only DataFrame expressions are used. Equal runs, of which there are few however many
files carry them, are compared once. The join with the templates is on words; templates
are a fixed, short list, so no pair of file and template that shares no word is ever formed. A
directory with a third of all files is a key with one row on the licence side, which Spark
splits or broadcasts.

Defined cases: null text has no header; a null path has no directory and inherits nothing; empty path segments are
dropped; of several licence files in a directory, the one with the highest cosine (then smallest licence name) counts;
repeated rows are scanned alike. Other columns pass through.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowmill.functions.arrays import let
from flowmill.llm.graph import small_enough
from flowmill.session import save_and_reload

BROADCAST_ROWS = 200_000
RUNS = (1, 2, 4, 8, 16, 32)  # lines of a header
COMMENT = r"^[\s#*/;%!<>-]+|[\s*/>-]+$"
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|unlicense|notice)([.\-_].*)?$"
WORD = r"[\p{L}\p{N}]+"

_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the Software), to deal in the Software without restriction, including without limitation the "
    "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
    "permit persons to whom the Software is furnished to do so, subject to the following conditions:")
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list "
    "of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
    "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
    "with the distribution.")
_BSD_NAMES = (
    " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission.")
_BSD_END = (
    " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, "
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")


def _gnu(kind: str, version: str, title: str) -> tuple[str, ...]:
    """Short forms, title and source notice of a GNU licence."""
    name = f"GNU {kind}General Public License"
    program = "This library" if kind == "Lesser " else "This program"
    return (
        f"licensed under the {name}, version {version}", f"{name} version {version}, {title}",
        f"{program} is free software: you can redistribute it and/or modify it under the terms of the {name} as published "
        f"by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. "
        f"{program} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
        f"warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details. You should have "
        f"received a copy of the {name} along with {program.lower()}.",
        f"you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software "
        f"Foundation, either version {version} of the License, or (at your option) any later version.")


#: (licence, terms that must be there, wordings): public short forms, notices and texts. Fixed values.
TEMPLATES = (
    ("Apache-2.0", "2 0", (
        "Licensed under the Apache License, Version 2.0", "Apache License Version 2.0, January 2004",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        "applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License.",
        "SPDX-License-Identifier: Apache-2.0")),
    ("MIT", "", (
        "Released under the MIT License", "Licensed under the MIT License", "SPDX-License-Identifier: MIT", _GRANT,
        _GRANT + " The above copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, "
        "INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
        "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
        "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")),
    ("ISC", "", (
        "Licensed under the ISC License", "SPDX-License-Identifier: ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS "
        "PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES "
        "OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
        "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF "
        "CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS "
        "SOFTWARE.")),
    ("BSD-2-Clause", "", (_BSD, _BSD + _BSD_END)),
    ("BSD-2-Clause", "2", ("Licensed under the BSD 2-Clause License", "SPDX-License-Identifier: BSD-2-Clause")),
    ("BSD-3-Clause", "endorse", (_BSD + _BSD_NAMES, _BSD + _BSD_NAMES + _BSD_END)),
    ("BSD-3-Clause", "3", ("Licensed under the BSD 3-Clause License", "SPDX-License-Identifier: BSD-3-Clause")),
    ("GPL-2.0", "2", (*_gnu("", "2", "June 1991"), "SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-or-later")),
    ("GPL-3.0", "3", (*_gnu("", "3", "29 June 2007"), "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-or-later",
                      "This work is licensed under the GNU General Public License, version 3")),
    ("LGPL-2.1", "2 1", (*_gnu("Lesser ", "2.1", "February 1999"), "SPDX-License-Identifier: LGPL-2.1-only", "SPDX-License-Identifier: LGPL-2.1-or-later")),
    ("LGPL-3.0", "3", (*_gnu("Lesser ", "3", "29 June 2007"), "SPDX-License-Identifier: LGPL-3.0-only", "SPDX-License-Identifier: LGPL-3.0-or-later")),
    ("AGPL-3.0", "3", (*_gnu("Affero ", "3", "19 November 2007"), "SPDX-License-Identifier: AGPL-3.0-only", "SPDX-License-Identifier: AGPL-3.0-or-later")),
    ("MPL-1.1", "1", ("Mozilla Public License Version 1.1", "SPDX-License-Identifier: MPL-1.1")),
    ("MPL-2.0", "2 0", (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Mozilla Public License Version 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "SPDX-License-Identifier: MPL-2.0")),
    ("CC-BY-4.0", "4 0", ("Licensed under CC BY 4.0", "Creative Commons Attribution 4.0 International License")),
    ("CC-BY-SA-4.0", "4 0", ("Licensed under CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License")),
    ("CC-BY-NC-4.0", "4 0", ("Licensed under CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License")),
    ("CC0-1.0", "1 0", ("CC0 1.0 Universal public domain dedication", "SPDX-License-Identifier: CC0-1.0")),
    ("Unlicense", "", (
        "This is free and unencumbered software released into the public domain", "SPDX-License-Identifier: Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
        "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
        "commercial or non-commercial, and by any means.")),
)


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def template_table(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """(template, wording, must, term, n)."""
    rows = [(name, f"{name}#{at}.{i}", must.split(), w)
            for at, (name, must, wordings) in enumerate(templates) for i, w in enumerate(wordings)]
    table = spark.createDataFrame(rows, "template string, wording string, must array<string>, text string")
    return table.select("template", "wording", "must", F.explode(_terms(F.col("text"))).alias("term")).groupBy(
        "template", "wording", "must", "term").agg(F.count(F.lit(1)).alias("n"))


def term_weights(texts: DataFrame, known: DataFrame) -> DataFrame:
    """(term, idf) over all texts and wordings, each counting a term once."""
    own = texts.select(F.explode(F.array_distinct(_terms(F.col("text")))).alias("term"))
    spread = own.unionAll(known.select("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    every = texts.count() + known.select("wording").distinct().count()
    return spread.select("term", (F.ln((F.lit(every) + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def _weighed(counted: DataFrame, idf: DataFrame, key: str) -> DataFrame:
    """``counted`` (.., term, n) with weight ``w`` and the norm of its ``key``."""
    rows = counted.join(idf, "term").withColumn("w", (F.lit(1.0) + F.ln("n")) * F.col("idf")).drop("n", "idf")
    norm = rows.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return rows.join(norm, key)


def anchors(weighed: DataFrame, least: float) -> list[str]:
    """The terms of which a vector needs one to reach ``least``; as many as the templates have at most.

    From the lightest term on, terms are left out while their norm stays below ``least`` of the wording's.
    """
    lightest = Window.partitionBy("wording").orderBy("w", F.desc("term"))
    light = F.sqrt(F.sum(F.col("w") * F.col("w")).over(lightest))
    needed = weighed.withColumn("light", light).filter(F.col("light") >= F.col("norm") * (least - 1e-6))
    return sorted(r.term for r in needed.select("term").distinct().collect())


def header_runs(text: Column, terms: list[str]) -> Column:
    """The distinct runs of lines, each from a line with one of the terms."""
    after: dict[str, list[str]] = {}  # by first letter, so that few alternatives are tried at a word
    for term in terms:
        after.setdefault(term[0], []).append(re.escape(term[1:]))
    words = "|".join(f"{re.escape(first)}(?:{'|'.join(rest)})" for first, rest in after.items())
    near = rf"(?i)(?<![\p{{L}}\p{{N}}])(?:{words})(?![\p{{L}}\p{{N}}])"
    plain = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, COMMENT, ""), r"\s+", " "))
    lines = F.split(F.coalesce(text, F.lit("")), "\n")

    def runs(lines):
        starts = F.filter(F.sequence(F.lit(1), F.size(lines)), lambda i: F.rlike(F.element_at(lines, i), F.lit(near)))
        return F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(
            *(F.array_join(F.transform(F.slice(lines, i, F.lit(n)), plain), " ") for n in RUNS)))))

    return let(lines, runs)


def run_licences(runs: DataFrame, known: DataFrame, idf: DataFrame, *, least: float) -> DataFrame:
    """(key, licence, cosine) of distinct runs (key, run) that reach the threshold; ``known`` is the weighed templates.

    Rows of all terms meet the weights once, under the number of their run, and leave only sums for its norm. Those of
    the templates' terms, which the products need, meet the templates where they are.
    """
    counted = runs.withColumn("no", F.monotonically_increasing_id()).select(
        "key", "no", F.explode(_terms(F.col("run"))).alias("term")).groupBy("key", "no", "term").agg(F.count(F.lit(1)).alias("n"))
    counted = save_and_reload(counted, "run-terms")
    met = idf.join(counted.select("term").distinct(), "term")
    weight = (F.lit(1.0) + F.ln("n")) * F.col("idf")
    weighed = counted.select("no", "term", "n").join(small_enough(save_and_reload(met, "idf"), BROADCAST_ROWS), "term")
    norms = weighed.select("no", weight.alias("w")).groupBy("no").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    # The templates are a fixed list of some thousand terms.
    theirs = idf.join(F.broadcast(known), "term").select(
        "wording", F.array_contains("must", F.col("term")).alias("must"), "term", "idf", F.col("w").alias("v"))
    wordings = known.select("template", "wording", F.size("must").alias("musts"), F.col("norm").alias("their_norm")).distinct()
    dots = counted.select("no", "term", "n").join(F.broadcast(theirs), "term").withColumn("w", weight).groupBy("no", "wording").agg(
        F.sum(F.col("v") * F.col("w")).alias("dot"), F.count_if("must").alias("there")).join(
        F.broadcast(wordings), "wording").filter(F.col("there") == F.col("musts")).join(norms, "no")
    cosine = F.round(F.col("dot") / F.col("norm") / F.col("their_norm"), 9)
    near = dots.withColumn("cosine", cosine).filter(F.col("cosine") >= least).join(counted.select("key", "no").distinct(), "no")
    best = near.groupBy("key").agg(F.min(F.struct((-F.col("cosine")).alias("less"), F.col("template").alias("licence"))).alias("best"))
    return best.select("key", "best.licence", (-F.col("best.less")).alias("cosine"))


def scan_licences(files: DataFrame, *, path_col: str = "path", text_col: str = "text", templates=TEMPLATES,
                  least: float = 0.6, keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep``, path, own_licence, cosine, directory, licence, origin of every file.

    ``origin`` is header, file (a licence file), inherited or none; ``directory`` is the one a licence was
    inherited from, the empty string being the root.
    """
    path = F.col(path_col).cast("string")
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    text = F.col(text_col).cast("string")
    known = template_table(files.sparkSession, templates)
    idf = save_and_reload(term_weights(files.select(text.alias("text")), known), "idf")
    known = save_and_reload(_weighed(known, idf, "wording"), "templates")
    is_file = F.coalesce((F.size(parts) > 0) & F.rlike(F.element_at(parts, -1), F.lit(LICENCE_FILE)), F.lit(False))
    runs = header_runs(text, anchors(known, least))
    whole = F.when(is_file & text.isNotNull(), F.array(text)).otherwise(F.array().cast("array<string>"))
    rows = files.select(
        *keep, path.alias("path"), parts.alias("_parts"), F.array_union(runs, whole).alias("_runs"),
        F.monotonically_increasing_id().alias("_row"))
    rows = save_and_reload(rows, "files")
    spoken = rows.select("_row", F.explode("_runs").alias("run")).withColumn("key", F.md5("run"))
    found = run_licences(spoken.select("key", "run").dropDuplicates(["key"]), known, idf, least=least)
    found = small_enough(save_and_reload(found, "found"), BROADCAST_ROWS)
    best = spoken.select("_row", "key").join(found, "key").groupBy("_row").agg(
        F.min(F.struct((-F.col("cosine")).alias("less"), "licence")).alias("best"))
    own = rows.drop("_runs").join(best, "_row", "left").select(
        *keep, "path", "_row", "_parts", F.col("best.licence").alias("own_licence"), (-F.col("best.less")).alias("cosine"))
    own = save_and_reload(own, "files")

    name = F.element_at("_parts", -1)
    holds = own.filter(F.col("own_licence").isNotNull() & (F.size("_parts") > 0) & F.rlike(name, F.lit(LICENCE_FILE)))
    folder = F.array_join(F.slice("_parts", 1, F.greatest(F.size("_parts") - 1, F.lit(0))), "/")
    licensed = holds.groupBy(folder.alias("directory")).agg(
        F.min(F.struct((-F.col("cosine")).alias("less"), F.col("own_licence").alias("licence"))).alias("best"))
    licensed = licensed.select("directory", F.col("best.licence").alias("above"))
    # Ancestors of the distinct directories, not of files: the nearest licensed one for each.
    without = own.filter(F.col("path").isNotNull()).select(folder.alias("folder"), F.slice(
        "_parts", 1, F.greatest(F.size("_parts") - 1, F.lit(0))).alias("steps")).distinct()
    ancestors = without.select("folder", F.explode(F.sequence(F.lit(0), F.size("steps"))).alias("depth"), "steps").select(
        "folder", "depth", F.array_join(F.expr("slice(steps, 1, depth)"), "/").alias("directory"))
    nearest = ancestors.join(small_enough(licensed, BROADCAST_ROWS), "directory").groupBy("folder").agg(
        F.max(F.struct("depth", "directory", "above")).alias("near"))
    met = own.withColumn("folder", F.when(F.col("path").isNotNull(), folder)).join(
        small_enough(nearest, BROADCAST_ROWS), "folder", "left")
    is_file = F.coalesce((F.size("_parts") > 0) & F.rlike(name, F.lit(LICENCE_FILE)), F.lit(False))
    origin = F.when(F.col("own_licence").isNotNull(), F.when(is_file, "file").otherwise("header")).when(
        F.col("near").isNotNull(), "inherited").otherwise("none")
    return met.select(
        *keep, "path", "own_licence", "cosine",
        F.when(origin == "inherited", F.col("near.directory")).alias("directory"),
        F.coalesce("own_licence", "near.above").alias("licence"), origin.alias("origin"))


def document_paths(docs: DataFrame) -> DataFrame:
    """Documents as files: source/lang/shelf/name, where each shelf's first document is its licence file.

    A shelf holds 64 ids, an aisle 16 shelves; the first of an aisle is the aisle's licence file.
    """
    ident = F.col("doc_id")
    aisle, shelf = F.expr("doc_id div 1024"), F.expr("doc_id div 64")
    base = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.concat(F.lit("a"), aisle))
    path = F.when(ident % 1024 == 0, F.concat_ws("/", base, F.lit("LICENSE"))).when(
        ident % 64 == 0, F.concat_ws("/", base, F.concat(F.lit("s"), shelf), F.lit("COPYING"))).otherwise(
        F.concat_ws("/", base, F.concat(F.lit("s"), shelf), F.coalesce("lang", F.lit("none")), F.concat(ident, F.lit(".txt"))))
    return docs.withColumn("path", F.when(ident.isNotNull(), path))
