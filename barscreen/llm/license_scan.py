"""Licence notices by sparse TF-IDF cosine, and licences inherited from directories.

Built-in functions only. Every line of a file is a candidate notice and is compared with short
licence texts; every paragraph of several lines, the leading comment and the whole of a licence
file are compared with these and with fuller texts. A cosine of ``threshold`` can't come from a template's commonest words alone, so
only those with one of its rarer words are scored. A licence file speaks for its directory; a
file without a notice of its own takes the licence of the nearest directory above it that has
one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import staged

# fixed values: short notices by SPDX identifier
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
    "the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, "
    "this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the "
    "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
    "materials provided with the distribution. "
)
_BSD_3 = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission. "
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED '
    "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
    "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
    "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER "
    "CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
    "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_GNU = (
    "This {0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1} as published "
    "by the Free Software Foundation, either version {2} of the License, or (at your option) any later version. "
    "This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
    "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1} for more details. "
    "You should have received a copy of the GNU {1} along with this {0}. If not, see http://www.gnu.org/licenses/."
)
# fixed values: bodies, headers of several lines and the titles of licence files
FULLER = (
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
     'associated documentation files (the "Software"), to deal in the Software without restriction, including without '
     "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
     "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
     "The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
     'the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT '
     "NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO "
     "EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN "
     "ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR "
     "OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
     "hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE "
     'SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL '
     "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
     "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR "
     "PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION "
     "WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-2-Clause", _BSD + _BSD_END),
    ("BSD-3-Clause", _BSD + _BSD_3 + _BSD_END),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
     "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
     "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed "
     'on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for '
     "the specific language governing permissions and limitations under the License."),
    ("GPL-2.0", _GNU.format("program", "General Public License", "2")),
    ("GPL-3.0", _GNU.format("program", "General Public License", "3")),
    ("LGPL-2.1", _GNU.format("library", "Lesser General Public License", "2.1")),
    ("LGPL-3.0", _GNU.format("library", "Lesser General Public License", "3")),
    ("AGPL-3.0", _GNU.format("program", "Affero General Public License", "3")),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the "
     "MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public "
     "License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
)
COMMENT = r"^\s*(#|//|/\*|\*|--|;|%|<!--|$)"
LICENSE_FILE = r"(?i)^(licen[sc]e|copying|notice)([^a-z].*)?$"
THRESHOLD = 0.7


def terms(line: Column) -> Column:
    """Runs of letters and digits in lower case."""
    return F.array_remove(F.split(F.lower(line), r"[^\p{L}\p{N}]+", -1), "")


def _templates(spark: SparkSession) -> DataFrame:
    """(template, license, term, tf): as many rows as the templates have words."""
    rows = [
        F.struct(F.lit(i).alias("template"), F.lit(name).alias("license"), F.lit(text).alias("text"))
        for i, (name, text) in enumerate(TEMPLATES + FULLER)
    ]
    words = spark.range(1).select(F.inline(F.array(*rows)))
    words = words.select("template", "license", F.explode(terms(F.col("text"))).alias("term"))
    return words.groupBy("template", "license", "term").agg(F.count("*").alias("tf"))


def _lines(files: DataFrame) -> DataFrame:
    lines = files.select("path", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return lines.filter(F.col("line").rlike(r"[\p{L}\p{N}]")).select("path", "pos", terms(F.col("line")).alias("terms"))


def _blocks(files: DataFrame) -> DataFrame:
    """(path, kind, pos, terms): 1 paragraphs of several lines, 2 leading comments, 3 licence files.

    Lines without a letter or digit separate paragraphs.
    """
    of = F.col("text")
    several = F.filter(F.split(of, r"\n[^\p{L}\p{N}]*\n", -1), lambda p: p.contains("\n"))
    lines = F.split(of, "\n", -1)
    code = F.array_position(F.transform(lines, lambda x: ~x.rlike(COMMENT)), True)
    head = F.when(code != 1, F.array_join(F.when(code == 0, lines).otherwise(F.slice(lines, 1, F.greatest(code - 1, F.lit(0)).cast("int"))), "\n"))
    whole = F.when(F.regexp_extract("path", r"[^/]*$", 0).rlike(LICENSE_FILE), of)
    block = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    blocks = F.concat(F.transform(several, lambda p: block(1, p)), F.array(block(2, head), block(3, whole)))
    rows = files.filter(of.isNotNull()).select("path", F.posexplode(blocks).alias("pos", "block"))
    return rows.filter("block.text IS NOT NULL").select("path", "block.kind", "pos", terms(F.col("block.text")).alias("terms"))


def notices(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(path, kind, pos, license, score) of what is a notice in ``files`` (path, text).

    kind: 0 a line (pos: its number), else as in ``_blocks``; lines meet the short texts only.

    Weights are term count times ln((lines + 1) / (lines with the term + 1)), counted over all
    lines with a letter or digit. Of equal scores the first template wins. Lines are what
    ``\\n`` separates.
    """
    spark = files.sparkSession
    lines = _lines(files)
    # one row for each word of all lines, and one for the number of lines
    seen = lines.select(F.explode(F.concat(F.array(F.lit("")), F.array_distinct("terms"))).alias("term"))
    counts = staged(seen.groupBy("term").agg(F.count("*").alias("df")), "term-counts")
    total = counts.filter("term = ''").select((F.col("df") + 1).alias("total"))
    words = _templates(spark)
    one = total.agg(F.max("total").alias("total"))
    rare = one.select(F.log(F.coalesce("total", F.lit(1)).cast("double")).alias("most"))
    most = rare.first()["most"]  # a single number
    known = counts.join(F.broadcast(words.select("term").distinct()), "term")
    weighted = words.join(F.broadcast(known), "term", "left").select(
        "template", "license", "term", "tf",
        (F.lit(most) - F.log(F.coalesce("df", F.lit(0)).cast("double") + 1)).alias("idf"),
    )
    weighted = weighted.withColumn("w", F.col("tf") * F.col("idf"))
    # words in ascending weight: those that together stay below the threshold can't decide
    up = Window.partitionBy("template").orderBy("w", "term").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("template")
    weighted = staged(
        weighted.withColumns(
            {
                "common": F.sum(F.col("w") * F.col("w")).over(up),
                "square": F.sum(F.col("w") * F.col("w")).over(whole),
            }
        ).select(
            "template", "license", "term", "idf",
            F.try_divide("w", F.sqrt("square")).alias("part"),
            (F.col("common") >= F.lit(threshold * threshold * (1 - 1e-9)) * F.col("square")).alias("anchor"),
        ),
        "templates",
    )
    # the templates are fixed: these lists are no longer than their words
    found = weighted.filter("anchor").groupBy("term").agg(F.min("template").alias("first")).sort("term").collect()
    short = len(TEMPLATES)

    def holding(rows: DataFrame, anchors: list[str]) -> DataFrame:
        return rows.filter(F.arrays_overlap("terms", F.array(*[F.lit(a) for a in anchors]).cast("array<string>")))

    candidates = holding(lines.select("path", F.lit(0).alias("kind"), "pos", "terms"), [r["term"] for r in found if r["first"] < short])
    candidates = candidates.unionByName(holding(_blocks(files), [r["term"] for r in found]))
    # the vocabulary is not bounded: its join with the candidates' words is left to Spark
    idf = counts.select("term", (F.lit(most) - F.log(F.col("df").cast("double") + 1)).alias("idf"))
    parts = (
        candidates.select("path", "kind", "pos", F.explode("terms").alias("term"))
        .groupBy("path", "kind", "pos", "term")
        .agg(F.count("*").alias("tf"))
        .join(idf, "term")
        .select("path", "kind", "pos", "term", (F.col("tf") * F.col("idf")).alias("w"))
    )
    parts = staged(parts, "line-terms")
    norms = parts.groupBy("path", "kind", "pos").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = (
        parts.join(F.broadcast(weighted.select("template", "license", "term", "part")), "term")
        .filter((F.col("template") < short) | (F.col("kind") > 0))
        .groupBy("path", "kind", "pos", "template", "license")
        .agg(F.sum(F.col("w") * F.col("part")).alias("dot"))
    )
    best = F.max_by("license", F.struct("score", -F.col("template")))
    return (
        dots.join(norms, ["path", "kind", "pos"])
        # rounded before it is compared, so that the order of a sum can't decide
        .withColumn("score", F.round(F.try_divide("dot", "norm"), 6))
        .filter(F.col("score") >= threshold)
        .groupBy("path", "kind", "pos")
        .agg(best.alias("license"), F.max("score").alias("score"))
    )


def _directory(path: Column) -> Column:
    """What stands before the last slash; empty for a bare name."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def inherited(found: DataFrame, directories: DataFrame) -> DataFrame:
    """(directory, license, origin) from the nearest directory at or above with a licence file.

    ``found``: path, license, score of files; ``directories``: distinct directories. Of several
    licence files in a directory the best score counts, then the first path.
    """
    name = F.regexp_extract("path", r"[^/]*$", 0)
    named = found.filter(name.rlike(LICENSE_FILE)).select(_directory(F.col("path")).alias("origin"), "path", "license", "score")
    order = Window.partitionBy("origin").orderBy(F.desc("score"), "path")
    # licence files of one directory; Spark cuts each task's rows to the first before the shuffle
    speaks = named.withColumn("rank", F.row_number().over(order)).filter("rank = 1").select("origin", "license")
    parts = F.split("directory", "/", -1)
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return (
        directories.select("directory", F.posexplode(above).alias("depth", "origin"))
        .join(speaks, "origin")
        .groupBy("directory")
        .agg(F.max_by("license", "depth").alias("license"), F.max_by("origin", "depth").alias("origin"))
    )


def scan(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``files`` (path, text, ...) with a struct column ``license_scan`` added at the end.

    license: of the file's best notice (the first of equals), else of the nearest directory;
    score: of the notice; origin: ``notice``, ``directory`` or null; directory: where an
    inherited licence comes from ('' is the root); n_notices:
    lines, or paragraphs if no line is one, else 1. Rows that share a path, null
    included, are one file; null texts have no notices.
    """
    lines = notices(files.select("path", "text"), threshold)
    own = lines.groupBy("path").agg(
        F.max_by("license", F.struct("score", -F.col("kind"), -F.col("pos"))).alias("license"),
        F.max("score").alias("score"),
        F.coalesce(*[F.nullif(F.count_if(F.col("kind") == k), F.lit(0)) for k in range(4)]).alias("n_notices"),
    )
    own = staged(own, "notices")
    directories = files.select(_directory(F.col("path")).alias("directory")).filter("directory IS NOT NULL").distinct()
    # written before the files are joined: one stage doing both holds the sorts and maps of both
    above = staged(inherited(own, directories), "directories").select(
        F.col("directory").alias("of"), F.col("license").alias("inherited"), "origin"
    )
    own = own.withColumnRenamed("path", "own_path")
    row = F.struct("*").alias("row")
    rows = files.select(row, F.col("path").alias("key"), _directory(F.col("path")).alias("dir"))
    joined = rows.join(own, rows["key"].eqNullSafe(own["own_path"]), "left").join(
        above, rows["dir"] == above["of"], "left"
    )
    has_own = F.col("license").isNotNull()
    return joined.select(
        "row.*",
        F.struct(
            F.coalesce("license", "inherited").alias("license"),
            F.col("score").alias("score"),
            F.when(has_own, F.lit("notice")).when(F.col("inherited").isNotNull(), F.lit("directory")).alias("origin"),
            F.when(~has_own, F.col("origin")).alias("directory"),
            F.coalesce("n_notices", F.lit(0)).cast("bigint").alias("n_notices"),
        ).alias("license_scan"),
    )


def with_paths(docs: DataFrame) -> DataFrame:
    """(doc_id, path, text): documents laid out as a tree of files.

    source / thousand / hundred / name; a document whose first or last line speaks of a licence
    is named as a licence file.
    """
    ends = F.concat_ws(" ", F.substring_index("text", "\n", 1), F.substring_index("text", "\n", -1))
    name = F.when(ends.rlike(r"(?i)\blicen[sc]ed?\b"), F.lit("LICENSE-")).otherwise(F.lit(""))
    part = [F.col("source"), *[F.floor(F.col("doc_id") / n).cast("string") for n in (1000, 100)]]
    return docs.select("doc_id", F.concat_ws("/", *part, F.concat(name, F.col("doc_id").cast("string"))).alias("path"), "text")


def documents_scan(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, license, score, origin, directory, n_notices) for every row of ``docs``."""
    found = scan(with_paths(docs), threshold)
    return found.select("doc_id", *[F.col(f"license_scan.{c}") for c in ("license", "score", "origin", "directory", "n_notices")])
