"""Licence scan by sparse TF-IDF cosine to templates, and inheritance along directories.

Units are every line of a file that speaks of licences (its headers, wherever
they stand), that line with the one and with the two behind it, as notices wrap,
and, of a licence file, the whole text besides.  A unit's words are
weighted by their count and by how rare they are among all files; the product
with the templates' weights is a join on words with the few that templates
have.  A file without a licence of its own takes that of the nearest directory
above it which has a licence file: directories, not files, are expanded to
their ancestors and joined by path.  DataFrame functions only.
"""

from __future__ import annotations

import pkgutil
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns, durable

_DISCLAIM = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY "
    "AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
    "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_ENDORSE = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
#: Licence texts (fixed values), their wording without title and holder.
TEXTS = [
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished "
        "to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
        "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
        "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("BSD-2-Clause", _BSD + _DISCLAIM),
    ("BSD-3-Clause", _BSD + _ENDORSE + _DISCLAIM),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear "
        "in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT "
        "SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
        "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES "
        "OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the "
        "License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
        "FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program.",
    ),
]
#: Titles that licence files begin with (fixed values).
TITLES = [
    ("MIT", "The MIT License (MIT)"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
]
#: Whole texts of long licences, in the folder licenses (public documents, verbatim).
WHOLE = [("Apache-2.0", "Apache-2.0"), ("GPL-2.0", "GPL-2"), ("GPL-3.0", "GPL-3"), ("LGPL-2.1", "LGPL-2.1"), ("LGPL-3.0", "LGPL-3"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0")]


def whole_text(name: str) -> str:
    return pkgutil.get_data(__package__, f"licenses/{name}.txt").decode("utf-8")


#: Identifiers of which there is a line "SPDX-License-Identifier: ..." (fixed values).
SPDX = "MIT Apache-2.0 GPL-2.0 GPL-3.0 LGPL-3.0 AGPL-3.0 MPL-2.0 BSD-2-Clause BSD-3-Clause ISC CC0-1.0 CC-BY-4.0 CC-BY-NC-4.0 Unlicense".split()
#: Short notices by licence (fixed values; more than one wording each), and the above.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license. See the license file in the project root for license information."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it under the terms of the GNU General Public License version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("proprietary", "All rights reserved."),
    *TEXTS,
    *TITLES,
    *((x, f"SPDX-License-Identifier: {x}") for x in SPDX),
    *((x, whole_text(name)) for x, name in WHOLE),
]
#: What a line must hold to be a header.
SPEAKS = "licen[cs]e|copyright|rights reserved|spdx"
WORD = "[a-z0-9]+"
#: Least cosine of a match, and names of licence files.
LEAST, FILES = 0.7, "(?i)^(licen[cs]e|copying)([.].*)?$"


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), 1)


def license_scan(files: DataFrame, path_col: str = "path", text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES, least: float = LEAST, keep: tuple[str, ...] = ()) -> DataFrame:
    """path, license, via ('header', 'file' or 'inherited'), score, and the columns in ``keep``, for every row; license, via and score are null if there is none.

    The best template wins, ties to the first licence by name; so does the best
    unit of a file.  Rows with a null path or text have no licence of their own
    (a null path inherits none); rows that repeat a path are one file, whose
    units are all scored, and each has its row.  Texts are taken whole, and every
    word weighs by the number of files that hold it; an empty table gives an empty
    result.
    """
    spark = files.sparkSession
    kept = [f"keep_{i}" for i in range(len(keep))]
    rows = columns(files, path_col, text_col, *keep).toDF("path", "text", *kept)
    name = F.regexp_extract("path", "([^/]*)$", 1)
    where = F.when(F.col("path").contains("/"), F.regexp_extract("path", "^(.*)/[^/]*$", 1)).otherwise("")
    listed = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(templates)], "template int, license string, notice string")
    told = listed.select("template", "license", F.explode(_words(F.col("notice"))).alias("word")).groupBy("template", "license", "word").agg(F.count("*").alias("tf"))
    is_file = name.rlike(FILES)
    speaking = rows.where(F.col("path").isNotNull() & (F.lower("text").rlike(SPEAKS) | is_file)).withColumn("is_file", is_file)
    at = F.split("text", "\n", -1)
    from_here = F.transform(at, lambda x, i: F.when(F.lower(x).rlike(SPEAKS), F.array(*(F.array_join(F.slice(at, i + 1, n), "\n") for n in (1, 2, 3)))))
    lines = speaking.select("path", F.explode(F.flatten(F.filter(from_here, lambda x: x.isNotNull()))).alias("unit")).withColumn("via", F.lit("header"))
    whole = speaking.where("is_file AND text IS NOT NULL").select("path", F.col("text").alias("unit"), F.lit("file").alias("via"))
    # 16 bytes name a unit of a path, so that its words need not carry both
    key = F.substring(F.unhex(F.sha2(F.concat(F.sha2("path", 256), F.col("via"), F.col("unit")), 256)), 1, 16)
    units = lines.unionByName(whole).distinct().withColumn("key", key)
    words = units.select("key", F.explode(_words(F.col("unit"))).alias("word")).groupBy("key", "word").agg(F.count("*").alias("tf"))

    # in how many files a word of a template or a unit stands, over all rows and whole texts
    held = rows.select(F.explode(F.array_distinct(_words(F.coalesce("text", F.lit(""))))).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    held = held.join(words.select("word").unionByName(told.select("word")).distinct(), "word", "left_semi")
    total = rows.count()
    held = durable(held)
    weight = lambda df: F.log((1.0 + total) / (1.0 + F.coalesce(df, F.lit(0)))) + 1.0

    told = told.join(held, "word", "left").withColumn("w", F.col("tf") * weight(F.col("df")))  # the templates' words
    length = told.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    told = told.join(length, "template").select("template", "license", "word", (F.col("w") / F.col("norm")).alias("y"))

    words = words.join(held, "word", "left").withColumn("x", F.col("tf") * weight(F.col("df")))
    norm = words.groupBy("key").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dot = words.join(F.broadcast(told), "word").groupBy("key", "template", "license").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    found = dot.join(norm, "key").select("key", "license", F.round(F.col("dot") / F.col("norm"), 6).alias("score")).where(F.col("score") >= least)
    found = found.join(units.select("key", "path", "via"), "key")
    # struct order: the higher score, then the first name
    best = found.groupBy("path").agg(F.min(F.struct((-F.col("score")).alias("s"), "license", "via")).alias("m")).select("path", F.col("m.license").alias("own"), F.col("m.via").alias("own_via"), (-F.col("m.s")).alias("own_score"))
    best = durable(best)

    # a directory has the licence of its licence files, the best of several
    given = best.where(name.rlike(FILES)).withColumn("dir", where).groupBy("dir").agg(F.min(F.struct((-F.col("own_score")).alias("s"), F.col("own").alias("license"))).alias("m")).select(F.col("dir").alias("above"), F.col("m.license").alias("license"), (-F.col("m.s")).alias("score"))
    dirs = rows.where("path IS NOT NULL").select(where.alias("dir")).distinct()
    parts = F.split("dir", "/", -1)
    ups = dirs.select("dir", F.explode(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/")))).alias("above")).distinct()
    heir = ups.join(given, "above").groupBy("dir").agg(F.max_by(F.struct("license", "score"), F.length("above")).alias("h")).select("dir", "h.license", "h.score")
    out = rows.select("path", *kept).withColumn("dir", where).join(best, "path", "left").join(heir, "dir", "left")
    return out.select(
        F.col("path").alias(path_col),
        F.coalesce("own", "license").alias("license"),
        F.when(F.col("own").isNotNull(), F.col("own_via")).when(F.col("license").isNotNull(), "inherited").alias("via"),
        F.when(F.col("own").isNotNull(), F.col("own_score")).otherwise(F.col("score")).alias("score"),
        *(F.col(k).alias(c) for k, c in zip(kept, keep)),
    )


def _simple(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


#: documents as files: a hundred ids share a directory, whose licence file is the one that ends in 00; a hundred directories share one above.
PATH_SQL = "concat('d', CAST(floor(doc_id / 10000) AS INT), '/', CASE WHEN doc_id % 10000 = 0 THEN 'LICENSE' WHEN doc_id % 100 = 0 THEN concat('d', CAST(floor(doc_id / 100) AS INT), '/LICENSE') ELSE concat('d', CAST(floor(doc_id / 100) AS INT), '/', coalesce(source, 'none'), '/', doc_id, '.txt') END)"


def op5_license_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.expr(PATH_SQL).alias("path"), "text")
    return license_scan(docs, keep=("doc_id",)).select("doc_id", "path", "license", "via", "score")


_LISTED = ", ".join("({}, '{}', '{}')".format(i, a, b.replace("'", "''")) for i, (a, b) in enumerate(TEMPLATES))
OP5_SQL = f"""
WITH doc AS (SELECT doc_id, {PATH_SQL} AS path, text FROM documents),
listed(template, license, notice) AS (VALUES {_LISTED}),
tw AS (SELECT template, license, unnest(regexp_extract_all(lower(notice), '{WORD}')) AS word FROM listed),
tf AS (SELECT template, license, word, count(*) AS tf FROM tw GROUP BY ALL),
dw AS (SELECT DISTINCT path, unnest(regexp_extract_all(lower(text), '{WORD}')) AS word FROM doc),
df AS (SELECT word, count(*) AS df FROM dw GROUP BY word),
idf AS (SELECT word, ln((1.0 + (SELECT count(*) FROM doc)) / (1.0 + df)) + 1.0 AS w FROM df),
rare AS (SELECT ln(1.0 + (SELECT count(*) FROM doc)) + 1.0 AS w),
tx AS (SELECT template, license, word, tf * coalesce(i.w, (SELECT w FROM rare)) AS x FROM tf LEFT JOIN idf i USING (word)),
ty AS (SELECT template, license, word, x / sqrt(sum(x * x) OVER (PARTITION BY template)) AS y FROM tx),
cut AS (SELECT path, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM doc WHERE regexp_matches(lower(text), '{SPEAKS}')),
long AS (SELECT path, l, lead(l, 1) OVER o AS m, lead(l, 2) OVER o AS n FROM cut WINDOW o AS (PARTITION BY path ORDER BY i)),
line AS (SELECT path, unnest([l, concat_ws(chr(10), l, m), concat_ws(chr(10), l, m, n)]) AS unit FROM long WHERE regexp_matches(lower(l), '{SPEAKS}')),
unit AS (SELECT DISTINCT path, 'header' AS via, unit FROM line UNION SELECT DISTINCT path, 'file', text FROM doc WHERE path LIKE '%/LICENSE' AND text IS NOT NULL),
uw AS (SELECT path, via, unit, unnest(regexp_extract_all(lower(unit), '{WORD}')) AS word FROM unit),
ut AS (SELECT path, via, unit, word, count(*) AS tf FROM uw GROUP BY ALL),
ux AS (SELECT path, via, unit, word, tf * coalesce(i.w, (SELECT w FROM rare)) AS x FROM ut LEFT JOIN idf i USING (word)),
un AS (SELECT path, via, unit, sqrt(sum(x * x)) AS norm FROM ux GROUP BY ALL),
sc AS (SELECT path, via, license, round(sum(x * y) / any_value(norm), 6) AS score FROM ux JOIN ty USING (word) JOIN un USING (path, via, unit) GROUP BY path, via, unit, template, license),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, license, via) AS r FROM sc WHERE score >= {LEAST}) WHERE r = 1),
given AS (SELECT regexp_replace(path, '/LICENSE$', '') AS above, license, score FROM best WHERE path LIKE '%/LICENSE'),
near AS (SELECT d.path, g.license, g.score, row_number() OVER (PARTITION BY d.path ORDER BY length(g.above) DESC) AS r FROM doc d JOIN given g ON d.path LIKE g.above || '/%')
SELECT d.doc_id, d.path, coalesce(b.license, n.license) AS license, CASE WHEN b.license IS NOT NULL THEN b.via WHEN n.license IS NOT NULL THEN 'inherited' END AS via, coalesce(b.score, n.score) AS score
FROM doc d LEFT JOIN best b USING (path) LEFT JOIN (SELECT * FROM near WHERE r = 1) n USING (path)
"""
