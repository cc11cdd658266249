"""Licence scans by TF-IDF cosine to templates, with inheritance along directories, in DataFrame operations only.

Units are headers (lines that name a licence) and licence files (whole texts that are called like one, or in which such
lines have half of the words or more). Templates are the usual notices, for headers, and whole licence texts, for files. Each different unit is a sparse TF-IDF vector over its terms, with document frequencies counted over
all units and templates; its licence is the template of the highest cosine, from ``MIN_COSINE`` up. A licence file
speaks for its directory: a document without a licence of its own takes that of the nearest directory above it that
has one, found by joining the prefixes of its path.

Cases: null texts and paths have no unit and no directory; ties go to the first template by name, and between licence
files of one directory to the most frequent, then first by name; repeated rows are scanned alike and stay; empty
tables give empty results; other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import checkpoint, join_few

MIN_COSINE = 0.55
FILE_SHARE = 0.5

#: Licence id and the words of its usual notice.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms are permitted under the BSD 3-Clause License"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License CC BY 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("GPL-2.0", "This program is free software licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("Proprietary", "All rights reserved. Proprietary and confidential"),
)
_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD_TERMS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_WARRANTY = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
#: Licence id and its whole text, for licence files.
WHOLE_TEXTS = (
    ("BSD-2-Clause", f"{_BSD_TERMS} {_BSD_WARRANTY}"),
    ("BSD-3-Clause", f"{_BSD_TERMS} {_BSD_NAMES} {_BSD_WARRANTY}"),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("MIT", f'MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_WARRANTY}'),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
)
#: A licence has a template for each of its texts.
ALL_TEMPLATES = TEMPLATES + WHOLE_TEXTS
#: Names of licence files.
FILE_NAME = "(?i)(^|/)(licen[sc]e|copying|unlicen[sc]e|notice)[^/]*$"
#: What makes a line a header.
CUES = ("licen[sc]e", "copyright", "spdx", "all rights reserved")
CUE = "(?i)(" + "|".join(CUES) + ")"
TERM = "[a-z0-9]+(?:[.+-][a-z0-9]+)*"


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def units(docs: DataFrame) -> DataFrame:
    """(doc_id, path, kind, unit): the headers and licence files of each document."""
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(CUE))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("path"), F.col("text"), lines.alias("lines")).where((F.size("lines") > 0) | F.col("path").rlike(FILE_NAME)).where("text is not null")
    words = lambda c: F.size(terms(c))
    is_file = F.coalesce(F.col("path").rlike(FILE_NAME), F.lit(False)) | (words(F.array_join("lines", "\n")) >= FILE_SHARE * words(F.col("text")))
    each = F.array_union(F.transform("lines", lambda x: F.struct(F.lit("header").alias("kind"), x.alias("unit"))), F.when(is_file, F.array(F.struct(F.lit("file").alias("kind"), F.col("text").alias("unit")))).otherwise(F.array().cast("array<struct<kind:string,unit:string>>")))
    return rows.select("doc_id", "path", F.explode(each).alias("u")).select("doc_id", "path", "u.kind", "u.unit")


def weights(vectors: DataFrame) -> DataFrame:
    """(id, term, w): unit-length TF-IDF over (id, term, tf)."""
    n = vectors.select("id").distinct().agg(F.count(F.lit(1)).alias("n"))
    idf = vectors.groupBy("term").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(n)).select("term", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))  # n is one row
    raw = vectors.join(idf, "term").select("id", "term", (F.col("tf") * F.col("idf")).alias("x"))
    norm = raw.groupBy("id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return raw.join(norm, "id").select("id", "term", (F.col("x") / F.col("norm")).alias("w"))


def classify(spark: SparkSession, found: DataFrame, templates: tuple[tuple[str, str], ...] = ALL_TEMPLATES, min_cosine: float = MIN_COSINE) -> DataFrame:
    """(unit, licence, cosine) of the different units that are like a template."""
    known = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(f"T{name}#{k}").alias("id"), F.lit(text).alias("unit")) for k, (name, text) in enumerate(templates)])).alias("t")).select("t.*")
    different = found.select("unit").distinct().select(F.concat(F.lit("U"), F.sha2("unit", 256)).alias("id"), "unit")
    vectors = different.unionByName(known).select("id", F.explode(terms(F.col("unit"))).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))
    w = checkpoint(weights(checkpoint(vectors)))
    of_templates = w.where(F.col("id").startswith("T")).select(F.substring("id", 2, 100).alias("template"), "term", F.col("w").alias("v"))
    own = w.where(F.col("id").startswith("U")).join(F.broadcast(of_templates), "term")  # len(templates) short vectors
    cosine = own.groupBy("id", "template").agg(F.sum(F.col("w") * F.col("v")).alias("cosine")).where(F.col("cosine") >= min_cosine).select("id", F.substring_index("template", "#", 1).alias("licence"), "cosine")
    best = cosine.groupBy("id").agg(F.min(F.struct((-F.round("cosine", 9)).alias("s"), "licence")).alias("b")).select("id", "b.licence", (-F.col("b.s")).alias("cosine"))
    return different.join(best, "id").select("unit", "licence", "cosine")


def directory(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = ALL_TEMPLATES, min_cosine: float = MIN_COSINE) -> DataFrame:
    """(doc_id, path, own_licence, cosine, inherited_from, licence, origin) for docs (doc_id, path, text), a row for each row."""
    found = checkpoint(units(docs))
    scored = checkpoint(found.join(classify(docs.sparkSession, found, templates, min_cosine), "unit").select("doc_id", "path", "kind", "licence", "cosine"))
    own = scored.groupBy("doc_id", "path").agg(F.min(F.struct((-F.col("cosine")).alias("s"), "licence")).alias("b"), F.max(F.when(F.col("kind") == "file", True).otherwise(False)).alias("is_file")).select("doc_id", "path", F.col("b.licence").alias("own_licence"), (-F.col("b.s")).alias("cosine"), "is_file")
    voices = scored.where("kind = 'file' and path is not null").groupBy(directory(F.col("path")).alias("dir"), "licence").agg(F.count(F.lit(1)).alias("n"))
    speaks = voices.groupBy("dir").agg(F.min(F.struct((-F.col("n")).alias("s"), "licence")).alias("b")).select("dir", F.col("b.licence").alias("dir_licence"))
    # each directory of documents meets each directory above it; the nearest with a licence counts
    dirs = docs.where("path is not null").select(directory(F.col("path")).alias("own_dir")).distinct()
    parts = F.split("own_dir", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("dir")))
    nearest = dirs.select("own_dir", F.explode(above).alias("a")).select("own_dir", "a.depth", "a.dir").join(speaks, "dir").groupBy("own_dir").agg(F.max(F.struct("depth", "dir", "dir_licence")).alias("b")).select("own_dir", F.col("b.dir").alias("inherited_from"), "b.dir_licence")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "path", directory(F.col("path")).alias("own_dir"))
    rows = join_few(rows.alias("d").join(own.alias("o"), F.expr("d.doc_id <=> o.doc_id and d.path <=> o.path"), "left").select("d.*", "o.own_licence", "o.cosine", "o.is_file"), nearest, "own_dir", "left")
    inherits = F.col("own_licence").isNull() & F.col("dir_licence").isNotNull()
    origin = F.when(F.col("own_licence").isNull(), F.when(F.col("dir_licence").isNull(), "none").otherwise("inherited")).when(F.col("is_file"), "file").otherwise("header")
    return rows.select("doc_id", "path", "own_licence", "cosine", F.when(inherits, F.col("inherited_from")).alias("inherited_from"), F.coalesce("own_licence", "dir_licence").alias("licence"), origin.alias("origin"))
