"""License scans by sparse TF-IDF cosines, in DataFrame operations only.

Units are the lines of a file that speak of rights, its blocks of several lines
that do (headers wrapped over lines; comment signs are no terms), and for files
that are named as licence files every block and the whole text. Templates are
the usual one-line statements, header notices, titles and, where they are
short, whole licence texts. Units and templates become TF-IDF vectors in
long form, one row a term; document frequencies come from all units of the
corpus. Cosines are sums over a join on terms. A file takes its best template
from MIN_COSINE on. Files without one inherit from the nearest ancestor
directory with a licence file: a file named as one, or one of whose words at
least half lie in units that match a template.

Defined cases: null text has no units; a null path has no directory and
inherits nothing; among equal cosines (to four digits) the smallest identifier
wins; repeated rows are one file and each get its result; an empty table gives
no rows. Texts of any length are split whole, in the engine; columns other than
the path and the text are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .work import Workspace

MIN_COSINE = 0.6
#: Directories with an inherited licence that are broadcast at most; one may hold most files.
BROADCAST_ROWS = 100_000
TERM = r"[a-z0-9]+(?:\.[0-9]+)*"
SIGNAL = r"(?i)licen[sc]e|copyright|all rights reserved|public domain|spdx|redistribution and use|permission is hereby granted|permission to use|free software|general public"
#: Blocks end at lines without letters or digits.
BREAK = r"\n(?:[^A-Za-z0-9\n]*\n)+"
NAMED = r"(?i)(?:^|/)(?:licen[sc]e|copying|notice|unlicense)(?:\.[a-z0-9]+)?$"

# Public licence texts, and the notices and titles by which files usually state these licenses.
_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAME = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_AS_IS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {} for more details."
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
_UNLICENSE = "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain."
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause Simplified License"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause New or Revised License"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License CC BY 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License CC BY-SA 4.0"),
    ("CC0-1.0", "Dedicated to the public domain under the CC0 1.0 Universal dedication"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("ISC", "Licensed under the ISC License"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("LicenseRef-Proprietary", "All rights reserved"),
    ("MIT", "Released under the MIT License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("BSD-2-Clause", f"Copyright (c) All rights reserved. {_BSD} {_BSD_AS_IS}"),
    ("BSD-3-Clause", f"Copyright (c) All rights reserved. {_BSD} {_BSD_NAME} {_BSD_AS_IS}"),
    ("GPL-2.0", _GNU.format("General Public License", 2, "General Public License")),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", _GNU.format("General Public License", 3, "General Public License")),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("ISC", f"ISC License Copyright (c) {_ISC} {_ISC_AS_IS}"),
    ("LGPL-3.0", _GNU.format("Lesser General Public License", 3, "Lesser General Public License")),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("MIT", f"MIT License Copyright (c) {_GRANT} {_NOTICE} {_AS_IS}"),
    ("MIT", _GRANT),
    ("MPL-2.0", _MPL),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("Unlicense", _UNLICENSE),
)


def terms(text: Column) -> Column:
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lower, F.lit(TERM), F.lit(0))


def _templates(spark: SparkSession, templates: tuple[tuple[str, str], ...]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(n).alias("template"), F.lit(i).alias("license"), F.lit(t).alias("text")) for n, (i, t) in enumerate(templates)])
    return spark.range(1).select(F.inline(rows))


def _vectors(units: DataFrame, key: list[str], idf: DataFrame, unknown: Column) -> DataFrame:
    """(key, term, w) of unit length."""
    tf = units.groupBy(*key, "term").agg(F.count("*").alias("tf"))
    w = tf.join(idf, "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", unknown)).select(*key, "term", "w")
    norm = w.groupBy(*key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, key).select(*key, "term", (F.col("w") / F.col("norm")).alias("w"))


def scan(files: DataFrame, path: str = "path", text: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = MIN_COSINE) -> DataFrame:
    """(path, license, origin, cosine, n_headers) of every row.

    origin: header (in the file), file (a licence file), inherited, or null.
    """
    spark = files.sparkSession
    work = Workspace(spark, "licenses")
    rows = files.select(F.col(path).alias("path"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("f", F.xxhash64("path", "text"))
    named = F.coalesce(F.col("path").rlike(NAMED), F.lit(False))
    held = rows.where(named | F.col("text").rlike(SIGNAL)).dropDuplicates(["f", "path", "text"])
    speaks = lambda x: x.rlike(SIGNAL)
    lines, blocks = F.filter(F.split("text", "\n", -1), speaks), F.filter(F.split("text", BREAK, -1), lambda x: named | (x.contains("\n") & speaks(x)))
    of = lambda kind, units: F.transform(units, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("unit")))
    every = F.concat(of("line", F.when(named, F.array().cast("array<string>")).otherwise(lines)), of("block", blocks), of("whole", F.when(named, F.array("text")).otherwise(F.array().cast("array<string>"))))
    units = held.select("f", "path", named.alias("named"), F.size(terms(F.col("text"))).alias("words"), F.posexplode(every).alias("at", "u"))
    units = work.keep(units.select("f", "path", "named", "words", "at", "u.kind", "u.unit"), "units")
    each = units.select("f", "at", F.explode(terms(F.col("unit"))).alias("term"))
    known = _templates(spark, templates)
    each_known = known.select("template", "license", F.explode(terms(F.col("text"))).alias("term"))
    n = units.count()
    df = each.distinct().groupBy("term").agg(F.count("*").alias("df"))
    idf = work.keep(df.select("term", (F.log((F.lit(n) + 1.0) / (F.col("df") + 1.0)) + 1.0).alias("idf")), "idf")
    unseen = F.log(F.lit(n + 1.0)) + 1.0
    a, b = _vectors(each, ["f", "at"], idf, unseen), _vectors(each_known, ["template", "license"], idf, unseen)
    dots = a.join(b.withColumnRenamed("w", "v"), "term").groupBy("f", "at", "template", "license").agg(F.round(F.sum(F.col("w") * F.col("v")), 4).alias("cosine"))
    matched = dots.where(F.col("cosine") >= least).groupBy("f", "at").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "license")).alias("best"))
    best = matched.join(units, ["f", "at"]).withColumn("inside", F.size(terms(F.col("unit"))))
    # a line and its block say the same: they are counted apart, and the more of them counts
    kinds = best.groupBy("f", "path", "named", "words", "kind").agg(F.min("best").alias("best"), F.count("*").alias("n"), F.sum("inside").alias("inside"))
    own = kinds.groupBy("f", "path", "named", "words").agg(F.min("best").alias("best"), F.max("n").alias("n_headers"), F.max("inside").alias("inside"))
    own = work.keep(own.select("f", "path", (F.col("named") | (2 * F.col("inside") >= F.col("words"))).alias("is_file"), F.col("best.license").alias("license"), (-F.col("best.c")).alias("cosine"), "n_headers"), "own")
    folder = lambda p: F.when(p.contains("/"), F.regexp_replace(p, "/[^/]*$", "")).when(p.isNotNull(), "")
    covered = own.where("is_file and path is not null").groupBy(folder(F.col("path")).alias("dir")).agg(F.min(F.struct((-F.col("cosine")).alias("c"), "license")).alias("best")).select("dir", F.col("best.license").alias("of_dir"))
    # every directory's ancestors, itself included, by depth; the deepest with a licence file counts
    dirs = rows.where("path is not null").select(folder(F.col("path")).alias("of")).distinct()
    depth = F.when(F.col("of") == "", 0).otherwise(F.size(F.split("of", "/")))
    up = dirs.select("of", F.explode(F.sequence(F.lit(0), depth)).alias("depth")).withColumn("dir", F.array_join(F.slice(F.split("of", "/"), F.lit(1), F.col("depth")), "/"))
    near = work.keep(up.join(covered, "dir").groupBy("of").agg(F.max(F.struct("depth", "of_dir")).alias("near")).select(F.col("of").alias("dir"), F.col("near.of_dir").alias("inherited")), "near")
    out = rows.select("path", "f", folder(F.col("path")).alias("dir")).join(own.select("f", "is_file", "license", "cosine", "n_headers"), "f", "left").join(F.broadcast(near) if near.count() <= BROADCAST_ROWS else near, "dir", "left")
    origin = F.when(F.col("license").isNotNull(), F.when(F.col("is_file"), "file").otherwise("header")).when(F.col("inherited").isNotNull(), "inherited")
    return out.select("path", F.coalesce("license", "inherited").alias("license"), origin.alias("origin"), "cosine", F.coalesce("n_headers", F.lit(0)).cast("long").alias("n_headers"))
