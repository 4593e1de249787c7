"""Licence scan: whole texts against known licences, by a digest of their canonical form.

DataFrame functions only. A unit is a document's whole text or one of its
lines. Its canonical form has A-Z in lower case, no copyright lines, one
spelling for equivalent words, and single blanks for everything else but
letters and digits; units whose SHA-256 is that of a known licence match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Equivalent spellings, the first replaced by the second.
SPELLINGS = (
    ("licence", "license"),
    ("sub-license", "sublicense"),
    ("non-infringement", "noninfringement"),
    ("merchantibility", "merchantability"),
    ("acknowledgement", "acknowledgment"),
    ("organisation", "organization"),
    ("favour", "favor"),
    ("honour", "honor"),
    ("wilful", "willful"),
    ("whilst", "while"),
    ("per cent", "percent"),
    ("https:", "http:"),
)

_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
    "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
    "to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
    'the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT '
    "NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO "
    "EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN "
    "ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR "
    "OTHER DEALINGS IN THE SOFTWARE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted, provided that the above copyright notice and this permission notice appear in all copies. "
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING '
    "ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
    "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE "
    "USE OR PERFORMANCE OF THIS SOFTWARE."
)

_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
    "following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
    "following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission. "
)
_BSD_TAIL = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE "
    "USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
    "liable for any damages arising from the use of this software. Permission is granted to anyone to use this software "
    "for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the "
    "following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you "
    "wrote the original software. If you use this software in a product, an acknowledgment in the product documentation "
    "would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not "
    "be misrepresented as being the original software. 3. This notice may not be removed or altered from any source "
    "distribution."
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
    "use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
    "purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author "
    "or authors of this software dedicate any and all copyright interest in the software to the public domain. We make "
    "this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend "
    "this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this "
    'software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, '
    "INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
    "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN "
    "ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
    "DEALINGS IN THE SOFTWARE. For more information, please refer to <http://unlicense.org/>"
)

# Known licences and licence notices, (name, text).
KNOWN = (
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-2-Clause", "BSD 2-Clause License " + _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    ("BSD-3-Clause", "BSD 3-Clause License " + _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    ("Zlib", _ZLIB),
    ("Zlib", "zlib License " + _ZLIB),
    ("Unlicense", _UNLICENSE),
    ("MIT", _MIT),
    ("MIT", "MIT License " + _MIT),
    ("ISC", _ISC),
    ("ISC", "ISC License " + _ISC),
    ("0BSD", _ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", "")),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    ("All-rights-reserved", "All rights reserved."),
)

_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A statement of who holds the copyright since when; a wrapped line that begins "copyright notice" is none.
_COPYRIGHT_LINE = r"(^|\n)[ \t]*((copyright[ \t]+)?(\(c\)|©)|copyright[ \t]+(19|20)[0-9][0-9])[^\n]*"


def canonical(text: Column) -> Column:
    """The canonical form of a text."""
    out = F.regexp_replace(F.translate(text, _UPPER, _SMALL), _COPYRIGHT_LINE, "$1")
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.trim(F.regexp_replace(out, "[^a-z0-9]+", " "))


def known_digests(spark, known=KNOWN) -> DataFrame:
    """(digest, license) of the known texts: as many rows as texts, whatever the corpus."""
    rows = spark.createDataFrame(list(known), "license string, text string").where(canonical(F.col("text")) != "")
    return rows.select(F.sha2(canonical("text").cast("binary"), 256).alias("digest"), "license").distinct()


def read_known(spark: SparkSession, folder: str, most_bytes: int = 64 << 20) -> tuple[tuple[str, str], ...]:
    """(name, text) of a folder's files, to be given to ``scan`` as ``known``: whole texts of longer licences.

    A name is the file's, without ``.txt``. Texts are UTF-8; empty files are
    left out. The collection passes the driver, so one of over ``most_bytes`` fails; it does not grow with the corpus.
    """
    files = spark.read.format("binaryFile").load(folder)
    size = files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    if size > most_bytes:
        raise ValueError(f"{folder}: {size} bytes of licences, over {most_bytes}")
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.txt$", "")
    rows = files.select(name.alias("name"), F.decode("content", "UTF-8").alias("text")).orderBy("name").collect()
    return tuple((r.name, r.text) for r in rows)


def scan(docs: DataFrame, known=KNOWN) -> DataFrame:
    """(doc_id, unit, line, license): every whole text and every line that is a known licence.

    unit is ``text`` (line -1) or ``line`` (line from 0, split at \\n); a text
    of one line matches as both. Null and empty texts match nothing: known
    texts whose canonical form is empty are left out, and no known texts give
    no rows; repeated rows match as often as they come; further columns are
    not read. Units of under half the letters and digits of the shortest known
    text cannot match, as no spelling doubles in length, and are left out
    before anything is normalised.
    """
    spark = docs.sparkSession
    least = min((sum(c.isalnum() for c in text) for _, text in known), default=0) // 2
    texts = docs.select("doc_id", F.lit("text").alias("unit"), F.lit(-1).alias("line"), "text")
    lines = docs.select("doc_id", F.lit("line").alias("unit"), F.posexplode(F.split("text", "\n")).alias("line", "text"))
    units = texts.union(lines).where(F.length("text") >= least)
    digest = F.sha2(canonical("text").cast("binary"), 256)
    digests = known_digests(spark, known)
    if len(known) <= 10_000:  # beyond, an exchange by digest
        digests = F.broadcast(digests)
    return units.join(digests, digest == F.col("digest")).select(
        "doc_id", "unit", "line", "license"
    )


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def oracle_sql(known=KNOWN) -> str:
    """The same rows in DuckDB's SQL."""
    form = f"regexp_replace(translate(text, {_sql(_UPPER)}, {_sql(_SMALL)}), {_sql(_COPYRIGHT_LINE)}, '\\1', 'g')"
    for old, new in SPELLINGS:
        form = f"replace({form}, {_sql(old)}, {_sql(new)})"
    form = f"sha256(trim(regexp_replace({form}, '[^a-z0-9]+', ' ', 'g')))"
    values = ", ".join(f"({_sql(name)}, {_sql(text)})" for name, text in known)
    return f"""
WITH known AS (SELECT DISTINCT license, {form} AS digest FROM (VALUES {values}) AS k(license, text)),
lines AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
units AS (
  SELECT doc_id, 'text' AS unit, CAST(-1 AS INTEGER) AS line, text FROM documents
  UNION ALL
  SELECT doc_id, 'line', CAST(n - 1 AS INTEGER), parts[n] FROM lines, UNNEST(range(1, len(parts) + 1)) AS r(n)),
digests AS (SELECT doc_id, unit, line, {form} AS digest FROM units)
SELECT d.doc_id, d.unit, d.line, k.license FROM digests d JOIN known k ON d.digest = k.digest"""
