"""License scans by canonical digests, in DataFrame functions only.

A text is made canonical (case, copyright lines, titles of short licences, punctuation, equivalent spellings,
white space), and its SHA-256 is looked up by a hash join among the digests of known licences, which go through the same
columns. Whole texts and each of their lines are looked up: the first finds licence files, the second
licence notices inside documents.

Defined cases: a null or empty text has the digest of the empty text and no licence; lines that are
empty once canonical are not looked up; a known text that occurs under two names reports the first by
name; repeated rows are reported each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS, durable

# Spellings that count as equal, the left one as the right one.
SPELLINGS = (
    ("licence", "license"),
    ("organisation", "organization"),
    ("acknowledgement", "acknowledgment"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("behaviour", "behavior"),
    ("favour", "favor"),
    ("fulfil ", "fulfill "),
    ("judgement", "judgment"),
    ("recognised", "recognized"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
    ("sub license", "sublicense"),
    ("non commercial", "noncommercial"),
    ("per cent", "percent"),
    ("copyright owner", "copyright holder"),
)

_NOTICE = "(^|\\n)[ \\t*#/;-]*(copyright[ ,:]*(\\(c\\)|©|[0-9]{4}|[<{\\[])|\\(c\\)|©|all rights reserved)[^\\n]*"
_MARKS = "[^\\p{L}\\p{N}\\n]+"
#: A line that holds a short licence's title alone, as it heads licence files (once marks are spaces).
_TITLE = (
    "(^|\\n) ?(the )?(mit|x11|isc|bsd zero clause|zero clause bsd|bsd [234] clause|[234] clause bsd|simplified bsd|new bsd|modified bsd) "
    "licen[cs]e( mit| isc| 0bsd| bsd [234] clause| simplified| new or revised)? ?(\\n|\\z)"
)

_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
    "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
    "conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and "
    "the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of "
    "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
)
_BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission.\n"
)
_BSD_TAIL = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, '
    "BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT "
    "SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
    "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
    "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE "
    "OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_TAIL = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
    "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
    "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
    "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)

# Public licence texts and the usual one-line notices, by SPDX name.
KNOWN = (
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
        "is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be "
        "included in all copies or substantial portions of the Software.\n" + _WARRANTY,
    ),
    ("ISC", _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_TAIL),
    ("0BSD", _ISC_GRANT + ".\n" + _ISC_TAIL),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at\nhttp://www.apache.org/licenses/LICENSE-2.0\nUnless required by applicable law or agreed "
        'to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY '
        "KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
)


# Digests (and lengths) of the canonical form of long public licence texts as they are published,
# by SPDX name. `tests/llm/test_license.py` makes them again from the texts where a system ships those.
KNOWN_DIGESTS = (
    ("Apache-2.0", 9826, "4580e5390400d27df89edd0617548ac0e66eaa029f6e07cf98aac9cd100b3a37"),
    ("Artistic-1.0-Perl", 5833, "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
    ("BSD-3-Clause", 1361, "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651"),
    ("CC0-1.0", 6692, "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", 19579, "1c057ea35084eb195331cec1a49fca335c176422a7726a9a23636906fd4e241f"),
    ("GFDL-1.3", 22015, "7e8edd3abe6258bb82bb853d91a0c24fcd9976894fd0592747354cffe1cb18e7"),
    ("GPL-1.0", 11765, "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-2.0", 17117, "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-3.0", 33409, "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68"),
    ("LGPL-2.0", 24130, "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1", 25217, "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-3.0", 7104, "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", 22340, "fbe9a0b96f52e03cb474f9a7083781399c011279e85b548118563ec96e659354"),
    ("MPL-2.0", 14272, "9e79a7d513376f6fa1500e4df4f6276c6e7e61c5c3e28dcdb1acee24033acc56"),
)


def canonical_lines(text: Column) -> Column:
    """The text with its lines kept: lower case, no copyright lines or titles, one space for marks, one spelling."""
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), _NOTICE, "$1")
    out = F.regexp_replace(F.regexp_replace(out, _MARKS, " "), _TITLE, "$1")
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def canonical(lines: Column) -> Column:
    return F.trim(F.regexp_replace(lines, "[ \\n]+", " "))


def digest(canon: Column) -> Column:
    return F.sha2(canon.cast("binary"), 256)


def known_digests(spark: SparkSession, known=KNOWN, digests=KNOWN_DIGESTS) -> DataFrame:
    """digest, license, size: the known texts through the same columns as the documents, and known digests."""
    rows = F.array(*[F.struct(F.lit(name).alias("license"), F.lit(text).alias("text")) for name, text in known])
    texts = spark.range(1, numPartitions=1).select(F.explode(rows).alias("x")).select("x.*")
    canon = texts.select("license", canonical(canonical_lines(F.col("text"))).alias("canon"))
    held = canon.select("license", F.length("canon").alias("size"), digest(F.col("canon")).alias("digest"))
    if digests:
        fixed = F.array(*[F.struct(F.lit(name).alias("license"), F.lit(size).alias("size"), F.lit(mark).alias("digest")) for name, size, mark in digests])
        held = held.unionByName(spark.range(1, numPartitions=1).select(F.explode(fixed).alias("x")).select("x.*"))
    return held.groupBy("digest").agg(F.min("license").alias("license"), F.min("size").alias("size"))


def scan(docs: DataFrame, known: DataFrame | None = None, text_col: str = "text") -> DataFrame:
    """doc_id, text_digest, license (of the whole text), n_notices (lines), notices (their licences)."""
    known = known_digests(docs.sparkSession) if known is None else known
    rows, sizes = known.agg(F.count(F.lit(1)), F.collect_set("size")).first()
    table = (F.broadcast if rows <= BROADCAST_ROWS else lambda x: x)(known.select("digest", "license"))
    lines = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), canonical_lines(F.col(text_col)).alias("lines"))
    # A line can only match a known text of its own length, so few lines need a digest.
    short = F.filter(F.transform(F.split("lines", "\n"), lambda x: F.trim(x)), lambda x: F.length(x).isin(sorted(sizes)) & (x != ""))
    per_doc = lines.select("doc_id", digest(canonical(F.col("lines"))).alias("text_digest"), F.transform(short, digest).alias("line_digests"))
    per_doc = durable(per_doc.withColumn("row", F.monotonically_increasing_id()))
    whole = per_doc.join(table, F.col("text_digest") == F.col("digest"), "left").select("row", "doc_id", "text_digest", "license")
    noted = per_doc.select("row", F.explode("line_digests").alias("digest")).join(table, "digest")
    noted = noted.groupBy("row").agg(F.count(F.lit(1)).alias("n_notices"), F.concat_ws(",", F.array_sort(F.collect_set("license"))).alias("notices"))
    return whole.join(noted, "row", "left").select(
        "doc_id", "text_digest", "license", F.coalesce("n_notices", F.lit(0)).cast("bigint").alias("n_notices"), F.coalesce("notices", F.lit("")).alias("notices")
    )


def oracle() -> str:
    """The same rows in DuckDB SQL."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    notice = quoted(_NOTICE.replace("\\n", "\n").replace("\\t", "\t"))
    expression = f"regexp_replace(lower(coalesce(text, '')), {notice}, '\\1', 'g')"
    expression = f"regexp_replace({expression}, {quoted(_MARKS.replace(chr(92) + 'n', chr(10)))}, ' ', 'g')"
    expression = f"regexp_replace({expression}, {quoted(_TITLE.replace(chr(92) + 'n', chr(10)))}, '\\1', 'g')"
    for old, new in SPELLINGS:
        expression = f"replace({expression}, {quoted(old)}, {quoted(new)})"
    whole = "trim(regexp_replace(lines, '[ \n]+', ' ', 'g'))"
    values = ", ".join(f"({quoted(name)}, {quoted(text)})" for name, text in KNOWN)
    fixed = ", ".join(f"({quoted(name)}, {quoted(mark)})" for name, _, mark in KNOWN_DIGESTS)
    return f"""
WITH raw AS (SELECT * FROM (VALUES {values}) AS v(license, text)),
held AS (SELECT license, sha256({whole}) AS digest FROM (SELECT license, {expression} AS lines FROM raw) UNION ALL SELECT * FROM (VALUES {fixed}) AS f(license, digest)),
known AS (SELECT digest, min(license) AS license FROM held GROUP BY digest),
docs AS (SELECT doc_id, {expression} AS lines FROM documents),
noted AS (
  SELECT doc_id, count(*) AS n_notices, array_to_string(list_sort(list(DISTINCT license)), ',') AS notices
  FROM (SELECT doc_id, sha256(trim(unnest(string_split(lines, chr(10))))) AS digest FROM docs) JOIN known USING (digest) GROUP BY doc_id
),
whole AS (SELECT doc_id, sha256({whole}) AS text_digest FROM docs)
SELECT w.doc_id, w.text_digest, k.license, coalesce(n.n_notices, 0) AS n_notices, coalesce(n.notices, '') AS notices
FROM whole w LEFT JOIN known k ON w.text_digest = k.digest LEFT JOIN noted n ON w.doc_id = n.doc_id
"""
