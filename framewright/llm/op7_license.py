"""Licence scans by canonical digest lookup; SQL functions only.

A text is made canonical: lower case, equivalent spellings (licence/license, (c)/copyright, http/https, quotes),
copyright lines dropped (a line that starts with the word or sign and goes on with the sign, a year, a name in brackets or
"by", or that holds a year; and "all rights reserved" alone), punctuation and white space folded to one blank. Its digest
is joined to the digests of known licences. Two units are looked up: the entire text, and each of its paragraphs
(lines), so that a notice inside a longer document is found while ordinary text that merely mentions a licence is not.

The registry is a small fixed table (its size is checked before it is broadcast): the texts in ``KNOWN``, and for long
licences the digests in ``DIGESTS``. Canonical forms are made in one pass; digests of paragraphs that match nothing are
dropped by the join before the one shuffle, which carries a row for each document.

Cases: a null or empty text has no licence; a canonical form that is empty (only punctuation, or only copyright
lines) never matches; two registry entries with one canonical form are one entry (the first name by order); every row is
scanned on its own, so rows with a null doc_id, repeated rows and different texts of one doc_id have their own notices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.common import table, utf8

# Public licence texts, without copyright lines.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_CONDITIONS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org>"""


def _titled(name: str, body: str, *titles: str) -> list[tuple[str, str]]:
    """The licence with each of its titles, and without one."""
    return [(name, body), *((name, f"{title}\n{body}") for title in titles)]


#: (licence, text): full texts and the notices by which documents declare them.
KNOWN = [
    *_titled("MIT", _MIT, "MIT License", "The MIT License", "The MIT License (MIT)"),
    *_titled("ISC", _ISC, "ISC License"),
    *_titled("0BSD", _ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", ""), "BSD Zero Clause License", "Zero-Clause BSD"),
    *_titled("BSD-2-Clause", _BSD_CONDITIONS + _BSD_DISCLAIMER, "BSD 2-Clause License"),
    *_titled("BSD-3-Clause", _BSD_CONDITIONS + _BSD_NAMES + _BSD_DISCLAIMER, "BSD 3-Clause License"),
    *_titled("Zlib", _ZLIB, "zlib License", "The zlib License"),
    *_titled("Unlicense", _UNLICENSE, "The Unlicense"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
]
# Digests of the canonical forms of the official long texts, entire and, where they have an appendix after
# "END OF TERMS AND CONDITIONS", without it.
DIGESTS = [
    ("Apache-2.0", "045649cdaf85384ba827242062f2f3b36409835c98d297e25177cb1faf7c2847"),
    ("Apache-2.0", "108490d21e2d3edc9128233e48fabc169818d0c7c5f0bbdd58231a367d2d6c87"),
    ("Artistic-1.0-Perl", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60"),
    ("GFDL-1.3", "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826"),
    ("GPL-1.0", "490a17f9c44b8e7737e6d5b52eebf4c3610f67ee98c4ad515329fa012eebe42d"),
    ("GPL-1.0", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc"),
    ("GPL-2.0", "2d0b5e012e036a2690fe078a56f4c6dabcb7e2c352ef799e5e2074dab15ef4ae"),
    ("GPL-2.0", "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34"),
    ("GPL-3.0", "d83c17395c9a12cd395b7344eeb0d7e93e4ce5c7e6565e5590ba6d2df2f9e9e1"),
    ("GPL-3.0", "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.0", "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-2.1", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "6569045bd34252afb47bedf231276a4116b13666bf9cd93f72a26b765bcaa015"),
    ("MPL-2.0", "95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9"),
]
MAX_REGISTRY = 100_000
#: (pattern, replacement), in this order, in lower-cased text; none needs more than a regular language.
_FOLDS = [
    (r"(?m)^[^\p{L}\p{N}\n]*(copyright[ \t]*(\(c\)|©|<|\[|\{|by[ \t])|\(c\)|©|(copyright|copr\.)[^\n]*\d{4})[^\n]*$", ""),
    (r"(?m)^[^\p{L}\p{N}\n]*all rights reserved[^\p{L}\p{N}\n]*$", ""),
    (r"licen[cs](e|ed|es|ing)\b", r"licens\1"),
    (r"https://", "http://"),
    (r"\(c\)|©", "copyright"),
    (r"[^\p{L}\p{N}\n]+", " "),
    (r" *\n[ \n]*", "\n"),
]


def canonical(text: Column) -> Column:
    """Paragraphs stay apart by line feeds; everything else that may differ between copies of a licence is folded."""
    t = F.lower(text)
    for pattern, to in _FOLDS:
        t = F.regexp_replace(t, pattern, to.replace("\\", "$"))
    return F.trim(t)


def whole(canon: Column) -> Column:
    return F.sha2(F.trim(F.regexp_replace(canon, "[ \n]+", " ")), 256)


def registry(spark: SparkSession, known: list[tuple[str, str]] = KNOWN, digests: list[tuple[str, str]] = DIGESTS) -> DataFrame:
    """(digest, licence), one row a digest."""
    rows = spark.createDataFrame(known, "licence string, body string")
    canon = canonical(F.col("body"))
    rows = rows.where(F.length(canon) > 0).select(whole(canon).alias("digest"), "licence")
    if digests:
        rows = rows.unionByName(spark.createDataFrame(digests, "licence string, digest string"))
    return rows.groupBy("digest").agg(F.min("licence").alias("licence"))


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, canonical_sha256, licence (of the entire text), n_notices, notices (comma-joined, sorted), for every row."""
    if known.count() > MAX_REGISTRY:
        raise ValueError(f"a registry of more than {MAX_REGISTRY} digests")
    canon = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", canonical(utf8("text")).alias("canon"))
    lines = F.transform(F.filter(F.split("canon", "\n"), lambda x: F.length(x) > 2), lambda x: F.struct(F.lit(False).alias("entire"), F.sha2(F.trim(x), 256).alias("digest")))
    units = canon.select("row", "doc_id", F.explode(F.concat(F.array(F.struct(F.lit(True).alias("entire"), whole(F.col("canon")).alias("digest"))), lines)).alias("u")).select("row", "doc_id", "u.*")
    found = units.join(F.broadcast(known), "digest", "left").where("entire or licence is not null")
    # A document's rows are in one task, so the sums are made there and one row a document is shuffled.
    out = found.groupBy("row", "doc_id").agg(
        F.max(F.when(F.col("entire"), F.col("digest"))).alias("canonical_sha256"),
        F.max(F.when(F.col("entire"), F.col("licence"))).alias("licence"),
        F.count(F.when(~F.col("entire"), True)).alias("n_notices"),
        F.array_join(F.sort_array(F.collect_set(F.when(~F.col("entire"), F.col("licence")))), ",").alias("notices"),
    )
    return out.drop("row")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), registry(spark))


def _canon_sql(x: str) -> str:
    t = f"lower({x})"
    for pattern, to in _FOLDS:
        t = f"regexp_replace({t}, '{pattern}', '{to}', 'g')"
    return f"trim({t})"


_VALUES = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in KNOWN)
_LONG = ", ".join(f"('{a}', '{b}')" for a, b in DIGESTS)
SQL = f"""
WITH k AS (SELECT digest, min(licence) AS licence FROM (SELECT sha256(trim(regexp_replace({_canon_sql("body")}, '[ \\n]+', ' ', 'g'))) AS digest, licence FROM (VALUES {_VALUES}) AS v(licence, body)
  UNION ALL SELECT digest, licence FROM (VALUES {_LONG}) AS w(licence, digest)) GROUP BY 1),
c AS (SELECT doc_id, {_canon_sql("coalesce(text, '')")} AS canon FROM documents),
n AS (SELECT doc_id, count(*) AS n_notices, string_agg(DISTINCT licence, ',' ORDER BY licence) AS notices
  FROM (SELECT doc_id, sha256(trim(line)) AS digest FROM (SELECT doc_id, unnest(string_split(canon, chr(10))) AS line FROM c) WHERE length(line) > 2) JOIN k USING (digest) GROUP BY 1),
w AS (SELECT doc_id, sha256(trim(regexp_replace(canon, '[ \\n]+', ' ', 'g'))) AS digest FROM c)
SELECT doc_id, digest AS canonical_sha256, licence, CAST(coalesce(n_notices, 0) AS BIGINT) AS n_notices, coalesce(notices, '') AS notices
FROM w LEFT JOIN k USING (digest) LEFT JOIN n USING (doc_id)
"""
