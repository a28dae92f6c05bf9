"""License scans: canonical digests of whole texts, hash-joined to the digests of known licences.

A canonical text is lower case, without copyright lines and web schemes, with
everything but letters and digits turned into single spaces, and with equivalent
spellings (such as licence and license) made one. The SHA-256 of the whole
canonical text is looked up. Each line's digest is looked up among known one-line
notices too, so that a notice inside a longer text is found: `notices` lists them.

All of this is built-in SQL functions in the scan's own stage. The join is by
broadcast where the known texts are counted to be at most _common.FEW, else by
shuffle. One-line notices are a parameter of at most _common.FEW rows.

Cases: a null text has a null digest, no licence and no notices. Texts without a
letter or digit, empty ones among them, have the digest of an empty text and no
licence. Very long texts are digested whole. Rows that repeat are looked up each. Of
known licences with one canonical text the least id counts. An empty table gives an
empty one. Other columns, whatever their names, don't matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

# Spellings taken as equal, each with its common form.
SPELLINGS = [
    ("licence", "license"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("sub-license", "sublicense"), ("sub license", "sublicense"),
    ("acknowledgement", "acknowledgment"), ("authorisation", "authorization"), ("authorised", "authorized"), ("favour", "favor"), ("fulfil", "fulfill"),
    ("honour", "honor"), ("judgement", "judgment"), ("merchantability", "merchantability"), ("non-infringement", "noninfringement"), ("non infringement", "noninfringement"),
    ("noncommercial", "non commercial"), ("organisation", "organization"), ("percent", "per cent"), ("programme", "program"), ("recognise", "recognize"),
    ("whilst", "while"), ("wilful", "willful"), ("initialise", "initialize"), ("per-cent", "per cent"), ("owner", "holder"), ("third-party", "third party"),
]

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""

_BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_WTFPL = """DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION

0. You just DO WHAT THE FUCK YOU WANT TO."""
_MIT_GRANT, _, _MIT_END = _MIT.split("\n\n")

# Known licence texts, by SPDX id.
LICENSES = [
    ("MIT-0", _MIT_GRANT.removesuffix(", subject to the following conditions:") + ".\n\n" + _MIT_END), ("MIT-0", "MIT No Attribution\n\n" + _MIT_GRANT.removesuffix(", subject to the following conditions:") + ".\n\n" + _MIT_END),
    ("0BSD", _ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies.", ".")), ("0BSD", "BSD Zero Clause License\n\n" + _ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies.", ".")),
    ("BSL-1.0", _BOOST), ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003\n\n" + _BOOST), ("Unlicense", _UNLICENSE), ("Unlicense", _UNLICENSE + "\n\nFor more information, please refer to <https://unlicense.org>"), ("WTFPL", _WTFPL),
    ("MIT", _MIT), ("MIT", "MIT License\n\n" + _MIT), ("MIT", "The MIT License (MIT)\n\n" + _MIT), ("ISC", _ISC), ("ISC", "ISC License\n\n" + _ISC),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL), ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + "\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n" + _BSD_TAIL),
    ("Zlib", _ZLIB), ("Zlib", "zlib License\n\n" + _ZLIB),
]
# One-line notices, by SPDX id.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC0-1.0", "Licensed under CC0 1.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."), ("LicenseRef-all-rights-reserved", "All rights reserved."),
]
#: A copyright line: it begins with the word or sign (after comment marks) and goes on with a sign, a year, 'by' or nothing.
COPYRIGHT = r"(^|\n)[ \t#*/;!>-]*(copyright|\(c\)|©)[ \t]*(\(c\)|©|by|[0-9]|<|\[|\n|$)[^\n]*"


# Between words there are two spaces, one of each word, so that equal spellings may follow each other.
_STEPS = [(COPYRIGHT, "\n"), (r"https?://(www\.)?", ""), (r"[^\p{L}\p{N}\n]+", "  "), (r" *\n[ \n]*", " \n ")]
_WIDE = lambda s: s.replace("-", " ").replace(" ", "  ")
_SPELL = [(f" {a}{s} ", f" {b}{s} ") for a, b in dict.fromkeys((_WIDE(a), _WIDE(b)) for a, b in SPELLINGS) if a != b for s in ("", "s")]
_ANY = " (" + "|".join(a.strip() for a, _ in _SPELL) + ") "


def lines(text: F.Column) -> F.Column:
    """The canonical text with its lines kept: words and newlines, a space on either side of each."""
    out = F.lower(text)
    for pattern, by in _STEPS:
        out = F.regexp_replace(out, pattern, by)
    return F.concat(F.lit(" "), out, F.lit(" "))


def spelled(lined: F.Column) -> F.Column:
    """Equivalent spellings made one; texts without any, which are most, are searched once only."""
    out = lined
    for a, b in _SPELL:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.when(lined.rlike(_ANY), out).otherwise(lined)


def whole(lined: F.Column) -> F.Column:
    """The canonical text on one line; spellings of two words may have met at a line's end."""
    out = F.replace(lined, F.lit("\n"), F.lit(""))
    for a, b in _SPELL:
        if " " in a.strip():
            out = F.replace(out, F.lit(a), F.lit(b))
    return F.replace(F.trim(out), F.lit("  "), F.lit(" "))


def digests(licences: DataFrame) -> DataFrame:
    """(digest, license) of licences(license, text)."""
    made = licences.where("text is not null and license is not null").select("license", lines(F.col("text")).alias("lined")).select("license", spelled(F.col("lined")).alias("lined")).select("license", whole(F.col("lined")).alias("canon")).where("canon <> ''")
    return made.groupBy(F.sha2("canon", 256).alias("digest")).agg(F.min("license").alias("license"))


def scan(spark: SparkSession, docs: DataFrame, licences: DataFrame | None = None, notices: DataFrame | None = None) -> DataFrame:
    """doc_id, digest, license (or null), notices (ids by commas, sorted) for each row of docs(doc_id, text)."""
    licences = spark.createDataFrame(LICENSES, "license string, text string") if licences is None else licences
    notices = spark.createDataFrame(NOTICES, "license string, text string") if notices is None else notices
    table, short = digests(licences.unionByName(notices)), digests(notices)
    if notices.limit(C.FEW + 1).count() > C.FEW:
        raise ValueError(f"more than {C.FEW} one-line notices")
    few = table.limit(C.FEW + 1).count() <= C.FEW
    by_digest = short.agg(F.map_from_entries(F.collect_list(F.struct("digest", "license"))).alias("by_digest"))  # one row of at most FEW entries
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lines(F.col("text").cast("string")).alias("lined")).select("doc_id", spelled(F.col("lined")).alias("lined"))
    ids = F.expr(r"array_sort(array_distinct(filter(transform(split(lined, '\n'), l -> by_digest[sha2(replace(trim(l), '  ', ' '), 256)]), x -> x is not null)))")
    looked = docs.join(F.broadcast(by_digest)).select("doc_id", F.sha2(whole(F.col("lined")), 256).alias("digest"), F.coalesce(F.array_join(ids, ","), F.lit("")).alias("notices"))
    return looked.join(F.broadcast(table) if few else table, "digest", "left").select("doc_id", "digest", "license", "notices")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, C.table(spark, sf_dir, "documents"))


def _duck() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    text = lambda s: quote(s).replace("\n", "' || chr(10) || '")
    out = "lower(text)"
    for pattern, by in _STEPS:
        out = f"regexp_replace({out}, {quote(pattern)}, {text(by)}, 'g')"
    out = f"' ' || {out} || ' '"
    for a, b in _SPELL:
        out = f"replace({out}, {quote(a)}, {quote(b)})"
    one = "replace(lined, chr(10), '')"
    for a, b in _SPELL:
        if " " in a.strip():
            one = f"replace({one}, {quote(a)}, {quote(b)})"
    one = f"replace(trim({one}), '  ', ' ')"
    rows = lambda xs: ", ".join(f"({quote(i)}, {text(t)})" for i, t in xs)
    return f"""
WITH short AS (SELECT * FROM (VALUES {rows(NOTICES)}) t(license, text)),
full_texts AS (SELECT * FROM (VALUES {rows(LICENSES)}) t(license, text) UNION ALL SELECT * FROM short),
known AS (SELECT sha256({one}) AS digest, min(license) AS license FROM (SELECT license, {out} AS lined FROM full_texts) GROUP BY 1),
notice AS (SELECT sha256({one}) AS digest, min(license) AS license FROM (SELECT license, {out} AS lined FROM short) GROUP BY 1),
d AS (SELECT row_number() OVER () AS r, doc_id, {out} AS lined FROM documents),
found AS (SELECT r, string_agg(DISTINCT license, ',' ORDER BY license) AS notices
          FROM (SELECT r, sha256(replace(trim(unnest(string_split(lined, chr(10)))), '  ', ' ')) AS digest FROM d) JOIN notice USING (digest) GROUP BY r)
SELECT doc_id, digest, license, notices FROM (
  SELECT doc_id, sha256({one}) AS digest, coalesce(notices, '') AS notices FROM d LEFT JOIN found USING (r)) LEFT JOIN known USING (digest)
"""


OP1_SQL = _duck()
