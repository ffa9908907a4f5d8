"""License scans by canonical digests.

Text is reduced to a canonical form (no case, punctuation, copyright lines or variant
spellings), and digests of whole texts, and of whole lines for one-line notices, are
hash-joined to those of known licenses reduced the same way.  A whole text is known with
or without its title and a line that reserves all rights, however its lines are broken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Spellings that count as the same, second for first, applied in this order to
# canonical words.
SPELLINGS = (
    ("licence", "license"), ("sub license", "sublicense"), ("non commercial", "noncommercial"), ("merchantibility", "merchantability"),
    ("acknowledgement", "acknowledgment"), ("authorisation", "authorization"), ("authorise", "authorize"), ("organisation", "organization"),
    ("recognise", "recognize"), ("favour", "favor"), ("behaviour", "behavior"), ("whilst", "while"), ("wilful", "willful"),
    ("fulfilment", "fulfillment"), ("copyright owner", "copyright holder"), ("per cent", "percent"), ("https", "http"),
)
_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM,
DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE
OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN
CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution."""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this
software without specific prior written permission."""
_BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR
CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT
OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
POSSIBILITY OF SUCH DAMAGE."""
# Fixed values: (license, text).  A text of one line also counts as a notice inside a text.
KNOWN = (
    ("MIT", f"""MIT License
Copyright (c) <year> <holder>
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to
deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense,
and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
{_WARRANTY}"""),
    ("ISC", f"""ISC License
Copyright (c) <year> <holder>
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
{_ISC_WARRANTY}"""),
    ("0BSD", f"""BSD Zero Clause License
Copyright (c) <year> <holder>
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
{_ISC_WARRANTY}"""),
    ("BSD-2-Clause", f"BSD 2-Clause License\nCopyright (c) <year> <holder>\n{_BSD_HEAD}\n{_BSD_WARRANTY}"),
    ("BSD-3-Clause", f"BSD 3-Clause License\nCopyright (c) <year> <holder>\n{_BSD_HEAD}\n{_BSD_THIRD}\n{_BSD_WARRANTY}"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
)
# Fixed values: (license, digest of its canonical text), with and without the appendix that
# says how to apply the terms.
DIGESTS = (
    ("Apache-2.0", "036b5ff6d47b44974c624da95e5bf0ac7ddfe5030e41dfa7ff8ac0c1daa9f32b"),
    ("Apache-2.0", "f70a2718f78121f2da77cd6afbffffbd668d7c1fd36c85a3ef121e83cb5f48fe"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-1.0", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-2.0", "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34"),
    ("GPL-3.0", "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a"),
    ("GPL-3.0", "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.0", "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-2.1", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "cbbde7eeab9b4d180dc00b34252f800e97fb1cddbab38ed8c0c73b956dc2cbf6"),
    ("MPL-2.0", "6fedd8db6adb0e102fc0f69b9e1501d2edaf25940e34910831cab46f9f5d4e4d"),
)
COPYRIGHT_LINE = r"^[^\p{L}\p{N}\n]*(?:copyright[ \t]*(?:\(c\)|©|[0-9]{4}|by\b|the\b[^\n]*\b(?:authors|contributors|developers|project|foundation)\b|[<\[{])|©|\(c\)[ \t]*[0-9])[^\n]*$"
NOT_WORDS = r"[^\p{L}\p{N}\n]+"
# canonical lines that a whole text may have or not: its title, and the rights
TITLE_LINE = (
    r"^ *(?:all rights reserved|(?:the )?(?:mit|isc|expat|(?:new |modified |simplified |revised )?bsd(?: [0-9])?(?: clause)?|bsd zero clause|zero clause bsd)"
    r" license(?: mit| isc| expat| 0bsd| bsd [0-9] clause)?) *$"
)
# spellings of two words, which a line may end between
TWO_WORDS = tuple(pair for pair in SPELLINGS if " " in pair[0])


def canonical_lines(text: Column) -> Column:
    """Canonical lines, joined by line feeds: what is left are words and single blanks."""
    bare = F.regexp_replace(text, r"(?imd)" + COPYRIGHT_LINE, "")
    words = F.regexp_replace(F.lower(bare), NOT_WORDS, " ")
    for other, usual in SPELLINGS:
        words = F.replace(words, F.lit(other), F.lit(usual))
    return words


def canonical(lines: Column) -> Column:
    """The whole text as one line, without title and rights."""
    words = F.trim(F.regexp_replace(F.regexp_replace(lines, r"(?md)" + TITLE_LINE, ""), r"[ \n]+", " "))
    for other, usual in TWO_WORDS:
        words = F.replace(words, F.lit(other), F.lit(usual))
    return words


def digest(words: Column) -> Column:
    return F.sha2(F.encode(words, "UTF-8"), 256)


def known(spark: SparkSession, extra: DataFrame | None = None) -> DataFrame:
    """``(license_id, digest, notice)``: the fixed licenses, and rows ``(license_id, text)`` of ``extra``."""
    rows = spark.createDataFrame(list(KNOWN), "license_id string, text string")
    if extra is not None:
        rows = rows.unionByName(extra.select("license_id", "text"))
    whole = canonical(canonical_lines(F.col("text")))
    kept = rows.select("license_id", whole.alias("_w"), (~F.col("text").contains("\n")).alias("notice")).where("_w != ''")
    listed = spark.createDataFrame(list(DIGESTS), "license_id string, digest string").withColumn("notice", F.lit(False))
    kept = kept.select("license_id", digest(F.col("_w")).alias("digest"), "notice").unionByName(listed)
    return kept.groupBy("digest").agg(F.min("license_id").alias("license_id"), F.max("notice").alias("notice"))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", extra: DataFrame | None = None) -> DataFrame:
    """One row per input row: ``doc_id, digest, license_id, notices``.

    ``digest`` is that of the whole canonical text (null and empty texts: of nothing) and
    ``license_id`` the license whose whole text it is, else null.  ``notices`` are the
    licenses of which a one-line notice is a whole line, sorted, once each, joined by
    commas.  Repeated rows get equal results; where two licenses have the same digest the
    first by name is given.
    """
    spark = docs.sparkSession
    licenses = known(spark, extra)
    # the fixed list has some tens of rows; what a caller adds is left to Spark's own size checks
    licenses = F.broadcast(licenses) if extra is None else licenses
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    lines = canonical_lines(F.col("text"))
    # digests of all lines: those of no license are dropped by the join
    units = rows.select("doc_id", F.xxhash64("text").alias("print"), lines.alias("lines"))
    each = units.select("doc_id", "print", F.explode(F.split("lines", "\n")).alias("line")).where("line != ''")
    found = each.select("doc_id", "print", digest(F.trim("line")).alias("digest")).join(licenses.where("notice"), "digest")
    notices = found.groupBy(F.col("doc_id").alias("d"), F.col("print").alias("p")).agg(
        F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("notices")
    )
    whole = units.select("doc_id", "print", digest(canonical(F.col("lines"))).alias("digest")).join(licenses.select("digest", "license_id"), "digest", "left")
    here = whole.join(notices, whole["doc_id"].eqNullSafe(notices["d"]) & (whole["print"] == notices["p"]), "left")
    return here.select("doc_id", "digest", "license_id", F.coalesce("notices", F.lit("")).alias("notices"))
