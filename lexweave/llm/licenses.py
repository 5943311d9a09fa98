"""License scans by canonical digests, with DataFrame functions only.

Texts are brought to one form (lower case; lines that begin with a copyright notice dropped; punctuation and white
space to single spaces; equivalent spellings unified), digested with SHA-256, and hash-joined to the digests of known
license texts and notices, which are brought to the same form by the same columns. The unit is the entire text; every
line is looked up as a text of its own as well, so that a notice inside a document is told.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexweave.llm._common import read
from lexweave.plans.session import cut

COPYRIGHT_LINES = r"(?m)^[ \t\r\x{A0}]*(?:copyright|\(c\)|©|all rights reserved)[^\n]*"
#: What is dropped: as above, but a line of a wrapped text that goes on about copyright (its holders, notices) is no notice.
#: The SQL's expressions have no lookahead, so it keeps the pattern above.
NOTICE_LINES = (
    r"(?m)^[ \t\r\x{A0}]*(?:copyright(?![a-z,;.)]|[ \t]*\r?$|[ \t]+(?:holders?|owners?|notices?|licen[cs]es?|laws?|statements?|interests?|and|or|in|to|is)\b)"
    r"|\(c\)|©|all rights reserved)[^\n]*"
)
#: Punctuation, signs and white space: ASCII, Latin-1, general punctuation (curly quotes, dashes, bullets), CJK.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\xA9\xAB-\xB1\xB4\xB6-\xB8\xBB\xBF\x{2000}-\x{206F}\x{2190}-\x{23FF}\x{2500}-\x{27BF}\x{3000}-\x{303F}\x{FEFF}]+"
#: Known digests up to so many are sent to every task; a longer table is joined by shuffle.
BROADCAST_ROWS = 100_000

#: Spellings that count as equal (a choice from the matching guidelines of the SPDX project).
EQUIVALENT = [
    ("licence", "license"), ("sub license", "sublicense"), ("non commercial", "noncommercial"),
    ("acknowledgement", "acknowledgment"), ("copyright owner", "copyright holder"), ("authorisation", "authorization"),
    ("organisation", "organization"), ("per cent", "percent"), ("whilst", "while"), ("favour", "favor"),
    ("judgement", "judgment"), ("wilful", "willful"), ("utilisation", "utilization"), ("merchantibility", "merchantability"),
]

#: Names of licenses in notices: identifier -> ways to write it.
NAMES = {
    "MIT": ["the MIT License", "MIT License", "the MIT license (MIT)", "MIT"],
    "Apache-2.0": ["the Apache License, Version 2.0", "Apache License 2.0", "the Apache 2.0 License", 'the Apache License, Version 2.0 (the "License")'],
    "GPL-2.0": ["the GNU General Public License, version 2", "GNU GPL v2", "the GPL, version 2"],
    "GPL-3.0": ["the GNU General Public License, version 3", "GNU GPL v3", "the GPL, version 3"],
    "LGPL-3.0": ["the GNU Lesser General Public License, version 3", "GNU LGPL v3"],
    "AGPL-3.0": ["the GNU Affero General Public License, version 3", "GNU AGPL v3"],
    "MPL-2.0": ["the Mozilla Public License, version 2.0", "MPL 2.0"],
    "BSD-2-Clause": ["the BSD 2-Clause License", "the Simplified BSD License"],
    "BSD-3-Clause": ["the BSD 3-Clause License", "the New BSD License"],
    "ISC": ["the ISC License"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal"],
    "CC-BY-4.0": ["CC BY 4.0", "the Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "the Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "the Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "the Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0"],
}
PHRASES = ["Licensed under {}.", "Released under {}.", "Distributed under {}.", "This work is licensed under {}.", "SPDX-License-Identifier: {}"]

AS_IS_MIT = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
AS_IS_ISC = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""
AS_IS_BSD = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
BSD_TERMS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
"""
BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission.
"""

#: Entire license texts, without their titles and copyright lines.
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.
""" + AS_IS_MIT,
    "MIT-0": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so.
""" + AS_IS_MIT,
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.
""" + AS_IS_ISC,
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted.
""" + AS_IS_ISC,
    "BSD-2-Clause": BSD_TERMS + AS_IS_BSD,
    "BSD-3-Clause": BSD_TERMS + BSD_NAMES + AS_IS_BSD,
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it
and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If
you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not
required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
}
TITLES = {
    "MIT": ["MIT License", "The MIT License (MIT)"], "MIT-0": ["MIT No Attribution"], "ISC": ["ISC License"], "0BSD": ["BSD Zero Clause License"],
    "BSD-2-Clause": ["BSD 2-Clause License"], "BSD-3-Clause": ["BSD 3-Clause License"], "Zlib": ["zlib License"],
}


#: Digests of the canonical forms of longer public texts, entire and, where there is a second one, without
#: what follows their terms (appendix, how to apply, exhibits).
DIGESTS: dict[str, list[str]] = {
    "Apache-2.0": ["4580e5390400d27df89edd0617548ac0e66eaa029f6e07cf98aac9cd100b3a37", "0b8c1a9e0ec99ab3b27e123e667fe4843df4dd7e6c667ccdc634dd6878c5dd6c"],
    "GPL-2.0": ["efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821", "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34"],
    "GPL-3.0": ["f6eaf8069e6992495ee63002d3cf837d745ad9c33d0c2129f4dd67750ebe0094", "7e1ec759902e79fd98df32aeafb56e0fcc9348cebf7b52c7a875052ac012ad4a"],
    "LGPL-2.1": ["4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"],
    "LGPL-3.0": ["aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"],
    "MPL-2.0": ["9e79a7d513376f6fa1500e4df4f6276c6e7e61c5c3e28dcdb1acee24033acc56", "2cec6f733aa157c2d0b72e9669f75ca354f332218fcb5a3a885931f385272a04"],
    "MPL-1.1": ["fbe9a0b96f52e03cb474f9a7083781399c011279e85b548118563ec96e659354"],
    "CC0-1.0": ["96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"],
    "GFDL-1.3": ["7e8edd3abe6258bb82bb853d91a0c24fcd9976894fd0592747354cffe1cb18e7"],
    "GFDL-1.2": ["1c057ea35084eb195331cec1a49fca335c176422a7726a9a23636906fd4e241f"],
    "Artistic-1.0": ["e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2"],
}


def known_texts() -> list[tuple[str, str]]:
    """(license, text): entire texts with and without a title, and the notices that PHRASES and NAMES make."""
    out = [(name, text) for name, text in TEXTS.items()]
    out += [(name, f"{title}\n\n{TEXTS[name]}") for name, titles in TITLES.items() for title in titles]
    out += [(name, phrase.format(way)) for name, ways in NAMES.items() for way in dict.fromkeys([*ways, name]) for phrase in PHRASES]
    return out


def canonical(text: Column) -> Column:
    """One form for texts that differ in case, punctuation, copyright lines or spelling only."""
    s = F.regexp_replace(F.lower(text), NOTICE_LINES, " ")
    s = F.regexp_replace(s, SEPARATORS, " ")
    for a, b in EQUIVALENT:
        s = F.replace(s, F.lit(a), F.lit(b))
    return F.trim(s)


def digest(text: Column) -> Column:
    """SHA-256 of the canonical form; null for null."""
    return F.sha2(canonical(text), 256)


def known_digests(spark: SparkSession, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """digest, license: one row for each canonical form that isn't empty (the least name if several share it); DIGESTS as
    well if no ``texts`` are named."""
    table = spark.createDataFrame(texts if texts is not None else known_texts(), "license string, text string")
    rows = table.where(canonical(F.col("text")) != "").select(digest(F.col("text")).alias("digest"), "license")
    if texts is None:
        rows = rows.unionByName(spark.createDataFrame([(d, name) for name, own in DIGESTS.items() for d in own], "digest string, license string"))
    return rows.groupBy("digest").agg(F.min("license").alias("license"))


def scan_licenses(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """One row for each document: doc_id, text_digest, license (of the entire text, else null), notices (the licenses
    that a line gives notice of, sorted, comma-joined, empty if none), n_notices (lines that do).

    ``known``: digest, license; of a digest's several rows the least license counts. A null text has a null digest, no
    license and no notices; an empty canonical form matches nothing, and an empty table gives no rows. Repeated rows and
    null ids give a row each. Other columns are not read. Lines meet the known digests where they are made and those of
    one document are combined before the shuffle, so a very long text costs one row in it.
    """
    spark = docs.sparkSession
    known = cut((known if known is not None else known_digests(spark)).groupBy("digest").agg(F.min("license").alias("license")))
    if known.count() <= BROADCAST_ROWS:
        known = F.broadcast(known)
    # the text's own digest stands below the explode, so that it is made once for each text
    whole_texts = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", digest(F.col("text")).alias("text_digest"), F.split("text", "\n").alias("lines"))
    units = whole_texts.select("row", "doc_id", "text_digest", F.explode_outer("lines").alias("line"))
    units = units.withColumn("line_digest", digest(F.col("line"))).drop("line")
    lines = units.join(known.select(F.col("digest").alias("line_digest"), F.col("license").alias("notice")), "line_digest", "left")
    per_doc = lines.groupBy("row", "doc_id", "text_digest").agg(
        F.array_join(F.array_sort(F.collect_set("notice")), ",").alias("notices"), F.count("notice").alias("n_notices")
    )
    whole = known.select(F.col("digest").alias("text_digest"), "license")
    return per_doc.join(whole, "text_digest", "left").select("doc_id", "text_digest", "license", "notices", "n_notices")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read(spark, sf_dir, "documents"))


def _sql_canonical(text: str) -> str:
    s = f"regexp_replace(lower({text}), '{COPYRIGHT_LINES}', ' ', 'g')"
    s = f"regexp_replace({s}, '{SEPARATORS}', ' ', 'g')"
    for a, b in EQUIVALENT:
        s = f"replace({s}, '{a}', '{b}')"
    return f"trim({s}, ' ')"


def _sql_known() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    return ", ".join(f"({quoted(name)}, {quoted(text)})" for name, text in known_texts())


def _sql_digests() -> str:
    return ", ".join(f"('{d}', '{name}')" for name, own in DIGESTS.items() for d in own)


OP9_SQL = f"""
WITH known AS (
  SELECT digest, min(license) AS license FROM (
    SELECT sha256(c) AS digest, license FROM (SELECT license, {_sql_canonical("body")} AS c FROM (VALUES {_sql_known()}) t(license, body)) WHERE c <> ''
    UNION ALL SELECT digest, license FROM (VALUES {_sql_digests()}) t(digest, license)) GROUP BY digest),
d AS (SELECT row_number() OVER () AS r, doc_id, text, sha256({_sql_canonical("text")}) AS text_digest FROM documents),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
n AS (
  SELECT r, string_agg(DISTINCT license, ',' ORDER BY license) AS notices, count(*) AS n
  FROM l JOIN known ON known.digest = sha256({_sql_canonical("line")}) GROUP BY r)
SELECT d.doc_id, d.text_digest, known.license, coalesce(n.notices, '') AS notices, CAST(coalesce(n.n, 0) AS BIGINT) AS n_notices
FROM d LEFT JOIN known ON known.digest = d.text_digest LEFT JOIN n USING (r)
"""
