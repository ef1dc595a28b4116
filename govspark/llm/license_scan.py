"""Licence lookup by canonical digests, in DataFrame functions only.

A text is made canonical: lower case, equivalent spellings joined, copyright lines out, everything but letters and digits
out, single spaces. Its digest is looked up among those of known licences by a hash join. The same is done for every line,
whose digest is looked up among known licence notices. Only lines as long as a known notice are kept for the join.

The known texts are a table of the caller's or ``catalogue()``; their digests travel to every task only while their counted
number is within ``BROADCAST_ROWS``. The documents' text is never shuffled.

Defined results: a null, blank or wholly copyright text has the digest null and no licence; known texts that become equal
name all their licences, sorted; a licence named by text and line counts once in ``licenses``; repeated rows come out as
often as they go in, and repeated keys share what is found under any of their rows; other columns are not read.
"""

from __future__ import annotations

from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from govspark.llm.tables import plain_docs

BROADCAST_ROWS = 100_000

#: Spellings that licence matching treats as equal, from public matching guidelines.
SPELLINGS = (
    ("licence", "license"), ("licenced", "licensed"), ("sub-license", "sublicense"), ("sub license", "sublicense"), ("non-commercial", "noncommercial"),
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("authorisation", "authorization"), ("behaviour", "behavior"), ("fulfil ", "fulfill "),
    ("whilst", "while"), ("wilful", "willful"), ("owner", "holder"), ("per cent", "percent"), ("https://", "http://"),
)

_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""
_MIT_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

#: Public licence texts, and one-line notices that name a licence.
KNOWN = (
    ("MIT", "text", f"MIT License\n{_MIT_GRANT}\n{_MIT_WARRANTY}"),
    ("MIT", "text", f"The MIT License (MIT)\n{_MIT_GRANT}\n{_MIT_WARRANTY}"),
    ("MIT", "text", f"{_MIT_GRANT}\n{_MIT_WARRANTY}"),
    ("ISC", "text", f"ISC License\n{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_WARRANTY}"),
    ("ISC", "text", f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_WARRANTY}"),
    ("0BSD", "text", f"{_ISC_GRANT}.\n{_ISC_WARRANTY}"),
    ("BSD-2-Clause", "text", f"{_BSD_2}\n{_BSD_WARRANTY}"),
    ("BSD-3-Clause", "text", f"{_BSD_2}\n{_BSD_3}\n{_BSD_WARRANTY}"),
    ("MIT", "line", "Released under the MIT License."),
    ("MIT", "line", "Licensed under the MIT License."),
    ("MIT", "line", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "line", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "line", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("Apache-2.0", "line", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "line", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "line", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "line", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "line", "Licensed under CC BY 4.0."),
    ("BSD-3-Clause", "line", "SPDX-License-Identifier: BSD-3-Clause"),
)

#: Usual headings of the short licences.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "MIT", "License: MIT", "Expat License"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)", "ISC"),
    "0BSD": ("0BSD", "BSD Zero Clause License", "Zero-Clause BSD", "Zero-Clause BSD License", "BSD 0-Clause License", "BSD Zero Clause License (0BSD)"),
    "BSD-2-Clause": (
        "BSD 2-Clause License", "The BSD 2-Clause License", "BSD 2-Clause", "The 2-Clause BSD License", "2-Clause BSD License", 'BSD 2-Clause "Simplified" License',
        "Simplified BSD License", "The Simplified BSD License", "FreeBSD License", "BSD License", "The BSD License",
    ),
    "BSD-3-Clause": (
        "BSD 3-Clause License", "The BSD 3-Clause License", "BSD 3-Clause", "The 3-Clause BSD License", "3-Clause BSD License", 'BSD 3-Clause "New" or "Revised" License',
        "New BSD License", "The New BSD License", "Modified BSD License", "Revised BSD License", "BSD License", "The BSD License",
    ),
}
#: Marks of the conditions: digits, letters, roman digits; of bullets and dashes the canonical form keeps nothing.
MARKS = (("1. ", "2. ", "3. "), ("", "", ""), ("a. ", "b. ", "c. "), ("i. ", "ii. ", "iii. "))
#: What follows these lines in a whole text is advice on its use, often left out; the line itself stays or goes.
ENDS = ("END OF TERMS AND CONDITIONS", "ADDENDUM: How to use this License for your documents", "Exhibit A - Source Code Form License Notice")


def catalogue() -> list[tuple[str, str, str]]:
    """``KNOWN``; the short licences under all ``TITLES`` and none, with all ``MARKS``; the texts in ``licenses``, whole and up to ``ENDS``."""
    plain = [
        ("MIT", f"{_MIT_GRANT}\n{_MIT_WARRANTY}"),
        ("0BSD", f"{_ISC_GRANT}.\n{_ISC_WARRANTY}"),
        ("0BSD", f"{_ISC_GRANT}.\n{_ISC_WARRANTY}".replace("and/or distribute", "and distribute")),
    ]
    for notice in (", provided", " provided"):
        for verbs in ("and/or distribute", "and distribute"):
            plain.append(("ISC", f"{_ISC_GRANT}{notice} that the above copyright notice and this permission notice appear in all copies.\n{_ISC_WARRANTY}".replace("and/or distribute", verbs)))
    holders = (("copyright holder", "COPYRIGHT HOLDER"), ("University", "REGENTS"))
    for marks in MARKS:
        two, three = _BSD_2, _BSD_3.replace("3. ", marks[2])
        for number, mark in zip(("1. ", "2. "), marks):
            two = two.replace(f"\n{number}", f"\n{mark}")
        for name, shout in holders:
            warranty = _BSD_WARRANTY.replace("COPYRIGHT HOLDERS", "COPYRIGHT HOLDERS" if shout == "COPYRIGHT HOLDER" else shout).replace("THE COPYRIGHT HOLDER OR", f"THE {shout} OR")
            plain.append(("BSD-2-Clause", f"{two}\n{warranty}"))
            plain.append(("BSD-3-Clause", f"{two}\n{three.replace('copyright holder', name)}\n{warranty}"))
    rows = [(name, "text", f"{title}\n{text}") for name, text in plain for title in ("", *TITLES[name])]
    for file in sorted(resources.files(__package__).joinpath("licenses").iterdir(), key=lambda f: f.name):
        if file.name.endswith(".txt"):
            text = file.read_text(encoding="utf-8")
            rows.append((file.name.removesuffix(".txt"), "text", text))
            for end in ENDS:
                if end in text:
                    head = text[: text.index(end)]
                    rows += [(file.name.removesuffix(".txt"), "text", t) for t in (head, f"{head}{end}")]
    return [*KNOWN, *rows]


COPYRIGHT_LINE = r"(?m)^[ \t*#/;-]*(copyright|\(c\)|©|all rights reserved)[^\n]*$"


def canonical_lines(text: Column) -> Column:
    """The canonical form with its line breaks kept."""
    out = F.lower(F.coalesce(text, F.lit("")))
    out = F.regexp_replace(out, COPYRIGHT_LINE, "")
    for spelling, common in SPELLINGS:
        out = F.replace(out, F.lit(spelling), F.lit(common))
    return F.regexp_replace(out, r"[^\p{L}\p{N}\n]+", " ")


def canonical_text(lines: Column) -> Column:
    return F.trim(F.regexp_replace(lines, r"[ \n]+", " "))


def known_licenses(spark: SparkSession, rows=None) -> DataFrame:
    return spark.createDataFrame(catalogue() if rows is None else rows, "license string, kind string, text string")


def _digests(known: DataFrame) -> DataFrame:
    form = known.select("license", "kind", canonical_text(canonical_lines(F.col("text"))).alias("form")).filter("form != ''")
    return form.groupBy("kind", "form").agg(F.array_sort(F.collect_set("license")).alias("names")).select("kind", F.sha2("form", 256).alias("digest"), F.length("form").alias("size"), "names")


def scan(docs: DataFrame, known: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key, digest of the canonical text, text_licenses, line_licenses, licenses."""
    table = _digests(known)
    rows = table.select("kind", "size").limit(BROADCAST_ROWS + 1).collect()
    hint = F.broadcast if len(rows) <= BROADCAST_ROWS else lambda df: df
    sizes = sorted({r["size"] for r in rows if r["kind"] == "line"})
    canonical = plain_docs(docs, key, text).select("doc", canonical_lines(F.col("body")).alias("lines"))

    whole = canonical.select("doc", F.nullif(canonical_text(F.col("lines")), F.lit("")).alias("form")).select("doc", F.sha2("form", 256).alias("digest"))
    texts = hint(table.filter("kind = 'text'").select("digest", F.col("names").alias("text_licenses")))

    # trimming comes first, so that the length alone decides which lines are hashed
    lines = canonical.select("doc", F.explode(F.split("lines", "\n")).alias("line")).select("doc", F.trim("line").alias("line"))
    lines = lines.filter(F.length("line").isin(sizes) if len(rows) <= BROADCAST_ROWS else F.length("line") > 0)
    notices = lines.select("doc", F.sha2("line", 256).alias("digest")).join(hint(table.filter("kind = 'line'").select("digest", "names")), "digest")
    found = notices.select("doc", F.explode("names").alias("name")).distinct().groupBy("doc").agg(F.array_sort(F.collect_list("name")).alias("line_licenses"))

    none = F.array().cast("array<string>")
    out = whole.join(texts, "digest", "left").join(found, "doc", "left")
    out = out.select(F.col("doc").alias(key), "digest", F.coalesce("text_licenses", none).alias("text_licenses"), F.coalesce("line_licenses", none).alias("line_licenses"))
    return out.withColumn("licenses", F.array_sort(F.array_union("text_licenses", "line_licenses")))


def _sql(text: str) -> str:
    out = f"regexp_replace(lower(coalesce({text}, '')), '{COPYRIGHT_LINE}', '', 'g')"
    for spelling, common in SPELLINGS:
        out = f"replace({out}, '{spelling}', '{common}')"
    return rf"regexp_replace({out}, '[^\p{{L}}\p{{N}}\n]+', ' ', 'g')"


def oracle() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quote(a)}, {quote(b)}, {quote(c)})" for a, b, c in KNOWN)
    whole = "trim(regexp_replace(lines, '[ \\n]+', ' ', 'g'))"
    return rf"""
WITH known AS (SELECT license, kind, sha256({whole}) AS digest FROM (SELECT license, kind, {_sql('text')} AS lines FROM (VALUES {values}) AS k(license, kind, text))),
doc AS (SELECT doc_id, {_sql('text')} AS lines FROM documents),
whole AS (SELECT doc_id, sha256(nullif({whole}, '')) AS digest FROM doc),
line AS (SELECT doc_id, trim(unnest(string_split(lines, chr(10)))) AS line FROM doc),
by_line AS (
  SELECT doc_id, list(DISTINCT license ORDER BY license) AS names FROM (SELECT DISTINCT doc_id, line FROM line WHERE length(line) BETWEEN 8 AND 200) JOIN known ON kind = 'line' AND digest = sha256(line) GROUP BY doc_id
),
by_text AS (SELECT digest, list(DISTINCT license ORDER BY license) AS names FROM known WHERE kind = 'text' GROUP BY digest)
SELECT doc_id, whole.digest, coalesce(array_to_string(t.names, ','), '') AS text_licenses, coalesce(array_to_string(l.names, ','), '') AS line_licenses
FROM whole LEFT JOIN by_text t ON whole.digest = t.digest LEFT JOIN by_line l USING (doc_id)
"""
