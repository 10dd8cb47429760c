"""Licence scans by canonical digests of entire texts.

A text and the known licences are brought to one form: lower case, lines that state a copyright and lines that only reserve
rights or name an SPDX identifier dropped, every run of characters other than letters and numbers one space, equivalent spellings
levelled. A line states a copyright if it begins with the word, unless it goes on as licences do (a list of words), with the sign, or
with "(c)" and the word or a year; where it ends with a comma, "&", "and" or "by" the next line belongs to it. A line of the licence
itself that a wrap happens to begin with "copyright" stays. The digest of that form is joined with the digests of the known licences.
A document is a licence if the whole text is one, however it is spaced, wrapped, cased, punctuated or spelled, and whoever holds
the copyright. Known are the short licences in KNOWN with the titles they go under, and the long ones in license_texts.

Notices and licences that stand inside longer texts are found by units: a text is cut at line breaks and after sentences, and
the digest of every run of units that is as long as a known form is looked up as well. That is for notices and licences of a few
sentences (WITHIN); long licences are found as whole texts.

Nulls: a null text counts as empty; an empty form is no licence. Repeated rows each get their answer; of known licences with one
form the first id counts. Extra columns don't matter."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Steps after lower-casing: (pattern, replacement with \1 for groups). They hold for Java's and RE2's syntax alike.
_GAP = r"[^\p{L}\p{N}\n]*"
#: A statement goes on in the next line where a line ends with a comma, "&", "and" or "by".
_REST = r"([^\n]*(,|&|[^\p{L}\n]and|[^\p{L}\n]by)[^\S\n]*\n)*[^\n]*"
#: How licences go on after the word; a line that a wrap begins so is no statement.
_BODY = "holders? notices? and laws? interests? owners? ownership line disclaimers? licen[cs]es? resulting on permissions? patents? statements? or of also like those treaty treaties are is if doctrines in to for with as protection".split()
LINES = [
    (rf"(^|\n){_GAP}(copyright{_GAP}(\(c\)|©|[0-9]{{4}}|19yy|yyyy|year)|(\(c\)|©){_GAP}(copyright|[0-9]{{4}}|yyyy|year)){_REST}", r"\1"),
    (rf"\n[^\p{{L}}\p{{N}}]*copyright[^\p{{L}}\p{{N}}]+({'|'.join(_BODY)}|the[^\p{{L}}\p{{N}}]+(software|library))\b", r" copyright \1"),
    (rf"(^|\n){_GAP}(copyright[^\p{{L}}\p{{N}}\n]|©){_REST}", r"\1"),
    (rf"(^|\n){_GAP}spdx-[a-z]+-?[a-z]*:[^\n]*", r"\1"),
    (rf"(^|\n){_GAP}all rights reserved{_GAP}(\n|$)", r"\1\2"),
]
PUNCTUATION = [(r"[^\p{L}\p{N}]+", " ")]
#: Equivalent spellings, by ending and by word; each word is followed by one space.
SPELLINGS = [
    (r"([a-z]{3})is(e|ed|es|er|ers|ing|able|ation|ations) ", r"\1iz\2 "),
    (r"([a-z]{2})our(|s|ed|ing|able|ite) ", r"\1or\2 "),
    (r"(anal|catal)ogue(|s) ", r"\1og\2 "),
    (r"(cent|calib)re(|s) ", r"\1er\2 "),
    (r"(cancel|model|label|signal)l(ed|ing) ", r"\1\2 "),
    (r"(licen|offen|defen|practi)c(e|es|ed|ing) ", r"\1s\2 "),
    (r"(judg|acknowledg)ement(|s) ", r"\1ment\2 "),
    (r"(ful)fil(|s|ment) ", r"\1fill\2 "),
    (r"arte(fact)(|s) ", r"arti\1\2 "),
    (r" (sub|non) (licens|commercial)", r" \1\2"),
    (r" per cent ", " percent "),
    (r" whilst ", " while "),
    (r" https ", " http "),
]
STEPS = [*LINES, *PUNCTUATION]
#: For a pattern what a text must hold, one of it, for the pattern to occur at all: looked for first, as that is quicker.
NEEDS = {
    LINES[0][0]: ("copyright", "(c)", "©"), LINES[1][0]: ("copyright",), LINES[2][0]: ("copyright", "©"), LINES[3][0]: ("spdx-",), LINES[4][0]: ("all rights reserved",), SPELLINGS[1][0]: ("our",), SPELLINGS[2][0]: ("ogue",), SPELLINGS[3][0]: ("centre", "calibre"), SPELLINGS[4][0]: ("ll",),
    SPELLINGS[5][0]: ("licenc", "offenc", "defenc", "practic"), SPELLINGS[6][0]: ("gement",), SPELLINGS[7][0]: ("fulfil",), SPELLINGS[8][0]: ("artefact",), SPELLINGS[9][0]: (" sub ", " non "), SPELLINGS[10][0]: (" per cent ",), SPELLINGS[11][0]: (" whilst ",), SPELLINGS[12][0]: (" https ",),
}

_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n"
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_CONDITIONS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
_ENDORSE = "3. Neither the name of the {holder} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_HOLDERS_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE {holders} AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE {holder} OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_BSD = _HOLDERS_AS_IS.format(holders="COPYRIGHT HOLDERS", holder="COPYRIGHT HOLDER")
#: Texts of licences and of the notices that stand for them.
KNOWN = {
    "MIT": f"MIT License\n{_GRANT}{_AS_IS}",
    "MIT-text": f"{_GRANT}{_AS_IS}",
    "MIT-notice": "Released under the MIT License.",
    "MIT-0": "MIT No Attribution\n" + _GRANT[: _GRANT.index(", subject to")] + ".\n" + _AS_IS,
    "ISC": f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_AS_IS}",
    "0BSD": f"{_ISC}.\n{_ISC_AS_IS}",
    "BSD-2-Clause": f"{_CONDITIONS}{_BSD}",
    "BSD-3-Clause": f"{_CONDITIONS}{_ENDORSE.format(holder='copyright holder')}{_BSD}",
    "BSD-3-Clause-UC": f"{_CONDITIONS}{_ENDORSE.format(holder='University')}{_HOLDERS_AS_IS.format(holders='REGENTS', holder='REGENTS')}",
    "Unlicense": "This is free and unencumbered software released into the public domain.\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\nFor more information, please refer to <https://unlicense.org>",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution.",
    "BSL-1.0": "Boost Software License - Version 1.0 - August 17th, 2003\nPermission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:\nThe copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "PostgreSQL": "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.\nIN NO EVENT SHALL THE UNIVERSITY OF CALIFORNIA BE LIABLE TO ANY PARTY FOR DIRECT, INDIRECT, SPECIAL, INCIDENTAL, OR CONSEQUENTIAL DAMAGES, INCLUDING LOST PROFITS, ARISING OUT OF THE USE OF THIS SOFTWARE AND ITS DOCUMENTATION, EVEN IF THE UNIVERSITY OF CALIFORNIA HAS BEEN ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.\nTHE UNIVERSITY OF CALIFORNIA SPECIFICALLY DISCLAIMS ANY WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE. THE SOFTWARE PROVIDED HEREUNDER IS ON AN \"AS IS\" BASIS, AND THE UNIVERSITY OF CALIFORNIA HAS NO OBLIGATIONS TO PROVIDE MAINTENANCE, SUPPORT, UPDATES, ENHANCEMENTS, OR MODIFICATIONS.",
    "WTFPL": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nVersion 2, December 2004\nEveryone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.\nDO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nTERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION\n0. You just DO WHAT THE FUCK YOU WANT TO.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\nhttp://www.apache.org/licenses/LICENSE-2.0\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
}
#: Titles under which the short licences go, beside none.
TITLES = {
    "MIT": ("The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "Expat License"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"), "0BSD": ("Zero-Clause BSD", "BSD Zero Clause License", "Zero-Clause BSD License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "BSD License"), "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "New BSD License", "BSD License"),
    "Zlib": ("zlib License", "The zlib License", "The zlib/libpng License"), "PostgreSQL": ("PostgreSQL License", "The PostgreSQL License"), "Unlicense": ("The Unlicense", "Unlicense"),
}
#: What is sought inside texts.
WITHIN = ("MIT", "MIT-text", "MIT-notice", "MIT-0", "ISC", "0BSD", "Apache-2.0-notice", "Apache-2.0-header", "GPL-3.0-notice", "CC-BY-NC-4.0-notice")


def forms() -> list[tuple[str, str]]:
    """(license_id, text) of every known form."""
    titled = [(i, f"{title}\n{KNOWN['MIT-text'] if i == 'MIT' else KNOWN[i]}") for i, titles in TITLES.items() for title in titles]
    long = [(p.stem, p.read_text("utf-8")) for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))]
    return [*KNOWN.items(), *titled, *long]


def known_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(forms(), "license_id string, text string")


def _step(text: Column, pattern: str, to: str) -> Column:
    """The pattern replaced everywhere; a text is evaluated once and only searched if it holds what the pattern needs."""
    replaced = lambda x: F.regexp_replace(x, pattern, to.replace("\\", "$"))
    needs = NEEDS.get(pattern)
    if not needs:
        return replaced(text)

    def one(x: Column) -> Column:
        holds = F.lit(False)
        for literal in needs:
            holds = holds | x.contains(literal)
        return F.when(holds, replaced(x)).otherwise(x)

    return F.get(F.transform(F.array(text), one), 0)


def canonical(text: Column) -> Column:
    out = F.lower(F.coalesce(text, F.lit("")))
    for pattern, to in STEPS:
        out = _step(out, pattern, to)
    out = F.concat(F.lit(" "), out, F.lit(" "))
    for pattern, to in SPELLINGS:
        out = _step(out, pattern, to)
    return F.btrim(out)


def known_digests(known: DataFrame) -> DataFrame:
    """known(license_id, text) -> (digest, license_id), one row for each form."""
    forms = known.select(canonical(F.col("text")).alias("form"), "license_id").where("form <> ''")
    return forms.groupBy(F.sha2("form", 256).alias("digest")).agg(F.min("license_id").alias("license_id"))


def scanned(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, canonical_sha256, license_id) of each row; license_id is null where the text is no known licence."""
    if known is None:
        digests = F.broadcast(known_digests(known_table(docs.sparkSession)))  # as many rows as forms() has entries, at most
    else:
        digests = known_digests(known)
    rows = docs.select(F.col(id_col), F.sha2(canonical(F.col(text_col)), 256).alias("canonical_sha256"))
    return rows.join(digests, rows["canonical_sha256"] == digests["digest"], "left").select(id_col, "canonical_sha256", "license_id")


#: Stands between units: neither a letter nor a number, in no known text.
UNIT = "\ue000"
#: Units that a run has at most; a hard-wrapped licence has one for each line.
LONGEST_RUN = 500


def _marked(text: Column) -> Column:
    """The canonical form with UNIT as a word between units (lines, and what ends with . ! or ? before white space)."""
    out = F.translate(F.lower(F.coalesce(text, F.lit(""))), UNIT, " ")
    for pattern, to in LINES:
        out = _step(out, pattern, to)
    out = F.regexp_replace(out, r"\n|[.!?][^\p{L}\p{N}\s]*\s", f" {UNIT} ")
    out = F.concat(F.lit(" "), F.regexp_replace(out, rf"[^\p{{L}}\p{{N}}{UNIT}]+", " "), F.lit(" "))
    for pattern, to in SPELLINGS:
        out = _step(out, pattern, to)
    return out


def _unmarked(marked: Column) -> Column:
    """canonical() of the text: without marks, and levelling the spellings of two words that a mark stood between."""
    out = F.regexp_replace(F.concat(F.lit(" "), F.translate(marked, UNIT, ""), F.lit(" ")), " +", " ")
    for pattern, to in SPELLINGS:
        if " " in pattern.strip():
            out = _step(out, pattern, to)
    return F.btrim(out)


def scanned_within(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, canonical_sha256, license_id, within) of each row: scanned(), and the sorted ids of the known licences that the
    text is or that stand in it as whole units; of one inside another the longer counts.

    known: all of it is sought whole and inside; without it WITHIN inside and every form whole. The forms sought inside are
    gathered on the driver and go along as one map, so that no row of docs is shuffled."""
    spark = docs.sparkSession
    whole = known_digests(known_table(spark) if known is None else known)
    whole = F.broadcast(whole) if known is None else whole
    if known is None:
        known = spark.createDataFrame([(i, KNOWN[i]) for i in WITHIN], "license_id string, text string")
    forms = known.select(canonical(F.col("text")).alias("form"), "license_id").where("form <> ''").groupBy("form").agg(F.min("license_id").alias("license_id"))
    table = forms.select(F.sha2("form", 256), "license_id", F.length("form"), F.split_part("form", F.lit(" "), F.lit(1))).collect()
    rows = docs.select(F.col(id_col).alias("__id"), _marked(F.col(text_col)).alias("__marked"))
    # the generator keeps the form evaluated once
    rows = rows.withColumn("__found", F.explode(F.array(F.struct(_unmarked(F.col("__marked")).alias("form"), F.filter(F.transform(F.split("__marked", UNIT), lambda u: F.btrim(u)), lambda u: u != "").alias("units")))))
    rows = rows.select("__id", F.sha2("__found.form", 256).alias("canonical_sha256"), F.col("__found.units").alias("__units"))
    rows = rows.join(whole.withColumnRenamed("digest", "canonical_sha256"), "canonical_sha256", "left")
    if not table:
        return rows.select(F.col("__id").alias(id_col), "canonical_sha256", "license_id", F.array().cast("array<string>").alias("within"))
    ids = F.create_map(*(F.lit(x) for digest, license_id, *_ in table for x in (digest, license_id)))
    lengths, firsts = sorted({r[2] for r in table}), sorted({r[3] for r in table})
    starts = F.filter(F.transform("__units", lambda u, i: F.when(F.split_part(u, F.lit(" "), F.lit(1)).isin(firsts), i)), lambda i: i.isNotNull())

    def runs(start: Column) -> Column:
        """(start, end, digest) of the runs from a unit that are as long as a known form."""
        acc = F.struct(F.lit(-1).alias("chars"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("ends"))
        ends = F.aggregate(
            F.slice("__units", start + 1, F.lit(LONGEST_RUN)),
            acc,
            lambda a, u: F.struct((a["chars"] + F.length(u) + 1).alias("chars"), (a["n"] + 1).alias("n"), F.when((a["chars"] + F.length(u) + 1).isin(lengths), F.concat(a["ends"], F.array(a["n"] + 1))).otherwise(a["ends"]).alias("ends")),
            lambda a: a["ends"],
        )
        return F.transform(ends, lambda n: F.struct(start.alias("start"), (start + n).alias("end"), ids[F.sha2(_unmarked(F.array_join(F.slice("__units", start + 1, n), " ")), 256)].alias("id")))

    rows = rows.withColumn("__hits", F.filter(F.flatten(F.transform(starts, runs)), lambda h: h["id"].isNotNull()))
    inside = lambda h, g: (g["start"] <= h["start"]) & (g["end"] >= h["end"]) & (g["end"] - g["start"] > h["end"] - h["start"])
    widest = F.filter("__hits", lambda h: ~F.exists("__hits", lambda g: inside(h, g)))
    within = F.array_union(F.transform(widest, lambda h: h["id"]), F.when(F.col("license_id").isNull(), F.array().cast("array<string>")).otherwise(F.array("license_id")))
    return rows.select(F.col("__id").alias(id_col), "canonical_sha256", "license_id", F.array_sort(within).alias("within"))
