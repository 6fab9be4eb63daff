"""Licence scans by canonical digests.

A text is brought into a canonical form: ASCII letters in lower case, copyright lines dropped, everything but letters,
digits and non-ASCII characters made single blanks, words of equivalent spelling unified. The SHA-256 of that form is
looked up among the digests of known licences, so entire texts match or don't. The same is done for each sentence and
line of a text against known notices. All of it is DataFrame functions; the known table is small and fixed.

Defined results: a null or empty text, and one of which the canonical form leaves nothing, has no licence; repeated rows
are looked up each; an empty table gives an empty result.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Spellings that count as the same, the first as the second.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("artefact", "artifact"), ("authorisation", "authorization"), ("authorised", "authorized"), ("cancelled", "canceled"), ("catalogue", "catalog"), ("centre", "center"),
    ("favour", "favor"), ("favourite", "favorite"), ("fulfil", "fulfill"), ("fulfilment", "fulfillment"), ("judgement", "judgment"), ("labour", "labor"), ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("merchantibility", "merchantability"),
    ("modelled", "modeled"), ("non commercial", "noncommercial"), ("offence", "offense"), ("organisation", "organization"), ("per cent", "percent"), ("practise", "practice"), ("programme", "program"), ("recognise", "recognize"), ("sub license", "sublicense"),
    ("sub licence", "sublicense"), ("sublicence", "sublicense"), ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"), ("https", "http"), ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"), ("gpl", "general public license"),
)
#: One-sentence notices by licence.
NOTICES = (
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "This project is licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "This project is licensed under the Apache License, Version 2.0."), ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0-only", "Licensed under the GNU General Public License, version 3."), ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-4.0", "This work is licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("BSD-3-Clause", "Licensed under the 3-Clause BSD License."), ("BSD-2-Clause", "Licensed under the 2-Clause BSD License."), ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
)
_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_ISC_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
#: Whole licence texts, without their copyright lines.
_SHORT = (
    ("MIT", "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n" + _WARRANTY),
    ("ISC", "ISC License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_WARRANTY),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _ISC_WARRANTY),
)
_LONG = ("Apache-2.0", "GPL-2.0-only", "GPL-3.0-only", "MPL-2.0", "CC-BY-SA-4.0", "Unlicense")
_UNTITLED = {name: text.removeprefix(f"{name} License\n\n") for name, text in _SHORT}
_TITLES = {"MIT": ("The MIT License", "The MIT License (MIT)"), "ISC": ("The ISC License",), "0BSD": ("Zero-Clause BSD", "BSD Zero Clause License")}
#: The clauses of the BSD licences, which stand numbered or under bullets, and their disclaimer.
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
)
_BSD_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A '
    "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT {} OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED "
    "TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT "
    "(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)


def bsd(clauses: int, numbered: bool, title: str, holder: str) -> str:
    lines = [f"{k}. {x}" if numbered else f"* {x}" for k, x in enumerate(_BSD[1 : clauses + 1], 1)]
    return "\n\n".join([*([title] if title else []), _BSD[0], *lines, _BSD_WARRANTY.format(holder)])


_BSD_TEXTS = tuple(
    (f"BSD-{n}-Clause", bsd(n, numbered, title, holder))
    for n in (2, 3)
    for title in ("", f"BSD {n}-Clause License", f"The {n}-Clause BSD License")
    for numbered in (True, False)
    for holder in ("HOLDER", "OWNER")
)
#: The short ones with their usual titles and without, the long ones from their files.
TEXTS = (
    *_SHORT,
    *((name, _UNTITLED[name]) for name in ("MIT", "ISC")),
    *((name, f"{title}\n\n{_UNTITLED[name]}") for name, titles in _TITLES.items() for title in titles),
    *_BSD_TEXTS,
    *((name, (Path(__file__).parent / "license_texts" / f"{name}.txt").read_text(encoding="utf-8")) for name in _LONG),
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Lines that are copyright notices: the word before a sign, a year or a placeholder. A line of a wrapped sentence may begin
#: with the word too, and items (c) of known licences begin with "you" or "under"; those are wording.
COPYRIGHT = r"(?m)^[ \t]*(?:copyright[ \t]+(?:\(c\)|[©0-9<\[{])[^\n]*|©[^\n]*|all rights reserved[^\n]*|\(c\)[ \t]*(?:[^ \tyu\n][^\n]*|y(?:[^o\n]|o[^u\n])[^\n]*|u(?:[^n\n]|n[^d\n])[^\n]*)?)$"
MARKS = r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"
ANY_SPELLING = " (?:" + "|".join(a for a, _ in SPELLINGS) + ") "


def canonical(text: Column) -> Column:
    """The canonical form; words stand between single blanks."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.translate(text, UPPER, LOWER), COPYRIGHT, " "), MARKS, " "))
    padded = F.concat(F.lit(" "), plain, F.lit(" "))
    unified = F.replace(padded, F.lit(" "), F.lit("  "))  # so that neighbours don't share a blank
    for a, b in SPELLINGS:
        unified = F.replace(unified, F.lit(_apart(a)), F.lit(_apart(b)))
    unified = F.replace(unified, F.lit("  "), F.lit(" "))
    return F.trim(F.when(padded.rlike(ANY_SPELLING), unified).otherwise(padded))


def _apart(words: str) -> str:
    return f" {words.replace(' ', '  ')} "


def digest(text: Column) -> Column:
    """The canonical form's SHA-256; null if nothing is left of the text."""
    form = canonical(text)
    return F.when(form != "", F.sha2(form, 256))


def known(spark, pairs: tuple[tuple[str, str], ...]) -> DataFrame:
    """Rows (license_id, digest) of fixed texts."""
    return spark.createDataFrame(pairs, "license_id string, text string").select("license_id", digest(F.col("text")).alias("digest")).distinct()


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", texts: tuple[tuple[str, str], ...] = TEXTS, notices: tuple[tuple[str, str], ...] = NOTICES) -> DataFrame:
    """Rows (id, digest, license_id, notices), one for each row of docs: the licence that the entire text is, or null, and the
    licences whose notices are among its sentences and lines, sorted, comma-joined."""
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # Every notice has this word, in any of its spellings; texts without it have no notice.
    word = "licen"
    if not all(word in text.lower() for _, text in notices):
        word = ""
    units = F.split(F.regexp_replace("text", r"([.!?])[ \t]+", "$1\n"), "\n")
    found = F.filter(units, lambda u: F.translate(u, UPPER, LOWER).contains(word))
    digests = F.transform(F.array_distinct(found), lambda u: digest(u))
    by_digest = {r["digest"]: r["license_id"] for r in known(spark, notices).collect()}  # a row for each given notice
    table = F.create_map(*[F.lit(x) for kv in sorted(by_digest.items()) for x in kv]) if by_digest else F.expr("cast(map() as map<string, string>)")
    names = F.array_sort(F.array_distinct(F.filter(F.transform(digests, lambda d: F.try_element_at(table, d)), lambda x: x.isNotNull())))
    listed = F.when(F.translate("text", UPPER, LOWER).contains(word), F.array_join(names, ",")).otherwise("")
    rows = own.select("id", digest(F.col("text")).alias("digest"), listed.alias("notices"))
    return rows.join(F.broadcast(known(spark, texts)), "digest", "left").select("id", "digest", "license_id", "notices")


def oracle(table: str = "documents") -> str:
    """DuckDB SQL for scan()."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"

    def form(x: str) -> str:
        plain = f"concat(' ', trim(regexp_replace(regexp_replace(translate({x}, '{UPPER}', '{LOWER}'), {quote(COPYRIGHT)}, ' ', 'g'), {quote(MARKS)}, ' ', 'g')), ' ')"
        plain = f"replace({plain}, ' ', '  ')"
        for a, b in SPELLINGS:
            plain = f"replace({plain}, '{_apart(a)}', '{_apart(b)}')"
        return f"trim(replace({plain}, '  ', ' '))"

    values = lambda pairs: ", ".join(f"({quote(a)}, {quote(b)})" for a, b in pairs)
    return f"""with t as (select row_number() over () as n, doc_id, coalesce(text, '') as text from {table}), lt as (select distinct license_id, sha256({form('x')}) as digest from (values {values(TEXTS)}) v(license_id, x)),
ln as (select distinct license_id, sha256({form('x')}) as digest from (values {values(NOTICES)}) v(license_id, x)),
u as (select n, unnest(string_split(regexp_replace(text, '([.!?])[ \\t]+', '\\1' || chr(10), 'g'), chr(10))) as x from t), c as (select distinct n, license_id from (select n, sha256({form('x')}) as digest from u where contains(lower(x), 'licen')) join ln using (digest)),
g as (select n, string_agg(license_id, ',' order by license_id) as notices from c group by n), d as (select n, doc_id, {form('text')} as form from t),
e as (select n, doc_id, case when form <> '' then sha256(form) end as digest from d)
select doc_id, digest, license_id, coalesce(notices, '') as notices from e left join lt using (digest) left join g using (n)"""
