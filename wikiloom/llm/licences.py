"""Licence scans by canonical digests: a text that is a known licence as a whole is found by its hash.

A text becomes canonical in fixed steps: copyright lines go, case and punctuation go, white space
becomes single spaces, and spellings that licences use alike become one. The SHA-256 of the result
is looked up among the digests of known licences by a hash join. Built-in functions only.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Mapping
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wikiloom.llm.common import column, text_of

# A copyright line names a year or has a sign, so that clauses that speak of
# "copyright notices" at the start of a line are not taken for one.
COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n©]*(?:copyright|\(c\)|©)[^\p{L}\p{N}\n]*(?:copyright|\(c\)|c\)|©|[12][0-9]{3}|year|yyyy)[^\n]*$"
#: The first words of what follows a copyright notice, where line breaks are lost.
GRANT = (
    r"(?:permission is hereby granted|permission to use|redistribution and use|this software is provided|"
    r"licen[sc]ed under the|everyone is permitted to copy|this (?:program|library) is free software)"
)
#: A copyright notice that goes on with a licence in the same line: at the start of the line, or after a heading.
FLAT_LINE = rf"(?m)^[^\p{{L}}\p{{N}}\n©]*(?:copyright|\(c\)|©)[^\p{{L}}\p{{N}}\n]*(?:copyright|\(c\)|c\)|©|[12][0-9]{{3}}|year|yyyy)[^\n]*?(?={GRANT})"
_NOTICE = r"(?:copyright|\(c\)|©)[^\p{L}\p{N}\n]*(?:copyright|\(c\)|c\)|©|[12][0-9]{3}|year|yyyy)"
#: The same behind other words, at any distance. Where no licence follows in the line, its rest is taken
#: as it is in one step, so that a line of many notices is not read once for each.
FLAT_NOTICE = rf"{_NOTICE}[^\n]*?(?={GRANT})|(?:(?<![\p{{L}}\p{{N}}])|(?=[(©]))({_NOTICE}[^\n]*+)"
RIGHTS_LINE = r"(?m)^[^\p{L}\p{N}\n]*all rights reserved[^\p{L}\p{N}\n]*$"
MARKS = r"[^\p{L}\p{N}]+"
#: Stems whose British endings in -ise, -ised, -ising and -isation are read as -ize and so on.
ISE_STEMS = "author|capital|categor|character|emphas|initial|item|maxim|minim|optim|organ|real|recogn|util"
ISE = rf"({ISE_STEMS})is(e|ing|ation)"
#: Spellings with the same meaning, replaced in this order after marks are gone.
EQUIVALENT = (
    ("licenc", "licens"), ("sub licens", "sublicens"), ("acknowledgement", "acknowledgment"), ("judgement", "judgment"),
    ("analyse", "analyze"), ("analogue", "analog"), ("catalogue", "catalog"), ("artefact", "artifact"),
    ("calibre", "caliber"), ("centre", "center"), ("favour", "favor"), ("honour", "honor"), ("labour", "labor"),
    ("cancelled", "canceled"), ("labelled", "labeled"), ("labelling", "labeling"), ("modelled", "modeled"),
    ("modelling", "modeling"), ("signalled", "signaled"), ("signalling", "signaling"), ("fulfilment", "fulfillment"),
    ("offence", "offense"), ("practise", "practice"), ("programme ", "program "), ("whilst", "while"),
    ("wilful", "willful"), ("per cent", "percent"), ("non commercial", "noncommercial"),
    ("copyright owner", "copyright holder"), ("https", "http"),
)

# The texts of short licences, as published.
_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
    "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
    "to permit persons to whom the Software is furnished to do so"
)
_MIT_DISCLAIMER = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO '
    "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
    "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
    "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS "
    "IN THE SOFTWARE."
)
_BSD_START = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this "
    "list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above "
    "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
    "materials provided with the distribution.\n\n"
)
_BSD_NAME = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission.\n\n"
)
_BSD_DISCLAIMER = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED '
    "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
    "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
    "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER "
    "CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
    "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_DISCLAIMER = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING '
    "ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
    "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR "
    "PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION "
    "WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
LICENCES: dict[str, str] = {
    "0BSD": f"{_ISC_GRANT}.\n\n{_ISC_DISCLAIMER}",
    "Apache-2.0 notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\n"
        "Unless required by applicable law or agreed to in writing, software distributed under the License is "
        'distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See '
        "the License for the specific language governing permissions and limitations under the License."
    ),
    "BSD-2-Clause": f"{_BSD_START}{_BSD_DISCLAIMER}",
    "BSD-3-Clause": f"{_BSD_START}{_BSD_NAME}{_BSD_DISCLAIMER}",
    "ISC": (
        f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n"
        f"{_ISC_DISCLAIMER}"
    ),
    "MIT": (
        f"{_MIT_GRANT}, subject to the following conditions:\n\nThe above copyright notice and this permission notice "
        f"shall be included in all copies or substantial portions of the Software.\n\n{_MIT_DISCLAIMER}"
    ),
    "MIT-0": f"{_MIT_GRANT}.\n\n{_MIT_DISCLAIMER}",
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be "
        "held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use "
        "this software for any purpose, including commercial applications, and to alter it and redistribute it "
        "freely, subject to the following restrictions:\n\n1. The origin of this software must not be "
        "misrepresented; you must not claim that you wrote the original software. If you use this software in a "
        "product, an acknowledgment in the product documentation would be appreciated but is not required.\n\n2. "
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original "
        "software.\n\n3. This notice may not be removed or altered from any source distribution."
    ),
}
#: Headings that the short licences are published under.
HEADINGS: dict[str, tuple[str, ...]] = {
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "Zero-Clause BSD License", "0BSD", "0BSD License"),
    "Apache-2.0 notice": (),
    "BSD-2-Clause": (
        "BSD 2-Clause License", "The BSD 2-Clause License", "BSD 2-Clause \"Simplified\" License", "The 2-Clause BSD License",
        "2-Clause BSD License", "Simplified BSD License", "BSD-2-Clause", "BSD License",
    ),
    "BSD-3-Clause": (
        "BSD 3-Clause License", "The BSD 3-Clause License", "BSD 3-Clause \"New\" or \"Revised\" License", "The 3-Clause BSD License",
        "3-Clause BSD License", "New BSD License", "Modified BSD License", "Revised BSD License", "BSD-3-Clause", "BSD License",
    ),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)", "ISC"),
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "MIT"),
    "MIT-0": ("MIT No Attribution", "MIT No Attribution License", "MIT-0", "MIT-0 License"),
    "Zlib": ("zlib License", "The zlib License", "zlib/libpng License", "The zlib/libpng License"),
}
#: A table of complete licences, one JSON object (licence, text) a line.
COMPLETE = Path(__file__).with_name("licence_texts.jsonl")
#: Where the terms of a complete licence end; what follows tells how to apply it and is often left out.
TERMS_END = r"(?m)^[ \t]*END OF TERMS AND CONDITIONS[ \t]*$"


def all_texts() -> list[tuple[str, str]]:
    """(licence, text) of the short licences without and with a heading, and of complete ones without
    and with what follows their terms, each also as one line, where its own notices end elsewhere."""
    out = list(LICENCES.items())
    out += [(k, f"{heading}\n\n{LICENCES[k]}") for k, headings in HEADINGS.items() for heading in headings]
    for line in COMPLETE.read_text(encoding="utf-8").splitlines():
        row = json.loads(line)
        texts = [row["text"]]
        if end := re.search(TERMS_END, row["text"]):
            texts += [row["text"][: end.end()], row["text"][: end.start()]]
        out += [(row["licence"], x) for text in texts for x in (text, " ".join(text.split()))]
    return out


def canonical(text: Column) -> Column:
    out = F.lower(text)
    out = F.regexp_replace(out, FLAT_LINE, " ")
    out = F.regexp_replace(out, FLAT_NOTICE, " $1")
    for line in (COPYRIGHT_LINE, RIGHTS_LINE):
        out = F.regexp_replace(out, line, " ")
    out = F.trim(F.regexp_replace(out, MARKS, " "))
    out = F.regexp_replace(out, ISE, "$1iz$2")
    for old, new in EQUIVALENT:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def known_digests(texts: DataFrame, licence: str = "licence", text: str = "text") -> DataFrame:
    """digest and licence of each known text; licences that read the same are listed together."""
    rows = texts.select(column(texts, licence).alias("licence"), F.sha2(canonical(text_of(texts, text)), 256).alias("digest"))
    return rows.groupBy("digest").agg(F.array_join(F.array_sort(F.collect_set("licence")), " or ").alias("licence"))


def published(spark: SparkSession, texts: Mapping[str, str] | Iterable[tuple[str, str]] | None = None) -> DataFrame:
    """The texts, those of ``all_texts`` if none are given, as a table (licence, text) without Python rows."""
    pairs = all_texts() if texts is None else texts.items() if isinstance(texts, Mapping) else texts
    rows = F.array(*(F.struct(F.lit(k).alias("licence"), F.lit(v).alias("text")) for k, v in pairs))
    return spark.range(1).select(F.inline(rows))


def licence_scan(docs: DataFrame, known: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, digest of its canonical text, licence (null if it is none).

    Only a text that is a licence as a whole is found, whatever its case, punctuation, line breaks,
    copyright lines and equivalent spellings. A null text is empty; texts without letters and
    digits have the digest of the empty text and are no licence. Null and repeated doc_ids are rows
    like others. ``known`` has one row per digest and is as large as the caller's list of licences;
    Spark broadcasts it where its size allows, and joins by hash otherwise.
    """
    rows = docs.select(column(docs, doc_id).alias("doc_id"), canonical(text_of(docs, text)).alias("canonical"))
    rows = rows.select("doc_id", F.sha2("canonical", 256).alias("digest"), (F.col("canonical") != "").alias("some"))
    found = known.select(F.col("digest").alias("known_digest"), "licence")
    return rows.join(found, F.col("some") & (F.col("digest") == F.col("known_digest")), "left").select("doc_id", "digest", "licence")


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_canonical(text: str) -> str:
    out = f"lower({text})"
    for line in (COPYRIGHT_LINE, RIGHTS_LINE):
        out = f"regexp_replace({out}, {_sql_text(line)}, ' ', 'g')"
    out = f"trim(regexp_replace({out}, {_sql_text(MARKS)}, ' ', 'g'))"
    out = f"regexp_replace({out}, {_sql_text(ISE)}, '\\1iz\\2', 'g')"
    for old, new in EQUIVALENT:
        out = f"replace({out}, '{old}', '{new}')"
    return out


SCAN_SQL = f"""
with known(licence, text) as (values {", ".join(f"({_sql_text(k)}, {_sql_text(v)})" for k, v in LICENCES.items())}),
digests as (
  select sha256({_sql_canonical("text")}) digest, string_agg(licence, ' or ' order by licence) licence from known group by 1
), docs as (select doc_id, {_sql_canonical("coalesce(text, '')")} t from documents)
select doc_id, sha256(t) digest, licence from docs left join digests on t <> '' and digests.digest = sha256(t)
"""
