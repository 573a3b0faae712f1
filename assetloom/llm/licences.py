"""Licence identification by digests of canonical texts (operator 7). Columns and joins only."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetloom.llm._common import pick

# Licence texts, grant notices and equivalent spellings.
_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
    "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
    "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
    "met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution.\n\n"
)
_BSD_TAIL = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
    "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
    "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
    "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
    "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_PERMIT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_TAIL = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF "
    "OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
    "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
    "conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n"
) + _AS_IS
LICENCE_TEXTS = [
    ("MIT", _MIT),
    ("MIT", f"MIT License\n\n{_MIT}"),
    ("MIT", f"The MIT License (MIT)\n\n{_MIT}"),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD_HEAD + _BSD_TAIL),
    (
        "BSD-3-Clause",
        _BSD_HEAD
        + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission.\n\n" + _BSD_TAIL,
    ),
    ("ISC", f"{_PERMIT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_TAIL}"),
    ("0BSD", f"{_PERMIT}.\n\n{_ISC_TAIL}"),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
        "arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial "
        "applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be "
        "misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the "
        "product documentation would be appreciated but is not required.\n\n2. Altered source versions must be plainly marked as such, and must not be "
        "misrepresented as being the original software.\n\n3. This notice may not be removed or altered from any source distribution.",
    ),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may '
        "obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or '
        "implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("MIT-0", _MIT.replace(" subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "").replace("to do so,", "to do so.")),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any "
        "means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the "
        "software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and "
        "successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software "
        "under copyright law.\n\n" + _AS_IS.replace(" AUTHORS OR COPYRIGHT HOLDERS BE", " AUTHORS BE") + "\n\nFor more information, please refer to <https://unlicense.org>",
    ),
    (
        "BSL-1.0",
        "Boost Software License - Version 1.0 - August 17th, 2003\n\nPermission is hereby granted, free of charge, to any person or organization "
        'obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, '
        "distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the "
        "Software is furnished to do so, all subject to the following:\n\nThe copyright notices in the Software and this entire statement, including the "
        "above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and "
        "all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code "
        'generated by a source language processor.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT '
        "NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT "
        "HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
        "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
]
#: Canonical digests (``_digest``) of longer licences, whose texts are not kept here.
LICENCE_DIGESTS: list[tuple[str, str]] = [
    ("Apache-2.0", "75acde0fb516a7ba4597dfc23680cf78281f7fae7f3b74a78e06ef83c1c375c6"),
    ("Artistic-1.0-Perl", "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2"),
    ("CC0-1.0", "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e"),
    ("GFDL-1.2", "15f6a8d360ffdecc988c29279c00f23e20de17f14f2a06572ab0d41de6e98b7b"),
    ("GFDL-1.3", "2d36daeff2ad303badb6dee8149748be25e22974dd468e1e8a55cf40f16fc01d"),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-3.0", "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "cbbde7eeab9b4d180dc00b34252f800e97fb1cddbab38ed8c0c73b956dc2cbf6"),
    ("MPL-2.0", "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
]
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License 2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
]
#: Spellings of one word; the first form is replaced wherever a word begins with it.
SPELLINGS = [
    ("licence", "license"),
    ("organisation", "organization"),
    ("sub license", "sublicense"),
    ("non infringement", "noninfringement"),
    ("merchantibility", "merchantability"),
    ("acknowledgement", "acknowledgment"),
    ("judgement", "judgment"),
    ("wilful", "willful"),
    ("fulfilment", "fulfillment"),
    ("favour", "favor"),
    ("https", "http"),
]
#: Lines that state a copyright: with a year, a sign or a placeholder for the year after the word or its sign; lines that reserve all rights and say nothing else; and single-line paragraphs that begin with the word. A
#: line of a wrapped sentence that begins with "copyright notice" is none of these.
COPYRIGHT_LINE = (
    r"(^|\n)[^a-z0-9\n]*(?:(?:copyright|©|\(c\))[^a-z0-9\n]*(?:\(c\)|©|[0-9]{4}|c [0-9]{4}|[<\[{]? ?y{2,4}[y>\]} ]|[<\[{] ?(?:year|name|copyright|date))|©)[^\n]*"
    r"|(^|\n)[^a-z0-9\n]*all rights reserved[^a-z0-9\n]*(?=\n|$)"
)
COPYRIGHT_PARAGRAPH = r"(^|\n[ \t\r]*\n)[^a-z0-9\n]*copyright [^\n]*(?=\n[ \t\r]*\n|[ \t\r\n]*$)"
PUNCTUATION = r"[^\p{L}\p{N}\n]+"
_STEMS = r"\b(?:" + "|".join(a for a, _ in SPELLINGS) + ")"


def canonical(text: str) -> str:
    """The canonical lines of a text in plain Python, for the catalogue and for tests."""
    t = re.sub(COPYRIGHT_LINE, lambda m: m[1] or m[2] or "", text.lower())
    t = re.sub(COPYRIGHT_PARAGRAPH, r"\1", t)
    t = re.sub(r"[^\w\n]+|_+", " ", t.replace("&", " and "))
    for a, b in SPELLINGS:
        t = re.sub(rf"\b{a}", b, t, flags=re.ASCII)
    return re.sub(r" *\n *", "\n", t)


def _digest(text: str) -> str:
    t = re.sub(r"[ \n]+", " ", canonical(text)).strip(" ")
    for a, b in SPELLINGS:
        if " " in a:  # its words may have stood on two lines
            t = re.sub(rf"\b{a}", b, t, flags=re.ASCII)
    return hashlib.sha256(t.encode()).hexdigest()


def canonical_column(text: Column) -> Column:
    """Lower case, without lines that state a copyright, "&" as "and", punctuation as space, one spelling; lines stay."""
    t = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "$1$2")
    t = F.regexp_replace(t, COPYRIGHT_PARAGRAPH, "$1")
    t = F.regexp_replace(F.replace(t, F.lit("&"), F.lit(" and ")), PUNCTUATION, " ")

    def spelt(x: Column) -> Column:
        y = x
        for a, b in SPELLINGS:
            y = F.regexp_replace(y, rf"\b{a}", b)
        return F.when(x.rlike(_STEMS), y).otherwise(x)

    return F.element_at(F.transform(F.array(t), spelt), 1)


def scan(docs: DataFrame, texts=None, notices=None, digests=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, canonical_sha256, licence, notices.

    ``licence`` is the catalogue entry whose canonical text equals the whole canonical text: lower case, lines that
    state a copyright removed, "&" as "and", punctuation as space, equivalent spellings unified, white space
    collapsed; wrapping doesn't matter. The catalogue (``texts``, pairs of name and text, and ``digests``, pairs of name
    and canonical digest, given in code and so of bounded size) is broadcast.
    ``notices`` lists, sorted and comma-joined, the licences whose one-line grant equals a whole line of the text, found
    by the same digest in a map; it is empty if there is none. Documents are read in place; nothing is shuffled.

    Nulls and edge cases: null and empty texts have the digest of the empty text and no licence; repeated rows are
    reported each; an empty table has no rows; ids may be null; extra columns are ignored.
    """
    spark = docs.sparkSession
    texts, notices = LICENCE_TEXTS if texts is None else texts, NOTICES if notices is None else notices
    whole = {d: name for name, d in (LICENCE_DIGESTS if digests is None else digests)} | {_digest(t): name for name, t in texts}
    lines = {_digest(t): name for name, t in notices if "licens" in canonical(t)}
    if len(lines) < len({_digest(t) for _, t in notices}):
        raise ValueError("a notice has to speak of a license")
    known = spark.createDataFrame(sorted(whole.items()) or [("", "")], "canonical_sha256 string, licence string")
    src = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), canonical_column(F.coalesce("text", F.lit(""))).alias("t"))
    pairs = [F.lit(x) for kv in sorted(lines.items()) for x in kv]
    table = F.create_map(*pairs) if pairs else F.create_map(F.lit(""), F.lit(""))
    named = F.transform(
        F.filter(F.split("t", "\n"), lambda x: F.contains(x, F.lit("licens"))), lambda x: F.try_element_at(table, F.sha2(F.trim(x), 256))
    )
    found = F.array_join(F.array_sort(F.array_distinct(F.filter(named, lambda x: x.isNotNull()))), ",")
    flat = F.trim(F.regexp_replace("t", "[ \n]+", " "))
    for a, b in SPELLINGS:
        if " " in a:  # its words may have stood on two lines
            flat = F.regexp_replace(flat, rf"\b{a}", b)
    src = src.select(
        "doc_id",
        F.sha2(flat, 256).alias("canonical_sha256"),
        F.when(F.contains("t", F.lit("licens")), found).otherwise("").alias("notices"),
    )
    return src.join(F.broadcast(known), "canonical_sha256", "left").select("doc_id", "canonical_sha256", "licence", "notices")


def oracle() -> str:
    """The scan over ``documents`` as DuckDB SQL: line by line and word by word, where the operator rewrites whole texts."""

    def quoted(s):
        return "'" + s.replace("'", "''") + "'"

    known = ", ".join(f"({quoted(d)}, {quoted(n)})" for d, n in sorted(({d: n for n, d in LICENCE_DIGESTS} | {_digest(t): n for n, t in LICENCE_TEXTS}).items()))
    lines = ", ".join(f"({quoted(d)}, {quoted(n)})" for d, n in sorted({_digest(t): n for n, t in NOTICES}.items()))
    states = (
        r"regexp_matches(x, '^[^a-z0-9]*(copyright|©|\(c\))[^a-z0-9]*(\(c\)|©|[0-9]{4}|c [0-9]{4}|[<\[{]? ?y{2,4}[y>\]} ]|[<\[{] ?(year|name|copyright|date))') "
        r"OR regexp_matches(x, '^[^a-z0-9]*©') OR regexp_matches(x, '^[^a-z0-9]*all rights reserved[^a-z0-9]*$')"
    )
    word = "list_reduce(list_prepend(x, [" + ", ".join(quoted(a) for a, _ in SPELLINGS if " " not in a) + "]), lambda acc, a: CASE WHEN starts_with(acc, a) THEN CASE a "
    word += " ".join(f"WHEN {quoted(a)} THEN {quoted(b)}" for a, b in SPELLINGS if " " not in a) + " END || substr(acc, length(a) + 1) ELSE acc END)"
    joined = " ".join(["regexp_replace(" * sum(" " in a for a, _ in SPELLINGS) + "list_aggregate(w, 'string_agg', ' ')", *[f", '\\b{a}', {quoted(b)}, 'g')" for a, b in SPELLINGS if " " in a]])
    return f"""
    WITH known(digest, licence) AS (VALUES {known}), grants(digest, name) AS (VALUES {lines}),
    s AS (SELECT doc_id, row_number() OVER () AS rn, string_split(lower(coalesce(text, '')), chr(10)) AS ls FROM documents),
    o AS (SELECT doc_id, rn, list_transform(ls, lambda x: CASE WHEN {states} THEN '' ELSE x END) AS ls FROM s),
    b AS (SELECT doc_id, rn, ls, list_transform(ls, lambda x: trim(x, ' ' || chr(9) || chr(13)) = '') AS blank FROM o),
    p AS (SELECT doc_id, rn, list_transform(range(1, len(ls) + 1), lambda i: CASE WHEN regexp_matches(ls[i], '^[^a-z0-9]*copyright ') AND (i = 1 OR (i > 2 AND blank[i - 1]))
      AND (i = len(ls) OR (blank[i + 1] AND i < len(ls) - 1) OR list_bool_and(blank[i + 1:])) THEN '' ELSE ls[i] END) AS ls FROM b),
    l AS (SELECT doc_id, rn, unnest(range(len(ls))) AS i, unnest(ls) AS line FROM p),
    t AS (SELECT doc_id, rn, i, list_transform(regexp_extract_all(replace(line, '&', ' and '), '[\\p{{L}}\\p{{N}}]+'), lambda x: {word}) AS w FROM l),
    j AS (SELECT doc_id, rn, i, {joined} AS line FROM t),
    f AS (SELECT doc_id, rn, [coalesce(string_agg(line, ' ' ORDER BY i) FILTER (line <> ''), '')] AS w FROM j GROUP BY 1, 2),
    a AS (SELECT doc_id, rn, sha256({joined}) AS canonical_sha256 FROM f),
    n AS (SELECT rn, string_agg(DISTINCT name, ',' ORDER BY name) AS notices FROM j JOIN grants ON sha256(coalesce(line, '')) = digest GROUP BY rn)
    SELECT a.doc_id, a.canonical_sha256, k.licence, coalesce(n.notices, '') AS notices
    FROM a LEFT JOIN known k ON k.digest = a.canonical_sha256 LEFT JOIN n ON n.rn = a.rn
    """
