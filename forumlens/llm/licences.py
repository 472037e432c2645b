"""Licence scan by canonical digest: entire texts are normalised, digested and hash-joined to known licences.

The canonical form has lower case, no copyright notices, no punctuation, one spelling for equivalent words, and two
spaces around every word. Two texts have the same digest exactly if their canonical forms are equal, so a licence
inside a longer text is no match for the whole text; every line is therefore looked up as a text of its own too,
which finds one-line notices. Everything is expressions and joins; no Python runs on the rows. Licences that are not
listed here come as a table of texts (:func:`known_texts`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from forumlens.sources.snapshots import materialize

# Pairs of spellings that count as one, after the equivalent-words guideline for licence matching.
EQUIVALENT_WORDS = {
    "acknowledgement": "acknowledgment",
    "analogue": "analog",
    "artefact": "artifact",
    "authorisation": "authorization",
    "authorised": "authorized",
    "cancelled": "canceled",
    "catalogue": "catalog",
    "centre": "center",
    "copyright owner": "copyright holder",
    "customised": "customized",
    "favour": "favor",
    "favourite": "favorite",
    "fulfil": "fulfill",
    "https": "http",
    "initialise": "initialize",
    "judgement": "judgment",
    "labelling": "labeling",
    "labour": "labor",
    "licence": "license",
    "licenced": "licensed",
    "maximise": "maximize",
    "modelling": "modeling",
    "noncommercial": "non commercial",
    "organisation": "organization",
    "organise": "organize",
    "practise": "practice",
    "programme": "program",
    "realise": "realize",
    "recognise": "recognize",
    "sublicence": "sublicense",
    "utilisation": "utilization",
    "whilst": "while",
    "wilful": "willful",
}

# What separates words (ASCII signs and typographic quotes, dashes and spaces; not the line feed), and
# words that show, right after the word copyright, that no owner is named.
SEPARATORS = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F\xA0\x{2010}-\x{201F}\x{2026}]+"
NO_OWNER = (
    "holders?|owners?|notices?|laws?|licen[sc]es?|statements?|interests?|protections?|infringements?|disclaimers?|"
    "permissions?|rights?|treat(?:y|ies)|and|or|in|to|of|is|on|for|the"
)
# Lines that canonical texts leave out, wherever a text is wrapped: lines that begin with a sign or year, and lines that
# only reserve rights.
NOTICE_LINE = (
    r"^[^a-z0-9\n]*(?:copyright[^a-z0-9\n]*(?:\(c\)|©|\d{4})|©|\(c\)[^a-z0-9\n]*\d{4})[^\n]*"
    r"|^[^a-z0-9\n]*all[^a-z0-9\n]+rights[^a-z0-9\n]+reserved[^a-z0-9\n]*$"
)
# And the first line of a paragraph, if it is short, not the last line, and names an owner behind the word.
OWNER = r"[^a-z0-9\n]*copyright[^a-z0-9\n]+"
OWNER_NAME = r"[a-z0-9][^\n]{0,79}"
_NOTICES = rf"(?md){NOTICE_LINE}|(?:\A\n?|(?<=\n\n)){OWNER}+(?!(?:{NO_OWNER})(?:[^a-z0-9]|$)){OWNER_NAME}(?=\n)"

# Texts of licences and notices, up to the end of KNOWN_TEXTS.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted"""

_ISC_CONDITION = ", provided that the above copyright notice and this permission notice appear in all copies"

_ISC_TAIL = """.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN
AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""

_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
"""

_BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission.
"""

_BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
specific language governing permissions and limitations under the License."""

_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or
as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright
interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the
detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of
all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT
OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org/>"""

_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it
and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If
you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not
required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""

_BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and
transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software
is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and
the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works
of the Software, unless such copies or derivative works are solely in the form of machine-executable object code
generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE
COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT,
TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_MPL_NOTICE = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""

_GNU_NOTICE = """This program is free software: you can redistribute it and/or modify it under the terms of the {name} as
published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details.

You should have received a copy of the {name} along with this program. If not, see <https://www.gnu.org/licenses/>."""

# Short identifiers, the heads that may stand above a text, and the text.
_HEADED_TEXTS = (
    ("MIT", ("MIT License", "The MIT License", "MIT License (MIT)", "The MIT License (MIT)"), _MIT),
    ("ISC", ("ISC License", "The ISC License", "ISC License (ISC)"), _ISC_GRANT + _ISC_CONDITION + _ISC_TAIL),
    ("0BSD", ("BSD Zero Clause License", "Zero-Clause BSD", "Zero Clause BSD License"), _ISC_GRANT + _ISC_TAIL),
    (
        "BSD-2-Clause",
        ("BSD 2-Clause License", "The BSD 2-Clause License", "Simplified BSD License", 'BSD 2-Clause "Simplified" License'),
        _BSD_HEAD + _BSD_TAIL,
    ),
    (
        "BSD-3-Clause",
        (
            "BSD 3-Clause License", "The BSD 3-Clause License", "New BSD License", "Modified BSD License",
            'BSD 3-Clause "New" or "Revised" License',
        ),
        _BSD_HEAD + _BSD_THIRD + _BSD_TAIL,
    ),
    ("Unlicense", ("The Unlicense", "Unlicense"), _UNLICENSE),
    ("Zlib", ("zlib License", "The zlib License", "The zlib/libpng License"), _ZLIB),
    ("BSL-1.0", ("Boost Software License - Version 1.0 - August 17th, 2003", "Boost Software License 1.0"), _BOOST),
    ("Apache-2.0", (), _APACHE_NOTICE),
    ("MPL-2.0", (), _MPL_NOTICE),
)
_GNU = (
    ("GPL", "GNU General Public License", (2, 3)),
    ("LGPL", "GNU Lesser General Public License", (3,)),
    ("AGPL", "GNU Affero General Public License", (3,)),
)
_NOTICE_LINES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
)

KNOWN_TEXTS = (
    *[(name, known) for name, heads, text in _HEADED_TEXTS for known in (text, *[f"{head}\n\n{text}" for head in heads])],
    *[
        (f"{short}-{version}.0-or-later", _GNU_NOTICE.format(name=name, version=version))
        for short, name, versions in _GNU
        for version in versions
    ],
    *_NOTICE_LINES,
)


def canonical(text: Column) -> Column:
    """The canonical form with its line feeds; NULL counts as empty."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    # Few texts have what a notice must have; the others need no search for one.
    may_have = lower.contains("copyright") | lower.contains("©") | lower.contains("(c)") | lower.contains("reserved")
    plain_ends = F.replace(lower, F.lit("\r\n"), F.lit("\n"))
    form = F.when(may_have, F.regexp_replace(plain_ends, _NOTICES, "")).otherwise(lower)
    form = F.replace(F.regexp_replace(form, SEPARATORS, "  "), F.lit("\n"), F.lit("  \n  "))
    form = F.concat(F.lit("  "), form, F.lit("  "))
    for other, usual in EQUIVALENT_WORDS.items():
        form = F.replace(form, F.lit(f" {other.replace(' ', '  ')} "), F.lit(f" {usual.replace(' ', '  ')} "))
    return form


def digest(form: Column) -> Column:
    """SHA-256 of a canonical text or line: words with one space between them."""
    return F.sha2(F.trim(F.regexp_replace(form, r"[ \n]+", " ")).cast("binary"), 256)


def known_texts(texts: DataFrame, licence: str = "licence", text: str = "text") -> DataFrame:
    """Digests of a table of licence texts as ``licence_digest, licence``.

    A text without words has no digest; of names for one digest, the first by alphabet is taken. A row without a name
    is left out.
    """
    found = texts.where(F.col(licence).isNotNull())
    found = found.select(digest(canonical(F.col(text))).alias("licence_digest"), F.col(licence).alias("licence"))
    empty = digest(F.lit(""))
    return found.where(F.col("licence_digest") != empty).groupBy("licence_digest").agg(F.min("licence").alias("licence"))


def known_licences(spark: SparkSession, texts=KNOWN_TEXTS) -> DataFrame:
    """The listed licences as :func:`known_texts` gives them."""
    listed = F.array(*[F.struct(F.lit(name).alias("licence"), F.lit(known).alias("text")) for name, known in texts])
    # Literals, unlike rows sent from the driver, have a size that Spark knows.
    return known_texts(spark.range(1).select(F.inline(listed)))


def scan(rows: DataFrame, known: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row as ``key, text_digest, licence, notices``.

    ``licence`` is the known licence that the entire text is, else NULL; ``notices`` lists the known licences that
    whole lines of the texts of this key are, in alphabetical order, comma-joined, empty if there are none. NULL and
    empty texts match nothing. Rows that repeat a key stay separate rows and share their notices; a NULL key is a key.
    Other columns are not carried. Spark broadcasts the known digests by their size, and would join by shuffle if they
    were many.

    The canonical form of a text is made once: the digests of the entire text and of its lines meet the known ones in
    one pass, and what it finds, one row per text and one per found line, is written.
    """
    lines = F.transform(
        F.split("form", "\n"), lambda line: F.struct(F.lit(False).alias("entire"), digest(line).alias("text_digest"))
    )
    entire = F.struct(F.lit(True).alias("entire"), digest(F.col("form")).alias("text_digest"))
    forms = rows.select(F.col(key).alias("record"), canonical(F.col(text)).alias("form"))
    parts = forms.select("record", F.inline(F.concat(F.array(entire), lines)))
    found = parts.join(known, parts["text_digest"] == known["licence_digest"], "left")
    found = materialize(found.where(F.col("entire") | F.col("licence").isNotNull()).drop("licence_digest"))
    notices = found.where(~F.col("entire")).groupBy(F.col("record").alias("noticed"))
    notices = notices.agg(F.array_join(F.array_sort(F.collect_set("licence")), ",").alias("notices"))
    whole = found.where("entire")
    return whole.join(notices, whole["record"].eqNullSafe(notices["noticed"]), "left").select(
        F.col("record").alias(key), "text_digest", "licence", F.coalesce("notices", F.lit("")).alias("notices")
    )
