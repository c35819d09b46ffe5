"""License scans by canonical digests.

A text is brought to a canonical form (case, punctuation, copyright lines, list marks and
equivalent spellings no longer matter) and its digest is hash-joined with those of known licence texts and
licence statements. Digests are of entire units: the whole text, each paragraph and each line.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bind

# Licences by SPDX id with the names they go by, and the sentences that state one.
NAMES = {
    "0BSD": ("Zero-Clause BSD License", "0BSD"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "GNU AGPLv3", "AGPL-3.0"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0"),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License", "BSD-2-Clause"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License", "Modified BSD License", "BSD-3-Clause"),
    "BSL-1.0": ("Boost Software License, Version 1.0", "BSL-1.0"),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License", "CC-BY-4.0"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "CC-BY-NC-4.0"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License", "CC-BY-ND-4.0"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "CC-BY-SA-4.0"),
    "CC0-1.0": ("CC0 1.0", "Creative Commons Zero v1.0 Universal", "CC0-1.0"),
    "EPL-2.0": ("Eclipse Public License 2.0", "Eclipse Public License, version 2.0", "EPL-2.0"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU GPLv2", "GPL-2.0"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU GPLv3", "GPL-3.0"),
    "ISC": ("ISC License", "ISC"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "GNU LGPLv2.1", "LGPL-2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "GNU LGPLv3", "LGPL-3.0"),
    "MIT": ("MIT License", "MIT"),
    "MPL-2.0": ("Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "MPL-2.0"),
    "Unlicense": ("Unlicense",),
    "Zlib": ("zlib License", "Zlib"),
}
STATEMENTS = (
    "{n}", "The {n}", "Licensed under {n}", "Licensed under the {n}", "Released under the {n}", "Distributed under the {n}",
    "This work is licensed under {n}", "This work is licensed under the {n}", "This work is licensed under a {n}",
    "This file is licensed under the {n}", "This software is licensed under the {n}", "This project is licensed under the {n}",
    "This code is released under the {n}", "License: {n}", "SPDX-License-Identifier: {n}",
)
_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
    "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
    "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
    "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_DISCLAIMED = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED '
    "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, "
    "INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR "
    "PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
    "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_NOTICE = (
    "This {what} is free software{stop} you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation{comma} either version {version} of the License, or (at your option) any later version.\n"
    "This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details.\n"
    "You should have received a copy of the {name} along with this {what}{end}"
)
_ENDS = (
    ". If not, see <https://www.gnu.org/licenses/>.",
    "; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301, USA.",
    "; if not, write to the Free Software Foundation, Inc., 59 Temple Place, Suite 330, Boston, MA 02111-1307 USA",
)
#: The licences that ask for _NOTICE, with their names in it and versions.
_GNU = {
    "GPL-2.0": ("GNU General Public License", "2"), "GPL-3.0": ("GNU General Public License", "3"), "LGPL-2.1": ("GNU Lesser General Public License", "2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License", "3"), "AGPL-3.0": ("GNU Affero General Public License", "3"),
}
#: Whole licence texts, and for Apache-2.0, MPL-2.0 and EPL-2.0 the notice that the licence asks for. A line here is a paragraph.
TEXTS = {
    "0BSD": f"{_GRANT}.\n{_AS_IS}",
    "BSD-2-Clause": f"{_BSD}\n{_DISCLAIMED}",
    "BSD-3-Clause": f"{_BSD}\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n{_DISCLAIMED}",
    "BSL-1.0": (
        'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, '
        "and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:\n"
        "The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, "
        "unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.\n"
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING '
        "THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "ISC": f"{_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n{_AS_IS}",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.\n"
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n"
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. "
        "We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n"
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER '
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n"
        "For more information, please refer to <https://unlicense.org/>"
    ),
    "MIT": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n"
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n"
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n"
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n"
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n"
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n"
        "3. This notice may not be removed or altered from any source distribution."
    ),
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n'
        "http://www.apache.org/licenses/LICENSE-2.0\n"
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
}
#: Digests of the canonical forms of entire long licences, as published: the whole text and, where it has an appendix, what comes before that with and without its last line.
DIGESTS = {
    "Apache-2.0": ("68ae424fcf569350024d4ba9e00f6845", "76c6ca481abc69eb25bf66b7584cdb7f", "f63f8768fabb39707f4f05a0a5db3dc0"),
    "Artistic-1.0": ("81264bf53b2a22402365ec1e7b32b976",),
    "CC0-1.0": ("1a2ae468ccae8122ceca54319f482b81",),
    "GFDL-1.2": ("81f2779dd32d9b2ca5a1c550ad7524a0",),
    "GFDL-1.3": ("725480d943dc81cdcc16729dc6e50cd5",),
    "GPL-1.0": ("9148dbcb0ce2b52205328e2b53d27a1e", "dd4e76135c87f2a7ebb0b51b03540f0f", "ef23c06d57ecebf899d6104e3fc8ef83"),
    "GPL-2.0": ("0ffb2f7f8824f904144d491094437938", "6592be25bfdd59116919bea4d5f3a452", "3cda588d7bf92841ddf930aeaa56fae5"),
    "GPL-3.0": ("142478062c5f70e4f47dfad51e768269", "2ad5ef75c59c48e3638baa1ffb3b0bec", "e57cfab6ad9b9519e3061b5610b89d8a"),
    "LGPL-2.0": ("26b620cb1c577f04e5598d5aa09e7a60", "89dd3d6c5ec00e1f740b3c5101fcfdf9", "6f14dededfb3776a6263bcc7f60b8c3a"),
    "LGPL-2.1": ("f2c647ddf22a34f7f567ae6cefaf3bf6", "8f62ecfbc118f55ed871b105ac8ef922", "9501cae012cc88d9e6ab8ec28574f446"),
    "LGPL-3.0": ("0dbc4783eda1bbc2f2e0f29b271f99a3",),
    "MPL-1.1": ("873ddeb6062321d31a92d52e35f5108c",),
    "MPL-2.0": ("4cc2fa639236c745d27581542225c85f",),
}
#: Spellings that mean the same, after lower-casing and removal of punctuation.
SPELLINGS = (("licence", "license"), ("noncommercial", "non commercial"), ("sub license", "sublicense"), ("acknowledgement", "acknowledgment"), ("merchantibility", "merchantability"), ("https", "http"))
#: Lines that go: a copyright line names a year, a sign or a place for the holder; wrapped prose may start with the word too.
COPYRIGHT = r"^\W*copyright\b.*(\(c\)|©|[0-9]{4}|[<\[])|^\W*(\(c\)|©)\W*[0-9]{4}|^\W*all rights reserved\W*$"
#: Marks of list items: 1. or 1) or (a) or *.
ITEM = r"^[ \t*•-]*(\(?[0-9]{1,2}[.)]|\([a-z]\))([ \t]+|$)"
#: A paragraph of at least so many words is known by itself if only one licence has it.
LONG_PARAGRAPH = 25
PUNCTUATION = r"[^\p{L}\p{N}\n]+"


def canonical(text: str) -> str:
    """The canonical form of a text in Python, for the registry; canonical_lines() is the same in Spark."""
    kept = []
    for line in text.lower().split("\n"):
        if not re.search(COPYRIGHT, line, re.A):
            line = re.sub(r"[\W_]+", " ", re.sub(ITEM, "", line, flags=re.A)).strip()
            for a, b in SPELLINGS:
                line = line.replace(a, b)
            kept.append(line)
    return " ".join(x for x in kept if x)


def canonical_lines(text: Column) -> Column:
    """array<string>: each line's canonical form; '' for copyright lines and lines without letters or digits."""

    def one(line: Column) -> Column:
        plain = F.trim(F.regexp_replace(F.regexp_replace(line, ITEM, ""), PUNCTUATION, " "))
        for a, b in SPELLINGS:
            plain = F.replace(plain, F.lit(a), F.lit(b))
        return F.when(line.rlike(COPYRIGHT), "").otherwise(plain)

    return F.transform(F.split(F.lower(text), "\n", -1), one)


def whole_texts() -> list[tuple[str, str]]:
    """(licence, text) of every known text, with the forms of the GNU notice."""
    forms = [
        (spdx, _NOTICE.format(what=what, stop=stop, comma=comma, name=name, version=version, end=end))
        for spdx, (name, version) in _GNU.items() for what in ("program", "library", "software", "file") for stop, comma in ((":", ","), (";", ";")) for end in _ENDS
    ]
    return [*TEXTS.items(), *forms]


def registry() -> dict[str, str]:
    """licence by digest of every known text and statement, and of long paragraphs that one licence has alone."""
    digest = lambda text: hashlib.md5(canonical(text).encode()).hexdigest()
    known, parts = {}, {}
    for spdx, text in whole_texts():
        for p in text.split("\n"):
            if len(p.split()) >= LONG_PARAGRAPH:
                parts.setdefault(digest(p), set()).add(spdx)
    known |= {d: min(of) for d, of in parts.items() if len(of) == 1}
    for spdx, names in NAMES.items():
        for n in names:
            for s in STATEMENTS:
                known[digest(s.format(n=n))] = spdx
    for spdx, text in whole_texts():
        known[digest(text)] = spdx
        for n in NAMES[spdx]:
            for title in (n, f"The {n}"):
                known[digest(f"{title}\n{text}")] = spdx
    known |= {d: spdx for spdx, digests in DIGESTS.items() for d in digests}
    return known


def known_digests(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(registry().items()), "digest string, license string").coalesce(1)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, unit, nth, license, digest) for every unit that is a known licence text or statement.

    A whole text that is known is found however its lines are broken; inside a longer text, a
    licence is found by its paragraphs and lines. ``unit`` is text, paragraph or line, ``nth`` its number from 0. Null and empty texts have
    no units and repeated rows give their matches once. Only doc_id and text are read.
    """
    full = lambda lines: F.filter(lines, lambda x: x != "")
    marked = bind(canonical_lines(F.col("text")), lambda lines: F.struct(
        full(lines).alias("lines"), F.array_join(F.transform(lines, lambda x: F.when(x == "", "\n").otherwise(x)), " ").alias("joined"),
    ))
    paragraphs = F.filter(F.transform(F.split("m.joined", r"[ \n]*\n[ \n]*"), lambda x: F.trim(x)), lambda x: x != "")
    unit = lambda name, items: F.transform(items, lambda x, i: F.struct(F.lit(name).alias("unit"), i.alias("nth"), F.md5(x.cast("binary")).alias("digest")))
    rows = docs.select("doc_id", marked.alias("m")).select("doc_id", "m.lines", paragraphs.alias("paragraphs"))
    rows = rows.select("doc_id", F.explode(F.concat(
        F.when(F.size("lines") > 0, unit("text", F.array(F.array_join("lines", " ")))).otherwise(F.array()),
        F.when(F.size("paragraphs") > 1, unit("paragraph", F.col("paragraphs"))).otherwise(F.array()),
        F.when(F.size("lines") > 1, unit("line", F.col("lines"))).otherwise(F.array()),
    )).alias("u"))
    known = F.broadcast(known_digests(docs.sparkSession))  # the registry above: under two thousand rows
    return rows.select("doc_id", "u.unit", "u.nth", "u.digest").join(known, "digest").select("doc_id", "unit", "nth", "license", "digest").distinct()


def _sql() -> str:
    plain = rf"trim(regexp_replace(regexp_replace(x, '{ITEM}', ''), '{PUNCTUATION}', ' ', 'g'), ' ')"
    for a, b in SPELLINGS:
        plain = f"replace({plain}, '{a}', '{b}')"
    rows = ", ".join(f"('{d}', '{n}')" for d, n in sorted(registry().items()))
    return rf"""
WITH known(digest, license) AS (VALUES {rows}),
l AS (
  SELECT doc_id, list_transform(string_split(lower(text), chr(10)), lambda x: CASE WHEN regexp_matches(x, '{COPYRIGHT}') THEN '' ELSE {plain} END) AS lines
  FROM documents WHERE text IS NOT NULL
), u AS (
  SELECT doc_id, list_filter(lines, lambda x: x <> '') AS lines,
    list_filter(list_transform(string_split_regex(array_to_string(list_transform(lines, lambda x: CASE WHEN x = '' THEN chr(10) ELSE x END), ' '), '[ \n]*\n[ \n]*'), lambda x: trim(x, ' ')), lambda x: x <> '') AS paragraphs
  FROM l
), units AS (
  SELECT doc_id, 'text' AS unit, 0 AS nth, md5(array_to_string(lines, ' ')) AS digest FROM u WHERE len(lines) > 0
  UNION ALL SELECT doc_id, 'paragraph', generate_subscripts(paragraphs, 1) - 1, md5(unnest(paragraphs)) FROM u WHERE len(paragraphs) > 1
  UNION ALL SELECT doc_id, 'line', generate_subscripts(lines, 1) - 1, md5(unnest(lines)) FROM u WHERE len(lines) > 1
)
SELECT DISTINCT doc_id, unit, nth::INT AS nth, license, digest FROM units JOIN known USING (digest)
"""


#: DuckDB SQL for the rows of op2.
SQL = _sql()
