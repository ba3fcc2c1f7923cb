"""License scans by canonical digests, in DataFrame operations only.

A text is put in lower case, lines that state a copyright (a sign or a year right behind the word) are dropped, and so is
"all rights reserved" where a line begins with it; equivalent spellings are made one and punctuation becomes single spaces.
The SHA-256 of the whole of it is joined to the digests of known licence texts, each with and without its usual titles;
the digest of each of its lines is looked up among known notices. Both tables are the constants below, so what is
broadcast is bounded by this file. Other texts, as the long ones of the GNU family, can be given as a parameter.

Null and empty texts, and texts without letters or digits, have the digest of the empty string and match nothing.
Repeated rows are scanned each; long texts are digested whole. Of several licences with one digest the first name counts.
Columns other than doc_id and text are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
#: Whole licence texts by SPDX identifier.
TEXTS = {
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "ISC": f"{_GRANT}, provided that the above copyright notice and this permission notice appear in all copies. {_AS_IS}",
    "0BSD": f"{_GRANT}. {_AS_IS}",
    "WTFPL": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "GPL-3.0-or-later-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
}
_KEEP = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_NAME = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_AS_IS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
TEXTS |= {
    "BSD-2-Clause": f"{_KEEP} {_BSD_AS_IS}",
    "BSD-3-Clause": f"{_KEEP} {_NAME} {_BSD_AS_IS}",
    "Unlicense": 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org>',
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "BSL-1.0": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
}
#: Titles that files with these texts have above them.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"),
    "ISC": ("ISC License",),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD"),
    "WTFPL": ("DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nVersion 2, December 2004\nEveryone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",),
    "BSD-2-Clause": ("BSD 2-Clause License", 'The 2-Clause BSD License', 'Simplified BSD License'),
    "BSD-3-Clause": ("BSD 3-Clause License", 'The 3-Clause BSD License', 'New BSD License'),
    "Unlicense": ("The Unlicense",),
    "Zlib": ("zlib License", "The zlib License"),
    "BSL-1.0": ("Boost Software License - Version 1.0 - August 17th, 2003",),
}
#: One-line notices by SPDX identifier.
NOTICES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Released under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "SPDX-License-Identifier: CC-BY-4.0"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only"),
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"),
}
#: Spellings taken as one, in this order.
SPELLINGS = (("licence", "license"), ("sub-license", "sublicense"), ("non-infringement", "noninfringement"), ("acknowledgement", "acknowledgment"), ("whilst", "while"), ("favour", "favor"), ("https:", "http:"))
_COPYRIGHT = r"(^|\n)[ \t]*(?:copyright[ \t:]*(?:\(c\)|©)[^\n]*|(?:copyright|\(c\)|©)[ \t:]*(?:[0-9]{4}|<year>|\[year\]|\[yyyy\])[^\n]*|all rights reserved\.?)"


def canonical_lines(text: Column) -> Column:
    """Words of the text, one space between them, line breaks kept."""
    out = F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), _COPYRIGHT, "$1")
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.regexp_replace(out, r"[^\p{L}\p{N}\n]+", " ")


def canonical(lines: Column) -> Column:
    return F.trim(F.regexp_replace(lines, r"[ \n]+", " "))


def _known(spark, entries: list[tuple[str, str]]) -> DataFrame:
    rows = spark.createDataFrame(entries, "license_id string, known string")
    return rows.select("license_id", F.sha2(canonical(canonical_lines(F.col("known"))), 256).alias("digest"))


def titled(texts: dict[str, str]) -> list[tuple[str, str]]:
    """Each text by itself and below each of its titles."""
    return [(k, f"{title}\n{text}") for k, text in texts.items() for title in ("", *TITLES.get(k, ()))]


def scan(docs: DataFrame, texts: dict[str, str] | None = None, notices: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """doc_id, digest, license_id (of the whole text, or null), notices (identifiers of its lines, in order, by commas)."""
    spark = docs.sparkSession
    texts, notices = TEXTS if texts is None else texts, NOTICES if notices is None else notices
    whole = _known(spark, [*titled(texts), *((k, line) for k, lines in notices.items() for line in lines)])
    lines = [F.struct(F.lit(k).alias("id"), canonical(canonical_lines(F.lit(line))).alias("line")) for k, own in notices.items() for line in own]
    lookup = F.map_from_entries(F.array(*(F.struct(F.sha2(x.getField("line"), 256), x.getField("id")) for x in lines)))
    base = docs.select("doc_id", canonical_lines(F.col("text")).alias("lines"))
    # only lines as short as the longest notice can be one: the others needn't be digested
    longest = max((len(line) for own in notices.values() for line in own), default=0) + 64
    short = F.filter(F.transform(F.split("lines", "\n"), lambda x: F.trim(x)), lambda x: (x != "") & (F.length(x) <= longest))
    found = F.array_sort(F.array_distinct(F.filter(F.transform(short, lambda x: F.element_at(lookup, F.sha2(x, 256))), lambda x: x.isNotNull())))
    out = base.select("doc_id", F.sha2(canonical(F.col("lines")), 256).alias("digest"), F.array_join(found, ",").alias("notices"))
    known = whole.groupBy("digest").agg(F.min("license_id").alias("license_id"))
    return out.join(F.broadcast(known), "digest", "left").select("doc_id", "digest", "license_id", "notices")


def _sql_lines(text: str) -> str:
    out = f"regexp_replace(lower(coalesce({text}, '')), '{_COPYRIGHT}', '\\1', 'g')"
    for old, new in SPELLINGS:
        out = f"replace({out}, '{old}', '{new}')"
    return f"regexp_replace({out}, '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g')"


def _sql_values(entries: list[tuple[str, str]]) -> str:
    return ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in entries)


_ALL_NOTICES = [(k, line) for k, lines in NOTICES.items() for line in lines]
SQL = f"""
WITH notice AS (SELECT id, sha256(trim({_sql_lines('known')})) AS digest FROM (VALUES {_sql_values(_ALL_NOTICES)}) v(id, known)),
whole AS (SELECT min(id) AS license_id, sha256(trim(regexp_replace({_sql_lines('known')}, '[ \\n]+', ' ', 'g'))) AS digest
  FROM (VALUES {_sql_values([*titled(TEXTS), *_ALL_NOTICES])}) v(id, known) GROUP BY 2),
d AS (SELECT doc_id, {_sql_lines('text')} AS lines FROM documents),
l AS (SELECT doc_id, sha256(trim(line)) AS digest FROM (SELECT doc_id, unnest(string_split(lines, chr(10))) AS line FROM d)),
n AS (SELECT doc_id, string_agg(id, ',' ORDER BY id) AS notices FROM (SELECT DISTINCT l.doc_id, notice.id FROM l JOIN notice USING (digest)) GROUP BY 1)
SELECT d.doc_id, sha256(trim(regexp_replace(d.lines, '[ \\n]+', ' ', 'g'))) AS digest, whole.license_id, coalesce(n.notices, '') AS notices
FROM d LEFT JOIN whole ON whole.digest = sha256(trim(regexp_replace(d.lines, '[ \\n]+', ' ', 'g'))) LEFT JOIN n ON n.doc_id = d.doc_id
"""
