"""License scans: canonical digests of entire texts, hash-joined to digests of known licences.

Two kinds of text are looked up: a document as a whole (licence) and each of its lines as a whole (notices),
which finds one-line grants inside other prose. Canonical form: lower case, equivalent spellings made one,
lines that name a copyright holder or say that all rights are reserved dropped, every run of characters other than
letters and digits one space.

Defined cases: a null text is empty; a text without letters or digits has the digest of the empty string and
matches nothing; every row has a result of its own, repeated rows and rows that share a doc_id included; an empty table
gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import documents, whole_text

#: Spelling to its canonical form, on lower-case text.
SPELLINGS = (
    ("licence", "license"),
    ("sub-license", "sublicense"),
    ("sub license", "sublicense"),
    ("https://", "http://"),
    ("(c)", "copyright"),
    ("©", "copyright"),
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorise", "authorize"),
    ("calibre", "caliber"),
    ("cancelled", "canceled"),
    ("catalogue", "catalog"),
    ("centre", "center"),
    ("copyright owner", "copyright holder"),
    ("emphasise", "emphasize"),
    ("favour", "favor"),
    ("fulfil ", "fulfill "),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labelling", "labeling"),
    ("labour", "labor"),
    ("maximise", "maximize"),
    ("merchantibility", "merchantability"),
    ("modelled", "modeled"),
    ("noncommercial", "non-commercial"),
    ("non-infringement", "noninfringement"),
    ("non infringement", "noninfringement"),
    ("optimise", "optimize"),
    ("organisation", "organization"),
    ("percent", "per cent"),
    ("practise", "practice"),
    ("programme", "program"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("signalling", "signaling"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
)
#: A line that says who holds the copyright: it begins with a mark or the word, and goes on with a year, a name or a place for one.
#: Lines that speak of "the above copyright notice", "copyright holders" or "copyright law" are the licence's own.
COPYRIGHT_LINE = (
    r"(?m)^[^\p{L}\p{N}\n]*copyright( copyright)*([ \t]*[:<\[{0-9-]|[ \t]+(by |year|yyyy)|[ \t]+[^ \t\n]).*$"
)
OWN_LINE = r"(?m)^([^\p{L}\p{N}\n]*copyright[ \t]+)(holder|owner|notice|law|license|statement|and |or |in |on |to |of |is |interest|protect|treat)"
RIGHTS_LINE = r"(?m)^[^\p{L}\p{N}\n]*all rights reserved[^\p{L}\p{N}\n]*$"

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""

_BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_NAME = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_UNLICENSE_LINK = "For more information, please refer to <https://unlicense.org>"
_BSL = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_0BSD = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_WTFPL = """DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
Version 2, December 2004

Copyright (C) 2004 Sam Hocevar <sam@hocevar.net>

Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.

DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION

0. You just DO WHAT THE FUCK YOU WANT TO."""
_MPL_NOTICE = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""

#: The notice that a file of a GNU licence carries; its name, number and address differ.
_GNU_NOTICE = """This {it} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {n} of the License, or (at your option) any later version.

This {it} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details.

You should have received a copy of the GNU {name} along with this {it}. If not, see <https://www.gnu.org/licenses/>."""
_GNU = (
    ("GPL-2.0-or-later", "program", "General Public License", "2"),
    ("GPL-3.0-or-later", "program", "General Public License", "3"),
    ("LGPL-2.1-or-later", "library", "Lesser General Public License", "2.1"),
    ("LGPL-3.0-or-later", "library", "Lesser General Public License", "3"),
    ("AGPL-3.0-or-later", "program", "Affero General Public License", "3"),
)

#: Licence identifier and an entire text known for it.
KNOWN = (
    ("MIT", _MIT),
    ("MIT", "MIT License\n\n" + _MIT),
    ("MIT", "The MIT License\n\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT-0", "MIT No Attribution\n\n" + _MIT.replace(", subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", ".")),
    ("ISC", _ISC),
    ("ISC", "ISC License\n\n" + _ISC),
    ("ISC", "The ISC License\n\n" + _ISC),
    ("0BSD", _0BSD),
    ("0BSD", "BSD Zero Clause License\n\n" + _0BSD),
    ("Zlib", _ZLIB),
    ("Zlib", "zlib License\n\n" + _ZLIB),
    ("BSD-2-Clause", f"{_BSD2}\n\n{_BSD_END}"),
    ("BSD-2-Clause", f"BSD 2-Clause License\n\n{_BSD2}\n\n{_BSD_END}"),
    ("BSD-2-Clause", f"The BSD 2-Clause License\n\n{_BSD2}\n\n{_BSD_END}"),
    ("BSD-3-Clause", f"{_BSD2}\n\n{_BSD_NAME}\n\n{_BSD_END}"),
    ("BSD-3-Clause", f"BSD 3-Clause License\n\n{_BSD2}\n\n{_BSD_NAME}\n\n{_BSD_END}"),
    ("BSD-3-Clause", f"The BSD 3-Clause License\n\n{_BSD2}\n\n{_BSD_NAME}\n\n{_BSD_END}"),
    ("Unlicense", _UNLICENSE),
    ("Unlicense", f"{_UNLICENSE}\n\n{_UNLICENSE_LINK}"),
    ("BSL-1.0", f"Boost Software License - Version 1.0 - August 17th, 2003\n\n{_BSL}"),
    ("BSL-1.0", _BSL),
    ("WTFPL", _WTFPL),
    ("MPL-2.0", _MPL_NOTICE),
    ("Apache-2.0", _APACHE_NOTICE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    *((name, _GNU_NOTICE.format(it=it, name=of, n=n)) for name, it, of, n in _GNU),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
)
#: Licence identifier and the digest of the canonical form of its published text, for texts too long to be kept here.
KNOWN_DIGESTS = (
    ("Apache-2.0", "ab8af54f2f9814aba95e91bddc0a1ced58303f2a9669b3ee1f1add796525e138"),
    ("Artistic-1.0-Perl", "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "58b6ebdf2bd26f81dd551d8efda909bfbc8914ce77996a5c289c28616b91ceeb"),
    ("GFDL-1.3", "c4f8ea2b5247ab1ff721ce8255137250d4c14f50a0fb68c00fd793f496ced65e"),
    ("GPL-1.0", "9f6185ed2aa24f98f7cb52ad068f704dbc9b5951a986f6275e8bd7264f5a1e94"),
    ("GPL-2.0", "cbce2709938501365973cbd4ead85f2d060294a310770d39aac679365387074a"),
    ("GPL-3.0", "826f46a485ae3ded4f243bebe658a26a4fb54fcf2467f8848117918212679d02"),
    ("LGPL-2.0", "e4deecd0730802431ad09f00ae3793f3703c8e4dba639586545d9f958405614d"),
    ("LGPL-2.1", "d3826e4e563a04a354453ff139a32b19d6c3fe283f518eb566107c54e18cd01f"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "71354de5aacde5c387b40d39561d31bc758e9aae9b47e20c2de47269c9727822"),
    ("MPL-2.0", "13dfde4441eb255a74418ebbd8a88e37eb73a108f5555ce529db0681924f136c"),
    ("BSD-3-Clause", "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651"),
)


def canonical(text: Column) -> Column:
    """The canonical form of a text, by built-in functions."""
    out = F.lower(text)
    for spelling, form in SPELLINGS:
        out = F.replace(out, F.lit(spelling), F.lit(form))
    # the licence's own lines are kept from the next pattern by a mark, which the last one takes out
    out = F.regexp_replace(out, OWN_LINE, "#kept $1$2")
    out = F.regexp_replace(F.regexp_replace(out, COPYRIGHT_LINE, " "), RIGHTS_LINE, " ")
    return F.trim(F.regexp_replace(F.replace(out, F.lit("#kept "), F.lit(" ")), r"[^\p{L}\p{N}]+", " "))


def known_licenses(spark: SparkSession, known=KNOWN, digests=KNOWN_DIGESTS) -> DataFrame:
    """(digest, licence): as many rows as the two tables have, of fixed size."""
    table = spark.createDataFrame(list(known), "licence string, body string").select(F.sha2(canonical(F.col("body")), 256).alias("digest"), "licence")
    if digests:
        table = table.unionByName(spark.createDataFrame(list(digests), "licence string, digest string"))
    return table.groupBy("digest").agg(F.min("licence").alias("licence"))


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, text_digest, licence (null: none), notices (sorted, comma-separated; null: none).

    known: (digest, licence), a digest once, of fixed size; it alone is broadcast. A row is taken apart into its whole text and
    its lines; lines without a match end in the join, and what is left is put together by a number of the row,
    within the task that made it before anything is shuffled.
    """
    text = F.col("text")
    digests = F.transform(F.filter(F.split(text, "\n", -1), lambda x: F.length(x) > 0), lambda x: F.struct(F.lit(False).alias("whole"), F.sha2(canonical(x), 256).alias("digest")))
    whole = F.array(F.struct(F.lit(True).alias("whole"), F.sha2(canonical(text), 256).alias("digest")))
    # numbered in a step of its own: beside explode() each exploded row would get a number
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", whole_text().alias("text"))
    each = rows.select("row", "doc_id", F.explode(F.concat(whole, digests)).alias("x"))
    found = each.select("row", "doc_id", "x.whole", "x.digest").join(F.broadcast(known), "digest", "left").filter("whole or licence is not null")
    return (
        found.groupBy("row", "doc_id")
        .agg(
            F.max(F.when(F.col("whole"), F.col("digest"))).alias("text_digest"),
            F.max(F.when(F.col("whole"), F.col("licence"))).alias("licence"),
            F.array_sort(F.collect_set(F.when(~F.col("whole"), F.col("licence")))).alias("lines"),
        )
        .select("doc_id", "text_digest", "licence", F.when(F.size("lines") > 0, F.array_join("lines", ",")).alias("notices"))
    )


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir), known_licenses(spark))


def _sql() -> str:
    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def canon(x: str) -> str:
        x = f"lower({x})"
        for spelling, form in SPELLINGS:
            x = f"replace({x}, {quoted(spelling)}, {quoted(form)})"
        x = f"regexp_replace({x}, '{OWN_LINE}', '#kept \\1\\2', 'g')"
        x = f"regexp_replace(regexp_replace({x}, '{COPYRIGHT_LINE}', ' ', 'g'), '{RIGHTS_LINE}', ' ', 'g')"
        return rf"trim(regexp_replace(replace({x}, '#kept ', ' '), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"

    values, digests = (", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in table) for table in (KNOWN, KNOWN_DIGESTS))
    return rf"""
WITH known AS (SELECT digest, min(licence) AS licence FROM (
  SELECT sha256({canon('body')}) AS digest, licence FROM (VALUES {values}) AS k(licence, body)
  UNION ALL SELECT digest, licence FROM (VALUES {digests}) AS k(licence, digest)) GROUP BY 1),
docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs),
notices AS (
  SELECT r, string_agg(DISTINCT licence, ',' ORDER BY licence) AS notices
  FROM (SELECT r, sha256({canon('line')}) AS digest FROM lines WHERE line <> '') JOIN known USING (digest) GROUP BY 1)
SELECT doc_id, digest AS text_digest, licence, notices
FROM (SELECT r, doc_id, sha256({canon("text")}) AS digest FROM docs)
LEFT JOIN known USING (digest) LEFT JOIN notices USING (r)"""


SQL = _sql()
