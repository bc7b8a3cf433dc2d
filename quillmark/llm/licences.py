"""Licence scans by canonical digests, in DataFrame functions alone.

A text is brought to a canonical form: lower case, copyright lines removed, anything but letters and digits one space,
equivalent spellings made equal. The digest of the form is looked up among those of known licence texts and notices by
a hash join. Units looked up are the entire text of a document and each of its lines, so that a notice in a longer
document is found as an entire line.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, small

COPYRIGHT = r"(^|\n)[ \t#*/;-]*((copyright|©)[ \t]*(\(c\)|©|[0-9]{4})|\(c\)[ \t]*[0-9]{4}|all rights reserved)[^\n]*"
NOT_WORD = r"[^\p{L}\p{N}]+"
#: Equivalent spellings of whole words, as canonical text has them, put right in this order; fixed values.
SPELLINGS = (
    ("licence", "license"), ("sub license", "sublicense"), ("non commercial", "noncommercial"), ("copyright owner", "copyright holder"),
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("artefact", "artifact"), ("authorisation", "authorization"),
    ("authorised", "authorized"), ("calibre", "caliber"), ("cancelled", "canceled"), ("catalogue", "catalog"), ("centre", "center"),
    ("favour", "favor"), ("fulfil", "fulfill"), ("initialise", "initialize"), ("judgement", "judgment"), ("labelling", "labeling"),
    ("modelled", "modeled"), ("organisation", "organization"), ("organise", "organize"),
    ("per cent", "percent"), ("programme", "program"), ("recognise", "recognize"), ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"),
)

MIT = """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """ISC License

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

AS_IS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
BSD_2 = f"""Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

{AS_IS}"""
BSD_3 = BSD_2.replace(AS_IS, f"""3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

{AS_IS}""")
APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""

#: (licence, text) of whole licences and headers and of one-line notices.
KNOWN = (
    ("MIT", MIT),
    ("MIT", MIT.split("\n\n", 1)[1]),
    ("ISC", ISC),
    ("ISC", ISC.split("\n\n", 1)[1]),
    ("BSD-2-Clause", BSD_2),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + BSD_2),
    ("BSD-3-Clause", BSD_3),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + BSD_3),
    ("Apache-2.0", APACHE_NOTICE),
    ("Zlib", ZLIB),
    ("Zlib", "zlib License\n\n" + ZLIB),
    ("Unlicense", UNLICENSE),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Released under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
)


def _plain(text: Column) -> Column:
    """Lower case without copyright lines, runs of anything but letters and digits as one space; spellings as they are."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), COPYRIGHT, "\n"), NOT_WORD, " "))


def _spelled(form: Column) -> Column:
    """Whole words put right; words stand between spaces of their own meanwhile. Most texts hold none and are left."""
    wide = F.concat(F.lit(" "), F.replace(form, F.lit(" "), F.lit("  ")), F.lit(" "))
    for spelled, same in SPELLINGS:
        wide = F.replace(wide, F.lit(f" {spelled} ".replace(" ", "  ")[1:-1]), F.lit(f" {same} "))
    some = reduce(lambda a, b: a | b, [F.contains(form, F.lit(spelled)) for spelled, _ in SPELLINGS])
    return F.when(some, F.trim(F.replace(wide, F.lit("  "), F.lit(" ")))).otherwise(form)


def canonical(text: Column) -> Column:
    """The canonical form of a text; null stays null."""
    return _spelled(_plain(text))


def known_licences(spark: SparkSession, texts: tuple[tuple[str, str], ...] = KNOWN) -> DataFrame:
    """(licence, digest) of known texts."""
    return spark.createDataFrame(list(texts), "licence string, text string").select("licence", F.sha2(canonical(F.col("text")), 256).alias("digest")).distinct()


def licences(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(doc_id, digest, licence, notices) of each row of `docs`: the canonical digest of the entire text, the licence
    of which it is the text (null: none), and the distinct licences, in order, that entire lines give notice of.

    A null text has a null digest; a text without letters or digits has the digest of the empty form and no licence.
    A digest that is known for several licences counts as the first in order. Rows are judged one by one: rows that
    repeat or share a doc_id, null too, are each returned with their own notices. Other columns are ignored; an empty
    table gives no rows.
    """
    spark = docs.sparkSession
    known = cut((known or known_licences(spark)).where(F.col("digest") != F.sha2(F.lit(""), 256)).groupBy("digest").agg(F.min("licence").alias("licence")))
    lines = F.filter(F.transform(F.split(F.col("text").cast("string"), "\n"), _plain), lambda x: x != "")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", lines.alias("lines"))
    # the whole text's form is that of its lines, so each character is brought to it once
    whole = F.sha2(_spelled(F.array_join("lines", " ")), 256)
    each = F.transform("lines", lambda x: F.struct(F.lit(False).alias("whole"), F.sha2(_spelled(x), 256).alias("digest")))
    units = rows.select("row", "doc_id", F.explode(F.concat(F.array(F.struct(F.lit(True).alias("whole"), whole.alias("digest"))), F.coalesce(each, F.array().cast("array<struct<whole:boolean,digest:string>>")))).alias("u"))
    met = units.select("row", "doc_id", "u.whole", "u.digest").join(small(known), "digest", "left").where("whole or licence is not null")
    found = met.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.max(F.when(F.col("whole"), F.col("digest"))).alias("digest"), F.max(F.when(F.col("whole"), F.col("licence"))).alias("licence"), F.array_sort(F.collect_set(F.when(~F.col("whole"), F.col("licence")))).alias("notices"))
    return found.select("doc_id", "digest", "licence", "notices")


def _sql() -> str:
    def form(text: str) -> str:
        out = f"concat(' ', replace(trim(regexp_replace(regexp_replace(lower({text}), '{COPYRIGHT}', chr(10), 'g'), '{NOT_WORD}', ' ', 'g')), ' ', '  '), ' ')"
        for spelled, same in SPELLINGS:
            out = f"replace({out}, ' {spelled.replace(' ', '  ')} ', ' {same} ')"
        return f"trim(replace({out}, '  ', ' '))"

    values = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in KNOWN)
    return f"""
with raw(licence, text) as (values {values}),
known as (select sha256({form("text")}) as digest, min(licence) as licence from raw group by 1),
lines as (select doc_id, unnest(string_split(text, chr(10))) as line from documents),
notices as (select doc_id, list_sort(list(distinct licence)) as notices from (select doc_id, sha256({form("line")}) as digest from lines) join known using (digest) group by 1),
whole as (select doc_id, case when text is not null then sha256({form("text")}) end as digest from documents)
select w.doc_id, w.digest, k.licence, coalesce(n.notices, []) as notices from whole w left join known k using (digest) left join notices n on n.doc_id = w.doc_id
"""


SQL = _sql()
