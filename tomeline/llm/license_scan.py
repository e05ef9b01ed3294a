"""Licence scan by canonical digests.

A text is brought to a canonical form (case, copyright lines, equivalent spellings, punctuation and blanks)
and its SHA-256 joined to the digests of known licences: the entire text of a row against licence texts, and
each of its lines against one-line notices. DataFrame functions only; nothing shuffles, since the
known digests are a fixed list of this module and broadcast. A licence is found by the bare form of the text: the
canonical form without title and copyright lines at its head and without the numbers of list items.

Defined cases: null counts as empty; an empty text, or one of copyright lines only, has the digest of the empty
text and no licence. A row has one licence at most, and each notice once, in code point order. Repeated rows give
repeated answers. Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Equivalent spellings, left as found, right as kept.
SPELLINGS = [
    ("licence", "license"), ("sub-license", "sublicense"), ("acknowledgement", "acknowledgment"), ("favour", "favor"),
    ("fulfilment", "fulfillment"), ("organisation", "organization"), ("wilful", "willful"), ("whilst", "while"),
    ("judgement", "judgment"), ("https://", "http://"), ("&", " and "),
]
# Fixed value: a line that states a copyright, after lower-casing.
COPYRIGHT_LINE = r"(?m)^[^a-z0-9\n]*(?:copyright[ \t]*(?:\(c\)|©|[0-9]{4}|<year>|\[year\])|©|\(c\)[ \t]*(?:copyright|[0-9]{4})|all rights reserved[. \t\r]*$)[^\n]*$"

_WARRANTY_BSD = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,
BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING,
BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED
AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT
OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in
the documentation and/or other materials provided with the distribution.
"""
_BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived
from this software without specific prior written permission.
"""
_WARRANTY_ISC = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
# Entire licence texts, by SPDX identifier.
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR
ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH
THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
    "provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _WARRANTY_ISC,
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _WARRANTY_ISC,
    "BSD-2-Clause": _BSD_2 + "\n" + _WARRANTY_BSD,
    "BSD-3-Clause": _BSD_2 + _BSD_3 + "\n" + _WARRANTY_BSD,
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for
any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute
it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this
software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
}
# One-line notices, by SPDX identifier. Each must hold the word "license".
NOTICES = {
    "Released under the MIT License.": "MIT",
    "Licensed under the MIT License.": "MIT",
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0-only",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    "Licensed under CC BY 4.0.": "CC-BY-4.0",
    "SPDX-License-Identifier: MIT": "MIT",
    "SPDX-License-Identifier: Apache-2.0": "Apache-2.0",
    "SPDX-License-Identifier: GPL-3.0-only": "GPL-3.0-only",
    "Licensed under the BSD 2-Clause License.": "BSD-2-Clause",
    "Licensed under the BSD 3-Clause License.": "BSD-3-Clause",
    "Licensed under the ISC License.": "ISC",
    "Licensed under the Mozilla Public License, Version 2.0.": "MPL-2.0",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "MPL-2.0",
} | {
    f"SPDX-License-Identifier: {i}": i
    for i in ("0BSD", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-4.0", "CC-BY-NC-4.0", "CC0-1.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MPL-2.0", "Zlib")
}
# SHA-256 of the bare form of longer licences, whole and up to the end of their terms.
LONG_DIGESTS = {
    "f0ddbbd4901401d72ef02550254c0ed47dbc2da29d2d35b1240de74db32bdd01": "Apache-2.0",
    "95ebafaabf80c10ce0c02d6506b3c942348da0561e2d2af910f930ef055bc343": "Apache-2.0",
    "9666d051921bc497595d01b3c5b73b1f06842a6aa072b0221619c1e6d78d99e7": "Apache-2.0",
    "2e8e378a3d24393c0f3fd1439ffbe84e750886c09715e622426a6a0e54fa1bee": "GPL-2.0-only",
    "80edaf5771a2ca5e7df6a5c023beb15391e60cf1bbae81a82600bb184fecef39": "GPL-2.0-only",
    "724499132592c4e4c95c8d0a0a79e0045822f797839536a7338312694e3341bc": "GPL-2.0-only",
    "3695e90f7fe4b461853cec533de5675ab2b6b1fcafcb504d6c64ded76f675d64": "GPL-3.0-only",
    "8c24ccf35998bd73317aa0801f6e6cbd865514baf55f246a48a8e890d1abc3d1": "GPL-3.0-only",
    "a7d16b580457c566303df373fd362c5bfbfbc013734bed4e4cf732a569a5598e": "GPL-3.0-only",
    "f2755dc4b609b314faab32d30ca6d0466b60adc931cece2ea4f0b61f483bfc98": "LGPL-2.1-only",
    "303c35384a2d8ff561e8480f4d8bc87bd79ea2d92d62ba0b24d22e2c1f88f1e3": "LGPL-2.1-only",
    "70a277553f5f0e974016dfc6aed9adda07c554792c5f1f3d75acb63053de3f89": "LGPL-2.1-only",
    "cb8c0f424bdd5c42a0b18285893829d988e9fb9a00d0cd604a59ebe8da7eeb45": "LGPL-3.0-only",
    "d2954ecddd82787482d526252c2595f628a7e2ccd8c32b969382705b61c7ed8d": "MPL-2.0",
    "a294e42efec572e26d12b189f195dad71c1bff400d97b3fb33d69f9803c30270": "CC0-1.0",
}
# Lines at the head of a licence file that are no part of its terms, after lower-casing.
TITLE = (
    r"""(?:the[ ])?(?:mit|expat|isc|zlib|0bsd|(?:new |modified |revised |simplified )?(?:bsd[ -](?:[023]|zero|two|three)[ -]clause|(?:[023]|zero|two|three)[ -]clause[ -]bsd|bsd))"""
    r"""(?:[ ]["'“(]?(?:new|revised|modified|simplified|freebsd)["'”)]?|[ ]or)*[ ]licen[sc]e(?:[ ]\((?:mit|expat|isc|zlib|0bsd|bsd[^)\n]*)\))?[.:]?"""
)
# Every part is possessive: lines are taken one by one without recursion, and none is tried twice.
HEAD = r"\A(?:[ \t\r#*=_/-]*+(?:" + TITLE + r"|(?:portions )?copyright[^\n]*+|©[^\n]*+|\(c\)[^\n]*+|all rights reserved[. ]*+)?+[ \t\r#*=_/-]*+(?:\n|\z))++"
ITEM = r"(?m)^[ \t]*\(?(?:[0-9]{1,2}|[a-z]|i{2,3}|iv)[.)][ \t]+"


def canonical(text: Column) -> Column:
    """Canonical form: what must be equal for two licence texts to count as the same."""
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, "")
    t = reduce(lambda c, s: F.replace(c, F.lit(s[0]), F.lit(s[1])), SPELLINGS, t)
    return F.trim(F.regexp_replace(t, r"[^\p{L}\p{N}]+", " "))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def bare_digest(text: Column) -> Column:
    """Digest that licences are told by."""
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), HEAD, "")
    return digest(F.regexp_replace(F.regexp_replace(t, COPYRIGHT_LINE, ""), ITEM, ""))


def may_be_known(text: Column) -> Column:
    """Whether a text holds a word that all licences of this module hold, in either spelling."""
    return F.lower(text).rlike("licen[sc]e|software")


def known(spark: SparkSession, extra: DataFrame | None = None) -> DataFrame:
    """``known_digest, license_id`` of the licence texts here, and of ``extra`` rows (``license_id, license_text``)."""
    rows = spark.createDataFrame(list(TEXTS.items()), "license_id string, license_text string")
    rows = rows if extra is None else rows.unionByName(extra.select("license_id", "license_text"))
    rows = rows.select(bare_digest(F.col("license_text")).alias("known_digest"), "license_id")
    if LONG_DIGESTS:
        rows = rows.unionByName(spark.createDataFrame(list(LONG_DIGESTS.items()), "known_digest string, license_id string"))
    return rows.groupBy("known_digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", extra: DataFrame | None = None) -> DataFrame:
    """``doc_id, text_digest, license_id, notices`` for every row.

    The fixed list is broadcast (a few rows); with ``extra`` the join is left to Spark, which looks at its size.
    """
    found = known(docs.sparkSession, extra)
    found = F.broadcast(found) if extra is None else found
    notice_ids = F.create_map(*[x for n, i in NOTICES.items() for x in (digest(F.lit(n)), F.lit(i))])
    digests = F.array(*[digest(F.lit(n)) for n in NOTICES])
    # Every notice holds the word "license", so a line without it in either spelling is none of them.
    lines = F.filter(F.split(F.col("text"), "\n"), lambda x: F.lower(x).rlike("licen[sc]e"))
    met = F.array_intersect(F.transform(lines, digest), digests)
    ids = F.array_sort(F.array_distinct(F.transform(met, lambda d: F.element_at(notice_ids, d))))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    low = F.lower(F.coalesce(F.col("text"), F.lit("")))
    notices = F.when(low.rlike("licen[sc]e"), F.array_join(ids, ",")).otherwise("")
    bare = bare_digest(F.col("text"))
    bare = F.when(may_be_known(F.col("text")), bare) if extra is None else bare
    rows = rows.select("doc_id", digest(F.col("text")).alias("text_digest"), bare.alias("bare_digest"), notices.alias("notices"))
    return rows.join(found, rows["bare_digest"] == found["known_digest"], "left").select("doc_id", "text_digest", "license_id", "notices")
