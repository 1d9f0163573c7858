"""Licence scan: digests of canonical whole texts joined with those of known licences.

Everything is built of DataFrame functions.  The canonical form has A-Z in lower
case, no copyright lines, one spelling for words that licences spell two ways, and
single spaces for everything but letters, digits and characters beyond ASCII.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Public licence texts and notices, without their copyright lines.
_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_START = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org>"""
_TEXTS = (
    ("0BSD", f"{_GRANT}.\n{_ISC_END}"), ("Apache-2.0", _APACHE), ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-2-Clause", _BSD_START + _BSD_END), ("BSD-3-Clause", _BSD_START + _BSD_THIRD + _BSD_END), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("ISC", f"{_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_END}"),
    ("MIT", _MIT), ("MIT", "MIT License\n" + _MIT), ("MIT", "The MIT License (MIT)\n" + _MIT), ("MIT", "Released under the MIT License."), ("Zlib", _ZLIB),
    ("0BSD", f"Zero-Clause BSD\n{_GRANT}.\n{_ISC_END}"), ("BSD-2-Clause", "BSD 2-Clause License\n" + _BSD_START + _BSD_END), ("BSD-3-Clause", "BSD 3-Clause License\n" + _BSD_START + _BSD_THIRD + _BSD_END),
    ("BSL-1.0", _BOOST), ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003\n" + _BOOST), ("ISC", f"ISC License\n{_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_END}"),
    ("Unlicense", _UNLICENSE), ("Zlib", "zlib License\n" + _ZLIB),
)
#: The texts, and the one-line tag of each licence.
KNOWN = (*_TEXTS, *((name, f"SPDX-License-Identifier: {name}") for name in sorted({name for name, _ in _TEXTS})))
#: Digests of known licences that are broadcast at most; more are joined by a shuffle.
BROADCAST_DIGESTS = 200_000
#: Spellings and phrases that count as equal, as (found, kept), after lower-casing.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"), ("authorisation", "authorization"), ("authorised", "authorized"), ("copyright owner", "copyright holder"), ("favour", "favor"), ("https://", "http://"),
    ("licence", "license"), ("non-infringement", "noninfringement"), ("organisation", "organization"), ("per cent", "percent"), ("recognised", "recognized"), ("sub-licen", "sublicen"), ("whilst", "while"),
)
#: A line of which only marks stand before the word.
COPYRIGHT_LINE = r"(^|\n)[^a-z0-9\n]*(copyright (\(c\)|©|[0-9])|\(c\) |© ?|all rights reserved)[^\n]*"
OTHER = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def canonical(text: Column) -> Column:
    out = F.translate(text, _UPPER, _LOWER)
    out = F.when(out.rlike("copyright|©|\\(c\\)|all rights"), F.regexp_replace(out, COPYRIGHT_LINE, "\n")).otherwise(out)
    for found, kept in SPELLINGS:
        out = F.replace(out, F.lit(found), F.lit(kept))
    return F.trim(F.regexp_replace(out, OTHER, " "))


def canonical_text(text: str) -> str:
    """The same form in Python, for the digests of the known texts."""
    out = text.translate(str.maketrans(_UPPER, _LOWER))
    out = re.sub(COPYRIGHT_LINE, "\n", out)
    for found, kept in SPELLINGS:
        out = out.replace(found, kept)
    return re.sub(OTHER, " ", out).strip(" ")


def known_digests(known=KNOWN) -> dict[str, str]:
    return {hashlib.sha256(canonical_text(t).encode()).hexdigest(): name for name, t in known}


def known_table(spark: SparkSession, known=KNOWN) -> DataFrame:
    return spark.createDataFrame(sorted(known_digests(known).items()), "digest string, license_id string")


def scan_licenses(docs: DataFrame, known: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, digest, license_id, matched``.

    The whole text counts; a null text is empty.  The digest of a text with
    nothing but copyright lines and marks is that of the empty text, which no
    licence has.  ``license_id`` is null without a match; if a known digest is
    given twice the least id is taken.  Repeated rows come back each, null ids
    stay null, other columns are not read.  An empty table gives no rows; texts of
    any length are taken whole.
    """
    digests = known.groupBy("digest").agg(F.min("license_id").alias("license_id"))
    if known.limit(BROADCAST_DIGESTS + 1).count() <= BROADCAST_DIGESTS:
        digests = F.broadcast(digests)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(canonical(F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("binary"), 256).alias("digest"))
    return rows.join(digests, "digest", "left").select("doc_id", "digest", "license_id", F.col("license_id").isNotNull().alias("matched"))


def _oracle() -> str:
    out = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"
    out = f"regexp_replace({out}, '{COPYRIGHT_LINE}', chr(10), 'g')"
    for found, kept in SPELLINGS:
        out = f"replace({out}, '{found}', '{kept}')"
    values = ", ".join(f"('{d}', '{n}')" for d, n in sorted(known_digests().items()))
    return f"""
WITH known(digest, license_id) AS (VALUES {values}),
rows AS (SELECT doc_id, sha256(trim(regexp_replace({out}, '{OTHER}', ' ', 'g'), ' ')) AS digest FROM documents)
SELECT doc_id, digest, license_id, license_id IS NOT NULL AS matched FROM rows LEFT JOIN known USING (digest)
"""


ORACLE = _oracle()
