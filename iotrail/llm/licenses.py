"""Licence scans by canonical digests, with DataFrame functions only.

A text is brought into a canonical form: lower case, no copyright lines, spellings made alike, everything but letters and digits turned
into single blanks. Its SHA-256 is joined to the digests of the known licence texts and notices, a table of fixed size. Besides whole
texts, lines are looked up by themselves, as notices stand among other text: all that begin like something known, which no spelling hides.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from iotrail.llm.common import drop_named, quoted

# Texts and notices of well-known licences, and spellings that count as the same.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
ISC_DISCLAIMER = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
BSD_1 = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
BSD_2 = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_3 = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
TEXTS: list[tuple[str, str]] = [
    ("MIT", MIT), ("MIT", "MIT License\n\n" + MIT), ("MIT", "The MIT License (MIT)\n\n" + MIT), ("MIT", "The MIT License\n\n" + MIT),
    ("ISC", f"{ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{ISC_DISCLAIMER}"),
    ("ISC", f"ISC License\n\n{ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{ISC_DISCLAIMER}"),
    ("0BSD", f"{ISC_GRANT}.\n\n{ISC_DISCLAIMER}"),
    ("BSD-2-Clause", f"{BSD_GRANT}\n\n1. {BSD_1}\n\n2. {BSD_2}\n\n{BSD_DISCLAIMER}"), ("BSD-2-Clause", f"BSD 2-Clause License\n\n{BSD_GRANT}\n\n1. {BSD_1}\n\n2. {BSD_2}\n\n{BSD_DISCLAIMER}"),
    ("BSD-3-Clause", f"{BSD_GRANT}\n\n1. {BSD_1}\n\n2. {BSD_2}\n\n3. {BSD_3}\n\n{BSD_DISCLAIMER}"),
    ("BSD-3-Clause", f"BSD 3-Clause License\n\n{BSD_GRANT}\n\n1. {BSD_1}\n\n2. {BSD_2}\n\n3. {BSD_3}\n\n{BSD_DISCLAIMER}"),
    ("Zlib", ZLIB), ("Apache-2.0", APACHE_HEADER),
]
#: What notices call a licence.
NAMES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache 2.0"),
    "MIT": ("MIT License", "MIT"),
    "ISC": ("ISC License", "ISC"),
    "BSD-2-Clause": ("BSD 2-Clause License", "BSD-2-Clause"),
    "BSD-3-Clause": ("BSD 3-Clause License", "BSD-3-Clause"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU General Public License v2.0", "GPL-2.0", "GPLv2"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU General Public License v3.0", "GPL-3.0", "GPLv3"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "LGPL-2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "LGPL-3.0"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "AGPL-3.0"),
    "MPL-2.0": ("Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "MPL-2.0", "MPL 2.0"),
    "Unlicense": ("Unlicense",),
    "CC0-1.0": ("CC0 1.0", "CC0"),
    **{f"CC-{kind}-{v}": (f"CC {kind} {v}", f"CC-{kind}-{v}", f"Creative Commons {kind} {v}") for kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND") for v in ("4.0", "3.0")},
}
PHRASES = (
    "Licensed under {}", "Licensed under the {}", "This work is licensed under {}", "This work is licensed under the {}", "Released under the {}", "Released under {}",
    "Distributed under the {}", "This project is licensed under the {}", "This software is licensed under the {}", "Available under the {}", "SPDX-License-Identifier: {}", "License: {}",
)
SPELLINGS = (
    ("licence", "license"), ("sub license", "sublicense"), ("non infringement", "noninfringement"), ("favour", "favor"), ("organisation", "organization"), ("behaviour", "behavior"),
    ("acknowledgement", "acknowledgment"), ("merchantibility", "merchantability"), ("per cent", "percent"), ("judgement", "judgment"), ("https ", "http "), ("copyright owner", "copyright holder"),
)
#: A line that only says whose the rights are.
COPYRIGHT_LINE = r"(?m)^[^a-z0-9\n]*(copyright[ \t]*(\(c\)|©|[0-9<\[{])|\(c\)[ \t]|©|all rights reserved)[^\n]*$"


def canonical(text: Column) -> Column:
    """The canonical form; null stays null."""
    low = F.replace(F.lower(text), F.lit("\r"), F.lit("\n"))
    plain = F.trim(F.regexp_replace(F.regexp_replace(low, COPYRIGHT_LINE, " "), "[^a-z0-9]+", " "))
    return reduce(lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pair[1])), SPELLINGS, plain)


def known_texts() -> list[tuple[str, str]]:
    """(licence, text) of all that is known."""
    return TEXTS + [(i, p.format(n)) for i, names in NAMES.items() for n in names for p in PHRASES]


def known_digests(spark: SparkSession) -> DataFrame:
    """(``license_id``, ``digest``) of the known texts and notices; a few hundred rows whatever the input."""
    table = spark.createDataFrame(known_texts(), "license_id string, body string")
    return table.select("license_id", F.sha2(canonical(F.col("body")), 256).alias("digest")).groupBy("digest").agg(F.min("license_id").alias("license_id"))


def beginnings(spark: SparkSession) -> str:
    """A pattern for the lower-case lines, in a text or alone, that begin like a known one.

    It has the first three characters of first words. Replacing spellings keeps them: both of a pair begin alike that far.
    """
    table = spark.createDataFrame(known_texts(), "license_id string, body string")
    first = {r[0] for r in table.select(F.substring(F.substring_index(canonical(F.col("body")), " ", 1), 1, 3)).collect()}
    return rf"(?:^|[\r\n])[^a-z0-9\r\n]*(?:{'|'.join(sorted(first - {''}))})"


def scan(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``line`` 0 for every row of ``docs``, with ``license_id`` if its whole text is a known licence, else null; further rows for lines
    (counted from 1) that are known notices.

    ``digest`` is that of the canonical form. Null texts count as empty and match nothing. Repeated rows are scanned each; the columns to
    carry are all but the text, those called like the new ones are replaced.
    """
    new = ("line", "digest", "license_id")
    carry = [c for c in docs.columns if c != text] if carry is None else carry
    kept = drop_named(docs.select(*map(quoted, carry)), new).columns
    whole = F.coalesce(quoted(text), F.lit(""))
    lines = F.transform(F.split(F.replace(whole, F.lit("\r"), F.lit("\n")), "\n"), lambda x, i: F.struct((i + 1).alias("line"), x.alias("body")))
    known_line = beginnings(docs.sparkSession)
    notices = F.filter(lines, lambda u: F.lower(u["body"]).rlike(known_line))
    units = F.array(F.struct(F.lit(0).alias("line"), whole.alias("body")))
    units = F.when(F.lower(whole).rlike(known_line), F.concat(units, notices)).otherwise(units)
    rows = docs.select(*map(quoted, kept), F.explode(units).alias("unit of the scan"))
    rows = rows.select(*map(quoted, kept), F.col("unit of the scan.line").alias("line"), F.sha2(canonical(F.col("unit of the scan.body")), 256).alias("digest"))
    known = F.broadcast(known_digests(docs.sparkSession))  # of fixed size
    return rows.join(known, "digest", "left").where("line = 0 or license_id is not null").select(*map(quoted, kept), "line", "digest", "license_id")
