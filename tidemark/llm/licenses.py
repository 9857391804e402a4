"""Licence scans by canonical digest lookup, in native expressions.

A text is brought to a canonical form (lower case, copyright statements removed, equivalent spellings
unified, punctuation and white space collapsed to single spaces) and addressed by its SHA-256. The
digests of whole texts are joined by hash to the digests of the known licences. Short licence notices
are looked up the same way, with each line of a text as the entire text of a possible notice.

Defined results: a null or empty text, or one of which the canonical form is empty, has no licence
and a null digest; texts may have any length and are read whole; one digest names one licence (an
ambiguous registry is refused); repeated rows repeat; an empty table gives no rows; other columns pass
through, columns named like the results are replaced.

Scale: row-local expressions and a hash join with the registry. Up to ``BROADCAST_TEXTS`` texts it is
broadcast and nothing is shuffled; a larger registry, given as a table (license, text), is shuffled by
digest, with documents without a digest kept out of the join.
"""

from __future__ import annotations

import itertools
import pkgutil
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import column, columns, free_name

#: Most texts of a registry that is broadcast (of each only id and digest, about 100 bytes).
BROADCAST_TEXTS = 200_000

#: Equivalent spellings, applied in order to the lower-case text.
SPELLINGS = (
    ("licence", "license"),
    ("sub-license", "sublicense"),
    ("sub license", "sublicense"),
    ("non-commercial", "noncommercial"),
    ("non commercial", "noncommercial"),
    ("organisation", "organization"),
    ("authorisation", "authorization"),
    ("favour", "favor"),
    ("whilst", "while"),
    ("https://", "http://"),
)
# A line that begins with the word copyright is a statement if the sign, a year or its place, or the reservation
# of rights follows, or if it is short (a name). It is not if a word of ``_PROSE`` comes next: wrapped licences
# have such lines. RE2 knows no lookahead, so a quotation mark, which goes later, shields what stays.
_LINE = r"(^|\n)([ \t*#/;-]*copyright[ \t:]+"
_PROSE = r"notice|holder|owner|license|law|act|statement|interest|protection|ownership|permission|disclaimer|infringement|claim|treaty|treatie|right|term|material|work|grant|and|or|in|is|are|was|were|as|to|on|for|of|with|under|from|if|it|that|which|may|can|shall|must|has|have|except|subsist|including|resulting|doctrine|the[ \t]+(?:software|library|program|work)"
_YEAR = r"(?:19|20)[0-9]{2}|yyyy|[<{\[][ \t]*(?:year|name|date)|year[ \t]"
#: Applied in order after them. The patterns mean the same in Java and in RE2.
CANON = (
    (_LINE + rf"(?:{_PROSE})s?([^a-z]|\z))", r'\1"\2'),
    (r"(^|\n)[ \t*#/;-]*(copyright[ \t:,]*(\(c\)|©|&copy;|" + _YEAR + r")|copyright[ \t:,][^\n]*((?:19|20)[0-9]{2}|all rights reserved)|\(c\)[ \t]*(copyright|" + _YEAR + r")|©|all rights reserved)[^\n]*", " "),
    (_LINE + r"[^ \t\n]+([ \t]+[^ \t\n]+){6})", r'\1"\2'),
    (_LINE + r"[^ \t\r\n][^\n]*)", " "),
    (r"version ([0-9])", r"v\1"),
    (r"v([0-9]+)\.0([^0-9.]|$)", r"v\1\2"),
    (r"[^0-9a-z\x{80}-\x{10FFFF}]+", " "),
)

# Public licence texts, without their copyright lines.
_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_ISC_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
_BSD3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_BSD_WARRANTY = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n"
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_COND = ", provided that the above copyright notice and this permission notice appear in all copies"
_ZLIB = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution."

#: Texts in ``texts/``: by id, the files, where the text without its title begins and where what follows the terms begins.
FILES = {
    "Apache-2.0": (("Apache-2.0",), ("TERMS AND CONDITIONS FOR USE",), ("END OF TERMS AND CONDITIONS", "APPENDIX: How to apply")),
    "Artistic-1.0-Perl": (("Artistic-1.0-Perl",), ("Preamble",), ("The End",)),
    "BSL-1.0": (("BSL-1.0",), ("Permission is hereby granted",), ()),
    "CC-BY-SA-4.0": (("CC-BY-SA-4.0",), ("Creative Commons Corporation", "Creative Commons Attribution-ShareAlike 4.0 International Public"), ("Creative Commons is not a party to its public",)),
    "CC0-1.0": (("CC0-1.0",), ("CC0 1.0 Universal", "CREATIVE COMMONS CORPORATION IS NOT", "Statement of Purpose"), ()),
    "GFDL-1.2": (("GFDL-1.2",), ("Copyright (C)",), ("ADDENDUM: How to use",)),
    "GFDL-1.3": (("GFDL-1.3",), ("Copyright (C)",), ("ADDENDUM: How to use",)),
    "GPL-1.0": (("GPL-1.0",), ("Copyright (C)",), ("Appendix: How to Apply These Terms",)),
    "GPL-2.0": (("GPL-2.0", "GPL-2.0-SPDX"), ("Copyright (C)",), ("How to Apply These Terms",)),
    "GPL-3.0": (("GPL-3.0",), ("Copyright (C)",), ("How to Apply These Terms",)),
    "LGPL-2.0": (("LGPL-2.0",), ("Copyright (C)",), ("How to Apply These Terms",)),
    "LGPL-2.1": (("LGPL-2.1",), ("Copyright (C)",), ("How to Apply These Terms",)),
    "LGPL-3.0": (("LGPL-3.0",), ("Copyright (C)",), ()),
    "MPL-1.1": (("MPL-1.1",), ("1. Definitions",), ("EXHIBIT A -Mozilla",)),
    "MPL-2.0": (("MPL-2.0",), ("1. Definitions",), ("Exhibit A - Source Code", 'Exhibit B - "Incompatible')),
    "OFL-1.1": (("OFL-1.1",), ("PREAMBLE",), ()),
    "Unicode-3.0": (("Unicode-3.0",), ("COPYRIGHT AND PERMISSION", "NOTICE TO USER"), ()),
    "Unlicense": (("Unlicense",), (), ("For more information",)),
}
#: The Free Software Foundation's addresses: its texts went out with each of them, and without one in the heading.
_ADDRESS = re.compile(r"51 Franklin St(?:reet)?, Fifth Floor, Boston,? MA\s+02110-1301,?\s+USA")
ADDRESSES = ("51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA", "51 Franklin St, Fifth Floor, Boston, MA 02110-1301 USA", "59 Temple Place, Suite 330, Boston, MA 02111-1307 USA", "675 Mass Ave, Cambridge, MA 02139, USA")


def _from_files(files: tuple, starts: tuple, ends: tuple) -> tuple[str, ...]:
    """The texts of a licence with and without title, appendix and the publisher's old addresses."""
    found: dict[str, None] = {}
    for file in files:
        whole = pkgutil.get_data(__name__, f"texts/{file}.txt").decode()
        heads = [0, *(whole.index(s) for s in starts)]
        tails = [*(whole.rindex(s) for s in ends), len(whole)]
        for a, b in itertools.product(heads, tails):
            text = whole[a:b]
            found[text] = None
            if _ADDRESS.search(text):
                found |= dict.fromkeys([*(_ADDRESS.sub(x, text) for x in ADDRESSES), _ADDRESS.sub("", text, count=1)])
    return tuple(found)


def _titled(titles: tuple, texts: tuple) -> tuple[str, ...]:
    return tuple(f"{t}\n{x}" for t in titles for x in texts)


def _bsd(clauses: str) -> tuple[str, ...]:
    """The warranty names holders, owners, regents or authors; conditions have numbers or bullets."""
    out = []
    for by, event in (("COPYRIGHT HOLDERS AND CONTRIBUTORS", "COPYRIGHT HOLDER OR CONTRIBUTORS"), ("COPYRIGHT HOLDERS AND CONTRIBUTORS", "COPYRIGHT OWNER OR CONTRIBUTORS"), ("REGENTS AND CONTRIBUTORS", "REGENTS OR CONTRIBUTORS"), ("AUTHOR AND CONTRIBUTORS", "AUTHOR OR CONTRIBUTORS"), ("AUTHOR", "AUTHOR")):
        text = clauses + _BSD_WARRANTY.replace("COPYRIGHT HOLDERS AND CONTRIBUTORS", by).replace("COPYRIGHT HOLDER OR CONTRIBUTORS", event)
        out += [text, re.sub(r"(?m)^[0-9]\. ", "* ", text)]
    return tuple(out)


def _bsd3() -> tuple[str, ...]:
    named = (_BSD3, _BSD3.replace("copyright holder", "University"), _BSD3.replace("copyright holder", "author"))
    return tuple(x for clause in named for x in _bsd(_BSD + clause))


_ISC_TEXTS = tuple(f"{start}{_ISC_COND}.\n{_ISC_WARRANTY}" for start in (_ISC, _ISC.replace("and/or", "and")))
_ZERO = (f"{_ISC}.\n{_ISC_WARRANTY}",)
_MIT_TEXTS = (_MIT + _WARRANTY, (_MIT + _WARRANTY).replace("this permission notice shall", "this permission notice (including the next paragraph) shall"))
LICENSES = {
    "0BSD": (*_ZERO, *_titled(("BSD Zero Clause License", "Zero-Clause BSD"), _ZERO)),
    "BSD-2-Clause": (*_bsd(_BSD), *_titled(("BSD 2-Clause License", "The 2-Clause BSD License"), _bsd(_BSD))),
    "BSD-3-Clause": (*_bsd3(), *_titled(("BSD 3-Clause License", "The 3-Clause BSD License", "BSD License"), _bsd3())),
    "ISC": (*_ISC_TEXTS, *_titled(("ISC License", "The ISC License", "ISC License (ISC)"), _ISC_TEXTS)),
    "MIT": _MIT + _WARRANTY,
    "MIT titled": (*_titled(("MIT License", "The MIT License", "The MIT License (MIT)"), _MIT_TEXTS), _MIT_TEXTS[1]),
    "Zlib": _ZLIB,
    "Zlib titled": _titled(("zlib License", "The zlib License", "The zlib/libpng License"), (_ZLIB,)),
    **{k: _from_files(*v) for k, v in FILES.items()},
}
# One-line licence notices. Each holds the word license, or a line without it is not looked up.
NOTICES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License 2.0.", "Released under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0"),
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.", "MIT License", "SPDX-License-Identifier: MIT"),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License.", "Released under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under CC BY-SA 4.0."),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only"),
    "MPL-2.0": ("This work is licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0"),
}


def canonical(text: Column) -> Column:
    out = F.lower(text)
    for find, put in SPELLINGS:
        out = F.replace(out, F.lit(find), F.lit(put))
    for pattern, put in CANON:
        out = F.regexp_replace(out, pattern, put.replace("\\1", "$1").replace("\\2", "$2"))
    return F.trim(out)


def digest(text: Column) -> Column:
    """SHA-256 of the canonical form; null if that is empty. The form is evaluated once."""
    return F.get(F.transform(F.array(canonical(text)), lambda c: F.when(F.length(c) > 0, F.sha2(c, 256))), F.lit(0))


def registry(spark: SparkSession, known: dict[str, str | tuple[str, ...]] | DataFrame) -> DataFrame:
    """(license, digest) of the known texts, given by id or as a table (license, text)."""
    if isinstance(known, DataFrame):
        texts = known.select("license", "text")
    else:
        texts = spark.createDataFrame([(k, t) for k, v in sorted(known.items()) for t in ([v] if isinstance(v, str) else v)], "license string, text string")
    return texts.select("license", digest(F.col("text")).alias("digest")).where("digest IS NOT NULL").distinct()


def _checked(known: DataFrame) -> DataFrame:
    """The registry, if no two licences share a digest."""
    clash = known.groupBy("digest").agg(F.min("license").alias("a"), F.max("license").alias("b")).where("a <> b").first()
    if clash:
        raise ValueError(f"{clash['a']} and {clash['b']} have the same canonical text")
    return known


def find_licenses(docs: DataFrame, text: str = "text", licenses: dict | DataFrame | None = None, notices: dict | None = None) -> DataFrame:
    """Documents with license_digest, license (of the entire text) and notices (sorted ids, from lines)."""
    spark = docs.sparkSession
    whole = _checked(registry(spark, LICENSES if licenses is None else licenses))
    lines = _checked(registry(spark, NOTICES if notices is None else notices)).collect()
    small = whole.count() <= BROADCAST_TEXTS
    body = column(text)
    # Only lines that hold the word can be notices, so only they are brought to canonical form.
    has_word = F.contains(F.lower(body), F.lit("licen"))
    candidates = F.filter(F.split(body, r"\n", -1), lambda line: F.contains(F.lower(line), F.lit("licen")))
    ids = F.array().cast("array<string>")
    if lines:
        by_digest = F.create_map(*[F.lit(x) for r in sorted(lines, key=lambda r: r["digest"]) for x in (r["digest"], r["license"])])
        ids = F.array_sort(F.array_distinct(F.filter(F.transform(candidates, lambda line: by_digest[digest(line)]), lambda x: x.isNotNull())))
    base = docs.drop("license_digest", "license", "notices")
    own, found = free_name(base, "__own"), free_name(base, "__found")
    base = base.withColumn(own, F.struct(digest(body).alias("digest"), F.when(has_word, ids).otherwise(F.array().cast("array<string>")).alias("notices")))
    table = whole.select(F.struct("digest", "license").alias(found))
    same = F.col(f"{own}.digest") == F.col(f"{found}.digest")
    if small:
        joined = base.join(F.broadcast(table), same, "left")
    else:
        some = F.col(f"{own}.digest").isNotNull()
        empty = base.where(~some).withColumn(found, F.lit(None).cast(table.schema[found].dataType))
        joined = base.where(some).join(table, same, "left").unionByName(empty)
    return joined.select(*columns(docs.drop("license_digest", "license", "notices")), F.col(f"{own}.digest").alias("license_digest"), F.col(f"{found}.license").alias("license"), F.col(f"{own}.notices").alias("notices"))
