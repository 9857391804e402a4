"""Whole licence texts in their published wraps, and what counts as a copyright statement."""

import pkgutil

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.llm import contracts, licenses
from tidemark.llm.oracles import ORACLES

ISC = """ISC License

Copyright (c) 2016, Somebody <some@body.example>

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR
ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF
OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.
"""
BSD = """Copyright 2019 The Example Authors.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are
met:

   * Redistributions of source code must retain the above copyright
notice, this list of conditions and the following disclaimer.
   * Redistributions in binary form must reproduce the above
copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the
distribution.

THIS SOFTWARE IS PROVIDED BY THE
COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR
A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT
OWNER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT
LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE,
DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY
THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
MIT = licenses.LICENSES["MIT"].replace("conditions:\nThe above copyright", "conditions:\n\nThe above\ncopyright").replace("AUTHORS OR COPYRIGHT", "AUTHORS OR\nCOPYRIGHT")
STATEMENTS = ("Copyright (c) 2020 Somebody", "Copyright © Somebody", "# Copyright 1999-2004, 2007 by a body with a rather long name and address", "Copyright The Example Authors", "Copyright [yyyy] [name of copyright owner]", "Copyright <YEAR> <COPYRIGHT HOLDER>", "Copyright Example, Inc. and other contributors, All rights reserved.", "(c) 2001 Somebody", "© Somebody", "All rights reserved.")
PROSE = ("copyright notice and this", "copyright holders or contributors", "copyright holder.", "Copyright law gives authors rights to works that they made", "copyright claims made since 1998", "copyright", "(c) You must retain the notices", "copyrighted works", "copyright licence to reproduce, prepare derivative works of, and display")


def whole(name):
    return pkgutil.get_data("tidemark.llm", f"texts/{name}.txt").decode()


@pytest.fixture(scope="module")
def texts():
    """(text, licence): whole, untitled and in other wraps, with line ends and addresses of all kinds."""
    rows = [(ISC, "ISC"), (BSD, "BSD-2-Clause"), (MIT, "MIT"), ("The MIT License (MIT)\n\nCopyright (c) 2014 A. Body\n\n" + MIT, "MIT titled")]
    rows += [(whole(f), k) for k, (files, _, _) in licenses.FILES.items() for f in files]
    gpl, apache, mpl = whole("GPL-2.0"), whole("Apache-2.0"), whole("MPL-2.0")
    rows += [(gpl[gpl.index(" Copyright (C)") :].replace("\n", "\r\n"), "GPL-2.0"), (gpl.replace("51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA", "59 Temple Place - Suite 330, Boston, MA 02111-1307, USA"), "GPL-2.0")]
    rows += [(apache[apache.index("TERMS AND") :].replace("[yyyy] [name of copyright owner]", "2021 Some Body Ltd."), "Apache-2.0"), (apache[: apache.index("   APPENDIX")], "Apache-2.0"), (mpl[mpl.index("1. Definitions") :], "MPL-2.0")]
    rows += [(" ".join(mpl.split()), "MPL-2.0"), (apache + "\nand one more condition", None), (gpl[: len(gpl) // 2], None)]
    return rows


def test_whole_texts_have_their_licence(spark, texts):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    found = {r["doc_id"]: r["license"] for r in licenses.find_licenses(docs).collect()}
    assert [found[i] for i in range(len(texts))] == [k for _, k in texts]


def test_only_copyright_statements_go(spark):
    form = lambda lines: [r[0] for r in spark.createDataFrame([(f"before\n{x}\nafter",) for x in lines], "t string").select(licenses.canonical(F.col("t"))).collect()]
    assert form(STATEMENTS) == ["before after"] * len(STATEMENTS)
    assert all(len(a.split()) == 2 + len(b.replace(",", " ").split()) for a, b in zip(form(PROSE), PROSE, strict=True))
    assert form(["\n".join(STATEMENTS)]) == ["before after"]


def test_sql_agrees_on_whole_texts(spark, texts, tmp_path):
    rows = [(i, t) for i, t in enumerate([*(t for t, _ in texts), "\n".join(STATEMENTS), "\n".join(PROSE), None, *STATEMENTS, *PROSE])]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(c.sql(ORACLES["op2_license_scan"]).fetchall())
    assert sorted(tuple(r) for r in contracts.op2_license_scan(spark, str(tmp_path)).collect()) == want and len(want) == len(rows)
