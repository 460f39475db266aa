import textwrap

import duckdb

from gridloom.llm import license_scan as op

NO_TEXT = {"AGPL-3.0", "CC-BY-4.0", "CC-BY-NC-4.0", "EPL-2.0"}
APACHE = """# Copyright 2020 Someone
#
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.
"""


def scanned(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    return {r["doc_id"]: (r["license"], [(x["line"], x["license"]) for x in r["notices"]]) for r in op.scan(df).collect()}


def test_entire_texts_and_headers(spark):
    known = [*op.TEXTS, *op.entire()]
    assert {i for i, _ in known} == {i for i, _ in op.LICENSES} - NO_TEXT
    got = scanned(spark, [t for _, t in known])
    assert [got[k][0] for k in range(len(known))] == [i for i, _ in known]
    assert all(f"{i}" in op.__doc__ for i in NO_TEXT)


def test_apache_header(spark):
    got = scanned(spark, [APACHE, APACHE + "\nimport os\n", "\n".join(APACHE.splitlines()[2:3])])
    assert [got[k] for k in range(3)] == [("Apache-2.0", [(3, "Apache-2.0")]), (None, [(3, "Apache-2.0")]), ("Apache-2.0", [(1, "Apache-2.0")])]


def wrapped(text, width):
    """Paragraphs filled to a width; lines that state a copyright stay by themselves."""
    out, held = [], []

    def fill():
        out.extend(textwrap.wrap(" ".join(held), width, break_long_words=False, break_on_hyphens=False))
        held.clear()

    for line in text.split("\n"):
        alone = line.strip().startswith(("Copyright (C)", "Copyright (c)"))
        if alone or not line.strip():
            fill()
            out.append(line)
        else:
            held.append(line.strip())
    fill()
    return "\n".join(out)


def test_wrapping_changes_nothing(spark):
    known = [(i, t) for i, t in [*op.TEXTS, *op.entire()] if op._END not in t or t.endswith(op._END)]
    cases = [(i, wrapped(t, width)) for i, t in known for width in (*range(20, 101, 4), 10_000)]
    got = scanned(spark, [t for _, t in cases])
    assert [(i, [x for x in t.split("\n") if "copyright" in x.lower()[:15] or "(c)" in x.lower()[:5]]) for k, (i, t) in enumerate(cases) if got[k][0] != i] == []


def test_statements_of_ownership(spark):
    mit = op.TEXTS[0][1]
    stated = ["Copyright 2020 A", "Copyright (c) 2020 A", "(c) 2020 A", "© A B", "COPYRIGHT: The Regents", "Copyright (C) <year> <owner>", "Copyright [yyyy] [name]", "# Copyright by Jane Doe", "All rights reserved.", "(c) Jane Doe", "Copyright ©"]
    prose = ["copyright notice", "Copyright holders agree.", "(c) You must retain", "copyright law", "Copyrighted by A", "copyright"]
    got = scanned(spark, [f"{x}\n{mit}" for x in stated + prose])
    assert [got[k][0] for k in range(len(stated + prose))] == ["MIT"] * len(stated) + [None] * len(prose)


def test_sql_on_entire_texts(spark, tmp_path):
    known = [*op.TEXTS, *op.entire()]
    mit = op.TEXTS[0][1]
    texts = [t for _, t in known] + [wrapped(t, 64) for _, t in known] + [APACHE, None, ""]
    texts += [f"{x}\n{mit}" for x in ("Copyright (c) 2020 A", "(c)", "© A B", "(c) You must retain", "Copyright holders agree.", "copyright law", "COPYRIGHT: The Regents", "Copyright (C) the software", "All rights reserved.", "Copyrighted by A", "copyright")]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"file://{tmp_path}/documents.parquet")
    got = op.op3_license_scan(spark, f"file://{tmp_path}").collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, con.execute(op.SQL).fetchall()))
    assert sum(r["license"] is not None for r in got) >= 2 * len(known) - 40
