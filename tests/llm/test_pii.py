import hashlib
import re

import pytest

from gridloom.llm import pii

KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base(text):
    out = []
    for kind, pattern in KINDS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


CASES = [
    "",
    None,
    "write to a.b+c@x-y.example.com, a@b.c_x@d.e or a@b.c%%q@r.s. no@domain @x.y z@.com",
    "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 0000255.0.0.001 999.1.2.3.4 v1.2.3.4x 1.2.3",
    "4111111111111111 4111-1111 1111 1111 4111 1111 1111 1112 5500005555555559 1 4111111111111111 41111111111111111111",
    "5  4111111111111111 7- 4111111111111111 4994226020900891 378282246310005",
    "+1 (743) 555-3824 +12 +1234567 ++44 20 7946 0958 +1-2-3-4-5-6-7-8-9-0-1-2-3-4-5-6 +9( ) 12345678.",
    "\U0001f600 été x@y.zz 日本 +49 30 1234567 1.1.1.1",
    "GB82 WEST 1234 5698 7654 32 and GB83WEST12345698765432 DE89370400440532013000",
    "my ssn is 123-45-6789 ok. " + "filler " * 9 + "number 123-45-6788 " + "alone " * 9 + "; social 000-12-3456",
    "a" * 60_000 + "@",
    "1 " * 30_000,
    "1." * 30_000,
    "9" * 50_000,
    "+1" * 5_000,
    ("mail x@y.zz " * 2_000),
    "A" * 30_000 + "GB82WEST12345698765432",
]


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame([(i, t, 1, "m") for i, t in enumerate(CASES)], "doc_id long, text string, found long, m_email string")
    return {r["doc_id"]: [f"{x['kind']}:{x['start']}:{x['stop']}" for x in r["found"]] for r in pii.personal_data(df).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_base_spans(found, i):
    assert [x for x in found[i] if x.split(":")[0] in KINDS] == base(CASES[i])


def test_added_kinds(found):
    text = CASES[8]
    assert [text[int(a) : int(b)] for k, a, b in (x.split(":") for x in found[8]) if k == "iban"] == ["GB82 WEST 1234 5698 7654 32", "DE89370400440532013000"]
    assert [CASES[9][int(a) : int(b)] for k, a, b in (x.split(":") for x in found[9]) if k == "ssn"] == ["123-45-6789"]


def test_query_against_plain_patterns(spark, sf_dir):
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    for r in pii.op1_pii(spark, sf_dir).collect():
        want = base(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in KINDS] == [sum(x.startswith(k) for x in want) for k in KINDS]


def test_masked(spark):
    df = spark.createDataFrame([(1, "call +1 (743) 555-3824 or x@y.zz now", "k"), (2, None, "k"), (3, "clean 12", "k"), (4, "x4111111111111111@y.zz", "k")], "doc_id long, text string, source string")
    got = {r["doc_id"]: r["text"] for r in pii.masked(df).collect()}
    assert got == {1: "call [PHONE] or [EMAIL] now", 2: None, 3: "clean 12", 4: "[EMAIL]"}
    assert pii.masked(df).columns == df.columns


def test_empty(empty):
    assert pii.personal_data(empty).collect() == []


def test_no_python_in_the_plan(spark, sf_dir):
    plan = pii.op1_pii(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
