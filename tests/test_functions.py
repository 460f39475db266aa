import pytest
from pyspark.sql import functions as F

from gridloom.functions import cells, names
from gridloom.functions.projections import PROJECTIONS


def values(spark, data, of):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(data)], "i int, x string")
    return [r["v"] for r in df.select("i", of(F.col("x")).alias("v")).orderBy("i").collect()]


def test_name_tokens(spark):
    got = values(spark, ["custId", "EmployeeCode", "order_dates", "addresses", "status", "boxes", "companies", "dept-no", "a"], names.name_tokens)
    assert got == [["customer", "identifier"], ["employee", "identifier"], ["order", "date"], ["addresse"], ["status"], ["box"], ["company"], ["department", "number"], ["a"]]


def test_safe_names(spark):
    long = "a" * 30 + " " + "b" * 30
    got = values(spark, ["Total (USD)", "2024", "1st Half", "", None, "__x__", long, "é", "9 lives"], lambda c: names.safe_name(c, F.lit(3)))
    assert got == ["total_usd", "n2024", "st_half", "col_3", "col_3", "x", "a" * 30, "col_3", "lives"]


def test_kinds(spark):
    assert values(spark, ["", None, "2024-01-05", "$1,200.50", "(45)", "12%", "abc", "1/2/24", "12 a"], cells.kind) == ["empty", "empty", "date", "number", "number", "number", "text", "date", "text"]


@pytest.mark.parametrize(("text", "european", "want"), [("1,234.56", False, 1234.56), ("1.234,56", True, 1234.56), ("(5)", False, -5.0), ("12%", False, 0.12), ("€ 7", False, 7.0), ("1d", False, None), ("NaN", False, None), ("1e3", False, 1000.0), (".5", False, 0.5), ("--3", False, None)])
def test_numbers(spark, text, european, want):
    assert values(spark, [text], lambda c: cells.number(c, F.lit(european))) == [want]


def test_null_spellings(spark):
    assert values(spark, [" N/A ", "-", "unknown", " x ", "", "(BLANK)"], cells.cleaned) == [None, None, None, "x", None, None]


def test_overflow(spark):
    assert values(spark, ["9223372036854775807", "9223372036854775808", "-1", "00000000000000000000001"], cells.overflows) == [False, True, False, False]


def test_dates(spark):
    assert [str(x) if x else None for x in values(spark, ["31/12/2024", "12/31/2024", "2024-01-01", "31/02/2024"], lambda c: cells.parsed(c, "d/M/yyyy"))] == ["2024-12-31 00:00:00", None, None, None]


def test_projections_agree_with_their_sql(spark):
    data = ["  AbC-12 ", "é9", "", None, "x_y 3"]
    df = spark.createDataFrame([(x,) for x in data], "x string")
    for p in PROJECTIONS.values():
        assert df.where(~p.of(F.col("x")).eqNullSafe(F.expr(p.sql.format("x")))).count() == 0
