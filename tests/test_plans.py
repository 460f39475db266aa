import datetime as dt
import decimal

import pytest

from gridloom.plans import guard, present


@pytest.fixture(scope="module")
def views(spark):
    spark.createDataFrame([(1, "a", 2.5), (2, "b", None)], "id int, name string, amount double").createOrReplaceTempView("items")
    spark.createDataFrame([(1,)], "id int").createOrReplaceTempView("other")
    return {"items", "other"}


GOOD = [
    "SELECT name, sum(amount) AS total FROM items GROUP BY name;",
    "WITH x AS (SELECT * FROM items) SELECT count(*) FROM x",
    "SELECT id FROM items UNION SELECT id FROM other",
    "SELECT * FROM items i WHERE EXISTS (SELECT 1 FROM other o WHERE o.id = i.id)",
    "SELECT name, row_number() OVER (ORDER BY id) AS r FROM items WHERE name <> 'drop; load' ORDER BY 1 LIMIT 3",
    "SELECT name FROM items GROUP BY name HAVING count(*) > 0",
]
BAD = [
    ("", "EMPTY_SQL"),
    (" ; ", "EMPTY_SQL"),
    ("SELEC x", "PARSE_ERROR"),
    ("SELECT 1 FROM items; SELECT 2 FROM items", "MULTIPLE_STATEMENTS"),
    ("DROP TABLE items", "WRITE_STATEMENT"),
    ("INSERT INTO items VALUES (1, 'x', 2)", "WRITE_STATEMENT"),
    ("SET spark.sql.shuffle.partitions = 1", "NOT_A_SELECT"),
    ("SELECT * FROM nowhere", "TABLE_NOT_FOUND"),
    ("SELECT * FROM csv.`/etc/passwd`", "TABLE_NOT_FOUND"),
    ("SELECT * FROM range(10)", "TABLE_NOT_FOUND"),
    ("SELECT id FROM items WHERE id IN (SELECT id FROM hidden)", "TABLE_NOT_FOUND"),
    ("SELECT 1", "NO_TABLES"),
    ("SELECT colour FROM items", "COLUMN_NOT_FOUND"),
    ("WITH x AS (SELECT * FROM items) SELECT colour FROM x", "COLUMN_NOT_FOUND"),
    ("SELECT sum(name, id) FROM items", "EXPLAIN_FAILED"),
    ("SELECT java_method('java.lang.System', 'exit', id) FROM items", "NOT_A_SELECT"),
]


@pytest.mark.parametrize("sql", GOOD)
def test_reads_pass(spark, views, sql):
    assert guard.run(guard.checked(spark, sql, views).frame).columns


@pytest.mark.parametrize(("sql", "code"), BAD)
def test_all_else_is_refused(spark, views, sql, code):
    with pytest.raises(guard.Refused) as e:
        guard.checked(spark, sql, views)
    assert e.value.code == code


def test_cap_and_time_limit(spark, views):
    got = guard.run(spark.range(100), cap=10)
    assert len(got.rows) == 10 and got.truncated
    with pytest.raises(guard.Refused) as e:
        guard.run(spark.range(1 << 40).selectExpr("sum(id % 7 * id % 5) AS s"), seconds=1)
    assert e.value.code == "TIMEOUT"


def test_plain_values():
    assert guard.plain([decimal.Decimal("1.5"), float("nan"), dt.datetime(2024, 1, 2, 3), dt.date(2024, 1, 2), b"x", {"a": (1, None)}]) == [1.5, None, "2024-01-02 03:00:00", "2024-01-02", "x", {"a": [1, None]}]


def test_charts(spark):
    assert present.chart(spark.range(1).selectExpr("id"))["kind"] == "big_number"
    assert present.chart(spark.range(5).selectExpr("cast(id AS string) AS k", "id AS v"))["kind"] == "bar"
    assert present.chart(spark.range(5).selectExpr("date_add(DATE '2024-01-01', int(id)) AS d", "id AS v"))["kind"] == "line"
    assert present.chart(spark.range(20).selectExpr("id AS a", "id * 2 AS b"))["kind"] == "scatter"
    assert present.chart(spark.range(0))["kind"] == "table"
    assert present.chart(spark.range(5), "none")["kind"] == "table"


def test_facts(spark):
    r = present.facts(spark.createDataFrame([("a", 1.0), ("b", None), ("c", 3.0)], "k string, v double")).first()
    assert (r["n_rows"], r["highest_label"], r["highest"], r["lowest_label"], r["lowest"], r["total"]) == (3, "c", 3.0, "b", 0.0, 4.0)
