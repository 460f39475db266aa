import datetime as dt

import pytest
from pyspark.sql import functions as F

from gridloom.operators import blocks, bm25, fuse, graph, infer, profile, relate


def frame(spark, text):
    head, *rows = [line.split(",") for line in text.strip().splitlines()]
    return spark.createDataFrame([tuple(x or None for x in r) for r in rows], ", ".join(f"`{h}` string" for h in head))


def kinds(spark, columns):
    n = max(map(len, columns.values()))
    rows = [tuple(c[i] if i < len(c) else None for c in columns.values()) for i in range(n)]
    df = spark.createDataFrame(rows, ", ".join(f"{k} string" for k in columns))
    return {r["column_name"]: r["target"] for r in infer.inferred(df).collect()}, infer.coerced(df)


def test_inference(spark):
    got, df = kinds(
        spark,
        {
            "whole": ["1", "2", " 3 ", "1,000"],
            "money": ["$1.50", "(2)", "n/a", "3%"],
            "eu": ["1.234,50", "7,25", "10", "8"],
            "zip": ["01234", "99999", "12345", "54321"],
            "huge": ["9223372036854775808", "1", "2", "3"],
            "dayfirst": ["13/01/2024", "02/03/2024", "04/05/2024", "28/02/2024"],
            "monthfirst": ["01/02/2024", "02/03/2024", "04/05/2024", "12/25/2024"],
            "month": ["2024-01", "2024-02", "2024-03", "2024-04"],
            "flag": ["yes", "No", "y", "n"],
            "one": ["yes", "yes", "yes", "yes"],
            "mixed": ["1", "2", "x", "4"],
            "void": ["", "-", None, "na"],
        },
    )
    assert got == {"whole": "bigint", "money": "double", "eu": "double", "zip": "string", "huge": "string", "dayfirst": "timestamp", "monthfirst": "timestamp", "month": "timestamp", "flag": "boolean", "one": "string", "mixed": "string", "void": "string"}
    rows = df.collect()
    assert [r["whole"] for r in rows] == [1, 2, 3, 1000]
    assert [r["money"] for r in rows] == [1.5, -2.0, None, 0.03]
    assert rows[0]["eu"] == 1234.5 and rows[0]["dayfirst"] == dt.datetime(2024, 1, 13) and rows[1]["monthfirst"] == dt.datetime(2024, 2, 3)
    assert [r["flag"] for r in rows] == [True, False, True, False]


def test_profile(spark):
    df = spark.createDataFrame([(1, "C-101", 5.0, "x"), (2, "C-102", None, "x"), (3, "C-103", 2.0, None), (4, "C-104", 2.0, "y")], "k long, customer_ref string, amount double, c string")
    got = {r["column_name"]: r for r in profile.profile(df).collect()}
    assert got["k"]["semantic_type"] == "id" and got["k"]["is_unique"]
    ref = got["customer_ref"]
    assert (ref["regex_signature"], ref["name_tokens"], ref["min_value"], ref["max_value"]) == (r"^[A-Z]{1,4}[-_]?\d+$", ["customer", "identifier"], "C-101", "C-104")
    assert (got["amount"]["semantic_type"], got["amount"]["n_null"], got["amount"]["null_rate"], got["amount"]["min_value"], got["amount"]["max_value"]) == ("numeric", 1, 0.25, "2", "5")
    assert (got["c"]["semantic_type"], got["c"]["n_distinct"], got["c"]["samples"]) == ("category", 2, ["x", "y"])


CUSTOMERS = "code,customer_name,region\n" + "\n".join(f"C-{100 + i},Name {i},{'EW'[i % 2]}" for i in range(30))
ORDERS = "order_id,cust_ref,amount\n" + "\n".join(f"O-{i},C-{100 + i % 28},{i * 3.5}" for i in range(90))
NOISY = "pay_id,cust_code\n" + "\n".join(f"P{i},{[f' C-{100 + i % 27} ', f'c-{100 + i % 27}', f'C_{100 + i % 27}', f'c_{100 + i % 27}'][i % 4]}" for i in range(90))
WEATHER = "station,rain\n" + "\n".join(f"W-{i},{i}" for i in range(30))


def test_discovery(spark):
    tables = {n: infer.coerced(frame(spark, t)) for n, t in (("customers", CUSTOMERS), ("orders", ORDERS), ("noisy", NOISY), ("weather", WEATHER))}
    found = {(r["left_table"], r["left_columns"][0], r["right_table"], r["right_columns"][0]): r for r in relate.discovered(tables).collect()}
    assert ("customers", "code", "orders", "cust_ref") in found
    assert found["customers", "code", "noisy", "cust_code"]["projection"] == "alnum_only"
    assert found["customers", "code", "orders", "cust_ref"]["parent_side"] == "left"
    assert not any("weather" in k for k in found)


def test_composite_and_grain(spark):
    months = [f"2024-{m:02d}" for m in range(1, 13)]
    sales = spark.createDataFrame([(m, r, 1.0) for m in months for r in "NESW"], "month string, region string, revenue double")
    targets = spark.createDataFrame([(m, r, 2.0) for m in months for r in "news"], "month string, region string, target double")
    best = relate.best_composite(relate.composite(sales, targets, [("month", "month"), ("region", "region")])).first()
    assert (best["left_columns"], best["containment"], best["uniqueness"]) == (["month", "region"], 1.0, 1.0)
    days = spark.createDataFrame([(dt.datetime(2024, 1, 1) + dt.timedelta(days=i),) for i in range(366)], "d timestamp_ntz")
    budget = spark.createDataFrame([(dt.datetime(2024, m, 1),) for m in range(1, 13)], "m timestamp_ntz")
    got = {r["unit"]: r for r in relate.grain_keys(days, "d", budget, "m").collect()}
    assert (got["month"]["containment"], got["month"]["uniqueness"]) == (1.0, 1.0)


def test_graph(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcdef"], "node string")
    edges = spark.createDataFrame([("b", "a"), ("b", "c"), ("e", "d")], "a string, b string")
    assert {r["node"]: r["component"] for r in graph.components(nodes, edges).collect()} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "f": "f"}
    chain = spark.createDataFrame([("orders", "customer"), ("customer", "nation"), ("nation", "region")], "a string, b string")
    assert graph.join_path(chain, "region", "orders").first()["path"] == ["region", "nation", "customer", "orders"]
    assert graph.join_path(chain, "region", "nowhere").collect() == []


def test_relationship_edits_and_hints(spark):
    schema = "id string, left_table string, left_columns array<string>, right_table string, right_columns array<string>, kind string, containment double, name_similarity double, score double, parent_side string, evidence string, status string, projection string"
    one = ("r1", "a", ["x"], "b", ["y"], "fk", 1.0, 0.5, 0.8, "left", "", "proposed", "lower_trim")
    old = graph.decided(spark.createDataFrame([one], schema), "r1", "rejected")
    new = spark.createDataFrame([(*one[:8], 0.9, *one[9:]), ("r2", *one[1:])], schema)
    both = {r["id"]: r["status"] for r in graph.merged(old, new).collect()}
    assert both == {"r1": "rejected", "r2": "proposed"}
    assert graph.hints(new).first()["hint"] == "lower(trim(a.x)) = lower(trim(b.y)) (proposed, overlap 100%)"
    with pytest.raises(ValueError):
        graph.decided(new, "r1", "maybe")


def cells_of(spark, *grids):
    rows = [(f"f{k}", "", i, j, v) for k, grid in enumerate(grids) for i, line in enumerate(grid) for j, v in enumerate(line) if v]
    return spark.createDataFrame(rows, "file string, sheet string, row int, col int, value string")


def test_blocks(spark):
    two = [["id", "name", "qty"], *[[str(i), f"n{i}", str(i * 2)] for i in range(1, 5)], [], [], ["city", "rain"], ["Oslo", "3"], ["Rome", "4"], ["Bonn", "5"]]
    titled = [["Report 2024"], ["for the board"], [], ["month", "sales", "cost"], *[[f"2024-0{m}", str(m), str(m)] for m in range(1, 6)], ["Total", "", "15"], ["Source: ledger"]]
    bare = [[f"C-00{i}", f"2024-01-0{i}", f"{i}.50"] for i in range(1, 6)]
    long = blocks.tables(cells_of(spark, two, titled, bare)).persist()
    heads = {(r["file"], r["block"]): (r["header"], r["n"]) for r in long.groupBy("file", "block", "header").agg(F.count_distinct("row").alias("n")).collect()}
    assert heads == {("f0", 1): (0, 4), ("f0", 2): (7, 3), ("f1", 1): (3, 5), ("f2", 1): (-1, 5)}
    assert blocks.wide(long, "f1", None, 1).columns == ["row", "month", "sales", "cost"]
    assert blocks.wide(long, "f2", None, 1).columns == ["row", "col_1", "col_2", "col_3"]
    assert not any(r["is_totals"] for r in blocks.totals_blocks(long).collect())


def test_form(spark):
    grid = [["Part I"], ["1", "Wages and salaries", "52,000"], ["2", "Interest", "120.50"], ["Part II"], ["Filing status", "Single"], ["a)", "Tax", "due", "9,100"]]
    got = [tuple(r) for r in blocks.form_items(cells_of(spark, grid)).orderBy("row").select("section", "item", "value").collect()]
    assert got == [("Part I", "Wages and salaries", "52,000"), ("Part I", "Interest", "120.50"), ("Part II", "Filing status", "Single"), ("Part II", "Tax due", "9,100")]


def test_fuse(spark):
    a = spark.createDataFrame([(1, 2)], "x int, y int")
    b = spark.createDataFrame([("z", 2.5)], "x string, y double")
    c = spark.createDataFrame([(1,)], "other int")
    made_up = spark.createDataFrame([(1,)], "col_1 int")
    got = fuse.fused({"week_1": a, "week_2": b, "c": c, "p": made_up, "q": made_up})
    assert sorted(got) == ["c", "p", "q", "week"] and got["week"].dtypes == [("x", "string"), ("y", "double")] and got["week"].count() == 2


def test_bm25(spark):
    docs = spark.createDataFrame([(1, "orders of customers and amounts"), (2, "weather stations rain"), (3, "customer names")], "id int, text string")
    counts = bm25.term_counts(docs, "id", bm25.tokens(F.col("text")))
    asked = spark.createDataFrame([("customer",), ("amount",)], "term string")
    assert [r["doc"] for r in bm25.ranked(counts, 3, asked).collect()][0] == 1


def test_terms_of_words_as_rows(spark):
    texts = ["Orders, ORDERS of the custIDs 12ab İstanbul \u212aelvin Straße keys no. 007", "", None, "ADDRESSES cats bus Qty QTY the The"]
    docs = spark.createDataFrame([(i % 3, t) for i, t in enumerate(texts)], "id int, text string")
    assert [r[0] for r in docs.where("id = 0").select(F.explode(bm25.words(F.col("text")))).collect()][:4] == ["orders", "orders", "custids", "12"]
    plain = bm25.term_counts(docs, "id", bm25.tokens(F.col("text")))
    got = bm25.text_terms(docs, "id", F.col("text"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect())) and {"kelvin", "i", "stanbul"} <= {r["term"] for r in got.collect()}
    read = got._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in read


def test_ranked_leaves_other_terms_before_shuffles(spark):
    docs = spark.range(400).selectExpr("id", "concat('alpha', id % 3, ' word', id, ' license') AS text")
    plan = bm25.ranked(bm25.text_terms(docs, "id", F.col("text")), 400, spark.createDataFrame([("alpha1",), ("license",)], "term string"))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [term" in plan and "SortMergeJoin [term" not in plan


def test_equal_values_are_read_once(spark):
    df = spark.range(4000).selectExpr("concat(lpad(1 + id % 28, 2, '0'), '/', lpad(1 + id % 12, 2, '0'), '/2024') AS d", "concat(id % 7, ',', 10 + id % 30) AS x")
    plan = infer.inferred(df)
    read = plan._jdf.queryExecution().optimizedPlan().toString()
    assert read.count("Aggregate [") == 2
    got = {r["column_name"]: (r["target"], r["european"], r["pattern"]) for r in plan.collect()}
    assert got == {"d": ("timestamp", False, "d/M/yyyy"), "x": ("double", True, None)}
