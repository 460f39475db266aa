"""Discovery of all given tables against plain sets, and keys of several columns and of cut dates."""

import datetime as dt
import hashlib
import itertools
import re

import pytest
from pyspark.sql import functions as F

from gridloom import queries
from gridloom.functions.projections import rendered
from gridloom.operators import graph, profile, relate
from gridloom.plans import grounding, present, route
from gridloom.session import Session

PLAIN = {"raw": lambda v: v, "lower_trim": lambda v: v.strip(" ").lower(), "digits_only": lambda v: re.sub("[^0-9]", "", v), "alnum_only": lambda v: re.sub("[^a-z0-9]", "", v.strip(" ").lower())}


def plain_pair(p, values):
    """Best (containment, coverage, projection) of a candidate pair by sets."""
    left, right = values[p["left_table"], p["left_column"]], values[p["right_table"], p["right_column"]]

    def measure(kind):
        a, b = ([x for x in map(PLAIN[kind], side) if x] for side in (left, right))
        parent, child = (a, b) if p["left_ratio"] >= p["right_ratio"] else (b, a)
        both, held = set(a) & set(b), set(parent)
        return len(both) / max(1, min(len(set(a)), len(set(b)))), sum(x in held for x in child) / max(1, len(child)), kind

    best = measure("raw")
    retry = best[0] < 0.5 or (best[0] >= 0.75 and "id" in (p["left_type"], p["right_type"]) and best[1] < 0.95)
    for kind in p["tried"][1:] if retry else []:
        if best[0] >= 0.75 and best[1] >= 0.95:
            break
        now = measure(kind)
        if (now[1], now[0]) > (best[1], best[0]):
            best = now
    return best


def test_all_tables_by_plain_sets(spark, sf_dir):
    tables = {n: queries.table(spark, sf_dir, n) for n in queries.TABLES}
    found, decided = relate.measured(tables)
    asked = [r.asDict() for r in relate.pairs(found).collect()]
    values = {}
    for t, c in {(p[f"{s}_table"], p[f"{s}_column"]) for p in asked for s in ("left", "right")}:
        values[t, c] = [r[0] for r in tables[t].select(rendered(tables[t], c)).collect() if r[0] is not None]
    got = {(r["left_table"], r["left_column"], r["right_table"], r["right_column"]): r for r in decided.collect()}
    assert len(got) == len(asked)
    for p in asked:
        r = got[p["left_table"], p["left_column"], p["right_table"], p["right_column"]]
        containment, coverage, kind = plain_pair(p, values)
        assert (r["containment"], r["coverage"]) == (pytest.approx(containment), pytest.approx(coverage)), p
        assert r["projection"] == kind or (containment, coverage) == (0, 0), p
        assert r["score"] == pytest.approx(min(1, round(0.7 * containment + 0.3 * p["name_similarity"] + 0.1 * p["same_signature"], 4)), abs=2e-4)
    more = relate.joint_keys(tables, found, decided)
    whole = relate.edges(decided) if more is None else relate.edges(decided).unionByName(more)
    edges = whole.collect()
    single = {(r["left_table"], r["left_columns"][0], r["right_table"], r["right_columns"][0]) for r in edges if r["kind"] == "fk"}
    assert single == {k for k, r in got.items() if r["decision"] in ("accepted", "named")}
    for r in got.values():
        if r["decision"] == "accepted":
            assert r["containment"] >= 0.75 and max(r["left_ratio"], r["right_ratio"]) >= 0.95 and "id" in (r["left_type"], r["right_type"])
    # components of the edges, by merging sets
    groups = [{n} for n in tables]
    for r in edges:
        met = [g for g in groups if r["left_table"] in g or r["right_table"] in g]
        groups = [g for g in groups if g not in met] + [set().union(*met)]
    nodes = spark.createDataFrame([(n,) for n in tables], "node string")
    labels = {r["node"]: r["component"] for r in graph.components(nodes, whole.selectExpr("left_table AS a", "right_table AS b")).collect()}
    assert labels == {n: min(g) for g in groups for n in g}


def test_composite_keys_are_discovered(spark):
    months = [f"2024-{m:02d}" for m in range(1, 13)]
    sales = spark.createDataFrame([(m, r, float(i)) for i, (m, r) in enumerate((m, r) for m in months for r in ("North", "East", "South", "West"))], "month string, region string, revenue double")
    targets = spark.createDataFrame([(m, r, 2.5 * i) for i, (m, r) in enumerate((m, r) for m in months for r in ("north", "EAST", "South ", "West"))], "month string, region string, target double")
    (edge,) = [r for r in relate.discovered({"sales": sales, "targets": targets}).collect()]
    assert (edge["kind"], sorted(edge["left_columns"]), sorted(edge["right_columns"]), edge["containment"], edge["parent_side"]) == ("composite", ["month", "region"], ["month", "region"], 1.0, None)


def test_cut_dates_are_discovered(spark):
    days = spark.createDataFrame([(dt.datetime(2024, 1, 1) + dt.timedelta(days=i), float(i)) for i in range(366)], "order_date timestamp_ntz, amount double")
    budget = spark.createDataFrame([(dt.datetime(2024, m, 15), 10.5 * m) for m in range(1, 13)], "budget_month timestamp_ntz, budget double")
    one_month = days.where("order_date < '2024-02-01'")
    (edge,) = relate.discovered({"daily": days, "monthly": budget}).collect()
    assert (edge["kind"], edge["left_columns"], edge["right_columns"]) == ("derived", ["order_date__month"], ["budget_month__month"])
    assert not [r for r in relate.discovered({"march": one_month, "april": one_month.withColumnRenamed("order_date", "day")}).collect() if r["kind"] == "derived"]
    s = Session(spark)
    s.add_table("daily", days)
    s.add_table("monthly", budget)
    out = s.sql("SELECT count(*) AS n FROM daily d JOIN monthly m ON d.order_date__month = m.budget_month__month")
    assert out["rows"] == [{"n": 366}]


def test_a_persons_relationships_stay(spark):
    s = Session(spark)
    s.add_table("left_side", spark.createDataFrame([("a", 1), ("b", 2)], "x string, u int"))
    s.add_table("right_side", spark.createDataFrame([("A ", 3), ("c", 4)], "y string, v int"))
    id_ = s.add_relationship("left_side", ["x"], "right_side", ["y"])
    edge = s.relationships.where(F.col("id") == id_).first()
    assert (edge["status"], edge["score"], edge["containment"], edge["derivation"]) == ("confirmed", 1.0, 0.5, "user")
    s.add_table("third", spark.createDataFrame([(1,)], "w int"))
    assert id_ in [r["id"] for r in s.relationships.collect()]
    s.decide(id_, "rejected")
    s.add_table("fourth", spark.createDataFrame([(1,)], "z int"))
    assert {r["id"]: r["status"] for r in s.relationships.collect()}[id_] == "rejected"
    with pytest.raises(ValueError):
        s.add_relationship("left_side", ["nothing"], "right_side", ["y"])
    assert s.resolve("THIRD").columns == ["w"]
    with pytest.raises(KeyError):
        s.resolve("fifth")


@pytest.fixture(scope="module")
def shop(spark):
    s = Session(spark)
    s.add_table("customers", spark.createDataFrame([(f"C-{i}", f"Name {i}", ["North", "South"][i % 2]) for i in range(40)], "code string, customer_name string, region string"))
    s.add_table("orders", spark.createDataFrame([(f"O-{i}", f"C-{i % 40}", i * 1.5) for i in range(90)], "order_id string, cust_ref string, amount double"))
    s.add_table("weather", spark.createDataFrame([(f"W{i}", i * 0.25) for i in range(30)], "station string, rain_mm double"))
    return s


def test_routes(shop):
    asked = shop.route("What is the order amount?")
    assert asked.retrieved[0] == "orders" and asked.matched["orders"] == ["order", "amount"] and "weather" not in asked.retrieved
    assert shop.route("revenue in the North").retrieved == ["customers"]
    assert shop.route("which files are uploaded").retrieved == ["schema_columns", "schema_tables"]
    nothing = shop.route("zebra")
    assert nothing.retrieved == ["customers", "orders"] and set(nothing.scores.values()) == {0.0}
    confirmed = shop.relationships.where("left_table = 'customers' AND right_table = 'orders'").first()
    shop.decide(confirmed["id"], "confirmed")
    assert shop.route("order amount").expanded == ["customers"]


def test_names_that_the_data_lacks(spark, shop):
    known = ["orders", "order_id", "cust_ref", "amount", "region"]
    assert grounding.ungrounded(spark, "SELECT cust_ref AS customer, sum(amount) AS profit, count(*) AS widgets FROM orders GROUP BY 1", known) == {"profit": "amount"}
    assert grounding.ungrounded(spark, "WITH x AS (SELECT 1 AS a) SELECT amount AS total_amount FROM orders ORDER BY amount LIMIT 3", known) == {}
    assert grounding.caveat({}) == "" and "profit shows amount" in grounding.caveat({"profit": "amount"})
    out = shop.sql("SELECT region, sum(amount) AS profit FROM orders JOIN customers ON cust_ref = code GROUP BY region ORDER BY region")
    assert "profit shows amount" in out["caveat"] and out["chart"]["kind"] == "bar" and "North" in out["summary"]


def test_descriptions():
    assert present.describe(["n"], []) == "No rows."
    assert present.describe(["total_sales"], [{"total_sales": 1234.5}]) == "total sales: 1,234.5."
    assert present.describe(["k", "v"], [{"k": "a", "v": 1}, {"k": "b", "v": None}, {"k": "c", "v": 3}], True) == "3 or more rows; v from nothing (b) to 3 (c)."
    assert present.describe(["k"], [{"k": str(i)} for i in range(7)]) == "7 rows: 0, 1, 2, 3, 4 and 2 others."
    assert present.describe(["a", "b"], [{"a": 1, "b": 2}] * 2) == "2 rows of a, b."


def test_kept_by_terms(spark):
    profiles = spark.createDataFrame([("t", "cust_id", "id", ["C-1"], ["customer", "identifier"]), ("t", "region", "category", ["North", "South"], ["region"])], "table_name string, column_name string, semantic_type string, samples array<string>, name_tokens array<string>")
    terms = [r["term"] for r in route.table_terms(profiles, {"t": ("file_a.csv", "Sheet9")}).where("doc = 't'").collect()]
    assert sorted(terms) == sorted(["t"] * 3 + ["file", "csv", "sheet9"] + ["customer", "identifier"] * 2 + ["region"] * 2 + ["north", "south"])


def test_rediscovery_drops_tables_that_are_gone(spark):
    schema = "id string, left_table string, right_table string, status string, derivation string"
    old = spark.createDataFrame([("1", "a", "b", "rejected", "statistics"), ("2", "a", "gone", "confirmed", "user"), ("3", "a", "b", "confirmed", "user")], schema)
    new = spark.createDataFrame([("1", "a", "b", "proposed", "statistics"), ("4", "a", "b", "proposed", "statistics")], schema)
    assert {r["id"]: r["status"] for r in graph.rediscovered(old, new, ["a", "b"]).collect()} == {"1": "rejected", "4": "proposed", "3": "confirmed"}


def test_sets_of_columns_are_counted_once(spark, monkeypatch):
    """Keys of a set of columns are held once, however many tuples it is in, and beyond 62 sets too."""
    rows = [(i % 3, i % 4, f"{i % 5}" if i % 7 else None) for i in range(60)]
    left, right = (spark.createDataFrame(r, "a int, b int, c string") for r in (rows, rows[:17]))
    sides = [(x, y) for x in "abc" for y in "abc" if x != y] + [(x,) for x in "abc"]
    tried = [relate.Tuples("left", l, "right", r) for l in sides for r in sides if len(l) == len(r)] * 2
    held = []
    monkeypatch.setattr(relate, "written", lambda df, name: held.append(df) or df)
    monkeypatch.setattr(relate, "WORD", 4)
    got = {r["tried"]: r for r in relate.tuple_measures({"left": left, "right": right}, tried).collect()}
    assert held[0].select("spec").distinct().count() == 2 * len(sides)

    def keys(rows, columns):
        values = [tuple(row["abc".index(c)] for c in columns) for row in rows]
        return [tuple(map(str, v)) for v in values if None not in v]

    for i, t in enumerate(tried):
        a, b = keys(rows, t.left_columns), keys(rows[:17], t.right_columns)
        assert [got[i][x] for x in ("a", "b", "shared", "rows_a", "rows_b", "all_a", "all_b")] == [len(set(a)), len(set(b)), len(set(a) & set(b)), len(a), len(b), 60, 17], t


def test_tuples_that_cannot_be_keys_are_not_read():
    column = lambda n, rows, blank=0: {"n_distinct": n, "n_rows": rows, "n_null": 0, "n_blank": blank}
    few = {("l", "a"): column(3, 100), ("l", "b"): column(4, 100), ("r", "a"): column(5, 100), ("r", "b"): column(20, 100)}
    assert relate._may_be_unique(relate.Tuples("l", ("a", "b"), "r", ("a", "b")), few)
    few["r", "b"] = column(18, 100)
    assert not relate._may_be_unique(relate.Tuples("l", ("a", "b"), "r", ("a", "b")), few)
    few["r", "a"] = column(5, 100, 10)
    assert relate._may_be_unique(relate.Tuples("l", ("a", "b"), "r", ("a", "b")), few)
    assert not relate._may_be_unique(relate.Tuples("l", ("a",), "r", ("a",), "month"), few)


def test_long_texts_are_counted_without_their_text(spark):
    """Profiles and pairs of texts that are counted by their digests, as of plain values."""
    long = [f" Text {i} " + "and some more words " * 20 for i in range(6)]
    digits, blank = ["7" * 300, "8" * 300, "9" * 300], " " * 200
    rows = [(v, d) for v, d in zip([*long, long[0], None, "short", blank], [*digits, *digits, *digits, None], strict=True)]
    left = spark.createDataFrame(rows, "story string, number string").coalesce(1)
    counts = profile.value_counts({"l": left})
    shuffled = [r for r in counts.collect() if r["n"]]
    assert sum(r["n"] for r in shuffled) == 20 and max(len(v) for r in shuffled for v in (r["text"], r["head"]) if v) <= profile.LONG
    got = {r["column_name"]: r for r in profile.profiles({"l": left}).collect()}
    story, number = got["story"], got["number"]
    assert (story["n_rows"], story["n_distinct"], story["n_null"], story["n_blank"]) == (10, 8, 1, 1)
    assert (story["min_value"], story["max_value"], story["samples"]) == (blank, "short", [x[:40] for x in long[:5]])
    assert (number["min_value"], number["max_value"], number["n_distinct"], number["regex_signature"]) == (digits[0], digits[2], 3, r"^\d{300}$")


def test_long_texts_meet(spark):
    long = [f" Text {i} " + "and some more words " * 20 for i in range(30)]
    left = spark.createDataFrame([(v, v.lower()) for v in long], "id string, other string")
    right = spark.createDataFrame([(v.strip().lower(), hashlib.sha256(v.encode()).hexdigest()) for v in long[:20]], "id string, digest string")
    _, decided = relate.measured({"left_side": left, "right_side": right})
    got = {(r["left_column"], r["right_column"]): (r["projection"], r["containment"], r["numeric_values"]) for r in decided.collect()}
    assert got["id", "id"] == ("lower_trim", 1.0, False) and got["id", "digest"][1] == 0 == got["other", "digest"][1]
    numbers = relate.values({"x": spark.createDataFrame([("1" * 90,), ("a" * 90,), ("12",), ("b",)], "v string")}).where("projection = 'raw'")
    assert sorted(r[0] for r in numbers.select(relate.is_number(F.col("value"))).collect()) == [False, False, True, True]
    assert max(len(r["value"]) for r in numbers.collect()) <= relate.KEY + 1


def plain_composites(tables, found, decided):
    """Of each pair of tables the best of all tuples, if its names are alike, by sets."""
    pairs = [r.asDict() for r in decided.where("containment >= 0.2").collect()]
    counted = {(r["table_name"], r["column_name"]): r.asDict() for r in found.collect()}
    rows = {n: df.collect() for n, df in tables.items()}
    out = set()
    for l, r in itertools.combinations(tables, 2):
        own = sorted((p for p in pairs if (p["left_table"], p["right_table"]) == (l, r)), key=lambda p: (-p["containment"], p["left_column"], p["right_column"]))
        good = []
        for i, t in enumerate(relate.combos(l, r, [(p["left_column"], p["right_column"]) for p in own])):
            a, b = ([tuple(str(row[c]).strip().lower() for c in cs) for row in rows[n]] for n, cs in ((l, t.left_columns), (r, t.right_columns)))
            contained = len(set(a) & set(b)) / min(len(set(a)), len(set(b)))
            if contained >= 0.8 and max(len(set(x)) / len(x) for x in (a, b)) >= 0.95 and relate._may_be_unique(t, counted):
                good.append((len(t.left_columns), -contained, i, t))
        if good:
            t = min(good)[3]
            names = {(p["left_column"], p["right_column"]): p["name_similarity"] for p in own}
            if min(names[x] for x in zip(t.left_columns, t.right_columns, strict=True)) >= 0.5:
                out.add((l, t.left_columns, r, t.right_columns))
    return out


def test_tuples_that_decide_nothing_are_not_tried(spark, monkeypatch):
    cells = [(m, r) for m in ("jan", "feb", "mar", "apr", "may", "jun") for r in ("north", "east", "south", "west")]
    named = spark.createDataFrame([(*c, i * 0.5) for i, c in enumerate(cells)], "month string, region string, x double")
    alike = spark.createDataFrame([(c[0], c[1].upper(), i * 0.25 + 100) for i, c in enumerate(cells)], "month string, region string, y double")
    unlike = spark.createDataFrame([(*c, i * 0.75 + 900) for i, c in enumerate(cells)], "period string, area string, z double")
    # the tuple of unlike names (first, second) is the better one
    rival = spark.createDataFrame([(*c, *(cells[i] if i < 22 else ("none", str(i)))) for i, c in enumerate(cells)], "first string, second string, month string, region string")
    tables = {"named": named, "alike": alike, "unlike": unlike, "rival": rival}
    tried, measures = [], relate.tuple_measures
    monkeypatch.setattr(relate, "tuple_measures", lambda ts, t: (tried.append(t), measures(ts, t))[1])
    monkeypatch.setattr(relate, "BATCH", 100)
    found, decided = relate.measured(tables)
    more = relate.joint_keys(tables, found, decided)
    got = set() if more is None else {(r["left_table"], tuple(r["left_columns"]), r["right_table"], tuple(r["right_columns"])) for r in more.collect() if r["kind"] == "composite"}
    assert got == plain_composites(tables, found, decided) and ("named", "alike") in {(x[0], x[2]) for x in got} and ("named", "rival") not in {(x[0], x[2]) for x in got}
    assert all({t.left, t.right} != {"named", "unlike"} for batch in tried for t in batch)
    assert max(24 * len({s for t in batch for s in ((t.left, t.left_columns), (t.right, t.right_columns))}) for batch in tried) <= 100
