"""Sheets of the kinds that uploads hold: header bands, stray empty rows, details beside tables, forms."""

import pytest
from pyspark.sql import functions as F

from gridloom.operators import blocks

from test_operators import cells_of

GRIDS = {
    "banded": [["Room", "Room", "Finishes", "Finishes"], ["No", "Name", "Floor", "Wall"], ["10", "Hall", "Tile", "Paint"], ["11", "Bath", "Stone", "Tile"], ["12", "Den", "Wood", "Paint"]],
    "merged": [["Name", None, "Period", None], ["First", "Pay", "From", "To"], ["1", "2", "3", "4"], ["Ann", "900", "2024-01-01", "2024-02-01"], ["Bo", "800", "2024-01-09", "2024-03-01"], ["Cy", "700", "2024-02-01", "2024-02-11"]],
    "numbers": [["a", "b", "c"], ["1", "2", "3"], ["4", "5", "6"], ["7", "8", "9"]],
    "gap": [["id", "name"], ["1", "A"], [], ["2", "B"], ["3", "C"]],
    "split_header": [["Official", "Official", "Matrix"], [], ["Name", "Rank", "Pay"], ["Ann", "IX", "900"], ["Bo", "X", "800"], ["Cy", "XI", "700"]],
    "invoice": [["Invoice No:", "INV-7"], [], ["item", "qty", "price"], ["pen", "2", "3.5"], ["ink", "1", "9"], ["pad", "4", "2"], [], ["Subtotal", "26"], ["GST", "2"], ["Total", "28"]],
    "two": [["id", "name", "qty"], *[[str(i), f"n{i}", str(i * 2)] for i in range(1, 5)], [], [], ["city", "rain"], ["Oslo", "3"], ["Rome", "4"], ["Bonn", "5"]],
    "text": [["city", "land"], ["Oslo", "Norway"], ["Rome", "Italy"], ["Bonn", "Germany"]],
    "form": [["Part I"], *[[f"The amount of kind {i}", *[None] * (i % 9), str(i * 100)] for i in range(1, 31)]],
}


@pytest.fixture(scope="module")
def found(spark):
    names = list(GRIDS)
    long = blocks.sheets(cells_of(spark, *GRIDS.values()))
    rows = long.groupBy("file", "role", "block", "header", "row").agg(F.array_sort(F.collect_list(F.struct("col", "column_name", "value"))).alias("c")).collect()
    out = {}
    for r in sorted(rows, key=lambda r: r["row"]):
        out.setdefault(names[int(r["file"][1:])], {}).setdefault((r["role"], r["block"], r["header"]), []).append({c["column_name"]: c["value"] for c in r["c"]})
    return out


def test_repeated_group_labels(found):
    assert found["banded"] == {("table", 1, 0): [{"room_no": a, "room_name": b, "finishes_floor": c, "finishes_wall": d} for a, b, c, d in GRIDS["banded"][2:]]}


def test_labels_over_some_columns_and_a_row_of_numbers(found):
    assert found["merged"] == {("table", 1, 0): [{"name_first": a, "pay": b, "period_from": c, "to": d} for a, b, c, d in GRIDS["merged"][3:]]}


def test_counting_data_is_no_header(found):
    assert len(found["numbers"]["table", 1, 0]) == 3
    assert len(found["text"]["table", 1, 0]) == 3


def test_an_empty_row_inside_a_table(found):
    assert found["gap"] == {("table", 1, 0): [{"id": "1", "name": "A"}, {"id": "2", "name": "B"}, {"id": "3", "name": "C"}]}


def test_an_empty_row_inside_a_header(found):
    assert found["split_header"] == {("table", 1, 0): [{"official_name": "Ann", "official_rank": "IX", "matrix_pay": "900"}, {"official_name": "Bo", "official_rank": "X", "matrix_pay": "800"}, {"official_name": "Cy", "official_rank": "XI", "matrix_pay": "700"}]}


def test_details_beside_a_table(found):
    assert [r["item"] for r in found["invoice"]["table", 1, 2]] == ["pen", "ink", "pad"]
    assert found["invoice"]["details", 0, -1] == [{"section": "", "item": i, "value": v} for i, v in (("Invoice No", "INV-7"), ("Subtotal", "26"), ("GST", "2"), ("Total", "28"))]


def test_two_tables_stay_two(found):
    assert {k: len(v) for k, v in found["two"].items()} == {("table", 1, 0): 4, ("table", 2, 7): 3}


def test_a_form_is_one_table(found):
    ((key, rows),) = found["form"].items()
    assert key == ("form", 0, -1)
    assert rows == [{"section": "Part I", "item": f"The amount of kind {i}", "value": str(i * 100)} for i in range(1, 31)]


def plain_lines(grid):
    import re

    figure, short, ordinal = re.compile(r"^[\s₹$£€]*-?[\d,]+(\.\d+)?\s*%?$"), re.compile(r"^[A-Za-z0-9][\w./@-]{0,30}$", re.ASCII), re.compile(r"(\d{1,3}|[a-zA-Z]|[ivxIVX]{1,4})")
    section, out = "", []
    for row in sorted(grid):
        cells = [v for _, v in sorted(grid[row].items())]
        is_ordinal = [bool(ordinal.fullmatch(c.strip("()[]. "))) for c in cells]
        if len(cells) == 1:
            if not figure.match(cells[0]) and len(cells[0]) <= 90:
                section = cells[0]
            continue
        if len(cells) == 2 and is_ordinal[0] and not figure.match(cells[1]):
            section = cells[1][:90]
            continue
        at = next((i for i in range(len(cells) - 1, 0, -1) if figure.match(cells[i]) or short.match(cells[i])), len(cells) - 1)
        item = " ".join(c for c, o in zip(cells[:at], is_ordinal, strict=False) if not o and not figure.match(c)).strip(" :.-")
        if item:
            out.append((row, section, item[:90], cells[at]))
    return out


def test_form_lines_of_documents(spark, sf_dir):
    from gridloom import queries

    grids = {}
    for r in queries._lines(spark, sf_dir).where("value <> ''").collect():
        grids.setdefault(r["file"], {}).setdefault(r["row"], {})[r["col"]] = r["value"]
    want = sorted((f, *line) for f, grid in grids.items() for line in plain_lines(grid))
    got = sorted((r["file"], r["row"], r["section"], r["item"], r["value"]) for r in queries.forms_in_documents(spark, sf_dir).collect())
    assert got == want


def test_cuts_of_blocks(spark):
    grid = [["a", "b"], ["1", "2"], ["3", "4"], [], ["x", "y", "", "p", "q"], ["5", "6", "", "7", "8"], ["9", "1", "", "2", "3"]]
    found = blocks.extended(blocks.regions(cells_of(spark, grid))).persist()
    assert sorted(tuple(r)[2:] for r in blocks.extents(found).drop("region").withColumn("k", F.lit(1)).select("file", "sheet", *blocks.EXTENT).collect()) == [(0, 2, 0, 1, 6), (4, 6, 0, 1, 6), (4, 6, 3, 4, 6)]
    plan = blocks.header_rows(found)._jdf.queryExecution().optimizedPlan().toString()
    # rows below a header are not joined with it one by one
    assert plan.count("Join ") == 1
