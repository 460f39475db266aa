import codecs
import io
import zipfile

import pytest

from gridloom.session import Session
from gridloom.sources import grids


@pytest.mark.parametrize("name", ["utf-8", "utf-8-sig", "utf-16", "utf-16-le", "utf-16-be", "utf-32", "cp1252"])
def test_encodings(name):
    text = "city,population\nZürich,400\nMálaga,500\n"
    assert grids.decoded(text.encode(name)) == text


CITIES = {
    "cp1251": "город,население\nМосква,13000\nКазань,1300\nСамара,1100\nУфа,1100\nПермь,1000\nВоронеж,1000\n" * 4,
    "shift_jis": "都市,人口\n東京,13000\n大阪,2700\n名古屋,2300\n札幌,1900\n" * 8,
    "euc_kr": "도시,인구\n서울,9400\n부산,3300\n대구,2300\n인천,2900\n" * 8,
    "cp1253": "πόλη,πληθυσμός\nΑθήνα,3000\nΠάτρα,170\nΛάρισα,150\nΒόλος,140\n" * 8,
}


@pytest.mark.parametrize("name", CITIES)
def test_other_scripts(name):
    pytest.importorskip("charset_normalizer")
    assert grids.decoded(CITIES[name].encode(name)) == CITIES[name]


def test_coherence():
    assert grids.coherence("Москва Казань 12") == 1.0
    assert grids.coherence("Моsква ab™c word") == pytest.approx(1 / 3)
    assert grids.coherence("12 34") == 0.0


def test_marks_do_not_stay():
    assert grids.decoded(codecs.BOM_UTF16_BE + "a,b".encode("utf-16-be")) == "a,b"


@pytest.mark.parametrize(("data", "want"), [(b"a;b\n1,5;2\n", [["a", "b"], ["1,5", "2"]]), (b"a\tb\n1\t2\n", [["a", "b"], ["1", "2"]]), (b'a,b\n"x,\ny","q""q"\n', [["a", "b"], ["x,\ny", 'q"q']]), (b"a,b\r1,2\r", [["a", "b"], ["1", "2"]])])
def test_dialects(data, want):
    got = {}
    for _, i, j, v in grids.csv_cells(data):
        got[i, j] = v
    assert got == {(i, j): v for i, row in enumerate(want) for j, v in enumerate(row)}


def workbook(sheets, styles="", shared=()):
    out = io.BytesIO()
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        z.writestr("xl/styles.xml", f"<styleSheet {ns}>{styles}</styleSheet>")
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><t>{s}</t></si>" for s in shared) + "</sst>")
        for i, body in enumerate(sheets.values(), 1):
            z.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")
    return out.getvalue()


def test_workbook():
    styles = '<numFmts><numFmt numFmtId="164" formatCode="yyyy-mm-dd"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/></cellXfs>'
    body = '<row r="2"><c r="B2" t="s"><v>0</v></c><c r="C2" t="b"><v>1</v></c><c r="D2" s="1"><v>45292</v></c></row><row r="3"><c r="B3"><v>3.0</v></c><c r="C3" t="inlineStr"><is><t>in</t></is></c><c r="D3" t="e"><v>#N/A</v></c></row>'
    got = list(grids.cells_of("a.xlsx", workbook({"One": body, "Two": ""}, styles, ["shared"])))
    assert got == [("One", 1, 1, "shared"), ("One", 1, 2, "true"), ("One", 1, 3, "2024-01-01 00:00:00"), ("One", 2, 1, "3"), ("One", 2, 2, "in"), ("One", 2, 3, "#N/A")]


def test_unreadable():
    with pytest.raises(grids.Unreadable):
        list(grids.cells_of("a.xlsx", b"PKnot a workbook"))
    with pytest.raises(grids.Unreadable):
        list(grids.cells_of("a.csv", b"x" * (2 << 20), max_mb=1))


def test_session(spark, tmp_path):
    (tmp_path / "customers.csv").write_text("code,customer_name,region\n" + "\n".join(f"C-{100 + i},Name {i},{['East', 'West'][i % 2]}" for i in range(30)))
    (tmp_path / "orders.csv").write_text("Order report\n\norder_id;cust_ref;amount\n".replace(";", ",") + "\n".join(f"O-{i},C-{100 + i % 28},{i}.5" for i in range(60)) + "\nTotal,,1800\n")
    for k in (1, 2):
        (tmp_path / f"week_{k}.csv").write_text("station,rain_mm\n" + "\n".join(f"W{k}{i},{i}" for i in range(9)))
    s = Session(spark)
    assert sorted(s.add_files(str(tmp_path))) == ["customers", "orders", "week"]
    assert s.tables["orders"].dtypes == [("order_id", "string"), ("cust_ref", "string"), ("amount", "double")]
    out = s.sql("SELECT region, sum(amount) AS total FROM orders JOIN customers ON cust_ref = code GROUP BY region ORDER BY region")
    assert [r["region"] for r in out["rows"]] == ["East", "West"] and out["chart"]["kind"] == "bar"
    assert sum(r["total"] for r in out["rows"]) == sum(i + 0.5 for i in range(60))
    assert s.sql("SELECT n_rows FROM schema_tables WHERE table_name = 'week'")["rows"] == [{"n_rows": 18}]
    assert {r["node"]: r["component"] for r in s.components().collect()} == {"customers": "customers", "orders": "customers", "week": "week"}
    edge = s.relationships.first()["id"]
    s.decide(edge, "rejected")
    assert len({r["component"] for r in s.components().collect()}) == 3
