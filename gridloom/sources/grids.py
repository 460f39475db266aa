"""Spreadsheet files as one long table of cells, read by tasks from any store that Spark opens.

CSV files are decoded, their delimiter sniffed, and parsed with quotes; Excel workbooks are read from
their XML parts.  A file is one task's work, up to ``max_mb``.
"""

from __future__ import annotations

import codecs
import csv
import io
import re
import unicodedata
import zipfile
from collections import Counter
from collections.abc import Iterator
from datetime import datetime, timedelta
from functools import lru_cache
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_MB = 100
#: Bytes of a file from which its encoding is guessed, and guesses that are held against each other.
SNIFFED, GUESSES = 1 << 16, 8
DELIMITERS = ",;\t|"
SCHEMA = "file string, sheet string, row int, col int, value string"
BOMS = ((codecs.BOM_UTF32_BE, "utf-32"), (codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_BE, "utf-16"), (codecs.BOM_UTF16_LE, "utf-16"))


class Unreadable(ValueError):
    pass


def decoded(data: bytes) -> str:
    """Text of bytes: by mark, by the places of zero bytes, as UTF-8, else by the most coherent script of a detector's guesses."""
    for mark, name in BOMS:
        if data.startswith(mark):
            return data.decode(name)
    head = data[:4096]
    odd, even = head[1::2].count(0), head[::2].count(0)
    if odd + even > len(head) / 4 and odd != even:
        return data.decode("utf-16-le" if odd > even else "utf-16-be")
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        pass
    if (likely := _by_script(data)) is not None:
        try:
            return data.decode(likely)
        except (UnicodeDecodeError, LookupError):
            pass
    try:
        return data.decode("cp1252")
    except UnicodeDecodeError:
        return data.decode("latin-1")


@lru_cache(maxsize=4096)
def _script(letter: str) -> str:
    return unicodedata.name(letter, "?").split()[0]


def coherence(text: str) -> float:
    """The part of words whose letters are of one script and among which no symbol stands."""
    words = [w for w in text.split() if any(map(str.isalpha, w))]
    whole = sum(len({_script(c) for c in w if c.isalpha()}) == 1 and not any(unicodedata.category(c)[0] == "S" for c in w) for w in words)
    return whole / len(words) if words else 0.0


def _by_script(data: bytes) -> str | None:
    """The most coherent of a detector's first guesses, if what it gives is mostly not Latin."""
    try:
        from charset_normalizer import from_bytes
    except ImportError:
        return None
    best, encoding = 0.0, None
    for guess in list(from_bytes(data[:SNIFFED]))[:GUESSES]:
        text = str(guess)
        if sum(c.isalpha() and c > "\u0370" for c in text) > 0.3 * sum(map(str.isalpha, text)) and (own := coherence(text)) > best:
            best, encoding = own, guess.encoding
    return encoding


def delimiter(text: str) -> str:
    try:
        return csv.Sniffer().sniff(text[:16_384], DELIMITERS).delimiter
    except csv.Error:
        counts = Counter(c for c in text[:16_384] if c in DELIMITERS)
        return max(DELIMITERS, key=lambda d: (counts[d], d == ","))


def csv_cells(data: bytes) -> Iterator[tuple[None, int, int, str]]:
    text = decoded(data)
    if "\n" not in text:
        text = text.replace("\r", "\n")
    csv.field_size_limit(MAX_MB << 20)
    try:
        for i, cells in enumerate(csv.reader(io.StringIO(text, newline=""), delimiter=delimiter(text), strict=False)):
            for j, cell in enumerate(cells):
                if cell.strip():
                    yield None, i, j, cell.strip()
    except csv.Error as e:
        raise Unreadable(str(e)) from e


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_BUILT_IN_DATES = {*range(14, 23), *range(45, 48)}


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {int(x.get("numFmtId")): re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", x.get("formatCode", "")) for x in root.iterfind("m:numFmts/m:numFmt", _NS)}
    dates = _BUILT_IN_DATES | {i for i, code in own.items() if re.search("[ymdhs]", code, re.I)}
    return {i for i, x in enumerate(root.iterfind("m:cellXfs/m:xf", _NS)) if int(x.get("numFmtId", 0)) in dates}


def _cell(c: ElementTree.Element, shared: list[str], dates: set[int]) -> str:
    kind, v = c.get("t", "n"), c.findtext("m:v", "", _NS)
    if kind == "inlineStr":
        return "".join(x.text or "" for x in c.iterfind(".//m:t", _NS))
    if kind == "s":
        return shared[int(v)] if v else ""
    if kind == "b":
        return "true" if v == "1" else "false"
    if kind in ("str", "e") or not v:
        return v
    number = float(v)
    if int(c.get("s", 0)) in dates:
        return str(datetime(1899, 12, 30) + timedelta(seconds=round(number * 86_400)))
    return str(int(number)) if number == int(number) and abs(number) < 1e15 else repr(number)


def xlsx_cells(data: bytes) -> Iterator[tuple[str, int, int, str]]:
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as book:
            shared = []
            if "xl/sharedStrings.xml" in book.namelist():
                shared = ["".join(t.text or "" for t in x.iterfind(".//m:t", _NS)) for x in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iterfind("m:si", _NS)]
            dates = _date_styles(book)
            targets = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
            sheets = list(ElementTree.fromstring(book.read("xl/workbook.xml")).iterfind("m:sheets/m:sheet", _NS))
            if not sheets:
                raise Unreadable("a workbook without sheets")
            for sheet in sheets:
                target = targets[sheet.get(_REL)]
                root = ElementTree.fromstring(book.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
                for i, row in enumerate(root.iterfind("m:sheetData/m:row", _NS)):
                    for j, c in enumerate(row.iterfind("m:c", _NS)):
                        letters, number = re.match(r"([A-Z]*)(\d*)", c.get("r", "")).groups()
                        at = int(number) - 1 if number else i
                        col = sum((ord(x) - 64) * 26**k for k, x in enumerate(reversed(letters))) - 1 if letters else j
                        if text := _cell(c, shared, dates).strip():
                            yield sheet.get("name"), at, col, text
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, ValueError) as e:
        raise e if isinstance(e, Unreadable) else Unreadable(f"not a workbook: {e}") from e


def cells_of(path: str, data: bytes, max_mb: int = MAX_MB) -> Iterator[tuple[str | None, int, int, str]]:
    if len(data) > max_mb << 20:
        raise Unreadable(f"{path}: over {max_mb} MB")
    name = path.lower().rsplit("/", 1)[-1]
    excel = name.endswith((".xlsx", ".xlsm", ".xltx", ".xltm")) or (not name.endswith((".csv", ".tsv", ".txt")) and data[:2] == b"PK")
    return xlsx_cells(data) if excel else csv_cells(data)


def read_cells(spark: SparkSession, *paths: str, max_mb: int = MAX_MB) -> DataFrame:
    """(file, sheet, row, col, value) of all non-empty cells of the files or folders; sheet is null for CSV."""
    return cells(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths)).select("path", "content"), max_mb)


def cells(files: DataFrame, max_mb: int = MAX_MB) -> DataFrame:
    """The same of a table (path, content), batch or streaming."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b["path"].to_pylist(), b["content"], strict=True):
                name, rows = path.rsplit("/", 1)[-1], []
                for row in cells_of(path, content.as_py(), max_mb):
                    rows.append((name, *row))
                    if len(rows) >= 50_000:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    return files.select(F.col("path"), F.col("content")).mapInArrow(over, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["file", "sheet", "row", "col", "value"])
