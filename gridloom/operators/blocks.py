"""Tables inside sheets, found on a long table of cells (file, sheet, row, col, value).

Every step is a window or a grouping within a sheet's regions, so sheets spread over tasks, and the cells
of one large sheet sort and spill like any others.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cells import kind
from ..functions.names import safe_name
from ..sources.store import written

HEADER_SCAN, ROWS_BELOW, SAMPLE_ROWS, LEAST_SCORE = 8, 2, 50, 2
#: Rows that a header can take above and below its best one.
BAND_UP, BAND_DOWN = 3, 2
LEAST_ROWS, LEAST_CELLS = 2, 3
SUBSTANTIAL_ROWS, FRAGMENT_ROWS, FORM_ROWS = 3, 2, 6
# What trailing and totals rows start with.
JUNK = r"(?i)^(total|grand total|subtotal|sum|note|source|footnote)\b"
TOTALS = r"(?i)^(sub\s*total|total|grand\s*total|net|gross|balance|c?gst|sgst|igst|vat|tax|discount|freight|round\s*off|amount\s+in\s+words)\b"
TOTALS_SHARE = 0.6
SHEET = ("file", "sheet")
REGION = (*SHEET, "region")
#: A region's first and last row and column, and its cells; columns of every cell in it.
EXTENT = ("top", "bottom", "left", "right", "cells")
#: Kinds as bits.
BITS = {"empty": 8, "text": 4, "number": 2, "date": 1}
#: Rounds of cutting by empty rows, then by empty columns; a cut is a row's and a column's, so six deep.
ROUNDS = 3


def _islands(cells: DataFrame, axis: str) -> DataFrame:
    """cells with their region split wherever the axis has a gap: what a place is ahead of its rank is the same on an island only."""
    ahead = F.col(axis) + 1 - F.dense_rank().over(Window.partitionBy(*REGION).orderBy(axis))
    return cells.withColumn("region", F.concat("region", F.lit("."), F.lpad(ahead.cast("string"), 10, "0")))


def regions(cells: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Non-empty cells with the region that cuts along empty rows and columns leave them in."""
    out = cells.where(F.col("value").isNotNull() & (F.trim("value") != "")).withColumns({"sheet": F.coalesce("sheet", F.lit("")), "region": F.lit("")})
    # a sheet's cells stay together through all cuts
    out = out.repartition("file", "sheet")
    for _ in range(rounds):
        out = _islands(_islands(out, "row"), "col")
    return out


def extended(found: DataFrame) -> DataFrame:
    """Cells with their region's extent."""
    own = Window.partitionBy(*REGION)
    return found.withColumns({"top": F.min("row").over(own), "bottom": F.max("row").over(own), "left": F.min("col").over(own), "right": F.max("col").over(own), "cells": F.count(F.lit(1)).over(own)})


def viable(found: DataFrame) -> DataFrame:
    """The cells of regions of at least two rows and three cells."""
    return found.where((F.col("bottom") - F.col("top") + 1 >= LEAST_ROWS) & (F.col("cells") >= LEAST_CELLS))


def row_facts(found: DataFrame) -> DataFrame:
    """(region, extent, row, cols, values, populated, words, different, wordy, label, doubled, numbering) of rows of cells.

    wordy: seven in ten are no figures; label: wordy and none ends with a colon; doubled: a value stands twice side by
    side; numbering: counts up from 1 or 2 in steps of 2 at most.
    """
    facts = found.groupBy(*REGION, *EXTENT, "row").agg(
        F.sort_array(F.collect_list(F.struct("col", "value"))).alias("line"),
        F.count(F.lit(1)).alias("populated"),
        F.count_if(kind(F.trim("value")) == "text").alias("words"),
        F.bool_or(F.trim("value").endswith(":")).alias("colon"),
    )
    facts = facts.withColumn("low", F.when(F.col("populated") > 1, F.transform("line", lambda c: F.lower(F.trim(c["value"])))))
    beside = F.zip_with(F.slice("line", 2, F.size("line")), F.slice("line", 1, F.size("line") - 1), lambda c, before: c["col"] == before["col"] + 1)
    twice = F.zip_with(F.slice("low", 2, F.size("low")), F.slice("low", 1, F.size("low") - 1), lambda v, before: v == before)
    doubled = (F.col("populated") > 1) & F.exists(F.zip_with(beside, twice, lambda a, b: a & b), lambda x: x)
    facts = facts.withColumns({"doubled": doubled, "different": F.when(F.col("populated") > 1, F.size(F.array_distinct("low"))).otherwise(1)})
    values = F.transform("line", lambda c: c["value"])
    numbers = F.transform(values, lambda v: F.trim(v).try_cast("int"))
    steps = F.zip_with(F.slice(numbers, 1, F.size(numbers) - 1), F.slice(numbers, 2, F.size(numbers)), lambda a, b: b - a)
    numbering = (F.col("populated") >= 3) & F.forall(numbers, lambda n: n.isNotNull()) & (F.element_at(numbers, 1) <= 2) & F.forall(F.slice(steps, 1, F.size(numbers) - 1), lambda d: d.between(0, 2))
    wordy = F.col("words") >= 0.7 * F.col("populated")
    return facts.select(*REGION, *EXTENT, "row", F.transform("line", lambda c: c["col"]).alias("cols"), values.alias("values"), "populated", "words", "different", wordy.alias("wordy"), (wordy & ~F.col("colon")).alias("label"), "doubled", F.coalesce(numbering, F.lit(False)).alias("numbering"))


def labels_group(upper: Column, below_cols: Column) -> Column:
    """Whether a row labels groups of the columns that the row below names: repeated across them, or over some of them only."""
    some = (F.size(F.array_except(upper["cols"], below_cols)) == 0) & (F.size(upper["cols"]) < F.size(below_cols))
    return upper["label"] & (upper["doubled"] | some)


def header_rows(found: DataFrame) -> DataFrame:
    """Facts of the first rows of every region, with ``data_like`` and, for rows that can be its header, ``score``."""
    width, n = F.col("right") - F.col("left") + 1, HEADER_SCAN + BAND_DOWN
    facts = row_facts(found.where(F.col("row") < F.col("top") + n))
    # kinds in each column of a first row, and of the rows below it
    name = kind(F.trim("value"))
    bit = reduce(lambda c, k: c.when(name == k, BITS[k]), BITS, F).cast("int")
    at = F.col("row") - F.col("top")
    first = found.where(at < n + SAMPLE_ROWS).select(*REGION, "top", "col", at.alias("at"), bit.alias("bit"))
    masks = [F.bit_or(F.when(on, F.col("bit"))).alias(f"{c}{i}") for i in range(n) for c, on in (("below", (F.col("at") > i) & (F.col("at") <= i + SAMPLE_ROWS)), ("own", F.col("at") == i))]
    columns = first.groupBy(*REGION, "top", "col").agg(*masks)
    columns = columns.select(*REGION, "top", F.posexplode(F.array(*(F.struct(F.col(f"below{i}").alias("below"), F.col(f"own{i}").alias("own")) for i in range(n)))).alias("i", "k"))
    one = F.col("k.below").isin(*BITS.values())
    typed = one & (F.col("k.below") != BITS["text"]) & F.col("k.own").isNotNull()
    compared = columns.where("k.below IS NOT NULL").groupBy(*REGION, (F.col("top") + F.col("i")).alias("row")).agg(
        F.avg(one.cast("int")).alias("steady"),
        F.count_if(typed).alias("typed"),
        F.count_if(typed & (F.col("k.own") == F.col("k.below"))).alias("alike"),
    )
    # two rows below at least tell what the columns hold
    enough = F.col("bottom") - F.col("row") >= 2
    joined = facts.join(compared, [*REGION, "row"], "left").withColumn("data_like", F.coalesce(enough & (F.col("typed") > 0) & (F.col("alike") >= 0.75 * F.col("typed")), F.lit(False)))
    points = (
        F.when(F.col("wordy"), 2).otherwise(0)
        + F.when(F.col("populated") == width, 1).otherwise(0)
        + F.when(enough & (F.col("steady") >= 0.75), 2).otherwise(0)
        - F.when(F.col("data_like"), 3).otherwise(0)
        - F.when((F.col("populated") == 1) & (width >= 3), 3).otherwise(0)
        - F.when(F.col("different") < F.col("populated"), 2).otherwise(0)
    )
    last = F.greatest(F.col("top"), F.least(F.col("top") + HEADER_SCAN - 1, F.col("bottom") - ROWS_BELOW))
    return joined.withColumn("score", F.when(F.col("row") <= last, points))


def headers(rows: DataFrame) -> DataFrame:
    """(region, header, last, skipped): first and last row of the header and its numbering rows; -1 where no row is good enough.

    The first row of best score is the header, with up to BAND_UP rows above it that label groups of its columns (empty
    rows between are stepped over) and up to BAND_DOWN rows below that go on with it.
    """
    facts = F.struct("row", "cols", "label", "doubled", "numbering", "wordy", "data_like")
    whole = rows.groupBy(*REGION).agg(F.max(F.when(F.col("score") >= LEAST_SCORE, F.struct("score", (-F.col("row")).alias("back")))).alias("b"), F.max("top").alias("top"), F.max("bottom").alias("bottom"), F.collect_list(facts).alias("rows"))
    whole = whole.withColumn("best", -F.col("b.back"))
    at = lambda n: F.try_element_at(F.filter("rows", lambda r: r["row"] == n), F.lit(1))

    def up(s: Column, k: Column) -> Column:
        r = at(F.col("best") - k)
        goes_on = (F.size(r["cols"]) >= 2) & labels_group(r, s["cols"])
        taken = F.struct(r["row"].alias("row"), r["cols"].alias("cols"), F.lit(False).alias("ended"))
        ended = F.struct(s["row"].alias("row"), s["cols"].alias("cols"), F.lit(True).alias("ended"))
        return F.when(s["ended"] | r.isNull(), s).when(goes_on, taken).otherwise(ended)

    def down(s: Column, k: Column) -> Column:
        r, above = at(F.col("best") + k), at(F.col("best") + k - 1)
        fills = (F.size(F.array_except(r["cols"], s["cols"])) > 0) & (F.size(F.array_intersect(r["cols"], s["cols"])) * 2 <= F.size(r["cols"]))
        goes_on = ~r["data_like"] & (r["numbering"] | (r["wordy"] & (fills | F.coalesce(above["doubled"], F.lit(False))))) & (r["row"] <= F.col("bottom") - ROWS_BELOW)
        taken = F.struct(r["row"].alias("row"), F.array_union(s["cols"], r["cols"]).alias("cols"), F.lit(False).alias("ended"))
        ended = F.struct(s["row"].alias("row"), s["cols"].alias("cols"), F.lit(True).alias("ended"))
        return F.when(s["ended"], s).when(F.coalesce(goes_on, F.lit(False)), taken).otherwise(ended)

    begin = F.struct(F.col("best").alias("row"), at(F.col("best"))["cols"].alias("cols"), F.lit(False).alias("ended"))
    steps = lambda n: F.sequence(F.lit(1), F.lit(n))
    first, last = F.aggregate(steps(BAND_UP), begin, up)["row"], F.aggregate(steps(BAND_DOWN), begin, down)["row"]
    out = whole.select(*REGION, "top", "rows", F.when(F.col("best").isNull(), -1).otherwise(first).alias("header"), F.when(F.col("best").isNull(), F.col("top") - 1).otherwise(last).alias("last"))
    skipped = F.transform(F.filter("rows", lambda r: r["row"].between(F.col("header"), F.col("last")) & r["numbering"]), lambda r: r["row"])
    # a header of nothing but numbers keeps its first row
    words = F.size(F.filter("rows", lambda r: r["row"].between(F.col("header"), F.col("last")) & ~r["numbering"]))
    return out.select(*REGION, "header", "last", F.when(words > 0, skipped).otherwise(F.filter(skipped, lambda r: r != F.col("header"))).alias("skipped"))


def extents(found: DataFrame) -> DataFrame:
    """(region, top, bottom, left, right, cells) of every region."""
    return found.select(*REGION, *EXTENT).distinct()


def rejoined(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Regions that an empty row cut out of one table made one again, and the headers of all; found: a stored table.

    A region goes on with the one before it, of the same columns, if it has no header of its own, or if the last row of the one
    before labels groups of the columns in its first row.  Headers are looked for anew in regions that were put together only.
    """
    heads = written(headers(header_rows(found)), "headers")
    edge = lambda side: row_facts(found.where(F.col("row") == F.col(side))).select(*REGION, F.struct("cols", "label", "doubled").alias(side + "_row"))
    every = extents(found).join(heads, list(REGION)).join(edge("top"), list(REGION)).join(edge("bottom"), list(REGION))
    order = Window.partitionBy(*SHEET).orderBy("region")
    before = lambda c: F.lag(c).over(order)
    told = every.select(*REGION, *EXTENT, "header", "top_row", before("bottom_row").alias("above"), ((before("left") == F.col("left")) & (before("right") == F.col("right"))).alias("same"))
    split = (F.size("above.cols") >= 2) & labels_group(F.col("above"), F.col("top_row.cols"))
    told = told.withColumn("new", (~F.coalesce(F.col("same") & ((F.col("header") < 0) | split), F.lit(False))).cast("int"))
    group = told.withColumn("group", F.sum("new").over(order))
    one = Window.partitionBy(*SHEET, "group")
    whole = {"region": F.min, "top": F.min, "bottom": F.max, "left": F.min, "right": F.max, "cells": F.sum}
    moved = group.select(*REGION, F.count(F.lit(1)).over(one).alias("n"), F.struct(*(f(c).over(one).alias(c) for c, f in whole.items())).alias("to")).where("n > 1")
    moved = written(moved.select(*REGION, "to"), "moved")
    out = found.join(moved, list(REGION), "left").select(*SHEET, *(F.coalesce(F.col("to")[c], F.col(c)).alias(c) for c in whole), "row", "col", "value", F.col("to").isNotNull().alias("moved"))
    out = written(out, "regions")
    anew = headers(header_rows(out.where("moved")))
    return out.drop("moved"), written(heads.join(moved.select(*REGION), list(REGION), "left_anti").unionByName(anew), "headers")


def column_names(found: DataFrame, heads: DataFrame) -> DataFrame:
    """(region, col, column_name): safe and unique names of the header's rows put together; col_i where there is no header cell."""
    places = extents(found).join(heads, list(REGION)).select(*REGION, "left", F.explode(F.sequence("left", "right")).alias("col"))
    band = found.join(heads, list(REGION)).where((F.col("header") >= 0) & F.col("row").between(F.col("header"), F.col("last")) & ~F.array_contains("skipped", F.col("row")))
    parts = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("row", F.trim("value").alias("value")))), lambda x: x["value"]))
    raw = band.groupBy(*REGION, "col").agg(F.array_join(parts, " ").alias("raw"))
    named = places.join(raw, [*REGION, "col"], "left").withColumn("name", safe_name(F.col("raw"), F.col("col") - F.col("left") + 1))
    nth = F.row_number().over(Window.partitionBy(*REGION, "name").orderBy("col"))
    return named.select(*REGION, "col", F.col("raw").alias("raw_name"), F.when(nth == 1, F.col("name")).otherwise(F.concat("name", F.lit("_"), nth.cast("string"))).alias("column_name"))


def data_cells(found: DataFrame, heads: DataFrame) -> DataFrame:
    """The cells below the headers, without trailing totals, notes and lone first cells."""
    inside = found.join(heads.select(*REGION, "header", "last"), list(REGION)).where(F.col("row") > F.col("last"))
    leads = F.col("col") == F.col("left")
    rows = inside.groupBy(*REGION, "row", (F.col("right") - F.col("left") + 1).alias("width")).agg(F.count(F.lit(1)).alias("n"), F.bool_or(leads).alias("leads"), F.bool_or(leads & F.trim("value").rlike(JUNK)).alias("said"))
    junk = (F.col("width") > 1) & F.col("leads") & ((F.col("n") == 1) | (F.col("said") & (F.col("n") < F.col("width"))))
    end = rows.groupBy(*REGION).agg(F.max(F.when(~junk, F.col("row"))).alias("end"))
    return inside.join(end, list(REGION)).where(F.col("row") <= F.col("end")).select(*REGION, "row", "col", "value", "header")


def _cut(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Regions' cells and headers, stored."""
    return rejoined(written(extended(regions(cells)), "regions"))


def tables(cells: DataFrame) -> DataFrame:
    """Long form of every table found: file, sheet (empty for files without), block (from 1), header, row, col, column_name, value."""
    return _tables(*_cut(cells)).drop("region")


def _tables(cut: DataFrame, heads: DataFrame) -> DataFrame:
    found = viable(cut)
    named = data_cells(found, heads).join(column_names(found, heads).drop("raw_name"), [*REGION, "col"])
    block = F.dense_rank().over(Window.partitionBy(*SHEET).orderBy("region"))
    return named.select(*REGION, block.alias("block"), "header", "row", "col", "column_name", "value")


def sheets(cells: DataFrame) -> DataFrame:
    """What becomes tables, in long form: as ``tables``, with ``role``: table, details or form, of which the latter two are block 0.

    A sheet that reads as a form is one table of (section, item, value).  Else, where it has a table of substance, its
    fragments (a row or two, totals, cells outside of tables) are folded into one such table beside it.
    """
    cut, heads = _cut(cells)
    long = written(_tables(cut, heads), "tables")
    cut = cut.drop(*EXTENT)
    blocks_ = long.groupBy(*REGION, "block").agg(F.count_distinct("row").alias("n_rows")).join(totals_blocks(long).drop("share"), [*SHEET, "block"])
    names = long.select(*REGION, "column_name").distinct().groupBy(*SHEET).agg(F.avg(F.col("column_name").rlike(r"^col_\d+$").cast("int")).alias("made_up"))
    size = cut.groupBy(*SHEET).agg((F.max("row") + 1).alias("rows"), (F.count(F.lit(1)) / ((F.max("row") + 1) * (F.max("col") + 1))).alias("density"))
    counts = blocks_.groupBy(*SHEET).agg(F.count(F.lit(1)).alias("n_blocks"), F.bool_or((F.col("n_rows") >= SUBSTANTIAL_ROWS) & ~F.col("is_totals")).alias("has_table"))
    zero = {"n_blocks": 0, "made_up": 0.0}
    told = size.join(counts, list(SHEET), "left").join(names, list(SHEET), "left").na.fill(zero).withColumn("has_table", F.coalesce("has_table", F.lit(False)))
    told = told.select(*SHEET, "has_table", is_form(F.col("n_blocks"), F.col("made_up"), F.col("density"), F.col("rows")).alias("may_be_form"))
    lines = form_lines(cut.join(told.where("may_be_form"), list(SHEET)).select(*SHEET, F.lit("").alias("part"), F.lit("").alias("place"), "row", "col", "value"))
    several = lines.groupBy(*SHEET).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= FORM_ROWS).select(*SHEET)
    forms = lines.join(several, list(SHEET))
    others = told.join(several, list(SHEET), "left_anti")

    small = blocks_.where((F.col("n_rows") <= FRAGMENT_ROWS) | F.col("is_totals")).select(*REGION)
    loose = cut.join(blocks_.select(*REGION), list(REGION), "left_anti").withColumn("part", F.lit(""))
    # of a fragment all from its header to its last row
    ends = long.groupBy(*REGION).agg(F.max("row").alias("end"))
    held = cut.join(small, list(REGION)).join(heads.select(*REGION, "header"), list(REGION)).join(ends, list(REGION)).where((F.col("row") >= F.col("header")) & (F.col("row") <= F.col("end")))
    pieces = loose.unionByName(held.withColumn("part", F.col("region")), allowMissingColumns=True).join(others.where("has_table"), list(SHEET))
    folded = form_lines(pieces.select(*SHEET, "part", F.col("region").alias("place"), "row", "col", "value"))
    gone = small.join(folded.select(*SHEET).distinct(), list(SHEET))
    kept = long.join(several, list(SHEET), "left_anti").join(gone, list(REGION), "left_anti").withColumn("role", F.lit("table"))
    made = _as_cells(forms, "form").unionByName(_as_cells(folded, "details"))
    return kept.select(*SHEET, "block", "role", "header", "row", "col", "column_name", "value").unionByName(made)


def _as_cells(lines: DataFrame, role: str) -> DataFrame:
    """Lines (part, place, row, section, item, value) as the cells of one table a sheet."""
    row = F.row_number().over(Window.partitionBy(*SHEET).orderBy("part", "place", "row")) - 1
    fields = F.array(*(F.struct(F.lit(i).alias("col"), F.lit(n).alias("column_name"), F.col(n).alias("value")) for i, n in enumerate(("section", "item", "value"))))
    return lines.withColumn("row", row).select(*SHEET, "row", F.explode(fields).alias("c")).select(*SHEET, F.lit(0).alias("block"), F.lit(role).alias("role"), F.lit(-1).alias("header"), "row", "c.col", "c.column_name", "c.value")


def totals_blocks(long: DataFrame) -> DataFrame:
    """(file, sheet, block, share): the share of rows that start with a totals label, and whether that makes a totals block."""
    first = long.groupBy(*SHEET, "block", "row").agg(F.min_by("value", "col").alias("first"))
    share = first.groupBy(*SHEET, "block").agg(F.avg(F.trim("first").rlike(TOTALS).cast("int")).alias("share"))
    return share.withColumn("is_totals", F.col("share") >= TOTALS_SHARE)


def wide(long: DataFrame, file: str, sheet: str | None, block: int) -> DataFrame:
    """One table as text columns, in sheet order; its names are its header's, so they are read on the driver."""
    own = long.where((F.col("file") == file) & (F.col("sheet") == (sheet or "")) & (F.col("block") == block))
    names = [r[0] for r in own.groupBy("column_name").agg(F.min("col").alias("c")).orderBy("c").collect()]
    return own.groupBy("row").pivot("column_name", names).agg(F.first("value"))


# Figures, short tokens and ordinals in forms.
FIGURE = r"^[\s₹$£€]*-?[\d,]+(\.\d+)?\s*%?$"
SHORT = r"^[A-Za-z0-9][\w./@-]{0,30}$"
ORDINAL = r"^(\d{1,3}|[a-zA-Z]|[ivxIVX]{1,4})$"
LABEL = 90


def form_items(cells: DataFrame) -> DataFrame:
    """(file, sheet, row, section, item, value): a form's lines under the heading that was last above them."""
    real = cells.where(F.col("value").isNotNull() & (F.trim("value") != ""))
    return form_lines(real.select(*SHEET, F.lit("").alias("part"), F.lit("").alias("place"), "row", "col", "value")).drop("part", "place")


def form_lines(cells: DataFrame) -> DataFrame:
    """(file, sheet, part, place, row, section, item, value): the lines of every part, in order of place and row.

    A heading is a lone cell that is no figure, or one after an ordinal; of other lines the rightmost figure or short
    token is the value, else the last cell, and the cells to its left are the label.  Lines without a label are left out.
    """
    line = (*SHEET, "part", "place", "row")
    rows = cells.withColumn("value", F.trim("value")).groupBy(*line).agg(F.array_sort(F.collect_list(F.struct("col", "value"))).alias("cells"))
    v = F.transform("cells", lambda c: c["value"])
    ordinal = lambda c: F.trim(c, F.lit("()[]. ")).rlike(ORDINAL)
    first, second = F.try_element_at(v, F.lit(1)), F.try_element_at(v, F.lit(2))
    heading = F.when((F.size(v) == 1) & ~first.rlike(FIGURE) & (F.length(first) <= LABEL), first).when((F.size(v) == 2) & ordinal(first) & ~second.rlike(FIGURE), F.left(second, F.lit(LABEL)))
    places = F.filter(F.sequence(F.lit(2), F.greatest(F.size(v), F.lit(2))), lambda i: F.try_element_at(v, i).rlike(FIGURE) | F.try_element_at(v, i).rlike(SHORT))
    at = F.coalesce(F.try_element_at(places, F.lit(-1)), F.size(v))
    label = F.array_join(F.filter(F.slice(v, 1, at - 1), lambda c: ~ordinal(c) & ~c.rlike(FIGURE)), " ")
    lines = rows.select(*line, heading.alias("heading"), F.trim(label, F.lit(" :.-")).alias("item"), F.element_at(v, at).alias("value"))
    section = F.last("heading", ignorenulls=True).over(Window.partitionBy(*SHEET, "part").orderBy("place", "row"))
    return lines.withColumn("section", F.coalesce(section, F.lit(""))).where(F.col("heading").isNull() & (F.col("item") != "")).select(*line, "section", F.left("item", F.lit(LABEL)).alias("item"), "value")


def is_form(found_blocks: Column, placeholder_share: Column, density: Column, n_rows: Column) -> Column:
    """Whether a sheet reads as a form: names are mostly made up, and it fell into pieces or is sparse."""
    return (n_rows >= 6) & (placeholder_share >= 0.5) & ((found_blocks >= 3) | ((found_blocks <= 2) & (density < 0.30) & (n_rows >= 20)))
