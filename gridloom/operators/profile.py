"""One-pass column profiles of a table, and the catalog of all tables."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import name_tokens
from ..functions.projections import rendered
from ..sources.store import written

# Shares, counts and the patterns that values are held against.
SAMPLES, SAMPLE_CHARS = 5, 40
SIGNATURE_SHARE, SIGNATURE_LEAST = 0.95, 3
ID_SHARE = 0.90
CATEGORY_DISTINCT, CATEGORY_SHARE = 50, 0.05
SIGNATURES = (r"^[A-Z]{1,4}[-_]?\d+$", r"^\d{4}-\d{2}-\d{2}$", r"^[^@\s]+@[^@\s]+\.[^@\s]+$", r"^\d{10}$")
ID_NAME = r"^(id|code|ref|key|no)$|_(id|code|ref|no|num|key)$"
ATOMIC = ("array", "map", "struct", "binary", "variant")


def semantic_type() -> Column:
    """boolean, date, id, numeric, category or text, over counts made by ``profile``."""
    share = F.try_divide(F.col("n_distinct"), F.col("n_rows"))
    whole = F.col("dtype").isin("bigint", "int", "smallint", "tinyint", "string")
    number = F.col("dtype").isin("bigint", "int", "smallint", "tinyint", "double", "float") | F.col("dtype").startswith("decimal")
    return (
        F.when(F.col("dtype") == "boolean", "boolean")
        .when(F.col("dtype").rlike("^(timestamp|date)"), "date")
        .when(F.lower("column_name").rlike(ID_NAME), "id")
        .when(whole & (share >= ID_SHARE) & (F.col("n_distinct") > 1), "id")
        .when(number, "numeric")
        .when((F.col("n_distinct") <= CATEGORY_DISTINCT) | (share <= CATEGORY_SHARE), "category")
        .otherwise("text")
    )


#: What whole columns' cells are counted as; all other types are counted by their text.
NATIVE = {"bigint": "long", "int": "long", "smallint": "long", "tinyint": "long", "double": "double", "date": "date", "timestamp": "date", "timestamp_ntz": "date"}
#: Bytes of text above which a value is counted by its digest, and only what profiles need of it is kept.
LONG = 128
#: Parts that the first rows of a column's values are dealt to, of each of which the least is known.
PARTS = 64


def columns_of(tables: dict[str, DataFrame]) -> list[tuple[str, str, int, str]]:
    """(table, column, position, dtype) of the atomic columns of all tables; their places in this list are their numbers."""
    found = ((t, [f.name for f in df.schema.fields if not f.dataType.simpleString().startswith(ATOMIC)], dict(df.dtypes)) for t, df in tables.items())
    return [(t, c, i, dtypes[c]) for t, names, dtypes in found for i, c in enumerate(names)]


def value_counts(tables: dict[str, DataFrame], row: Column | None = None) -> DataFrame:
    """(no, long, double, date, text, head, width, seen, n, first_row): a row per distinct value of a numbered column, in the one place of its type.

    Values are counted as they are and become text (``value_text``) once a distinct value; all else is derived from these.
    Texts over LONG bytes are never shuffled: they are counted by SHA-256, and of each stay its head, its width if it is all
    digits, and as bits which signatures it matches and whether it is blank.  The least and the greatest of a column are there
    as texts too, in rows of no rows (n = 0).
    """
    every = columns_of(tables)
    at = F.monotonically_increasing_id() if row is None else row
    out = []
    for kind in ("long", "double", "date", "string"):
        long = []
        for name, df in tables.items():
            own = [(no, c) for no, (t, c, _, dtype) in enumerate(every) if t == name and NATIVE.get(dtype, "string") == kind]
            cells = [F.struct(F.lit(no).alias("no"), (rendered(df, c) if kind == "string" else F.col(f"`{c}`").cast(kind)).alias("v")) for no, c in own]
            if is_scan(df):
                long += [df.select(at.alias("row"), c.alias("c")) for c in cells]
            elif cells:
                long.append(df.select(at.alias("row"), F.explode(F.array(*cells)).alias("c")))
        if long:
            cells = reduce(DataFrame.unionByName, long).select("row", "c.no", "c.v")
            v, rest = F.col("v"), ("head", "width", "seen")
            if kind == "string":
                cut = lambda c: F.when(is_long(v), c)
                bits = reduce(lambda x, y: x + y, (F.when(t, 1 << i).otherwise(0) for i, t in enumerate([*(v.rlike(p) for p in SIGNATURES), F.trim(v) == ""])))
                cells = cells.select("row", "no", F.when(~is_long(v), v).alias("v"), cut(F.unhex(F.sha2(v, 256))).alias("digest"), cut(F.left(v, F.lit(SAMPLE_CHARS))).alias("head"), cut(_digits_width(v)).alias("width"), cut(bits).alias("seen"))
            else:
                cells = cells.select("row", "no", "v", *(F.lit(None).cast(k).alias(c) for c, k in zip(rest, ("string", "int", "int"), strict=True)))
            # what is kept of a long text follows from its digest
            counted = cells.groupBy(*(c for c in cells.columns if c != "row")).agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first_row"))
            places = [(v if k == kind else F.lit(None).cast(k)).alias("text" if k == "string" else k) for k in ("long", "double", "date", "string")]
            out.append(counted.select("no", *places, *rest, "n", "first_row"))
    nothing = {"long": "long", "double": "double", "date": "date", "head": "string", "width": "int", "seen": "int", "first_row": "long"}
    for texts in long_texts(tables, {(t, c) for t, c, *_ in every}).values():
        # without groups, as texts are sorted by group otherwise; a row a task is shuffled
        ends = [(no, f(f"c{no}").alias(f"{f.__name__}_{no}")) for no in (int(c[1:]) for c in texts.columns) for f in (F.min, F.max)]
        each = texts.agg(*(c for _, c in ends)).select(F.explode(F.array(*(F.struct(F.lit(no).alias("no"), F.col(f"{f}_{no}").alias("text")) for no in dict(ends) for f in ("min", "max")))).alias("e"))
        out.append(each.select("e.*", F.lit(0).cast("long").alias("n"), *(F.lit(None).cast(k).alias(c) for c, k in nothing.items())).where("text IS NOT NULL"))
    return reduce(DataFrame.unionByName, out)


def is_long(v: Column) -> Column:
    return F.coalesce(F.octet_length(v) > LONG, F.lit(False))


def _digits_width(v: Column) -> Column:
    return F.when(v.rlike(r"^\d+$"), F.length(v))


def long_texts(tables: dict[str, DataFrame], wanted: Iterable[tuple[str, str]]) -> dict[str, DataFrame]:
    """By table its texts over LONG bytes, null where shorter, of the wanted columns: columns c and their number."""
    out = {}
    for name, df in tables.items():
        own = [(no, c) for no, (t, c, _, dtype) in enumerate(columns_of(tables)) if t == name and (t, c) in wanted and NATIVE.get(dtype, "string") == "string"]
        if own:
            out[name] = df.select(*(F.when(is_long(rendered(df, c)), rendered(df, c)).alias(f"c{no}") for no, c in own))
    return out


def is_scan(df: DataFrame) -> bool:
    """Whether df only reads and computes columns of a stored table: then a column is read by tasks of its own, which hold its values only."""
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() in ("Project", "Filter"):
        plan = plan.children().head()
    return plan.nodeName().startswith(("Relation", "LogicalRelation"))


def value_text(df: DataFrame) -> Column:
    """The text of a row of ``value_counts``; null stays null, and so do long texts."""
    return F.coalesce("text", *(rendered(df, c) for c in ("long", "double", "date")))


def profile(df: DataFrame, row: Column | None = None) -> DataFrame:
    """A row per atomic column: counts, bounds, samples, signature, tokens and semantic type."""
    return profiles({"": df}, row).drop("table_name")


def profiles(tables: dict[str, DataFrame], row: Column | None = None) -> DataFrame:
    """The profiles of all tables, in one pass over their cells."""
    return profiled(written(value_counts(tables, row), "counts"), columns_of(tables))


def signature() -> Column:
    """The pattern that 95 % of a group's values match, else the fixed digit width; over counts made by ``profile``."""
    n = F.col("n_rows") - F.col("n_null")
    known = [F.when(F.col(f"matches_{i}") >= SIGNATURE_SHARE * n, F.lit(p)) for i, p in enumerate(SIGNATURES)]
    width = F.when((F.col("digits") >= SIGNATURE_SHARE * n) & (F.col("width_rows") >= SIGNATURE_SHARE * F.col("digits")), F.concat(F.lit(r"^\d{"), F.col("width").cast("string"), F.lit("}$")))
    return F.when(n >= SIGNATURE_LEAST, F.coalesce(*known, width))


def profiled(counts: DataFrame, every: list[tuple[str, str, int, str]]) -> DataFrame:
    """Profiles of columns by their value counts, a written table; every: the columns by number.

    Values are summed by column and width, then by column: both hold a number a group.  Only text is compared for its
    bounds.  Null counts as a value of its own, never as a distinct one.
    """
    # all of a short text, the head of a long one
    valued = counts.where("n > 0").withColumn("value", F.coalesce(value_text(counts), "head"))
    real, seen = F.col("value").isNotNull(), lambda i, test: F.coalesce(F.col("seen").bitwiseAND(1 << i) != 0, test)
    weigh = lambda test: F.coalesce(F.sum(F.when(real & test, F.col("n"))), F.lit(0))
    natives = ("long", "double", "date")
    by_width = valued.groupBy("no", F.when(F.col("head").isNotNull(), F.col("width")).otherwise(_digits_width(F.col("value"))).alias("width")).agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(~real, F.col("n"))), F.lit(0)).alias("n_null"),
        weigh(seen(len(SIGNATURES), F.trim("value") == "")).alias("n_blank"),
        F.count("value").alias("n_distinct"),
        *(f(c).alias(f"{f.__name__}_{c}") for c in natives for f in (F.min, F.max)),
        *(weigh(seen(i, F.col("value").rlike(p))).alias(f"matches_{i}") for i, p in enumerate(SIGNATURES)),
    )
    of_width = F.struct(F.when(F.col("width").isNotNull(), F.col("n")).alias("rows"), (-F.col("width")).alias("w"))
    out = by_width.groupBy("no").agg(
        F.sum("n").alias("n_rows"),
        *(F.sum(c).alias(c) for c in ("n_null", "n_blank", "n_distinct", *(f"matches_{i}" for i in range(len(SIGNATURES))))),
        *(f(f"{f.__name__}_{c}").alias(f"{f.__name__}_{c}") for c in natives for f in (F.min, F.max)),
        F.max(F.when(F.col("width").isNotNull(), of_width)).alias("widest"),
        F.sum(F.when(F.col("width").isNotNull(), F.col("n"))).alias("digits"),
    )
    out = out.withColumns({"width_rows": F.col("widest.rows"), "width": -F.col("widest.w")})
    numbers = [no for no, (_, _, _, dtype) in enumerate(every) if dtype.startswith(("float", "decimal"))]
    numeric = F.when(F.col("no").isin(*numbers) if numbers else F.lit(False), F.col("text").try_cast("double"))
    bounds = counts.where(F.col("text").isNotNull()).groupBy("no").agg(F.min("text").alias("min_text"), F.max("text").alias("max_text"), F.min_by("text", numeric).alias("min_number"), F.max_by("text", numeric).alias("max_number"))
    out = out.join(first_values(valued, SAMPLES), "no", "left").join(bounds, "no", "left")
    named = F.array(*(F.struct(F.lit(t).alias("table_name"), F.lit(c).alias("column_name"), F.lit(i).alias("position"), F.lit(dtype).alias("dtype")) for t, c, i, dtype in every))
    out = out.withColumn("named", F.element_at(named, F.col("no") + 1)).select("named.*", "*")
    kind = semantic_type()
    is_number = F.col("dtype").isin("bigint", "int", "smallint", "tinyint", "double", "float") | F.col("dtype").startswith("decimal")
    bound = lambda f: F.coalesce(*(rendered(out.select(F.col(f"{f}_{c}")), f"{f}_{c}") for c in natives), F.when(is_number, F.col(f"{f}_number")).otherwise(F.col(f"{f}_text")))
    return out.select(
        "table_name",
        "column_name",
        "position",
        "dtype",
        kind.alias("semantic_type"),
        "n_rows",
        "n_distinct",
        "n_null",
        F.round(F.try_divide(F.col("n_null"), F.col("n_rows")), 4).alias("null_rate"),
        ((F.col("n_null") == 0) & (F.col("n_distinct") == F.col("n_rows"))).alias("is_unique"),
        bound("min").alias("min_value"),
        bound("max").alias("max_value"),
        F.coalesce("samples", F.array().cast("array<string>")).alias("samples"),
        F.when(kind.isin("id", "text", "category"), signature()).alias("regex_signature"),
        name_tokens(F.col("column_name")).alias("name_tokens"),
        "n_blank",
    )


def first_values(valued: DataFrame, n: int) -> DataFrame:
    """(no, samples): the first n distinct values of each column in row order, cut to SAMPLE_CHARS.

    The nth of the least first rows of PARTS parts is no less than the nth of all, so only values up to there are ordered.
    """
    real = valued.where(F.col("value").isNotNull())
    least = real.groupBy("no", F.pmod(F.xxhash64("first_row"), F.lit(PARTS)).alias("part")).agg(F.min("first_row").alias("r"))
    upto = least.groupBy("no").agg(F.array_sort(F.collect_list("r")).alias("r")).select("no", F.try_element_at("r", F.lit(n)).alias("upto"))
    order = Window.partitionBy("no").orderBy("first_row")
    near = real.join(F.broadcast(upto), "no").where(F.col("upto").isNull() | (F.col("first_row") <= F.col("upto")))
    first = near.select("no", "first_row", F.left("value", F.lit(SAMPLE_CHARS)).alias("value")).withColumn("k", F.row_number().over(order)).where(F.col("k") <= n)
    return first.groupBy("no").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "value"))), lambda x: x["value"]).alias("samples"))


def catalog(tables: dict[str, tuple[DataFrame, str]]) -> tuple[DataFrame, DataFrame]:
    """schema_tables and schema_columns of named tables (with their source file)."""
    return catalog_of(profiles({name: df for name, (df, _) in tables.items()}), {name: source for name, (_, source) in tables.items()})


def catalog_of(found: DataFrame, sources: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """The same of profiles."""
    files = F.create_map(*(F.lit(x) for pair in sources.items() for x in pair))
    found = found.withColumn("source_file", F.element_at(files, F.col("table_name")))
    columns = found.select("table_name", "column_name", F.col("semantic_type").alias("data_type"), "n_distinct", F.col("n_null").alias("n_nulls"), F.concat_ws(", ", F.slice("samples", 1, 3)).alias("example_values"))
    whole = found.groupBy("table_name", "source_file").agg(F.max("n_rows").alias("n_rows"), F.count(F.lit(1)).alias("n_columns"))
    return whole, columns
