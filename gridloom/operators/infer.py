"""Types of all-string tables: one aggregate decides a type per column, one select applies it.

Every decision is made for a whole column over all its rows: a single value that does not fit keeps the column
text, but for dates, of which nine in ten make a column of dates and the others become null.  Votes on decimal
commas and on day-first dates count all values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cells

DATE_SHARE = 0.90
LEADING_ZERO = r"^0\d+$"
#: What all spellings of dates start with.
MAY_BE_A_DATE = r"^(?:\d{1,4}[-/ ]|(?:19|20)\d{6}$)"


def inferred(df: DataFrame) -> DataFrame:
    """(column_name, position, target, european, pattern): target is bigint, double, timestamp, boolean or string."""
    named = F.array(*(F.struct(F.lit(n).alias("column_name"), F.lit(i).alias("position"), cells.cleaned(F.col(f"`{n}`").cast("string")).alias("v")) for i, n in enumerate(df.columns)))
    return decided(df.select(F.explode(named).alias("c")).select("c.*"))


def decided(values: DataFrame) -> DataFrame:
    """The same over (column_name, position, v) in long form."""
    v = F.col("v")
    # every spelling is read once a cell; only text that starts like a date is held against the date formats
    dated = F.when(v.rlike(MAY_BE_A_DATE), v)
    us = cells.number(v, F.lit(False))
    # a value's spellings are held against all shapes once, with the rows that hold it
    once = values.groupBy("column_name", "position", "v").agg(F.count(F.lit(1)).alias("rows"))
    read = once.select(
        "column_name",
        "position",
        "v",
        "rows",
        us.alias("us"),
        F.when(v.rlike("[.,]"), cells.number(v, F.lit(True))).otherwise(us).alias("eu"),
        cells.boolean(v).isNotNull().alias("is_boolean"),
        cells.day(dated, 1).alias("first_day"),
        cells.day(dated, 2).alias("second_day"),
        *(cells.parsed(dated, p).isNotNull().alias(f"is_date_{i}") for i, p in enumerate(cells.DATE_FORMATS)),
    )
    count = lambda test: F.coalesce(F.sum(F.when(test, F.col("rows"))), F.lit(0))
    votes = read.groupBy("column_name", "position").agg(
        count(v.isNotNull()).alias("n"),
        count(F.col("us").isNotNull()).alias("us"),
        count(F.col("eu").isNotNull()).alias("eu"),
        count(F.col("us") % 1 == 0).alias("us_whole"),
        count(F.col("eu") % 1 == 0).alias("eu_whole"),
        count(F.contains(v, F.lit(",")) & v.rlike(cells.EU_DECIMAL)).alias("eu_votes"),
        count(F.contains(v, F.lit(".")) & v.rlike(cells.US_DECIMAL)).alias("us_votes"),
        count(v.rlike(LEADING_ZERO) | cells.overflows(v)).alias("vetoes"),
        count(F.col("first_day") > 12).alias("first_days"),
        count(F.col("second_day") > 12).alias("second_days"),
        count(F.col("is_boolean")).alias("booleans"),
        F.size(F.collect_set(F.when(F.col("is_boolean"), F.lower(v)))).alias("spellings"),
        *(count(F.col(f"is_date_{i}")).alias(f"date_{i}") for i in range(len(cells.DATE_FORMATS))),
    )
    european = (F.col("eu_votes") > F.col("us_votes")) & (F.col("eu_votes") > 0)
    fits = F.when(european, F.col("eu")).otherwise(F.col("us")) == F.col("n")
    whole = F.when(european, F.col("eu_whole")).otherwise(F.col("us_whole")) == F.col("n")
    day_first = F.col("first_days") > F.col("second_days")
    usable = {p: ~day_first if p in cells.MONTH_FIRST else day_first if p in cells.DAY_FIRST else F.lit(True) for p in cells.DATE_FORMATS}
    dates = F.array(*(F.struct(F.when(usable[p], F.col(f"date_{i}")).otherwise(0).alias("n"), F.lit(-i).alias("i"), F.lit(p).alias("pattern")) for i, p in enumerate(cells.DATE_FORMATS)))
    best = F.array_max(dates)
    target = (
        F.when(F.col("n") == 0, "string")
        .when(fits & (F.col("vetoes") == 0), F.when(whole, "bigint").otherwise("double"))
        .when(best["n"] >= DATE_SHARE * F.col("n"), "timestamp")
        .when((F.col("booleans") == F.col("n")) & (F.col("spellings") >= 2), "boolean")
        .otherwise("string")
    )
    return votes.select("column_name", "position", target.alias("target"), european.alias("european"), F.when(target == "timestamp", best["pattern"]).alias("pattern"))


def typed(cell: Column, target: str, european: bool, pattern: str | None) -> Column:
    v = cells.cleaned(cell)
    if target == "bigint":
        return cells.number(v, F.lit(european)).cast("bigint") if european else F.coalesce(v.try_cast("bigint"), cells.number(v, F.lit(european)).cast("bigint"))
    if target == "double":
        return cells.number(v, F.lit(european))
    if target == "timestamp":
        return cells.parsed(v, pattern)
    if target == "boolean":
        return cells.boolean(v)
    return v


def coerced(df: DataFrame, plan: DataFrame | None = None) -> DataFrame:
    """df with each column in its inferred type; the plan has a row a column, so it is read on the driver."""
    return retyped(df, {r["column_name"]: r for r in (plan or inferred(df)).collect()})


def retyped(df: DataFrame, kinds: dict) -> DataFrame:
    """df with the columns named in ``kinds`` (target, european, pattern of each) in their types."""
    return df.select(*(typed(F.col(f"`{n}`").cast("string"), kinds[n]["target"], kinds[n]["european"], kinds[n]["pattern"]).alias(n) if n in kinds else F.col(f"`{n}`") for n in df.columns))
