"""Value projections that make differently spelled keys equal: as columns, and as SQL text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Projection:
    name: str
    of: Callable[[Column], Column]
    sql: str

    def predicate(self, left: str, right: str) -> str:
        return f"{self.sql.format(left)} = {self.sql.format(right)}"


RAW = Projection("raw", lambda c: c, "{0}")
LOWER_TRIM = Projection("lower_trim", lambda c: F.lower(F.trim(c)), "lower(trim({0}))")
DIGITS_ONLY = Projection("digits_only", lambda c: F.regexp_replace(c, "[^0-9]", ""), "regexp_replace({0}, '[^0-9]', '')")
ALNUM_ONLY = Projection("alnum_only", lambda c: F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]", ""), "regexp_replace(lower(trim({0})), '[^a-z0-9]', '')")
PROJECTIONS = {p.name: p for p in (RAW, LOWER_TRIM, DIGITS_ONLY, ALNUM_ONLY)}
GRAINS = ("month", "week")


def rendered(df: DataFrame, name: str) -> Column:
    """A column as text: dates as yyyy-MM-dd, integral numbers without a fraction, all else as it is."""
    kind = dict(df.dtypes)[name]
    c = F.col(f"`{name}`")
    if kind.startswith(("timestamp", "date")):
        return F.date_format(c, "yyyy-MM-dd")
    if kind in ("double", "float"):
        small = F.when(F.abs(c) < 1e15, c.cast("long").cast("string")).otherwise(c.cast("decimal(38,0)").cast("string"))
        return F.when(c % 1 == 0, small).otherwise(c.cast("string"))
    return c.cast("string")


def grained(c: Column, unit: str) -> Column:
    return F.date_trunc(unit, c).cast("timestamp_ntz")
