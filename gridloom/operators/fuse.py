"""Tables of one shape as one table."""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _widened(frames: list[DataFrame]) -> list[DataFrame]:
    """Columns whose types differ become text; numbers of different width become doubles."""
    out = frames
    for i, name in enumerate(frames[0].columns):
        kinds = {f.dtypes[i][1] for f in frames}
        if len(kinds) > 1:
            to = "double" if kinds <= {"int", "bigint", "double", "float"} else "string"
            out = [f.withColumn(name, F.col(f"`{name}`").cast(to)) for f in out]
    return out


def common_prefix(names: list[str]) -> str:
    first, last = min(names), max(names)
    n = next((i for i, (a, b) in enumerate(zip(first, last, strict=False)) if a != b), min(len(first), len(last)))
    return first[:n].rstrip("_0123456789") or first


def fused(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """tables with those of equal column names united under their common prefix; made-up and form columns stay apart."""
    groups: dict[tuple[str, ...], list[str]] = defaultdict(list)
    for name, df in tables.items():
        groups[tuple(df.columns)].append(name)
    out = dict(tables)
    for columns, names in groups.items():
        if len(names) < 2 or columns == ("section", "item", "value") or all(c.startswith("col_") for c in columns):
            continue
        alias = base = common_prefix(names)
        n = 2
        while alias in out and alias not in names:
            alias, n = f"{base}_{n}", n + 1
        united = reduce(DataFrame.unionByName, _widened([tables[x] for x in names]))
        out = {k: v for k, v in out.items() if k not in names} | {alias: united}
    return out


def with_grain(df: DataFrame, column: str, unit: str) -> DataFrame:
    """df with a date cut to its month or week as column__unit; the same again changes nothing."""
    return df.withColumn(f"{column}__{unit}", F.date_trunc(unit, F.col(column)).cast("timestamp_ntz"))
