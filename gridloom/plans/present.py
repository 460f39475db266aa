"""What a result says: facts about its figures, and the chart that fits it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NUMBER = ("int", "bigint", "smallint", "tinyint", "double", "float")
CATEGORIES, POINTS = 25, 15
DESCRIBED, LISTED = 4, 5


def _is_number(kind: str) -> bool:
    return kind in NUMBER or kind.startswith("decimal")


def facts(df: DataFrame) -> DataFrame:
    """Per numeric column: rows, the highest and lowest with the first label column's value, and the total; null counts as 0."""
    label = next((n for n, k in df.dtypes if not _is_number(k)), None)
    named = F.col(f"`{label}`").cast("string") if label else F.lit(None).cast("string")
    parts = []
    for name, kind in df.dtypes:
        if _is_number(kind):
            v = F.coalesce(F.col(f"`{name}`").cast("double"), F.lit(0.0))
            high, low = F.max(F.struct(v.alias("v"), named.alias("label"))), F.min(F.struct(v.alias("v"), named.alias("label")))
            parts.append(df.agg(F.count(F.lit(1)).alias("n_rows"), high.alias("h"), low.alias("l"), F.sum(v).alias("total")).select(F.lit(name).alias("measure"), "n_rows", F.col("h.label").alias("highest_label"), F.col("h.v").alias("highest"), F.col("l.label").alias("lowest_label"), F.col("l.v").alias("lowest"), "total"))
    if not parts:
        raise ValueError("no numeric column")
    return reduce(DataFrame.unionByName, parts)


def chart(df: DataFrame, intent: str = "auto", rows: list[dict] | None = None) -> dict:
    """The chart of a result: kind, x, y and series; rows: the (capped) rows of df if they have been fetched."""
    if rows is None:
        rows = [r.asDict() for r in df.limit(POINTS + CATEGORIES * CATEGORIES).collect()]
    n = len(rows)
    numbers = [c for c, k in df.dtypes if _is_number(k)]
    times = [c for c, k in df.dtypes if k.startswith(("timestamp", "date"))]
    few = [c for c, k in df.dtypes if k == "string" and len({r[c] for r in rows if r[c] is not None}) <= CATEGORIES]
    if intent == "none" or not n:
        return {"kind": "table"}
    if n == 1 and len(df.columns) == 1 and numbers:
        return {"kind": "big_number", "y": numbers[0]}
    if times and numbers:
        return {"kind": "line", "x": times[0], "y": numbers[0]}
    if few and numbers:
        return {"kind": "bar", "x": few[0], "y": numbers[0], "series": few[1] if len(few) > 1 else None}
    if len(numbers) >= 2 and n > POINTS:
        return {"kind": "scatter", "x": numbers[0], "y": numbers[1]}
    if intent == "single_value" and n == 1 and numbers:
        return {"kind": "big_number", "y": numbers[0]}
    return {"kind": "table"}


def _shown(value) -> str:
    if value is None:
        return "nothing"
    if isinstance(value, bool):
        return "yes" if value else "no"
    if isinstance(value, float):
        return f"{value:,.2f}".rstrip("0").rstrip(".")
    return f"{value:,}" if isinstance(value, int) else str(value)


def describe(columns: list[str], rows: list[dict], truncated: bool = False) -> str:
    """What capped rows say in words: one value, one row, the extremes of a figure by label, a list, or their shape."""
    named = lambda c: c.replace("_", " ").strip()
    if not rows:
        return "No rows."
    if len(rows) == 1:
        return "; ".join(f"{named(c)}: {_shown(rows[0][c])}" for c in columns[:DESCRIBED]) + "."
    figure = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
    held = {c: [r[c] for r in rows if r[c] is not None] for c in columns}
    numbers = [c for c in columns if held[c] and all(map(figure, held[c]))]
    labels = [c for c in columns if c not in numbers]
    size = f"{len(rows):,}{' or more' if truncated else ''} rows"
    if labels and numbers:
        by = sorted(rows, key=lambda r: r[numbers[0]] if figure(r[numbers[0]]) else 0.0, reverse=True)
        high, low = ((_shown(r[labels[0]]), _shown(r[numbers[0]])) for r in (by[0], by[-1]))
        return f"{size}; {named(numbers[0])} from {low[1]} ({low[0]}) to {high[1]} ({high[0]})."
    if labels:
        rest = len(rows) - LISTED
        return f"{size}: {', '.join(_shown(r[labels[0]]) for r in rows[:LISTED])}{f' and {rest:,} others' if rest > 0 else ''}."
    return f"{size} of {', '.join(map(named, columns[:LISTED]))}."
