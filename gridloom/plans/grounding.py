"""Names in a result that the data does not have, found on Catalyst's parsed plan."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.names import name_tokens

# Words that name a way of aggregating rather than a thing in the data.
AGGREGATION_WORDS = (
    "average",
    "avg",
    "mean",
    "total",
    "sum",
    "count",
    "number",
    "minimum",
    "min",
    "maximum",
    "max",
    "highest",
    "lowest",
    "distinct",
    "percent",
    "percentage",
    "ratio",
    "rate",
    "per",
    "each",
    "overall",
    "value",
    "result",
    "amount",
)


def outputs(spark: SparkSession, sql: str) -> list[tuple[str, list[str]]]:
    """(alias, columns) of the named outputs of a statement's first SELECT, in order; columns are the last parts of their names."""
    plan = json.loads(spark._jsparkSession.sessionState().sqlParser().parsePlan(sql).toJSON())
    for node in plan:
        kind = node["class"].rsplit(".", 1)[-1]
        listed = node.get("projectList" if kind == "Project" else "aggregateExpressions" if kind == "Aggregate" else "", None)
        if listed is not None:
            break
    else:
        return []
    out = []
    for tree in listed:
        if tree[0]["class"].endswith(".Alias"):
            columns = [_last_part(x["nameParts"]) for x in tree if x["class"].endswith(".UnresolvedAttribute")]
            out.append((tree[0]["name"], columns))
    return out


def _last_part(parts) -> str:
    return (parts.strip("[]").split(",") if isinstance(parts, str) else list(parts))[-1].strip()


def ungrounded(spark: SparkSession, sql: str, names: list[str]) -> dict[str, str]:
    """Outputs that stand for a column under a word that neither tables nor columns (names) have: their first column.

    An output without a column (count(*) AS n) renames nothing.
    """
    renamed = [(alias, columns) for alias, columns in outputs(spark, sql) if columns]
    if not renamed:
        return {}
    words = spark.createDataFrame([(n, False) for n in names] + [(a, True) for a, _ in renamed], "name string, asked boolean").select("name", "asked", name_tokens(F.col("name")).alias("tokens")).collect()
    known = {t for r in words if not r["asked"] for t in r["tokens"]} | set(AGGREGATION_WORDS)
    tokens = {r["name"]: r["tokens"] for r in words if r["asked"]}
    return {alias: columns[0] for alias, columns in renamed if any(t not in known for t in tokens[alias])}


def caveat(labels: dict[str, str]) -> str:
    """A sentence that says what such outputs are; empty if there are none."""
    if not labels:
        return ""
    return "These names are not in the data: " + "; ".join(f"{alias} shows {column}" for alias, column in sorted(labels.items())) + "."
