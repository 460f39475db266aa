"""Read-only SQL over registered tables: checked on Catalyst's own plan, then run with a row cap and a time limit."""

from __future__ import annotations

import datetime as dt
import decimal
import json
import math
import re
import threading
from dataclasses import dataclass, field
from typing import Any

from pyspark.errors import AnalysisException, ParseException, PySparkException
from pyspark.sql import DataFrame, Row, SparkSession

ROW_CAP, SECONDS, EVIDENCE_ROWS = 5000, 20, 100
FORBIDDEN_FUNCTIONS = {"java_method", "reflect", "try_reflect"}
#: Plan nodes that only read; a statement with any other is refused.
READING = {
    "Project", "Filter", "Aggregate", "Join", "Sort", "GlobalLimit", "LocalLimit", "Limit", "Offset", "Distinct", "Union", "Except", "Intersect", "SubqueryAlias",
    "UnresolvedWith", "CTERelationDef", "CTERelationRef", "UnresolvedRelation", "UnresolvedHaving", "UnresolvedSubqueryColumnAliases", "OneRowRelation", "UnresolvedInlineTable",
    "LocalRelation", "Window", "WithWindowDefinition", "Generate", "LateralJoin", "Pivot", "Unpivot", "Tail", "Sample", "UnresolvedHint", "Expand", "UnresolvedOrdinal",
}


class Refused(Exception):
    def __init__(self, code: str, message: str, **more: Any):
        super().__init__(message)
        self.code, self.more = code, more


@dataclass
class Checked:
    sql: str
    tables: list[str]
    frame: DataFrame = field(repr=False)


def _nodes(plan_json: str):
    stack = [json.loads(plan_json)]
    while stack:
        x = stack.pop()
        if isinstance(x, dict):
            if "class" in x:
                yield x
            stack += x.values()
        elif isinstance(x, list):
            stack += x


def checked(spark: SparkSession, sql: str, tables: set[str]) -> Checked:
    """One SELECT (or set operation) over the registered views only; raises Refused with a code."""
    text = re.sub(r"[;\s]+$", "", sql or "")
    if not text.strip():
        raise Refused("EMPTY_SQL", "there is no statement")
    parser = spark._jsparkSession.sessionState().sqlParser()
    try:
        plan = parser.parsePlan(text)
    except Exception as e:
        if len(_statements(text)) > 1:
            raise Refused("MULTIPLE_STATEMENTS", "one statement only") from e
        raise Refused("PARSE_ERROR", str(e).splitlines()[0]) from e
    relations, ctes, functions = set(), set(), set()
    for n in _nodes(plan.toJSON()):
        name = n["class"].rsplit(".", 1)[-1]
        package = n["class"]
        if ".plans.logical." in package or name == "UnresolvedRelation" or name.startswith("UnresolvedTableValued"):
            if name in ("UnresolvedTableValuedFunction", "UnresolvedTVFAliases"):
                raise Refused("TABLE_NOT_FOUND", "table functions are not tables")
            if name not in READING:
                code = "WRITE_STATEMENT" if re.search("Insert|Delete|Update|Merge|Create|Drop|Alter|Replace|Truncate|Rename|Add|Load|Write", name) else "NOT_A_SELECT"
                raise Refused(code, f"{name} is not a read")
        elif ".command." in package or ".execution." in package:
            raise Refused("NOT_A_SELECT", f"{name} is not a read")
        if name == "UnresolvedRelation":
            relations.add(tuple(_parts(n["multipartIdentifier"])))
        elif name == "UnresolvedFunction":
            functions.add(_parts(n["nameParts"])[-1].lower())
        elif name == "UnresolvedWith":
            ctes |= {x.lower() for x in re.findall(r"(?is)(?:\bwith\b(?:\s+recursive)?|,)\s*`?(\w+)`?\s*(?:\([^)]*\)\s*)?as\s*\(", text)}
    if functions & FORBIDDEN_FUNCTIONS:
        raise Refused("NOT_A_SELECT", f"not allowed: {sorted(functions & FORBIDDEN_FUNCTIONS)}")
    known = {t.lower(): t for t in tables}
    used = []
    for parts in relations:
        if len(parts) == 1 and parts[0].lower() in ctes:
            continue
        if len(parts) > 1 or parts[0].lower() not in known:
            raise Refused("TABLE_NOT_FOUND", f"no table {'.'.join(parts)}; there are {', '.join(sorted(tables))}")
        used.append(known[parts[0].lower()])
    if not used:
        raise Refused("NO_TABLES", "the statement reads no table")
    try:
        frame = spark.sql(text)
    except (AnalysisException, ParseException) as e:
        if (e.getCondition() or "").startswith("UNRESOLVED_COLUMN"):
            raise Refused("COLUMN_NOT_FOUND", str(e).splitlines()[0], **(e.getMessageParameters() or {})) from e
        raise Refused("EXPLAIN_FAILED", str(e).splitlines()[0]) from e
    return Checked(text, sorted(set(used)), frame)


def evidence(spark: SparkSession, sql: str, tables: set[str]) -> DataFrame:
    """The first rows of a checked statement that shows what a figure was made of."""
    return checked(spark, sql, tables).frame.limit(EVIDENCE_ROWS)


def _parts(x: Any) -> list[str]:
    return [p.strip() for p in x.strip("[]").split(",")] if isinstance(x, str) else list(x)


def _statements(text: str) -> list[str]:
    """Pieces between semicolons outside quotes."""
    return [x for x in re.split(r";(?=(?:[^'\"]|'[^']*'|\"[^\"]*\")*$)", text) if x.strip()]


def plain(value: Any) -> Any:
    """A result value as JSON has it."""
    if isinstance(value, Row):
        return plain(value.asDict(recursive=True))
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if isinstance(value, dt.datetime):
        return value.strftime("%Y-%m-%d %H:%M:%S")
    if isinstance(value, dt.date):
        return value.isoformat()
    if isinstance(value, dt.timedelta):
        return str(value)
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).decode("utf-8", "replace")
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [plain(v) for v in value]
    return value


@dataclass
class Result:
    columns: list[str]
    rows: list[dict]
    truncated: bool


def run(frame: DataFrame, cap: int = ROW_CAP, seconds: float = SECONDS) -> Result:
    """The first rows of a frame, cancelled at the time limit."""
    sc = frame.sparkSession.sparkContext
    group = f"query-{id(frame)}"
    out: dict[str, Any] = {}

    def work() -> None:
        sc.setJobGroup(group, "bounded query", interruptOnCancel=True)
        try:
            out["rows"] = frame.limit(cap + 1).collect()
        except PySparkException as e:
            out["error"] = e
        except Exception as e:  # py4j wraps what a cancelled job raises
            out["error"] = e

    t = threading.Thread(target=work, daemon=True)
    t.start()
    t.join(seconds)
    if t.is_alive():
        sc.cancelJobGroup(group)
        t.join(10)
        raise Refused("TIMEOUT", f"over {seconds} s")
    if "error" in out:
        raise Refused("EXECUTION_FAILED", str(out["error"]).splitlines()[0]) from out["error"]
    rows = [plain(r) for r in out["rows"]]
    return Result(frame.columns, rows[:cap], len(rows) > cap)
