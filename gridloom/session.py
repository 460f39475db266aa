"""One analytics session: files in, typed tables, profiles, relationships and checked queries out."""

from __future__ import annotations

import re
import uuid
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import blocks, fuse, graph, infer, profile, relate
from .plans import grounding, guard, present
from .plans import route as routing
from .sources import grids
from .sources.store import written

TABLE = ("file", "sheet", "role", "block")


class Session:
    """Tables of one session, as views of a Spark session of their own."""

    def __init__(self, spark: SparkSession):
        self.spark = spark.newSession()
        self.tables: dict[str, DataFrame] = {}
        self.sources: dict[str, tuple[str, str]] = {}
        self.relationships: DataFrame | None = None
        self.undecided: DataFrame | None = None
        self.profiles: DataFrame | None = None

    def add_files(self, *paths: str) -> list[str]:
        """Read, type, fuse and relate the tables of the files; all of them are staged before any is registered."""
        found = blocks.sheets(grids.read_cells(self.spark, *paths))
        key = F.sha1(F.concat_ws("\x01", *TABLE))
        # a folder a table, so that each is read alone; the types of all columns of all tables are one aggregate
        long = written(found.withColumn("table_key", key), "cells", "table_key")
        votes = infer.decided(long.select(F.struct("table_key", "column_name").alias("column_name"), F.col("col").alias("position"), infer.cells.cleaned(F.col("value")).alias("v")))
        kinds: dict[str, dict] = defaultdict(dict)
        for r in votes.orderBy("position").collect():
            kinds[r["column_name"]["table_key"]][r["column_name"]["column_name"]] = r
        staged, sources = dict(self.tables), dict(self.sources)
        for r in long.select(*TABLE, "table_key").distinct().orderBy(*TABLE).collect():
            name = self._alias(r["file"], r["sheet"], r["role"], r["block"], staged)
            own = kinds[r["table_key"]]
            wide = long.where(F.col("table_key") == r["table_key"]).groupBy("row").pivot("column_name", list(own)).agg(F.first("value")).drop("row")
            staged[name] = written(infer.retyped(wide, own), name)
            sources[name] = (r["file"], r["sheet"])
        self._register(fuse.fused(staged), sources)
        return list(self.tables)

    def add_table(self, name: str, df: DataFrame) -> None:
        """A table of any session of this application, which all its sessions can see under a name of its own."""
        seen = f"gridloom_{uuid.uuid4().hex}"
        df.createGlobalTempView(seen)
        df = self.spark.table(f"global_temp.{seen}")
        self._register({**self.tables, name: df}, {**self.sources, name: (name, "")})

    @staticmethod
    def _alias(file: str, sheet: str | None, role: str, block: int, taken: dict) -> str:
        stem = sheet if sheet and not re.fullmatch(r"(?i)sheet\d*", sheet) else file.rsplit(".", 1)[0]
        base = re.sub("[^0-9a-z]+", "_", stem.lower()).strip("_") or "table"
        base = f"{base}_details" if role == "details" else f"{base}_{block}" if block > 1 else base
        n, name = 2, base
        while name in taken:
            name, n = f"{base}_{n}", n + 1
        return name

    def _register(self, tables: dict[str, DataFrame], sources: dict[str, tuple[str, str]]) -> None:
        for gone in set(self.tables) - set(tables):
            self.spark.catalog.dropTempView(gone)
        self.tables, self.sources = dict(tables), {n: sources.get(n, (n, "")) for n in tables}
        self.profiles = written(profile.profiles(tables), "profiles")
        for view, df in zip(("schema_tables", "schema_columns"), profile.catalog_of(self.profiles, {n: f for n, (f, _) in self.sources.items()}), strict=True):
            written(df, view).createOrReplaceTempView(view)
        self._rediscover()
        for name, df in self.tables.items():
            df.createOrReplaceTempView(name)

    def _rediscover(self) -> None:
        if len(self.tables) < 2:
            return
        found, undecided = relate.related(self.tables, self.profiles)
        if self.relationships is not None:
            found = graph.rediscovered(self.relationships, found, list(self.tables))
        self.relationships, self.undecided = written(found, "relationships"), written(undecided, "undecided")
        # keys of dates cut to a unit are columns of the tables that they join
        for r in self.relationships.where("kind = 'derived'").collect():
            for table, (column,) in ((r["left_table"], r["left_columns"]), (r["right_table"], r["right_columns"])):
                date, _, unit = column.rpartition("__")
                self.tables[table] = fuse.with_grain(self.tables[table], date, unit)

    def decide(self, id_: str, status: str) -> None:
        self.relationships = graph.decided(self.relationships, id_, status)

    def add_relationship(self, left: str, left_columns: list[str], right: str, right_columns: list[str]) -> str:
        """State a relationship; it stays whatever is found later."""
        own = written(relate.given(self.tables, left, left_columns, right, right_columns), "given")
        known = own if self.relationships is None else self.relationships.join(own.select("id"), "id", "left_anti").select(*own.columns).unionByName(own)
        self.relationships = written(known, "relationships")
        return own.first()["id"]

    def resolve(self, name: str) -> DataFrame:
        """A table by its name, in any case."""
        found = {n.lower(): df for n, df in self.tables.items()}.get(name.lower())
        if found is None:
            raise KeyError(f"no table {name}; there are {', '.join(sorted(self.tables))}")
        return found

    def components(self) -> DataFrame:
        nodes = self.spark.createDataFrame([(n,) for n in self.tables], "node string")
        edges = graph.active(self.relationships).select(F.col("left_table").alias("a"), F.col("right_table").alias("b"))
        return graph.components(nodes, edges)

    def route(self, question: str) -> routing.Route:
        """The tables that a question is about."""
        return routing.route(routing.table_terms(self.profiles, self.sources), question, self.relationships)

    def sql(self, text: str, cap: int = guard.ROW_CAP, seconds: float = guard.SECONDS) -> dict:
        """Rows up to the cap, and what they say; all but the rows is made from these."""
        found = guard.checked(self.spark, text, {*self.tables, "schema_tables", "schema_columns"})
        result = guard.run(found.frame, cap, seconds)
        names = [*self.tables, *(c for n in found.tables if n in self.tables for c in self.tables[n].columns)]
        return {
            "sql": found.sql,
            "tables": found.tables,
            "columns": result.columns,
            "rows": result.rows,
            "truncated": result.truncated,
            "chart": present.chart(found.frame, rows=result.rows),
            "summary": present.describe(result.columns, result.rows, result.truncated),
            "caveat": grounding.caveat(grounding.ungrounded(self.spark, found.sql, names)),
        }
