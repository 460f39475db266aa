"""Which tables a question is about: BM25 over what the tables are called, then their confirmed neighbours."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bm25, graph
from ..sources.store import written

NAME_WEIGHT, CATEGORY_VALUES, EXPANSION = 3, 5, 2
CATALOG = ("schema_tables", "schema_columns")
# Words by which questions ask for the catalog.
CATALOG_WORDS = ("schema", "catalog", "file", "files", "table", "tables", "column", "columns", "present", "contain", "contains", "inside", "overview", "describe", "structure", "uploaded")


@dataclass
class Route:
    tables: list[str]
    retrieved: list[str]
    expanded: list[str] = field(default_factory=list)
    scores: dict[str, float] = field(default_factory=dict)
    matched: dict[str, list[str]] = field(default_factory=dict)


def table_terms(profiles: DataFrame, sources: dict[str, tuple[str, str]]) -> DataFrame:
    """(doc, term), as often as a term stands in a table's document.

    A document is the table's name (three times), its file and sheet, its columns' names and tokens, and the samples of its
    categories; the catalog's tables have fixed words instead.  profiles: see ``profile.profiles``; sources: file and sheet by table.
    """
    spark = profiles.sparkSession
    places = spark.createDataFrame([(n, f, s) for n, (f, s) in sources.items()], "table_name string, file string, sheet string")
    named = places.select("table_name", F.flatten(F.array_repeat(bm25.tokens(F.col("table_name")), NAME_WEIGHT)).alias("terms"))
    located = places.select("table_name", F.concat(bm25.tokens(F.coalesce("file", F.lit(""))), bm25.tokens(F.coalesce("sheet", F.lit("")))).alias("terms"))
    held = F.when(F.col("semantic_type") == "category", F.flatten(F.transform(F.slice("samples", 1, CATEGORY_VALUES), bm25.tokens))).otherwise(F.array().cast("array<string>"))
    columns = profiles.select("table_name", F.concat(bm25.tokens(F.col("column_name")), F.col("name_tokens"), held).alias("terms"))
    fixed = spark.createDataFrame([(n, " ".join(CATALOG_WORDS)) for n in CATALOG], "table_name string, words string")
    catalog = fixed.select("table_name", F.concat(F.flatten(F.array_repeat(bm25.tokens(F.col("table_name")), NAME_WEIGHT)), bm25.tokens(F.col("words"))).alias("terms"))
    every = reduce(DataFrame.unionByName, (named, located, columns, catalog))
    return every.select(F.col("table_name").alias("doc"), F.explode("terms").alias("term"))


def asked_terms(spark: SparkSession, question: str) -> DataFrame:
    return spark.range(1).select(F.explode(bm25.tokens(F.lit(question))).alias("term"))


def route(terms: DataFrame, question: str, relationships: DataFrame | None = None, top: int = bm25.TOP) -> Route:
    """The best tables for a question; terms: (doc, term) of all tables, a row a table's word.

    Tables that score above 0, else the first by name; the catalog alone if it is first, else without it; and up to
    EXPANSION tables that a confirmed relationship joins to them.
    """
    spark = terms.sparkSession
    counts = written(terms.groupBy("doc", "term").agg(F.count(F.lit(1)).alias("tf")), "terms")
    names = sorted(r[0] for r in counts.select("doc").distinct().collect())
    asked = asked_terms(spark, question)
    found = [(r["doc"], r["score"]) for r in bm25.ranked(counts, len(names), asked, top).orderBy("rank").collect()] or [(n, 0.0) for n in names[:top]]
    catalog_first = found[0][0] in CATALOG if found else False
    found = [x for x in found if (x[0] in CATALOG) == catalog_first]
    retrieved = [n for n, _ in found]
    words = [r[0] for r in asked.collect()]
    own = {r["doc"]: set(r["terms"]) for r in counts.where(F.col("doc").isin(retrieved)).groupBy("doc").agg(F.collect_set("term").alias("terms")).collect()}
    out = Route(list(retrieved), retrieved, scores={n: round(s, 3) for n, s in found}, matched={n: [w for w in dict.fromkeys(words) if w in own.get(n, ())] for n in retrieved})
    for name in retrieved if relationships is not None else []:
        for (near,) in graph.neighbours(relationships, name).orderBy("table_name").collect():
            if len(out.expanded) < EXPANSION and near not in out.tables:
                out.tables.append(near)
                out.expanded.append(near)
    return out
