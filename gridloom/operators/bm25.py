"""BM25 ranking as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import expanded

K1, B, EPSILON = 1.5, 0.75, 0.25
TOP = 4
# Words that say nothing about a table.
STOPWORDS = (
    "the",
    "a",
    "an",
    "of",
    "in",
    "on",
    "for",
    "to",
    "and",
    "or",
    "is",
    "are",
    "was",
    "were",
    "by",
    "with",
    "what",
    "which",
    "how",
    "many",
    "much",
    "show",
    "me",
    "list",
    "give",
    "get",
    "per",
    "each",
    "total",
    "all",
    "from",
    "that",
    "this",
    "it",
    "do",
    "does",
    "did",
    "be",
    "been",
    "has",
    "have",
    "had",
    "at",
    "as",
    "we",
    "our",
)


def _spelled(text: Column) -> Column:
    """Words and numbers as they are spelled.

    Lower case makes ASCII letters of two other letters only, so of other texts only the words are lowered: whole texts that are
    not ASCII take long.
    """
    plain = F.when(text.rlike("[\u0130\u212a]"), F.lower(text)).otherwise(text)
    return F.regexp_extract_all(plain, F.lit(r"[a-zA-Z][a-zA-Z0-9]*|\d+"), F.lit(0))


def words(text: Column) -> Column:
    """Lower-case words and numbers without stop words."""
    return F.filter(F.transform(_spelled(text), F.lower), lambda w: ~w.isin(*STOPWORDS))


def tokens(text: Column) -> Column:
    """Words expanded like column names; a lower-case word is one token of a name."""
    return F.transform(words(text), expanded)


def term_counts(docs: DataFrame, id_col: str, terms: Column) -> DataFrame:
    """(doc, term, tf)."""
    long = docs.select(F.col(id_col).alias("doc"), F.explode(terms).alias("term"))
    return long.groupBy("doc", "term").agg(F.count(F.lit(1)).alias("tf"))


def text_terms(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    """As ``term_counts`` of ``tokens(text)``: words are rows before they are expanded, as expressions over rows are compiled and such over arrays are not."""
    long = docs.select(F.col(id_col).alias("doc"), F.explode(_spelled(text)).alias("word")).select("doc", F.lower("word").alias("word"))
    return long.where(~F.col("word").isin(*STOPWORDS)).groupBy("doc", expanded(F.col("word")).alias("term")).agg(F.count(F.lit(1)).alias("tf"))


def ranked(counts: DataFrame, n_docs: int, query: DataFrame, top: int = TOP) -> DataFrame:
    """(doc, score, rank) of the top documents for query(term); ties go to the smaller doc.  counts is read several times: a written table.

    A term that over half of the documents hold counts EPSILON times the mean weight of all terms.
    """
    lengths = counts.groupBy("doc").agg(F.sum("tf").alias("len"))
    mean = lengths.agg((F.sum("len") / n_docs).alias("avg_len"))
    df = counts.where(F.col("term").isNotNull()).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weighed = df.select("term", F.log((n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("raw"))
    floor = weighed.agg((F.avg("raw") * EPSILON).alias("floor"))
    asked = weighed.join(F.broadcast(query.groupBy("term").agg(F.count(F.lit(1)).alias("asked"))), "term")
    # a question's words are few, so all other counts leave before anything is shuffled
    held = counts.join(F.broadcast(query.select("term").distinct()), "term", "left_semi")
    hits = held.join(F.broadcast(asked), "term").join(lengths, "doc").crossJoin(F.broadcast(mean)).crossJoin(F.broadcast(floor))
    idf = F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw"))
    part = idf * F.col("asked") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    scores = hits.groupBy("doc").agg(F.sum(part).alias("score")).where(F.col("score") > 0)
    return scores.orderBy(F.desc("score"), "doc").limit(top).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "doc")))
