"""Column and table names as columns: tokens, singulars, and safe spellings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The abbreviations that names are expanded by.
ABBREVIATIONS = {
    "emp": "employee",
    "empl": "employee",
    "cust": "customer",
    "custm": "customer",
    "dept": "department",
    "dep": "department",
    "qty": "quantity",
    "amt": "amount",
    "num": "number",
    "no": "number",
    "nbr": "number",
    "dt": "date",
    "id": "identifier",
    "code": "identifier",
    "ref": "identifier",
    "key": "identifier",
    "org": "organisation",
    "mgr": "manager",
    "addr": "address",
    "desc": "description",
    "prod": "product",
    "cat": "category",
    "txn": "transaction",
    "trans": "transaction",
    "acct": "account",
    "yr": "year",
    "mth": "month",
    "mon": "month",
}
MAX_NAME = 48


def singular(token: Column) -> Column:
    """English plural folded to its singular; short words and -ss, -us, -is, -as, -os stay."""
    cut = F.length(token)
    return (
        F.when((cut < 4) | F.right(token, F.lit(2)).isin("ss", "us", "is", "as", "os"), token)
        .when(token.endswith("ies"), F.concat(F.left(token, cut - 3), F.lit("y")))
        .when(F.right(token, F.lit(4)).isin("ches", "shes") | F.right(token, F.lit(3)).isin("xes", "zes"), F.left(token, cut - 2))
        .when(token.endswith("s"), F.left(token, cut - 1))
        .otherwise(token)
    )


def expanded(token: Column) -> Column:
    """A lower-case token with its abbreviation written out, else its singular."""
    known = F.create_map(*(F.lit(x) for pair in ABBREVIATIONS.items() for x in pair))
    return F.when(token.isin(*ABBREVIATIONS), F.try_element_at(known, token)).otherwise(singular(token))


def name_tokens(name: Column) -> Column:
    """Tokens of a camelCase or snake_case name, lower-case, expanded."""
    spaced = F.regexp_replace(name, "(?<=[a-z0-9])(?=[A-Z])", " ")
    parts = F.filter(F.split(F.regexp_replace(spaced, "[^0-9a-zA-Z]+", " "), " "), lambda x: x != "")
    return F.transform(parts, lambda x: expanded(F.lower(x)))


def safe_name(raw: Column, position: Column) -> Column:
    """A header cell as a column name: lower case, underscores, no leading digits, at most MAX_NAME long."""
    flat = F.trim(F.regexp_replace(F.lower(F.coalesce(raw, F.lit(""))), "[^0-9a-z]+", "_"), F.lit("_"))
    bare = F.when(flat.rlike("^[0-9]+$"), F.concat(F.lit("n"), flat)).otherwise(F.regexp_replace(flat, "^[0-9_]+", ""))
    whole = F.regexp_extract(F.left(bare, F.lit(MAX_NAME)), "^(.*)_[^_]*$", 1)
    short = F.when(F.length(bare) <= MAX_NAME, bare).when(whole != "", whole).otherwise(F.left(bare, F.lit(MAX_NAME)))
    return F.when(short == "", F.concat(F.lit("col_"), position.cast("string"))).otherwise(short)
