"""Personal data: patterns propose, checksums confirm, context words score (operator 1).

DataFrame functions only.  Patterns propose spans; validators confirm them: byte values for addresses,
the Luhn digit for cards, mod-97 for IBANs, digit counts for phones.  A span's score starts from its
kind and rises by ``CONTEXT_GAIN`` where one of the kind's context words stands within ``REACH``
characters before or after it (and before the next match of the kind).  The kinds email, ip, card and phone are kept whatever their score; the
kinds that the method adds (iban, ssn) are kept from ``LEAST_SCORE`` on.

The patterns are the plain ones, written so that a Java matcher takes linear time and no recursion:
possessive loops, and starts only where a run starts or the last match ended.  Places of spans are sums over the
pieces between matches, made by doubling, so a text of n matches takes some n log n steps.

Defined results.  Null text is empty: counts 0 and no spans.  Offsets are code points.  Null ids keep
their row; repeated rows give repeated rows; an empty table gives an empty result; of the input only the
id and text columns are used, so other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REACH = 40
CONTEXT_GAIN = 0.3
LEAST_SCORE = 0.6

_LOCAL = r"[A-Za-z0-9._%+-]"
EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
#: Length of an IBAN: its countries.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH CR HN HR LI LV",
    22: "BG BH DE GB GE IE IM JE GG ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_OF_LENGTH = "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}+" for n, c in IBAN_LENGTHS.items())
#: By the country's length, so that words after the number are left; else, as for other countries, as far as it goes.
IBAN = rf"(?<![A-Za-z0-9])(?:(?:{_OF_LENGTH})(?![A-Za-z0-9])|[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]){{11,30}}+(?![A-Za-z0-9]))"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"

BYTE = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.|$)){4}$"

#: kind: pattern, what a text must hold for a match, first score, context words
KINDS = {
    "email": (EMAIL, "@", 0.9, "mail|contact|write"),
    "ip": (IP, ".", 0.7, "address|host|server|ip"),
    "card": (CARD, None, 0.8, "card|visa|master|credit|payment"),
    "phone": (PHONE, "+", 0.6, "phone|call|tel|mobile|fax"),
    "iban": (IBAN, None, 0.7, "iban|account|bank|transfer"),
    "ssn": (SSN, "-", 0.4, "ssn|social|security|taxpayer"),
}
BASE = ("email", "ip", "card", "phone")


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def mod97(x: Column) -> Column:
    """Whether a spelling of an IBAN leaves 1 when divided by 97."""
    bare = F.regexp_replace(x, " ", "")
    turned = F.concat(F.substring(bare, 5, 60), F.substring(bare, 1, 4))

    def add(rest: Column, char: Column) -> Column:
        code = F.ascii(char)
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97).cast("int")

    return F.aggregate(F.split(turned, ""), F.lit(0), lambda rest, c: F.when(c == "", rest).otherwise(add(rest, c))) == 1


def confirmed(kind: str, x: Column) -> Column:
    if kind == "ip":
        return x.rlike(BYTE)
    if kind == "card":
        return F.call_function("luhn_check", _digits(x))
    if kind == "phone":
        return F.length(_digits(x)).between(8, 15)
    if kind == "iban":
        return F.length(F.regexp_replace(x, " ", "")).between(15, 34) & mod97(x)
    if kind == "ssn":
        return ~x.rlike("^(?:000|666|9..)") & ~x.rlike("-00-|-0000$")
    return F.lit(True)


def _may_match(kind: str, text: Column) -> Column:
    """A cheap test that every text with a match passes."""
    sign = KINDS[kind][1]
    if sign:
        return F.contains(text, F.lit(sign))
    return text.rlike(r"[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]" if kind == "card" else r"[A-Z]{2}[0-9]{2}")


def _proposed(kind: str, text: Column) -> Column:
    """The matches of a kind's pattern."""
    return F.when(_may_match(kind, text), F.regexp_extract_all(text, F.lit(KINDS[kind][0]), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _running(x: Column, join) -> Column:
    """What ``join`` (a sum, a maximum) makes of the integers from 0 and up to each place of an array, by doubling."""
    n = F.size(x)
    rounds = F.sequence(F.lit(0), F.greatest(F.ceil(F.log2(n)).cast("int") - 1, F.lit(0)))

    def twice(so_far: Column, k: Column) -> Column:
        moved = F.concat(F.array_repeat(F.lit(0), F.call_function("shiftleft", F.lit(1), k)), so_far)
        return F.slice(F.zip_with(so_far, moved, join), 1, n)

    return F.aggregate(rounds, x, twice)


def _spans(kind: str) -> Column:
    """array<struct<kind,start,stop,score>> of the confirmed matches in columns m_kind and p_kind (pieces)."""
    words = rf"(?i)\b(?:{KINDS[kind][3]})"
    matches, pieces = F.col(f"m_{kind}"), F.col(f"p_{kind}")
    # the pieces have one element more than the matches
    before, after = F.slice(pieces, 1, F.size(matches)), F.slice(pieces, 2, F.size(matches))
    stops = _running(F.zip_with(before, matches, lambda b, m: F.length(b) + F.length(m)), lambda a, b: a + b)
    rows = F.arrays_zip(before.alias("before"), after.alias("after"), matches.alias("match"), stops.alias("stop"))

    def span(x: Column) -> Column:
        near = F.concat_ws(" ", F.right(x["before"], F.lit(REACH)), F.left(x["after"], F.lit(REACH))).rlike(words)
        score = F.least(F.lit(1.0), F.lit(KINDS[kind][2]) + F.when(near, F.lit(CONTEXT_GAIN)).otherwise(F.lit(0.0)))
        return F.struct(F.lit(kind).alias("kind"), (x["stop"] - F.length(x["match"])).alias("start"), x["stop"].alias("stop"), F.round(score, 2).alias("score"))

    kept = F.filter(rows, lambda x: confirmed(kind, x["match"]))
    found = F.transform(kept, span)
    if kind not in BASE:
        found = F.filter(found, lambda x: x["score"] >= LEAST_SCORE - 1e-9)
    return F.when(F.size(matches) == 0, F.array().cast("array<struct<kind:string,start:int,stop:int,score:double>>")).otherwise(found)


def _matched(docs: DataFrame, text_col: str) -> DataFrame:
    """docs with, per kind, the proposed matches and the pieces between them."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out = docs.withColumn("_text", text)
    out = out.withColumns({f"m_{k}": _proposed(k, F.col("_text")) for k in KINDS})
    return out.withColumns({f"p_{k}": F.when(F.size(f"m_{k}") > 0, F.split("_text", KINDS[k][0], -1)).otherwise(F.array().cast("array<string>")) for k in KINDS})


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, and found: its spans (kind, start, stop, score) by kind as listed in KINDS, then start."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return _matched(own, "text").select("doc_id", F.concat(*(_spans(k) for k in KINDS)).alias("found"))


def masked(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every span found replaced by its kind in brackets; of overlapping spans the first to start, then the longest, names all."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = _matched(docs, text_col).withColumn("_found", F.concat(*(_spans(k) for k in KINDS))).select(*docs.columns, "_found")
    order = F.array_sort(F.transform("_found", lambda x: F.struct(x["start"].alias("start"), (-x["stop"]).alias("back"), x["kind"].alias("kind"))))
    found = found.withColumn("_found", order).withColumn("_reach", _running(F.transform("_found", lambda x: -x["back"]), lambda a, b: F.greatest(a, b)))
    # a span that starts before where those before it reach belongs to them
    ahead = F.concat(F.array(F.lit(0)), F.slice("_reach", 1, F.size("_reach") - 1))
    first = F.filter(F.arrays_zip(F.col("_found").alias("span"), ahead.alias("ahead"), F.sequence(F.lit(0), F.size("_found") - 1).alias("i")), lambda x: (x["i"] == 0) | (x["span"]["start"] >= x["ahead"]))
    found = found.withColumn("_first", F.when(F.size("_found") > 0, first))

    def piece(whole: Column, a: Column, z: Column) -> Column:
        part = F.substring(whole, a * 4 + 1, (z - a) * 4)
        return F.concat(F.when(F.hex(F.substring(part, 1, 4)) == "0000FEFF", "\ufeff").otherwise(""), F.decode(part, "UTF-32"))

    def rewritten(whole: Column) -> Column:
        parts = F.transform("_first", lambda x: F.concat(piece(whole, x["ahead"], x["span"]["start"]), F.lit("["), F.upper(x["span"]["kind"]), F.lit("]")))
        return F.concat(F.array_join(parts, ""), piece(whole, F.element_at("_reach", -1), (F.octet_length(whole) / 4).cast("int")))

    # four bytes a character, so that a piece is found by its place; an element of an array, which is not copied at each use as a column would be
    whole = F.transform(F.array(F.encode(text, "UTF-32")), rewritten)[0]
    return found.withColumn(text_col, F.when(F.size("_found") > 0, whole).otherwise(F.col(text_col))).select(*docs.columns)


def _listed(kinds: tuple[str, ...] | None = None) -> Column:
    found = F.col("found") if kinds is None else F.filter("found", lambda x: x["kind"].isin(*kinds))
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")


def _is(kind: str):
    return lambda x: x["kind"] == kind


def op1_pii(spark, sf_dir: str) -> DataFrame:
    """Operator 1 over all documents."""
    out = personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    counts = [F.size(F.filter("found", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *counts, F.sha2(_listed(BASE), 256).alias("base_sha256"), _listed().alias("spans"), F.array_join(F.transform("found", lambda x: x["score"].cast("string")), ",").alias("scores"))
