"""Text cells as columns: kinds, null spellings, numbers, dates and booleans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of a missing value, in lower case.
NULL_TOKENS = (
    "na",
    "n/a",
    "#n/a",
    "null",
    "none",
    "nil",
    "nan",
    "-",
    "--",
    "?",
    "#null!",
    "#value!",
    "#div/0!",
    "(blank)",
    "unknown",
    "not available",
)
# Spellings of booleans, and the shapes of figures and dates.
TRUE_TOKENS = ("true", "yes", "y", "t", "1")
FALSE_TOKENS = ("false", "no", "n", "f", "0")

NUMERIC_LIKE = r"^[\s$€£₹(]*-?[\d,]+(\.\d+)?\s*[%)]?$"
DATE_LIKE = r"^\d{1,4}[-/]\d{1,2}[-/]\d{1,4}"
EU_DECIMAL = r"^[^\d-]*-?\d{1,3}(\.\d{3})*,\d{1,2}[^\d]*$"
US_DECIMAL = r"^[^\d-]*-?\d{1,3}(,\d{3})*\.\d{1,2}[^\d]*$"
#: What no spelling of a number holds.
NO_NUMBER = r"[^0-9eE+\-.,$€£₹¥%()\s\x{85}\x{2028}\x{2029}]"
NUMBER = r"^-?\d*\.?\d+([eE][-+]?\d+)?$"
DAY_MONTH = r"^(\d{1,2})[/-](\d{1,2})[/-]\d{2,4}"
# days and months that no calendar has are left out here, as a failed parse costs many times a match
_DAY, _MONTH = r"(?:0?[1-9]|[12]\d|3[01])", r"(?:0?[1-9]|1[0-2])"
#: Spark datetime patterns that a column can be in, and the text that each takes.
DATE_FORMATS = {
    "yyyy-M-d": r"^\d{4}-\d{1,2}-\d{1,2}$",
    "yyyy-MM": r"^\d{4}-\d{2}$",
    "yyyy/M/d": r"^\d{4}/\d{1,2}/\d{1,2}$",
    "d/M/yyyy": rf"^{_DAY}/{_MONTH}/\d{{4}}$",
    "M/d/yyyy": rf"^{_MONTH}/{_DAY}/\d{{4}}$",
    "d-M-yyyy": rf"^{_DAY}-{_MONTH}-\d{{4}}$",
    "M-d-yyyy": rf"^{_MONTH}-{_DAY}-\d{{4}}$",
    "d MMM yyyy": r"^\d{1,2} [A-Za-z]{3} \d{4}$",
    "yyyyMMdd": r"^(19|20)\d{6}$",
    "yyyy-MM-dd HH:mm:ss": r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$",
    "yyyy-MM-dd'T'HH:mm:ss": r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$",
    "yyyy-MM-dd'T'HH:mm:ssXXX": r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}([+-]\d{2}:\d{2}|Z)$",
}
DAY_FIRST, MONTH_FIRST = ("d/M/yyyy", "d-M-yyyy"), ("M/d/yyyy", "M-d-yyyy")


def cleaned(cell: Column) -> Column:
    """Trimmed text; null where nothing or a spelling of a missing value is left."""
    bare = F.regexp_replace(cell, r"^\s+|\s+$", "")
    return F.when((bare != "") & ~F.lower(bare).isin(*NULL_TOKENS), bare)


def kind(cell: Column) -> Column:
    """empty, date, number or text."""
    return F.when(cell.isNull() | (cell == ""), "empty").when(cell.rlike(DATE_LIKE), "date").when(cell.rlike(NUMERIC_LIKE), "number").otherwise("text")


def number_text(cell: Column, european: Column) -> Column:
    """A number's spelling as plain digits; null where it is not a number.  The percent sign divides by 100 in ``number``."""
    local = F.when(european, F.replace(F.replace(cell, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(cell)
    signed = F.regexp_replace(local, r"^\((.*)\)$", "-$1")
    bare = F.regexp_replace(F.regexp_replace(signed, "%$", ""), r"[$€£₹¥,\s]", "")
    return F.when(~cell.rlike(NO_NUMBER), F.when(bare.rlike(NUMBER), bare))


def number(cell: Column, european: Column) -> Column:
    value = number_text(cell, european).try_cast("double")
    return F.when(cell.rlike(r"%\)?$"), value / 100).otherwise(value)


def is_integer_text(cell: Column) -> Column:
    return cell.rlike(r"^[-+]?\d+$")


def overflows(cell: Column) -> Column:
    """Whether a plain integer is beyond 64 bits."""
    digits = F.regexp_replace(cell, "^[-+]?0*", "")
    return (F.length(cell) >= 19) & is_integer_text(cell) & ((F.length(digits) > 19) | ((F.length(digits) == 19) & (digits > "9223372036854775807")))


def day(cell: Column, group: int) -> Column:
    """First or second number of a d/m/y spelling; null for other text."""
    return F.when(cell.rlike(DAY_MONTH), F.regexp_extract(cell, DAY_MONTH, group).try_cast("int"))


def parsed(cell: Column, pattern: str) -> Column:
    return F.when(cell.rlike(DATE_FORMATS[pattern]), F.try_to_timestamp(cell, F.lit(pattern))).cast("timestamp_ntz")


def boolean(cell: Column) -> Column:
    low = F.lower(cell)
    return F.when(low.isin(*TRUE_TOKENS), True).when(low.isin(*FALSE_TOKENS), False)
