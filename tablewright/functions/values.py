"""Fields as numbers and as text: the number grammar, missing tokens, case folding."""

from __future__ import annotations

from pyspark.sql import Column, functions as F
from pyspark.sql.types import DataType, NumericType

#: Whole fields that mean a missing value, compared without case.
MISSING = ("na", "n/a", "nan")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Leading blanks, then a whole number: decimal, hexadecimal, infinity or not-a-number (with an optional payload).
NUMBER = (
    r"^[ \t\n\r\x0B\f]*[+-]?(?:(?i:inf(?:inity)?|nan(?:\([0-9A-Za-z_]*\))?)"
    r"|0[xX](?:[0-9A-Fa-f]+\.?[0-9A-Fa-f]*|\.[0-9A-Fa-f]+)(?:[pP][+-]?[0-9]+)?"
    r"|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)$"
)
NAN, INF = float("nan"), float("inf")


def fold(text: Column) -> Column:
    """A-Z as a-z; every other character stays."""
    return F.translate(text, UPPER, LOWER)


def unless_missing(column: Column, kind: DataType, narm: bool) -> Column:
    """The column, null where ``narm`` is on and the field is a missing token. Numeric columns have NaN for it."""
    if not narm:
        return column
    if isinstance(kind, NumericType):
        return F.when(~F.isnan(column.cast("double")), column)
    return F.when(~F.lower(column).isin(*MISSING), column)


def number(column: Column, kind: DataType, label: str, separator: str = ".") -> Column:
    """A field as a double. A text field that isn't a number raises an error that names field and value."""
    if isinstance(kind, NumericType):
        return column.cast("double")
    text = column if separator == "." else F.replace(F.replace(column, F.lit("."), F.lit("?")), F.lit(separator), F.lit("."))
    bare = F.regexp_replace(text, r"^[ \t\n\r\x0B\f]*\+?", "")
    # Hexadecimal numbers need an exponent here; not-a-number may have a sign or a payload.
    value = F.coalesce(bare.try_cast("double"), F.concat(bare, F.lit("p0")).try_cast("double"), F.lit(NAN))
    bad = F.raise_error(F.concat(F.lit(f"invalid numeric value in field {label}: '"), column, F.lit("'"))).cast("double")
    return F.when(column.isNotNull(), F.when(text.rlike(NUMBER), value).otherwise(bad))
