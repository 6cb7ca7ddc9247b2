"""Numbers as the C library's printf shows them, and result labels."""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column, functions as F

from tablewright.errors import UserError

DEFAULT = "%.14g"
_FORMAT = re.compile(r"^(?P<before>(?:[^%]|%%)*)%(?P<flags>[-+ #0']*)(?P<width>\d*)(?:\.(?P<digits>\d*))?(?P<kind>[aefgAEFG])(?P<after>(?:[^%]|%%)*)$")


def parse_format(text: str) -> re.Match:
    """The parts of a format with one numeric directive; at most 99 bytes."""
    if len(text.encode()) > 99:
        raise UserError("format is longer than 99 bytes")
    found = _FORMAT.match(text)
    if not found:
        raise UserError(f"format '{text}' needs exactly one % directive of a, e, f, g, A, E, F or G")
    return found


def _hexadecimal(value: float, digits: int | None) -> str:
    """C's %a of a double's magnitude."""
    if value == 0:
        return "0x0" + ("." + "0" * digits if digits else "") + "p+0"
    fraction, exponent = math.frexp(value)
    fraction, exponent = fraction * 2, exponent - 1
    places = 13 if digits is None else digits
    scaled = round(fraction * 16**places) if places <= 13 else int(fraction * 16**13) * 16 ** (places - 13)
    whole, rest = divmod(scaled, 16**places)
    tail = f"{rest:0{places}x}" if places else ""
    if digits is None:
        tail = tail.rstrip("0")
    return f"0x{whole}{'.' + tail if tail else ''}p{exponent:+d}"


def show(value: float | None, format: str = DEFAULT) -> str:
    """One number in printf style. Infinities and NaN keep their sign and ignore zero padding."""
    return _show(value, parse_format(format))


def _show(value: float | None, found: re.Match) -> str:
    flags, kind = found["flags"], found["kind"]
    value = math.nan if value is None else float(value)
    digits = None if found["digits"] is None else int(found["digits"] or 0)
    negative = math.copysign(1, value) < 0
    body = abs(value)
    if math.isnan(value) or math.isinf(value):
        shown, flags = ("nan" if math.isnan(value) else "inf"), flags.replace("0", "")
    elif kind in "aA":
        shown = _hexadecimal(body, digits)
    else:
        group = "," if "'" in flags and kind in "fFgG" else ""
        shown = format_spec(body, f"{'#' if '#' in flags else ''}{group}.{6 if digits is None else digits}{kind.lower()}")
    if kind.isupper():
        shown = shown.upper()
    sign = "-" if negative else "+" if "+" in flags else " " if " " in flags else ""
    width = int(found["width"] or 0)
    if "-" in flags:
        shown = (sign + shown).ljust(width)
    elif "0" in flags:
        shown = sign + shown.rjust(width - len(sign), "0")
    else:
        shown = (sign + shown).rjust(width)
    return found["before"].replace("%%", "%") + shown + found["after"].replace("%%", "%")


def format_spec(value: float, spec: str) -> str:
    return format(value, spec)


def shown(column: Column, format: str = DEFAULT) -> Column:
    """A numeric column as text in printf style; null stays null. For sinks: values stay typed until then."""
    parse_format(format)
    simple = re.fullmatch(r"%(\.\d+[efg])", format)
    spec = simple[1] if simple else None

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        found = parse_format(format)
        if spec is None:
            return pd.Series([_show(x, found) for x in values.to_list()], index=values.index)
        return pd.Series([format_spec(x, spec) if math.isfinite(x) else _show(x, found) for x in values.to_list()], index=values.index)

    return F.when(column.isNotNull(), run(column.cast("double")))


def rounded(places: int) -> str:
    """The format of ``--round``: 1 to 50 decimals."""
    if not 1 <= places <= 50:
        raise UserError("rounding takes 1 to 50 decimals")
    return f"%.{places}f"
