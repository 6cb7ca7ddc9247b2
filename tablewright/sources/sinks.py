"""Results as lines of text: delimited or CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import FractionalType

from tablewright.errors import UserError
from tablewright.functions.display import DEFAULT, shown
from tablewright.operators.summary import quoted


def cell(df: DataFrame, name: str, format: str = DEFAULT) -> Column:
    """A column as text: fractional numbers in printf style, everything else as it is; null is empty."""
    kind = df.schema[name].dataType
    text = shown(quoted(name), format) if isinstance(kind, FractionalType) else quoted(name).cast("string")
    return F.coalesce(text, F.lit(""))


def csv_quoted(text: Column) -> Column:
    """A CSV cell: quoted if empty or with a comma, quote or line end in it."""
    return F.when((text == "") | text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def lines(df: DataFrame, delimiter: str = "\t", csv: bool = False, format: str = DEFAULT, columns: list[str] | None = None) -> DataFrame:
    """(value): a line for each row, in the row order of ``df``."""
    cells = [cell(df, c, format) for c in columns or df.columns]
    return df.select(F.concat_ws("," if csv else delimiter, *[csv_quoted(c) if csv else c for c in cells]).alias("value"))


def header_line(names: list[str], delimiter: str = "\t", csv: bool = False) -> str:
    if not csv:
        return delimiter.join(names)
    return ",".join('"' + n.replace('"', '""') + '"' if n == "" or any(x in n for x in ',"\r\n') else n for n in names)


def renamed(names: list[str], wanted: dict[int, str]) -> list[str]:
    """Result names with some replaced by number from 1."""
    out = list(names)
    for i, name in wanted.items():
        if not 1 <= i <= len(out):
            raise UserError(f"there is no result {i} to name")
        if not name:
            raise UserError("a result name is not empty")
        out[i - 1] = name
    return out
