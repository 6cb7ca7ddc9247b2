"""Delimited text, whitespace-separated text and vnlog as tables of (rid, fields)."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tablewright.errors import UserError

COMMENT = r"^[ \t]*[#;]"


@dataclass(frozen=True)
class TextTable:
    """A ragged table in row order (``rid``, ``raw``, ``fields``; rid numbers lines from 1) and its header's names, if it has one."""

    rows: DataFrame
    names: tuple[str, ...] | None = None

    def position(self, selector: str) -> int:
        """A field's number from 1: given as a number, or by name (the first of equal names)."""
        if selector.isdigit():
            if int(selector) < 1:
                raise UserError("field numbers start at 1")
            return int(selector)
        if self.names is None:
            raise UserError(f"field name '{selector}' needs a header")
        if selector not in self.names:
            raise UserError(f"there is no field named '{selector}'")
        return self.names.index(selector) + 1

    def label(self, position: int) -> str:
        return self.names[position - 1] if self.names and position <= len(self.names) else f"field-{position}"

    def columns(self, positions: dict[str, int]) -> DataFrame:
        """(rid, one text column for each name); a row without the field is an error."""

        def cell(p: int) -> Column:
            gone = F.raise_error(F.concat(F.lit("line "), F.col("rid").cast("string"), F.lit(f": field {p} is missing (the line has "), F.size("fields").cast("string"), F.lit(" fields)"))).cast("string")
            return F.when(F.size("fields") >= p, F.get("fields", F.lit(p - 1))).otherwise(gone)

        return self.rows.select("rid", *[cell(p).alias(name) for name, p in positions.items()])


#: File blocks whose line counts may be broadcast: a row of about 200 bytes each.
BLOCKS = 100_000


def ordered_lines(spark: SparkSession, path: str, terminator: str = "\n") -> DataFrame:
    """(rid, value) of a text file or folder: lines numbered from 1 in order of file, block and place.

    Lines never move. Of one file in one block they are numbered as they are read; otherwise lines are counted for each
    block in a pass of its own, and the counts, a row for each block, are added up and joined back.
    """
    lines = spark.read.option("lineSep", terminator).text(path).select(
        F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_seq"), "value"
    )
    files = len(lines.inputFiles())
    parts = lines.rdd.getNumPartitions()
    if files <= 1 and parts <= 1:
        return lines.select((F.col("_seq") + 1).alias("rid"), "value")
    block = ["_path", "_at"]
    counts = lines.groupBy(*block).agg(F.count("*").alias("_n"), F.min("_seq").alias("_least"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(*block, (before - F.col("_least") + 1).alias("_shift"))
    # A partition has one block of a large file, or several small files.
    small = files + parts <= BLOCKS
    return lines.join(F.broadcast(offsets) if small else offsets, block).select((F.col("_seq") + F.col("_shift")).alias("rid"), "value")


def split_fields(value: Column, separator: str = "\t", whitespace: bool = False) -> Column:
    """A line's fields. An empty line has none; blanks at the end of a ``whitespace`` line leave one empty field."""
    if whitespace:
        blank = F.when(value == "", F.array().cast("array<string>")).otherwise(F.array(F.lit("")))
        return F.when(value.rlike("^[ \t]*$"), blank).otherwise(F.split(F.regexp_replace(value, "^[ \t]+", ""), "[ \t]+", -1))
    return F.when(value == "", F.array().cast("array<string>")).otherwise(F.split(value, re.escape(separator), -1))


def read_text(
    spark: SparkSession, path: str, separator: str = "\t", whitespace: bool = False, zero_terminated: bool = False, skip_comments: bool = False, header: bool = False, vnlog: bool = False
) -> TextTable:
    """A text table. ``header`` takes the first line that isn't skipped as names.

    ``skip_comments`` leaves out lines whose first character other than a blank is # or ;. ``vnlog`` reads whitespace
    columns whose names stand after the first line that begins with a single #, and drops everything after a later #.
    """
    if len(separator) != 1:
        raise UserError("the field separator is one character")
    lines = ordered_lines(spark, path, "\0" if zero_terminated else "\n")
    if vnlog:
        first = lines.where(F.col("value").rlike(r"^[ \t]*#(?![#!])[ \t]*\S")).orderBy("rid").first()
        data = lines.withColumn("value", F.regexp_replace("value", r"[ \t]*#.*$", "")).where(~F.col("value").rlike(r"^[ \t]*$"))
        if first is None:
            if data.limit(1).count():
                raise UserError("vnlog data without a header")
            names: tuple[str, ...] = ()
        else:
            names = tuple(first.value.strip()[1:].split())
            data = data.where(F.col("rid") > first.rid)
        return TextTable(data.select("rid", F.col("value").alias("raw"), split_fields(F.col("value"), whitespace=True).alias("fields")), names)
    if skip_comments:
        lines = lines.where(~F.col("value").rlike(COMMENT))
    rows = lines.select("rid", F.col("value").alias("raw"), split_fields(F.col("value"), separator, whitespace).alias("fields"))
    if not header:
        return TextTable(rows)
    top = rows.orderBy("rid").first()
    return TextTable(rows.where(F.col("rid") > (top.rid if top else 0)), tuple(top.fields) if top else ())
