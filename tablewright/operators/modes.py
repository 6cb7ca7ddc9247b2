"""Table modes: reverse, transpose, check, duplicate removal, crosstab and Top-N selection."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import FractionalType

from tablewright.errors import Refusal, UserError
from tablewright.functions.display import shown
from tablewright.functions.values import fold, number, unless_missing
from tablewright.operators.summary import Op, aggregates, op, quoted, spellings, spelt, with_tables
from tablewright.plans.order import islands, ordinals

FILLER = "N/A"


def fields_of(df: DataFrame) -> Column:
    """A typed table's columns as one array of text, in order; ragged tables have it as ``fields``."""
    return F.array(*[quoted(c).cast("string") for c in df.columns])


def noop(df: DataFrame, full: bool = False) -> DataFrame:
    """Every row read and none returned; with ``full`` the rows themselves."""
    return df if full else df.where(F.lit(False))


def reverse(df: DataFrame) -> DataFrame:
    """Columns in reverse order; of a ragged table each row's fields."""
    if df.columns[-1:] == ["fields"]:
        return df.withColumn("fields", F.reverse("fields"))
    return df.select(*[quoted(c) for c in reversed(df.columns)])


def check_widths(df: DataFrame, rid: str) -> DataFrame:
    """The first row of a ragged table whose width differs from the row before: (rid, width, previous), or no row.

    Rows of one bucket are compared in a window; a bucket's first row is compared with the last of the bucket before.
    """
    widths = df.select(quoted(rid).alias("rid"), F.size("fields").alias("width"))
    runs = islands(widths, [F.col("width")], "rid")
    # A run's first row has its rid; the two least of them, each a row, are all that is needed.
    two = runs.where(F.col("rid") == F.col("_gid")).orderBy("rid").limit(2)
    place = [F.min_by("width", "rid").alias("previous"), F.max_by("width", "rid").alias("width"), F.max("rid").alias("rid"), F.count("*").alias("n")]
    return two.agg(*place).where("n = 2").select("rid", "width", "previous")


def check(df: DataFrame, lines: int | None = None, fields: int | None = None, rid: str | None = None) -> DataFrame:
    """(n_lines, n_fields) of a table; an error names the first row of another width, or a count that was expected."""
    ragged = df.columns[-1:] == ["fields"]
    if ragged and rid:
        bad = check_widths(df, rid).first()
        if bad:
            raise UserError(f"line {bad.rid} has {bad.width} fields (previous lines had {bad.previous})")
    width = F.coalesce(F.max(F.size("fields")), F.lit(0)) if ragged else F.lit(len(df.columns))
    result = df.agg(F.count("*").alias("n_lines"), width.cast("long").alias("n_fields"))
    for value, name in ((lines, "n_lines"), (fields, "n_fields")):
        if value is not None:
            wrong = F.raise_error(F.concat(F.lit(f"expecting {value} {name[2:]}, found "), F.col(name).cast("string"))).cast("long")
            result = result.withColumn(name, F.when(F.col(name) == value, F.col(name)).otherwise(wrong))
    return result


def transpose(df: DataFrame, rid: str, strict: bool = True, filler: str = FILLER) -> DataFrame:
    """(pos, fields): row ``pos`` of the transposed table. Short rows are padded, or an error if ``strict``."""
    table = df if df.columns[-1:] == ["fields"] else df.select(quoted(rid), fields_of(df.drop(rid)).alias("fields"))
    width = table.agg(F.max(F.size("fields")).alias("_width"))
    numbered = ordinals(table.select(quoted(rid).alias("_rid"), "fields"), "_rid")
    full = numbered.crossJoin(F.broadcast(width))  # one row
    if strict:
        uneven = F.raise_error(F.concat(F.lit("line "), F.col("_line").cast("string"), F.lit(" has "), F.size("fields").cast("string"), F.lit(" fields"))).cast("array<string>")
        full = full.withColumn("fields", F.when(F.size("fields") == F.col("_width"), F.col("fields")).otherwise(uneven))
    cells = full.select("_line", F.posexplode(F.concat("fields", F.array_repeat(F.lit(filler), F.col("_width") - F.size("fields")))).alias("pos", "v"))
    row = F.transform(F.array_sort(F.collect_list(F.struct("_line", "v"))), lambda c: c["v"])
    return cells.groupBy("pos").agg(row.alias("fields")).orderBy("pos")


def remove_duplicates(df: DataFrame, keys: Sequence[str], rid: str, sort: bool = False) -> DataFrame:
    """The first row of each key (compared as text), in row order, or in key order with ``sort``."""
    if len(keys) != 1:
        raise Refusal("duplicate removal takes exactly one field")
    key = quoted(keys[0]).cast("string")
    firsts = df.groupBy(key.alias("_key")).agg(F.min_by(F.struct(*[quoted(c) for c in df.columns]), quoted(rid)).alias("_row"), F.min(quoted(rid)).alias("_rid"))
    return firsts.orderBy("_key" if sort else "_rid").select("_row.*")


def top(df: DataFrame, field: str, n: int, rid: str, bottom: bool = False, group: Sequence[str] = (), sort: bool = True, narm: bool = False, ignore_case: bool = False) -> DataFrame:
    """Complete rows of the ``n`` largest (or smallest) numbers, of each group if there is one; ties: earlier rows.

    ``narm`` leaves out rows whose ranked field is missing, ``ignore_case`` folds A-Z in keys.
    """
    if n < 1:
        raise UserError("a selection takes one record or more")
    kind = df.schema[field].dataType
    if narm:
        df = df.where(unless_missing(quoted(field), kind, True).isNotNull())
    value = number(quoted(field), kind, field)
    keys = [fold(quoted(g).cast("string")) if ignore_case else quoted(g) for g in group]
    # A filter, so that every row is looked at whatever the selection needs.
    unranked = F.raise_error(F.lit(f"a value of {field} is NaN and cannot be ranked")).cast("boolean")
    rows = df.where(F.when(F.isnan(value), unranked).otherwise(F.lit(True))).withColumn("_value", value)
    order = [F.col("_value").asc() if bottom else F.col("_value").desc(), quoted(rid)]
    if not group:
        return rows.orderBy(*order).limit(n).drop("_value")
    if not sort:
        rows, part = islands(rows, keys, rid), ["_gid"]
    else:
        part = [f"_g{i}" for i in range(len(group))]
        rows = rows.withColumns(dict(zip(part, keys)))
    chosen = rows.withColumn("_place", F.row_number().over(Window.partitionBy(*part).orderBy(*order))).where(F.col("_place") <= n)
    return chosen.orderBy(*part, "_place").select(*[quoted(c) for c in df.columns])


def crosstab(
    df: DataFrame, row: str, column: str, what: Op | None = None, rid: str | None = None, sort: bool = True, ignore_case: bool = False, filler: str = FILLER, labels: Sequence[str] | None = None, narm: bool = False
) -> DataFrame:
    """One operation (by default the count of rows) for each pair of labels, rows and columns in byte order, as text.

    Unsorted, groups are runs of adjacent rows and the first completed run of a pair counts. Pairs that don't occur
    have ``filler``. ``labels`` fixes the columns; otherwise a first pass finds them (as Spark's pivot does, at most
    ``spark.sql.pivotMaxValues``).
    """
    what = what or op("count", row)
    keys = [fold(quoted(k).cast("string")) if ignore_case else quoted(k).cast("string") for k in (row, column)]
    apart = spelt(what, ignore_case)
    if rid is None and (apart or not sort):
        raise UserError("row order matters here: give an order column")
    cell = replace(what, alias="_cell")
    made = F.count("*").alias("_count") if apart else aggregates(df, [cell], rid, narm, ignore_case=ignore_case)[0]

    def whole(groups: DataFrame, rows: DataFrame, by: list[str]) -> DataFrame:
        return with_tables(groups, by, [([cell], spellings(rows, by, cell, rid, narm, ","))]) if apart else groups

    if sort:
        cells = whole(df.groupBy(keys[0].alias("_r"), keys[1].alias("_c")).agg(made), df.withColumns({"_r": keys[0], "_c": keys[1]}), ["_r", "_c"])
    else:
        rows = islands(df, keys, rid)
        runs = whole(rows.groupBy("_gid").agg(F.first(keys[0]).alias("_r"), F.first(keys[1]).alias("_c"), made), rows, ["_gid"])
        cells = runs.groupBy("_r", "_c").agg(F.min_by("_cell", "_gid").alias("_cell"))
    names = sorted(labels) if labels is not None else None
    table = cells.groupBy(F.col("_r").alias(row)).pivot("_c", names).agg(F.first("_cell"))
    values = [c for c in table.columns if c != row]
    number_like = isinstance(cells.schema["_cell"].dataType, FractionalType)
    text = [F.coalesce(shown(quoted(c)) if number_like else quoted(c).cast("string"), F.lit(filler)).alias(c) for c in values]
    return table.select(quoted(row), *text).orderBy(quoted(row))
