"""Whole-table, sorted and adjacent-run summaries."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import NumericType

from tablewright.errors import UserError
from tablewright.functions.values import fold, number, unless_missing
from tablewright.operators.aggregates import ALIASES, ORDERED, REGISTRY, TEXTUAL, Sample, finish
from tablewright.plans.order import islands, places


@dataclass(frozen=True)
class Op:
    """One requested operation: name, the field or the pair of fields, and its parameter."""

    name: str
    fields: tuple[str, ...]
    param: object = None
    alias: str | None = None

    @property
    def label(self) -> str:
        own = f":{self.param}" if self.param is not None else ""
        return self.alias or f"{self.name}{own}({','.join(self.fields)})"


def op(name: str, *fields: str, param: object = None, alias: str | None = None) -> Op:
    """A checked operation. A parameter given to one that takes none, or a wrong number of fields, is an error."""
    name = ALIASES.get(name, name)
    spec = REGISTRY.get(name)
    if spec is None:
        raise UserError(f"invalid operation '{name}'")
    if len(fields) != spec.arity:
        raise UserError(f"operation '{name}' takes {'a pair of fields' if spec.arity == 2 else 'one field'}")
    if param is not None and spec.param is None:
        raise UserError(f"too many parameters for operation '{name}'")
    value = spec.default if param is None else spec.param(str(param))
    return Op(name, tuple(fields), value, alias)


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


class _Samples:
    def __init__(self, df: DataFrame, rid: str | None, narm: bool, delimiter: str, ignore_case: bool, separator: str):
        self.df, self.narm, self.delimiter, self.ignore_case, self.separator = df, narm, delimiter, ignore_case, separator
        self.rid = quoted(rid) if rid else None

    def __call__(self, field: str, textual: bool) -> Sample:
        kind = self.df.schema[field].dataType
        column = unless_missing(quoted(field), kind, self.narm)
        if textual:
            value = F.lit(None).cast("double")
        else:
            value = quoted(parsed_name(field)) if parsed_name(field) in self.df.columns else number(column, kind, field, self.separator)
        return Sample(column.cast("string") if textual or not isinstance(kind, NumericType) else column, value, self.rid, self.delimiter, self.ignore_case)


def parsed_name(field: str) -> str:
    return f"_n_{field}"


def parsed(df: DataFrame, ops: Sequence[Op], narm: bool = False, separator: str = ".") -> DataFrame:
    """``df`` with the text fields that operations read as numbers parsed once, in columns of their own."""
    numeric = {f for o in ops if o.name not in TEXTUAL for f in o.fields if not isinstance(df.schema[f].dataType, NumericType)}
    return df.withColumns({parsed_name(f): number(unless_missing(quoted(f), df.schema[f].dataType, narm), df.schema[f].dataType, f, separator) for f in sorted(numeric)})


def aggregates(df: DataFrame, ops: Sequence[Op], rid: str | None = None, narm: bool = False, delimiter: str = ",", ignore_case: bool = False, separator: str = ".") -> list[Column]:
    """The operations as aliased aggregate columns of ``df``."""
    samples = _Samples(df, rid, narm, delimiter, ignore_case, separator)
    out = []
    for o in ops:
        spec = REGISTRY[o.name]
        if narm and spec.arity == 2 and o.name != "wmean":
            raw = _compacted(o, [samples(f, False) for f in o.fields])
        else:
            own = [samples(f, o.name in TEXTUAL) for f in o.fields]
            raw = spec.build(*own, *([o.param] if spec.param else []))
        out.append(finish(o.name, raw).alias(o.label))
    return out


def _compacted(o: Op, pair: list[Sample]) -> Column:
    """Paired operations under narm: each side drops its own missing values and the rest pair up by position."""
    left, right = (s.in_order(s.number) for s in pair)
    n = F.size(left)
    unequal = F.raise_error(F.lit(f"{o.label}: different number of items")).cast("array<struct<x:double,y:double>>")
    pairs = F.when(n != F.size(right), unequal).otherwise(F.zip_with(left, right, lambda x, y: F.struct(x.alias("x"), y.alias("y"))))
    total = lambda f: F.aggregate(pairs, F.lit(0.0), lambda a, p: a + f(p))
    if o.name == "dotprod":
        return F.when(n > 0, total(lambda p: p["x"] * p["y"]))
    mx, my = (F.try_divide(total(lambda p, k=k: p[k]), n) for k in ("x", "y"))
    co = total(lambda p: (p["x"] - mx) * (p["y"] - my))
    if o.name in ("pcov", "scov"):
        return F.try_divide(co, n - (o.name == "scov"))
    sx, sy = total(lambda p: (p["x"] - mx) * (p["x"] - mx)), total(lambda p: (p["y"] - my) * (p["y"] - my))
    value = F.try_divide(co, F.sqrt(sx) * F.sqrt(sy))
    return value if o.name == "ppearson" else F.when(n > 1, value)


def _compacts(o: Op, narm: bool) -> bool:
    return narm and REGISTRY[o.name].arity == 2 and o.name != "wmean"


def _paired(df: DataFrame, group: list[str], o: Op, rid: str, separator: str) -> DataFrame:
    """Group columns and what :func:`_compacted` gives, by a join of the present values' places: no group is collected."""
    samples = _Samples(df, rid, True, ",", False, separator)
    sides = []
    for f, c in zip(o.fields, "xy"):
        own = df.select(*group, quoted(rid).alias("_rid"), samples(f, False).number.alias(c)).where(F.col(c).isNotNull())
        sides.append(places(own, group, "_rid").select(*[F.col(g).alias(f"_{c}{i}") for i, g in enumerate(group)], F.col("_place").alias(f"_{c}"), c))
    left, right = sides
    same = [left["_x"] == right["_y"], *[left[f"_x{i}"].eqNullSafe(right[f"_y{i}"]) for i in range(len(group))]]
    unequal = F.raise_error(F.lit(f"{o.label}: different number of items")).cast("double")
    first = F.col("_x").isNotNull()
    pairs = left.join(right, same, "full").select(
        *[F.when(first, F.col(f"_x{i}")).otherwise(F.col(f"_y{i}")).alias(g) for i, g in enumerate(group)],
        *[F.when(F.col("x").isNull() | F.col("y").isNull(), unequal).otherwise(F.col(c)).alias(c) for c in "xy"],
    )
    x, y = (Sample(F.col(c), F.col(c), None) for c in "xy")
    return pairs.groupBy(*group).agg(REGISTRY[o.name].build(x, y).alias(o.label))


def representative(df: DataFrame, ops: Sequence[Op], rid: str, narm: bool, separator: str) -> Column:
    """The rid of the row that stands for a group: its first row, unless a later one became an operation's choice."""
    samples = _Samples(df, rid, narm, ",", False, separator)
    own = quoted(rid)
    candidates = [F.min(own)]
    for o in ops:
        s = samples(o.fields[0], o.name in TEXTUAL)
        if o.name in ("first", "last"):
            candidates.append((F.min if o.name == "first" else F.max)(F.when(s.text.isNotNull(), own)))
        elif o.name in ("min", "max", "absmin", "absmax"):
            value = F.abs(s.number) if o.name.startswith("abs") else s.number
            value = F.when(~F.isnan(s.number), value)
            low = o.name.endswith("min")
            candidates.append(F.min_by(own, F.when(value.isNotNull(), F.struct((value if low else -value), own))))
    return F.greatest(*candidates) if len(candidates) > 1 else candidates[0]


#: Operations that two map-side combined aggregates compute: first by value, then by group.
COUNTED = {"mode": -1, "antimode": 1}


def _commonest(df: DataFrame, group: list[str], o: Op, narm: bool, separator: str) -> DataFrame:
    """Group columns and the value that occurs most (or least) often, the smallest of several; no group is collected."""
    value = _Samples(df, None, narm, ",", False, separator)(o.fields[0], False).number
    counts = df.groupBy(*group, value.alias("_value")).agg(F.count("*").alias("_n")).where("_value is not null")
    return counts.groupBy(*group).agg(F.min_by("_value", F.struct(F.col("_n") * COUNTED[o.name], F.col("_value"))).alias(o.label))


def spelt(o: Op, ignore_case: bool) -> bool:
    """Whether :func:`spellings` computes the operation."""
    return ignore_case and o.name == "unique"


def spellings(df: DataFrame, group: list[str], o: Op, rid: str, narm: bool, delimiter: str) -> DataFrame:
    """Group columns and the distinct values without regard to the case of A-Z, each as its first row spells it.

    Aggregates that are combined before they move find a spelling's first row, then a folded value's first spelling;
    only the values of the result itself are collected.
    """
    text = _Samples(df, rid, narm, delimiter, True, ".")(o.fields[0], True).text
    every = df.select(*group, text.alias("_text"), quoted(rid).alias("_first")).where("_text is not null")
    own = every.groupBy(*group, "_text").agg(F.min("_first").alias("_first"))
    firsts = own.groupBy(*group, fold(F.col("_text")).alias("_folded")).agg(F.min_by("_text", F.struct("_first", "_text")).alias("_text"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("_folded", "_text"))), lambda x: x["_text"])
    return firsts.groupBy(*group).agg(F.array_join(listed, delimiter).alias(o.label))


def with_tables(result: DataFrame, by: list[str], tables: Sequence[tuple[Sequence[Op], DataFrame]]) -> DataFrame:
    """``result`` with the operations that were computed apart, in tables with a row for each group at most."""
    for own, found in tables:
        same = [result[b].eqNullSafe(found[b]) for b in by]
        result = result.join(found, same, "left").select(*[result[c] for c in result.columns], *[finish(o.name, found[o.label]).alias(o.label) for o in own])
    return result


#: Operations that are order statistics of a group, by their points; a percentile has its own.
POINTS = {"median": (0.5,), "q1": (0.25,), "q3": (0.75,), "iqr": (0.25, 0.75), "perc": ()}
#: Relative rank error of the brackets is one in so many.
ACCURACY = 10_000


def _points(o: Op) -> tuple[float, ...]:
    return POINTS[o.name] or (o.param / 100,)


def _order_statistics(df: DataFrame, group: list[str], field: str, ops: Sequence[Op], narm: bool, separator: str, whole: bool) -> DataFrame:
    """Group columns and exact quantiles of one field, whatever the size of a group.

    A first pass brackets every quantile between two approximate ones, two ranks in ACCURACY to either side of it, whose
    own error is at most one in ACCURACY; a group of no more than 4 * ACCURACY values, where roundings of ranks would
    count, has brackets without bounds. A second pass counts values, with those outside the brackets moved to the nearest
    bracket below, which keeps the ranks inside: only about 4 / ACCURACY of a larger group's values are told apart, and
    those are sorted. NaN counts as the largest value. ``whole``: there
    is one group, so one row of brackets.
    """
    value = _Samples(df, None, narm, ",", False, separator)(field, False).number
    rows = df.select(*group, F.when(F.isnan(value), float("inf")).otherwise(value).alias("_v"), F.isnan(value).alias("_nan")).where("_v is not null")
    points = sorted({p for o in ops for p in _points(o)})
    around = [min(1.0, max(0.0, p + side * 2 / ACCURACY)) for p in points for side in (-1, 1)]
    open_ = F.array(F.lit(-float("inf")), *[F.lit(float("inf"))] * (len(around) - 1))
    found = rows.groupBy(*group).agg(F.percentile_approx("_v", around, ACCURACY).alias("_b"), F.count("*").alias("_n"))
    brackets = found.select(*[F.col(g).alias(f"_j{i}") for i, g in enumerate(group)], F.when(F.col("_n") > 4 * ACCURACY, F.col("_b")).otherwise(open_).alias("_b"))
    met = rows.join(F.broadcast(brackets) if whole else brackets, [F.col(g).eqNullSafe(F.col(f"_j{i}")) for i, g in enumerate(group)])
    clamped = F.greatest("_v", F.col("_b")[0])
    for k in range(len(points)):
        high = F.col("_b")[2 * k + 1]
        above = F.when(F.col("_v") < F.col("_b")[2 * k + 2], high).otherwise(F.col("_v")) if k + 1 < len(points) else high
        clamped = F.when(F.col("_v") > high, above).otherwise(clamped)
    # Moved values stand before or after those that are equal to where they were moved to; no quantile may fall on one.
    moved = F.when(F.col("_v") < clamped, -1).when(F.col("_v") > clamped, 1).otherwise(0)
    counted = met.groupBy(*group, clamped.alias("_v"), moved.alias("_moved"), "_nan").agg(F.count("*").alias("_n"))
    held = counted.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("_v", "_moved", "_nan", "_n"))).alias("_values"), F.sum("_n").alias("_n"))
    places = {p: (F.col("_n") - 1) * F.lit(p) for p in points}
    wanted = [f(places[p]).cast("long") for p in points for f in (F.floor, F.ceil)]

    def step(a: Column, x: Column) -> Column:
        missed = F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double")
        own, after = F.when(x["_moved"] != 0, missed).when(x["_nan"], float("nan")).otherwise(x["_v"]), a["n"] + x["_n"]
        return F.struct(after.alias("n"), *[F.when((w >= a["n"]) & (w < after), own).otherwise(a[f"v{i}"]).alias(f"v{i}") for i, w in enumerate(wanted)])

    start = F.struct(F.lit(0).cast("long").alias("n"), *[F.lit(None).cast("double").alias(f"v{i}") for i in range(len(wanted))])
    held = held.withColumn("_found", F.aggregate("_values", start, step))
    at = {}
    for i, p in enumerate(points):
        low, high, rest = F.col(f"_found.v{2 * i}"), F.col(f"_found.v{2 * i + 1}"), places[p] - F.floor(places[p])
        at[p] = F.when(rest == 0, low).otherwise(low * (1 - rest) + high * rest)
    return held.select(*group, *[(at[_points(o)[-1]] - at[_points(o)[0]] if o.name == "iqr" else at[_points(o)[0]]).alias(o.label) for o in ops])


def summarise(
    df: DataFrame,
    ops: Sequence[Op],
    keys: Sequence[str] = (),
    rid: str | None = None,
    sort: bool = True,
    narm: bool = False,
    ignore_case: bool = False,
    full: bool = False,
    delimiter: str = ",",
    separator: str = ".",
) -> DataFrame:
    """Results of ``ops``, a row for each group: key columns, then a column for each operation.

    Without keys the whole table is one group, and an empty table gives no row. ``sort``: a group is all rows of one key
    tuple, and groups come in key order. Otherwise a group is a run of adjacent rows in order of ``rid`` (a unique
    numeric column), and groups come in that order. ``ignore_case`` folds A-Z in keys and shows a group's first
    spelling. ``narm`` skips missing values. ``full`` puts every column of the group's representative row first.
    """
    columns = df.columns
    df = parsed(df, ops, narm, separator)
    # Sorted groups may be of any size: order statistics, commonest values and spellings are found by plans of their own.
    apart = lambda o: o.name in COUNTED or _compacts(o, narm) or spelt(o, ignore_case) or o.name in POINTS and (sort or not keys)
    made = aggregates(df, [o for o in ops if not apart(o)], rid, narm, delimiter, ignore_case, separator)
    if (not sort and keys or full or ignore_case and keys or any(o.name in ORDERED or _compacts(o, narm) or spelt(o, ignore_case) for o in ops)) and rid is None:
        raise UserError("row order matters here: give an order column")
    group = [fold(quoted(k).cast("string")) if ignore_case else quoted(k) for k in keys]
    shown = [(F.min_by(quoted(k), quoted(rid)) if ignore_case else F.first(quoted(k))).alias(f"_s{i}") for i, k in enumerate(keys)]
    extra = [representative(df, ops, rid, narm, separator).alias("_rep")] if full else []
    if not keys:
        df, by = df.withColumn("_g0", F.lit(0)), ["_g0"]
    elif sort:
        by = [f"_g{i}" for i in range(len(keys))]
        df = df.withColumns(dict(zip(by, group)))
    else:
        df, by = islands(df, group, rid), ["_gid"]
    result = df.groupBy(*by).agg(F.count("*").alias("_count"), *shown, *extra, *made)
    tables = []
    for o in ops:
        if o.name in COUNTED:
            tables.append(([o], _commonest(df, by, o, narm, separator)))
        elif spelt(o, ignore_case):
            tables.append(([o], spellings(df, by, o, rid, narm, delimiter)))
        elif _compacts(o, narm):
            tables.append(([o], _paired(df, by, o, rid, separator)))
    for f in sorted({o.fields[0] for o in ops if apart(o) and o.name in POINTS}):
        own = [o for o in ops if o.name in POINTS and o.fields[0] == f]
        tables.append((own, _order_statistics(df, by, f, own, narm, separator, not keys)))
    result = with_tables(result, by, tables)
    if keys:
        result = result.orderBy(*by)
    names = [o.label for o in ops]
    if full:
        rows = df.select(quoted(rid).alias("_rep"), F.struct(*[quoted(c) for c in columns]).alias("_row"))
        joined = result.join(rows, "_rep")
        return (joined.orderBy(*by) if keys else joined).select("_row.*", *[quoted(n) for n in names])
    return result.select(*[F.col(f"_s{i}").alias(k) for i, k in enumerate(keys)], *[quoted(n) for n in names])
