"""Seeded random selection: one stream of the C library's additive-feedback generator over all rows in group order.

A row's draws follow from its ordinal alone, because the generator is a linear recurrence: any stretch of the stream
is reached by raising x to its place modulo the recurrence's polynomial. So every task makes its own draws.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tablewright.operators.summary import Op, aggregates, parsed, quoted, representative, spellings, spelt, with_tables
from tablewright.functions.values import fold, unless_missing
from tablewright.plans.order import before_in_order, islands, running

#: Fixed values of the generator: degree, tap, multiplier and modulus of the seeding step, draws thrown away.
DEGREE, TAP, MULTIPLIER, MODULUS, DISCARDED = 31, 28, 16807, 2147483647, 310
MASK = np.uint64(0xFFFFFFFF)


def _start(seed: int) -> np.ndarray:
    """The first DEGREE values that the recurrence runs on."""
    value = (seed & 0xFFFFFFFF) or 1
    value = value - (1 << 32) if value >= 1 << 31 else value
    state = [value & 0xFFFFFFFF]
    for _ in range(DEGREE - 1):
        value = int(np.fmod(MULTIPLIER * value, MODULUS))
        value += MODULUS if value < 0 else 0
        state.append(value)
    return np.array(state[3:] + state[:3], np.uint64)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of two polynomials modulo x**31 = x**28 + 1 and 2**32."""
    out = np.zeros(2 * DEGREE - 1, np.uint64)
    for i in range(DEGREE):
        out[i : i + DEGREE] += a[i] * b & MASK
    for i in range(2 * DEGREE - 2, DEGREE - 1, -1):
        out[i - DEGREE + TAP] += out[i]
        out[i - DEGREE] += out[i]
    return out[:DEGREE] & MASK


def _power(n: int) -> np.ndarray:
    result, base = np.zeros(DEGREE, np.uint64), np.zeros(DEGREE, np.uint64)
    result[0] = base[1] = 1
    while n:
        if n & 1:
            result = _times(result, base)
        base, n = _times(base, base), n >> 1
    return result


def draws(seed: int, first: int, count: int) -> np.ndarray:
    """Draws ``first`` to ``first + count - 1`` (from 0) of the generator, each of 31 bits."""
    begin, x = _start(seed), np.zeros(DEGREE, np.uint64)
    x[1] = 1
    at = _power(first + DISCARDED + DEGREE)
    values = np.zeros(max(count, DEGREE), np.uint64)
    for i in range(DEGREE):
        values[i] = (at * begin & MASK).sum() & MASK
        at = _times(at, x)
    for i in range(DEGREE, count):
        values[i] = values[i - 3] + values[i - DEGREE] & MASK
    return (values[:count] >> np.uint64(1)).astype(np.int64)


def seeded_rand(
    df: DataFrame,
    ops: Sequence[Op],
    seed: int,
    rid: str,
    keys: Sequence[str] = (),
    sort: bool = True,
    narm: bool = False,
    ignore_case: bool = False,
    full: bool = False,
    delimiter: str = ",",
) -> DataFrame:
    """One chosen value for each ``rand`` operation and group, the same for a seed however the rows are dealt out.

    Rows draw in group order and then row order, once for each request; a row's value replaces the choice if it is its
    group's first or its draw divides by its place in the group. ``N/A`` is chosen where every value is missing. Other
    operations among ``ops`` draw nothing. ``full`` puts every column of the group's representative row first.
    """
    columns, every = df.columns, ops
    ops, others = ([o for o in every if (o.name == "rand") == x] for x in (True, False))
    whole, df = df, parsed(df, others, narm)
    group = [fold(quoted(k).cast("string")) if ignore_case else quoted(k) for k in keys]
    if sort or not keys:
        rows = df.withColumn("_group", F.struct(*[g.alias(f"g{i}") for i, g in enumerate(group)]) if keys else F.struct(F.lit(0).alias("g0")))
    else:
        rows = islands(df, group, rid).withColumn("_group", F.struct(F.col("_gid").alias("g0"))).drop("_gid")
    made = aggregates(rows, [o for o in others if not spelt(o, ignore_case)], rid, narm, delimiter, ignore_case)
    tables = [([o], spellings(rows, ["_group"], o, rid, narm, delimiter)) for o in others if spelt(o, ignore_case)]
    present = [unless_missing(quoted(o.fields[0]), df.schema[o.fields[0]].dataType, narm).cast("string") for o in ops]
    # A missing value draws nothing: a row's draws are numbered by the present values before it, request by request.
    here = sum((p.isNotNull().cast("long") for p in present), F.lit(0).cast("long"))
    rows = rows.withColumn("_here", here).withColumns({f"_v{i}": p for i, p in enumerate(present)})
    rows = running(rows, ["_group"], rid, {"_upto": F.col("_here")} | {f"_c{i}": F.col(f"_v{i}").isNotNull().cast("long") for i in range(len(ops))})
    rows = rows.withColumn("_before", F.col("_upto") - F.col("_here"))
    totals = rows.groupBy("_group").agg(F.sum("_here").alias("_all"))
    rows = rows.join(before_in_order(totals, "_group", "_all", "_offset"), "_group") if keys else rows.withColumn("_offset", F.lit(0))

    @F.pandas_udf("long")
    def draw(at: pd.Series) -> pd.Series:
        known = np.unique(at.dropna().to_numpy().astype(np.int64))
        out = np.zeros(len(known), np.int64)
        cuts = np.flatnonzero(np.diff(known) > 64) + 1
        for part in np.split(np.arange(len(known)), cuts):
            if len(part):
                low = known[part[0]]
                out[part] = draws(seed, int(low), int(known[part[-1]] - low + 1))[known[part] - low]
        return at.map(dict(zip(known.tolist(), out.tolist())))

    chosen = []
    ordinal = F.col("_offset") + F.col("_before")
    for i, o in enumerate(ops):
        drawn = draw(F.when(F.col(f"_v{i}").isNotNull(), ordinal))
        keep = (F.col(f"_c{i}") == 1) | (drawn % F.col(f"_c{i}") == 0)
        rows = rows.withColumn(f"_k{i}", F.when(F.col(f"_v{i}").isNotNull() & keep, quoted(rid)))
        chosen.append(F.coalesce(F.max_by(f"_v{i}", f"_k{i}"), F.lit("N/A")).alias(o.label))
        ordinal = ordinal + F.col(f"_v{i}").isNotNull().cast("long")
    shown = [F.min_by(quoted(k), quoted(rid)).alias(f"_s{i}") for i, k in enumerate(keys)]
    picks = [F.max(f"_k{i}") for i in range(len(ops))]
    extra = [F.greatest(representative(rows, others, rid, narm, "."), *picks).alias("_rep")] if full else []
    result = rows.groupBy("_group").agg(F.count("*").alias("_count"), *shown, *extra, *chosen, *made)
    result = with_tables(result, ["_group"], tables).orderBy("_group")
    values = [quoted(o.label) for o in every]
    if full:
        kept = whole.select(quoted(rid).alias("_rep"), F.struct(*[quoted(c) for c in columns]).alias("_row"))
        return result.join(kept, "_rep").orderBy("_group").select("_row.*", *values)
    return result.select(*[F.col(f"_s{i}").alias(k) for i, k in enumerate(keys)], *values)
