"""Comparison of two datasets: keyed summaries of each, merged on all keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablewright.errors import Refusal, UserError
from tablewright.functions.values import INF, fold
from tablewright.operators.aggregates import REGISTRY
from tablewright.operators.summary import Op, aggregates, quoted


def _finite(value: Column, *of: Column, what: str) -> Column:
    """The value; an infinity that finite operands make is refused, not reported."""
    sound = F.lit(True)
    for x in of:
        sound = sound & (F.abs(x) < INF)
    over = F.raise_error(F.lit(f"{what} of finite values is out of range")).cast("double")
    return F.when(sound & ((F.abs(value) == INF)), over).otherwise(value)


def compare(
    before: DataFrame, after: DataFrame, ops: Sequence[Op], keys: Sequence[str] = (), rank: int | None = None, by: str = "absolute", limit: int | None = None, narm: bool = False, ignore_case: bool = False
) -> DataFrame:
    """A row for each key of either table: presence, rank_state, and for each operation six columns.

    They are ``<label>_before``, ``_after``, ``_difference`` (after minus before), ``_difference_state``,
    ``_percentage`` (of before) and ``_percentage_state``; a cell without value is null. ``rank`` is the number (from 1)
    of the result to rank by, by the size of its difference or percentage, largest first, ties by key, keys that can't
    be ranked last; ``limit`` drops ranked rows below that many. Groups are global whatever their row order.
    """
    for o in ops:
        if REGISTRY[o.name].kind == "text":
            raise Refusal(f"comparison takes numeric results, not '{o.name}'")
    if rank is not None and not 1 <= rank <= len(ops):
        raise UserError(f"there is no result {rank} to rank by")
    if by not in ("absolute", "percent"):
        raise UserError(f"rank by absolute or percent, not '{by}'")
    if limit is not None and rank is None:
        raise UserError("a limit needs a rank")

    def side(df: DataFrame, name: str) -> DataFrame:
        group = [(fold(quoted(k).cast("string")) if ignore_case else quoted(k)).alias(f"_k{i}") for i, k in enumerate(keys)]
        made = [c.alias(f"_{name}{i}") for i, c in enumerate(aggregates(df, ops, None, narm, ignore_case=ignore_case))]
        grouped = df.groupBy(*group or [F.lit(0).alias("_k0")])
        return grouped.agg(*made, F.lit(True).alias(f"_{name}"))

    names = [f"_k{i}" for i in range(len(keys) or 1)]
    a, b = side(before, "b").alias("b"), side(after, "a").alias("a")
    same = [F.col(f"b.{k}").eqNullSafe(F.col(f"a.{k}")) for k in names]
    both = a.join(b, same, "full_outer").select(*[F.coalesce(f"b.{k}", f"a.{k}").alias(k) for k in names], *[F.col(f"{x}{i}") for i in range(len(ops)) for x in ("_b", "_a")], "_b", "_a")
    matched = F.col("_b").isNotNull() & F.col("_a").isNotNull()
    presence = F.when(matched, "matched").when(F.col("_b").isNotNull(), "removed").otherwise("added")
    columns: list[Column] = []
    scores: list[tuple[Column, Column]] = []
    for i, o in enumerate(ops):
        x, y = F.col(f"_b{i}").cast("double"), F.col(f"_a{i}").cast("double")
        difference = _finite(y - x, x, y, what=f"the difference of {o.label}")
        state = F.when(~matched, "not_matched").when(F.isnan(difference), "unordered").otherwise("available")
        share = _finite(F.try_divide(difference, x) * 100, difference, x, what=f"the percentage of {o.label}")
        percent_state = (
            F.when(~matched, "not_matched").when(x == 0, "zero_baseline").when(F.isnan(x) | (F.abs(x) == INF), "nonfinite_baseline").when(F.isnan(y) | (F.abs(y) == INF), "nonfinite_after").otherwise("available")
        )
        percentage = F.when(percent_state == "available", share)
        difference = F.when(state == "available", difference)
        scores.append((difference, percentage))
        columns += [F.col(f"_b{i}").alias(f"{o.label}_before"), F.col(f"_a{i}").alias(f"{o.label}_after"), difference.alias(f"{o.label}_difference"), state.alias(f"{o.label}_difference_state")]
        columns += [percentage.alias(f"{o.label}_percentage"), percent_state.alias(f"{o.label}_percentage_state")]
    if rank is None:
        score, state = None, F.lit("not_requested")
    else:
        score = scores[rank - 1][by == "percent"]
        state = F.when(~matched, "one_sided").when(score.isNull(), "unavailable").otherwise("ranked")
    shown = [F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)]
    if score is None:
        return both.orderBy(*names).select(*shown, presence.alias("presence"), state.alias("rank_state"), *columns)
    ranked = both.withColumn("_score", F.abs(score))
    order = [F.col("_score").isNull(), F.col("_score").desc(), *names]
    if limit is not None:
        # The cut-off needs the best rows only: the others keep their place behind them.
        best = ranked.where("_score is not null").orderBy(*order).limit(limit)
        ranked = best.unionByName(ranked.where("_score is null"))
    return ranked.orderBy(*order).select(*shown, presence.alias("presence"), state.alias("rank_state"), *columns)
