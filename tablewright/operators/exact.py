"""Extended-precision summaries: values parsed from text and added up in row order as 80-bit numbers.

An opt-in for results to the last digit. A group is one task's work, as its order is; use the plain summaries at scale.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tablewright.errors import Refusal
from tablewright.functions.display import parse_format
from tablewright.functions.values import fold, unless_missing
from tablewright.operators.summary import Op, quoted
from tablewright.plans.order import islands

Numbers = np.ndarray


def _ordered_sum(x: Numbers) -> np.longdouble:
    total = np.longdouble(0)
    for v in x:
        total += v
    return total


def _moment(df: int) -> Callable[[Numbers], np.longdouble]:
    def value(x: Numbers) -> np.longdouble:
        n = len(x)
        if n <= df:
            return np.longdouble("nan")
        d = x - _ordered_sum(x) / n
        return _ordered_sum(d * d) / (n - df)

    return value


def _quarter(k: int) -> Callable[[Numbers], np.longdouble]:
    def value(x: Numbers) -> np.longdouble:
        s = np.sort(x)
        at, rest = divmod((len(s) - 1) * k, 4)
        return s[at] if not rest else s[at] + (s[at + 1] - s[at]) * np.longdouble(rest) / 4

    return value


def _perc(x: Numbers, percent: int) -> np.longdouble:
    s = np.sort(x)
    at, rest = divmod((len(s) - 1) * percent, 100)
    return s[at] if not rest else s[at] + (s[at + 1] - s[at]) * np.longdouble(rest) / 100


def _trimmed(x: Numbers, share: float) -> np.longdouble:
    if share == 0.5:
        return _quarter(2)(x)
    cut = int(len(x) * share)
    return _ordered_sum(np.sort(x)[cut : len(x) - cut]) / (len(x) - 2 * cut)


def _deviation(scale: str) -> Callable[[Numbers], np.longdouble]:
    return lambda x: _quarter(2)(np.abs(x - _quarter(2)(x))) * np.longdouble(scale)


def _commonest(sign: int) -> Callable[[Numbers], np.longdouble]:
    def value(x: Numbers) -> np.longdouble:
        values, n = np.unique(x, return_counts=True)
        return values[np.argmax(sign * n)]

    return value


def _power_mean(k: int) -> Callable[[Numbers], np.longdouble]:
    """Standardised central moment."""

    def value(x: Numbers) -> np.longdouble:
        d = x - _ordered_sum(x) / len(x)
        spread = _ordered_sum(d * d) / len(x)
        return _ordered_sum(d**k) / len(x) / spread ** (np.longdouble(k) / 2) - (3 if k == 4 else 0)

    return value


def _sample(k: int) -> Callable[[Numbers], np.longdouble]:
    """Skewness and excess kurtosis of a sample, without bias."""

    def value(x: Numbers) -> np.longdouble:
        n = np.longdouble(len(x))
        if n < k:
            return np.longdouble("nan")
        g = _power_mean(k)(x)
        return g * np.sqrt(n * (n - 1)) / (n - 2) if k == 3 else ((n + 1) * g + 6) * (n - 1) / ((n - 2) * (n - 3))

    return value


EXACT: dict[str, Callable[..., np.longdouble]] = {
    "sum": _ordered_sum,
    "mean": lambda x: _ordered_sum(x) / len(x),
    "min": lambda x: x.min(),
    "max": lambda x: x.max(),
    "range": lambda x: x.max() - x.min(),
    "absmin": lambda x: x[np.argmin(np.abs(x))],
    "absmax": lambda x: x[np.argmax(np.abs(x))],
    "geomean": lambda x: np.exp(_ordered_sum(np.log(x)) / len(x)),
    "harmmean": lambda x: len(x) / _ordered_sum(1 / x),
    "trimmean": _trimmed,
    "perc": _perc,
    "mode": _commonest(1),
    "antimode": _commonest(-1),
    "madraw": _deviation("1"),
    "mad": _deviation("1.4826"),
    "pskew": _power_mean(3),
    "pkurt": _power_mean(4),
    "sskew": _sample(3),
    "skurt": _sample(4),
    "ms": lambda x: _ordered_sum(x * x) / len(x),
    "rms": lambda x: np.sqrt(_ordered_sum(x * x) / len(x)),
    "median": _quarter(2),
    "q1": _quarter(1),
    "q3": _quarter(3),
    "iqr": lambda x: _quarter(3)(x) - _quarter(1)(x),
    "pvar": _moment(0),
    "svar": _moment(1),
    "pstdev": lambda x: np.sqrt(_moment(0)(x)),
    "sstdev": lambda x: np.sqrt(_moment(1)(x)),
}


def show_long(value: np.longdouble, format: str = "%.14g") -> str:
    """``%.Ng`` of an 80-bit number."""
    found = parse_format(format)
    if found["kind"] != "g" or found["flags"] or found["width"]:
        raise Refusal("extended numbers are shown as %.Ng only")
    digits = max(1, int(found["digits"] or 6))
    if not np.isfinite(value):
        return ("-" if np.signbit(value) else "") + ("nan" if np.isnan(value) else "inf")
    if value == 0:
        return "-0" if np.signbit(value) else "0"
    text = np.format_float_scientific(value, precision=digits - 1, unique=False, trim="k")
    mantissa, exponent = text.split("e")
    e = int(exponent)
    if -4 <= e < digits:
        text = np.format_float_positional(value, precision=digits - 1 - e, unique=False, trim="k") if digits - 1 - e > 0 else np.format_float_positional(value, precision=0, unique=False, trim="-")
        return text.rstrip("0").rstrip(".") if "." in text else text
    mantissa = mantissa.rstrip("0").rstrip(".") if "." in mantissa else mantissa
    return f"{mantissa}e{'-' if e < 0 else '+'}{abs(e):02d}"


#: What an empty sample gives; NaN for the others.
NOTHING = {"sum": 0.0, "min": -np.inf, "max": np.inf, "absmin": -np.inf, "absmax": np.inf}


def _numbers(values: pd.Series) -> Numbers:
    return np.array([np.longdouble(v.strip()) for v in values.dropna()], np.longdouble)


def exact_summary(
    df: DataFrame, ops: Sequence[Op], rid: str, keys: Sequence[str] = (), sort: bool = True, format: str = "%.14g", narm: bool = False, ignore_case: bool = False
) -> DataFrame:
    """Results as text, a row for each group, of the operations in ``EXACT``; values are read from text columns.

    ``narm`` skips missing values; ``ignore_case`` folds A-Z in keys and shows a group's first spelling.
    """
    for o in ops:
        if o.name not in EXACT:
            raise Refusal(f"operation '{o.name}' has no extended form")
    fields = sorted({o.fields[0] for o in ops})
    shown, group = [f"_k{i}" for i in range(len(keys))], [f"_g{i}" for i in range(len(keys))]
    spelt = [quoted(k).cast("string") for k in keys]
    rows = df.select(
        *[c.alias(k) for c, k in zip(spelt, shown)],
        *[(fold(c) if ignore_case else c).alias(g) for c, g in zip(spelt, group)],
        quoted(rid).alias("_rid"),
        *[unless_missing(quoted(f), df.schema[f].dataType, narm).cast("string").alias(f"_f{i}") for i, f in enumerate(fields)],
    )
    if keys and not sort:
        rows = islands(rows, [F.col(g) for g in group], "_rid")
        group = ["_gid"]
    out = [f"_r{i}" for i in range(len(ops))]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_rid")
        numbers = {f: _numbers(part[f"_f{i}"]) for i, f in enumerate(fields)}
        with np.errstate(all="ignore"):
            found = [EXACT[o.name](numbers[o.fields[0]], *([o.param] if o.name in ("perc", "trimmean") else [])) if len(numbers[o.fields[0]]) else np.longdouble(NOTHING.get(o.name, np.nan)) for o in ops]
        return pd.DataFrame([{g: part[g].iloc[0] for g in [*group, *shown]} | {c: show_long(x, format) for c, x in zip(out, found)}])

    schema = ", ".join([f"{g} {'long' if g == '_gid' else 'string'}" for g in [*group, *shown]] + [f"{c} string" for c in out])
    made = rows.groupBy(*group).applyInPandas(run, schema)
    ordered = made.orderBy(*group) if group else made
    return ordered.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], *[F.col(c).alias(o.label) for c, o in zip(out, ops)])
