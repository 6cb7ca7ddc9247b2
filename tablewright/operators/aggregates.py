"""Summary operations: each builds one aggregate Column from a field's typed views.

``REGISTRY`` maps a name to its :class:`Aggregate`. A builder gets a :class:`Sample` per field, whose columns are null
where a value is missing, and returns the raw aggregate; ``finish`` turns an empty or too small sample into the
defined result (NaN, 0, an infinity, ``N/A`` or an empty string) where Spark would give null.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from tablewright.errors import UserError
from tablewright.functions.values import INF, NAN, fold


@dataclass(frozen=True)
class Sample:
    """A field: its text and number (null if missing) and the order column."""

    text: Column
    number: Column
    rid: Column | None
    delimiter: str = ","
    ignore_case: bool = False

    @property
    def order(self) -> Column:
        if self.rid is None:
            raise UserError("this operation depends on row order: give an order column")
        return self.rid

    @property
    def n(self) -> Column:
        return F.count(self.text)

    def in_order(self, value: Column) -> Column:
        """Present values as an array in row order."""
        pairs = F.collect_list(F.when(value.isNotNull(), F.struct(self.order.alias("r"), value.alias("v"))))
        return F.transform(F.sort_array(pairs), lambda p: p["v"])

    @property
    def ascending(self) -> Column:
        """Present numbers as a sorted array."""
        return F.sort_array(F.collect_list(self.number))


@dataclass(frozen=True)
class Aggregate:
    build: Callable[..., Column]
    kind: str = "number"  # count, number or text
    empty: object = NAN
    arity: int = 1
    param: Callable[[str], object] | None = None
    default: object = None


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _quantile(p: float) -> Callable[[Sample], Column]:
    return lambda s: F.percentile(s.number, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))[int(p * 4) - 1]


def _iqr(s: Sample) -> Column:
    quartiles = F.percentile(s.number, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return quartiles[2] - quartiles[0]


def _unless_nan(s: Sample, value: Column) -> Column:
    """The extreme of the numbers: NaN replaces none of them, but one that comes first stays, if row order is known."""
    value = F.coalesce(value, F.when(F.count(s.number) > 0, NAN))
    if s.rid is None:
        return value
    first = F.min_by(s.number, F.when(s.number.isNotNull(), s.rid))
    return F.when(F.isnan(first), first).otherwise(value)


def _extreme(pick: Callable[[Column], Column]) -> Callable[[Sample], Column]:
    return lambda s: _unless_nan(s, pick(F.when(~F.isnan(s.number), s.number)))


def _by_magnitude(pick: Callable, sign: int) -> Callable[[Sample], Column]:
    def build(s: Sample) -> Column:
        size = F.abs(s.number)
        key = F.struct(size, s.rid.cast("long") * sign) if s.rid is not None else F.struct(size, s.number)
        return _unless_nan(s, pick(s.number, F.when(s.number.isNotNull() & ~F.isnan(s.number), key)))

    return build


def _logarithm(v: Column) -> Column:
    return F.when(v == 0, -INF).when(v < 0, NAN).when(F.isnan(v), NAN).otherwise(F.log(v))


def _inverse(v: Column) -> Column:
    """1/v; a zero gives an infinity of its sign, which atan2 tells apart."""
    return F.when(v == 0, F.when(F.atan2(v, F.lit(-1.0)) < 0, -INF).otherwise(INF)).otherwise(F.try_divide(F.lit(1.0), v))


def _trimmed(s: Sample, share: float) -> Column:
    if share == 0.5:
        return F.median(s.number)

    def mean(values: Column) -> Column:
        n = F.size(values)
        cut = F.floor(n * F.lit(share)).cast("int")
        kept = F.slice(values, cut + 1, n - 2 * cut)
        return F.try_divide(F.aggregate(kept, F.lit(0.0), lambda a, x: a + x), F.size(kept))

    return _let(s.ascending, mean)


def _runs(values: Column, better: Callable[[Column, Column], Column]) -> Column:
    """Of a sorted array's runs of equal values, the value of the first best one by length."""
    start = F.struct(F.lit(None).cast("double").alias("v"), F.lit(0).alias("n"), F.lit(None).cast("double").alias("bv"), F.lit(0).alias("bn"))

    def settle(a: Column) -> tuple[Column, Column]:
        take = (a["n"] > 0) & ((a["bn"] == 0) | better(a["n"], a["bn"]))
        return F.when(take, a["v"]).otherwise(a["bv"]), F.when(take, a["n"]).otherwise(a["bn"])

    def step(a: Column, x: Column) -> Column:
        v, n = settle(a)
        same = (a["n"] > 0) & (a["v"] == x)
        return F.struct(
            x.alias("v"),
            F.when(same, a["n"] + 1).otherwise(1).alias("n"),
            F.when(same, a["bv"]).otherwise(v).alias("bv"),
            F.when(same, a["bn"]).otherwise(n).alias("bn"),
        )

    return F.aggregate(values, start, step, lambda a: settle(a)[0])


def _middle(values: Column) -> Column:
    n = F.size(values)
    low, high = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")
    return F.when(n > 0, (F.get(values, low) + F.get(values, high)) * 0.5)


def _mad(scale: float) -> Callable[[Sample], Column]:
    def spread(values: Column) -> Column:
        return _let(_middle(values), lambda m: _let(F.sort_array(F.transform(values, lambda x: F.abs(x - m))), _middle))

    return lambda s: _let(s.ascending, spread) * scale


def _at_least(n: Column, least: int, value: Column) -> Column:
    return F.when(n >= least, value).otherwise(NAN)


def _skew(s: Sample) -> Column:
    return F.skewness(s.number)


def _kurt(s: Sample) -> Column:
    return F.kurtosis(s.number)


def _n(s: Sample) -> Column:
    return s.n.cast("double")


def _sample_skew(s: Sample) -> Column:
    n = _n(s)
    return _at_least(n, 3, _skew(s) * F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2))


def _sample_kurt(s: Sample) -> Column:
    n = _n(s)
    return _at_least(n, 4, ((n + 1) * _kurt(s) + 6) * (n - 1) / F.when(n > 3, (n - 2) * (n - 3)))


def _jarque(s: Sample) -> Column:
    half = _n(s) * (_kurt(s) * _kurt(s) / 4 + _skew(s) * _skew(s)) / 12
    return F.when(half >= 64, 0.0).otherwise(F.exp(-half))


def _dpo(s: Sample) -> Column:
    n = _n(s)
    ses = F.sqrt(6 * n * (n - 1) / F.when(n > 3, (n - 2) * (n + 1) * (n + 3)))
    sek = 2 * ses * F.sqrt((n * n - 1) / F.when(n > 3, (n - 3) * (n + 5)))
    a, b = _sample_skew(s) / ses, _sample_kurt(s) / sek
    half = (a * a + b * b) / 2
    return F.when(half >= 64, 0.0).otherwise(F.exp(-half))


def _unique(s: Sample) -> Column:
    if not s.ignore_case:
        return F.array_join(F.sort_array(F.collect_set(s.text)), s.delimiter)
    entry = F.when(s.text.isNotNull(), F.struct(fold(s.text).alias("f"), s.order.alias("r"), s.text.alias("t")))
    every = F.sort_array(F.collect_list(entry))
    firsts = _let(every, lambda e: F.filter(e, lambda x, i: (i == 0) | (F.get(e, i - 1)["f"] != x["f"])))
    return F.array_join(F.transform(firsts, lambda x: x["t"]), s.delimiter)


def _both(a: Sample, b: Sample) -> tuple[Column, Column]:
    there = a.number.isNotNull() & b.number.isNotNull()
    return F.when(there, a.number), F.when(there, b.number)


def _pearson(a: Sample, b: Sample) -> Column:
    return F.corr(*_both(a, b))


def _weighted(v: Sample, w: Sample) -> Column:
    bad = F.isnan(w.number) | (F.abs(w.number) == INF) | (w.number < 0)
    refused = F.raise_error(F.concat(F.lit("expected a finite nonnegative weight: "), w.number.cast("string"))).cast("double")
    weight = F.when(bad, refused).otherwise(w.number)
    used = F.when((weight > 0) & v.number.isNotNull(), weight)
    product = F.when(used.isNotNull(), used * v.number)
    none = F.raise_error(F.lit("no positive retained weight")).cast("double")
    mean = F.sum(product) / F.when(F.sum(used) > 0, F.sum(used))
    over = F.raise_error(F.lit("a weighted mean of finite values is not finite")).cast("double")
    finite = F.coalesce(F.max(F.abs(v.number)) < INF, F.lit(True))
    return F.when(F.count(used) == 0, none).when(finite & (F.abs(mean) == INF), over).otherwise(mean)


def _share(text: str) -> float:
    value = float(text)
    if not 0 <= value <= 0.5:
        raise UserError(f"invalid trim value {text}: expected 0 <= X <= 0.5")
    return value


def _percent(text: str) -> int:
    from tablewright.errors import Refusal

    value = float(text)
    if value != int(value):
        raise Refusal(f"percentile {text} is not an integer")
    if not 1 <= value <= 100:
        raise UserError(f"invalid percentile value {text}")
    return int(value)


REGISTRY: dict[str, Aggregate] = {
    "count": Aggregate(lambda s: s.n, "count", 0),
    "countunique": Aggregate(lambda s: F.count_distinct(fold(s.text) if s.ignore_case else s.text), "count", 0),
    "unique": Aggregate(_unique, "text", ""),
    "collapse": Aggregate(lambda s: F.array_join(s.in_order(s.text), s.delimiter), "text", ""),
    "first": Aggregate(lambda s: F.min_by(s.text, F.when(s.text.isNotNull(), s.order)), "text", "N/A"),
    "last": Aggregate(lambda s: F.max_by(s.text, F.when(s.text.isNotNull(), s.order)), "text", "N/A"),
    "rand": Aggregate(lambda s: F.min_by(s.text, F.when(s.text.isNotNull(), F.rand())), "text", "N/A"),
    "sum": Aggregate(lambda s: F.sum(s.number), empty=0.0),
    "mean": Aggregate(lambda s: F.avg(s.number)),
    "min": Aggregate(_extreme(F.min), empty=-INF),
    "max": Aggregate(_extreme(F.max), empty=INF),
    "absmin": Aggregate(_by_magnitude(F.min_by, 1), empty=-INF),
    "absmax": Aggregate(_by_magnitude(F.max_by, -1), empty=INF),
    "range": Aggregate(lambda s: _extreme(F.max)(s) - _extreme(F.min)(s)),
    "geomean": Aggregate(lambda s: F.exp(F.avg(_logarithm(s.number)))),
    "harmmean": Aggregate(lambda s: F.try_divide(s.n.cast("double"), F.sum(_inverse(s.number)))),
    "ms": Aggregate(lambda s: F.avg(s.number * s.number)),
    "rms": Aggregate(lambda s: F.sqrt(F.avg(s.number * s.number))),
    "trimmean": Aggregate(_trimmed, param=_share, default=0.0),
    "median": Aggregate(_quantile(0.5)),
    "q1": Aggregate(_quantile(0.25)),
    "q3": Aggregate(_quantile(0.75)),
    "iqr": Aggregate(_iqr),
    "perc": Aggregate(lambda s, p: F.percentile(s.number, F.lit(p / 100)), param=_percent, default=95),
    "mode": Aggregate(lambda s: _runs(s.ascending, lambda n, best: n > best)),
    "antimode": Aggregate(lambda s: _runs(s.ascending, lambda n, best: n < best)),
    "pvar": Aggregate(lambda s: F.var_pop(s.number)),
    "svar": Aggregate(lambda s: F.var_samp(s.number)),
    "pstdev": Aggregate(lambda s: F.stddev_pop(s.number)),
    "sstdev": Aggregate(lambda s: F.stddev_samp(s.number)),
    "madraw": Aggregate(_mad(1.0)),
    "mad": Aggregate(_mad(1.4826)),
    "pskew": Aggregate(lambda s: _at_least(s.n, 2, _skew(s))),
    "sskew": Aggregate(_sample_skew),
    "pkurt": Aggregate(lambda s: _at_least(s.n, 2, _kurt(s))),
    "skurt": Aggregate(_sample_kurt),
    "jarque": Aggregate(_jarque),
    "dpo": Aggregate(_dpo),
    "pcov": Aggregate(lambda a, b: F.covar_pop(*_both(a, b)), arity=2),
    "scov": Aggregate(lambda a, b: F.covar_samp(*_both(a, b)), arity=2),
    "ppearson": Aggregate(_pearson, arity=2),
    "spearson": Aggregate(lambda a, b: _at_least(F.count(_both(a, b)[0]), 2, _pearson(a, b)), arity=2),
    "dotprod": Aggregate(lambda a, b: F.sum(_both(a, b)[0] * b.number), arity=2),
    "wmean": Aggregate(_weighted, arity=2),
}
ALIASES = {"uniq": "unique"}
#: Operations that read a field as text.
TEXTUAL = {"count", "countunique", "unique", "collapse", "first", "last", "rand"}
#: Operations whose result depends on row order.
ORDERED = {"collapse", "first", "last"}


def finish(name: str, raw: Column) -> Column:
    """The raw aggregate with the operation's defined result for an empty sample, and its type."""
    spec = REGISTRY[name]
    if spec.kind == "count":
        return raw.cast("long")
    if spec.kind == "text":
        return F.when(raw.isNull(), F.lit(spec.empty)).otherwise(raw)
    return F.coalesce(raw.cast("double"), F.lit(spec.empty))
