"""Per-row operations: one result for each input row."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tablewright.errors import UserError
from tablewright.functions.values import INF, NAN, number, unless_missing
from tablewright.operators.summary import quoted

#: Suffixes of compressed and encrypted files, which take the extension before them along.
PACKED = ("gz", "xz", "lz", "gpg", "bz2", "std")
_EXTENSION = rf"(?s)^.+?((?:\.[0-9A-Za-z]+)?\.(?:{'|'.join(PACKED)})|\.[0-9A-Za-z]+)$"
#: The characters of each kind of embedded number.
NUMBER_CLASSES = {"n": "0-9", "i": r"0-9+\-", "d": r"0-9.+\-eE", "p": "0-9.+", "h": "0-9a-fA-F", "o": "0-7"}
BIG = float(2**53)


def _whole(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """A rounding function kept within doubles: what is integral already (and not finite) stays."""
    return lambda v: F.when(F.isnan(v) | (F.abs(v) >= BIG), v).otherwise(f(v).cast("double"))


def _away(v: Column) -> Column:
    """Ties away from zero; a fraction just below a half stays below."""
    low = F.floor(F.abs(v)).cast("double")
    return F.signum(v) * F.when(F.abs(v) - low >= 0.5, low + 1).otherwise(low)


ROUNDING = {
    "round": lambda v: _whole(_away)(v) + F.lit(0.0),
    "floor": lambda v: _whole(F.floor)(v),
    "ceil": lambda v: _whole(F.ceil)(v),
    "trunc": lambda v: _whole(lambda x: F.signum(x) * F.floor(F.abs(x)))(v) + F.lit(0.0),
    "frac": lambda v: F.when(F.abs(v) == INF, 0.0).otherwise(v - _whole(lambda x: F.signum(x) * F.floor(F.abs(x)))(v)),
}


def bin_of(v: Column, size: float) -> Column:
    """The lower bound of the value's bin; bins of no width hold zero only."""
    if size == 0:
        return F.when(v == 0, 0.0).otherwise(NAN)
    return _whole(F.floor)(v / size) * size + F.lit(0.0)


def string_bin(text: Column, bins: int) -> Column:
    """A bin from 0 for any text: a rotating 64-bit hash of its bytes, modulo ``bins``."""

    @F.pandas_udf("long")
    def run(values: pd.Series) -> pd.Series:
        coded = [v.encode() for v in values.dropna()]
        size = np.fromiter(map(len, coded), np.int64, len(coded))
        data, begin = np.frombuffer(b"".join(coded), np.uint8), np.cumsum(size) - size
        # The longest first: byte i of all texts that have one is a step of them together.
        by = np.argsort(-size, kind="stable")
        begin, longer = begin[by], np.searchsorted(-size[by], -np.arange(int(size.max(initial=0))), side="left")
        h = np.zeros(len(coded), np.uint64)
        for i, n in enumerate(longer.tolist()):
            h[:n] = (h[:n] << np.uint64(9) | h[:n] >> np.uint64(55)) + data[begin[:n] + i]
        out = np.empty(len(coded), np.int64)
        out[by] = h % np.uint64(bins)
        return pd.Series(out, index=values.dropna().index).reindex(values.index).astype("Int64")

    return run(text)


def embedded_number(text: Column, kind: str) -> Column:
    """The first number in a text: the first run of the kind's characters, as far as it parses; none: 0."""
    if kind not in NUMBER_CLASSES:
        raise UserError(f"invalid getnum type '{kind}'")
    run = F.regexp_extract(text, f"[{NUMBER_CLASSES[kind]}]+", 0)
    if kind in ("p", "d"):
        part = F.regexp_extract(run, r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?", 0)
        return F.coalesce(F.nullif(part, F.lit("")).try_cast("double"), F.lit(0.0))
    if kind in ("n", "i"):
        part = F.regexp_extract(run, r"^[+-]?[0-9]+", 0)
        return F.coalesce(F.nullif(part, F.lit("")).try_cast("long").cast("double"), F.lit(0.0))
    base, most = (16, 16) if kind == "h" else (8, 21)
    digits = F.regexp_replace(run, "^0+(?=.)", "")
    fits = (F.length(digits) < most) | (F.length(digits) == most) & (F.substring(digits, 1, 1) < "8" if kind == "h" else F.lit(True))
    return F.when(fits, F.coalesce(F.conv(F.nullif(run, F.lit("")), base, 10).try_cast("long").cast("double"), F.lit(0.0))).otherwise(0.0)


def strict_unbase64(text: Column) -> Column:
    """Text of padded base 64, up to a NUL; anything else is an error."""
    good = text.rlike(r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$")
    bad = F.raise_error(F.concat(F.lit("invalid base64 value: '"), text, F.lit("'"))).cast("string")
    return F.when(good, F.substring_index(F.unbase64(text).cast("string"), "\0", 1)).when(text.isNotNull(), bad)


def directory(path: Column) -> Column:
    bare = F.regexp_replace(path, "(?<=.)/+$", "")
    stem = F.regexp_replace(F.regexp_extract(bare, "(?s)^(.*)/[^/]*$", 1), "(?<=[^/])/+$", "")
    slashes = F.when(path.rlike("^//[^/]") | (path == "//"), "//").otherwise("/")
    return (
        F.when(path == "", ".")
        .when(path.rlike("^/+$"), F.when(path == "//", "//").otherwise("/"))
        .when(~bare.contains("/"), ".")
        .when(stem.rlike("^/*$"), slashes)
        .otherwise(stem)
    )


def base_name(path: Column) -> Column:
    return F.when(path == "", "").when(path.rlike("^/+$"), "/").otherwise(F.regexp_extract(path, "(?s)([^/]*)/*$", 1))


def extension(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(base_name(path), _EXTENSION, 1), r"^\.", "")


def bare_name(path: Column) -> Column:
    name, ext = base_name(path), extension(path)
    return F.when(ext == "", name).otherwise(F.left(name, F.length(name) - F.length(ext) - 1))


@dataclass(frozen=True)
class RowOp:
    build: Callable[..., Column]
    textual: bool = True
    missing: object = ""
    param: Callable[[str], object] | None = None
    default: object = None


def _bins(text: str) -> int:
    n = int(text)
    if n <= 0:
        raise UserError("bucket size must not be zero" if n == 0 else f"invalid bucket size {text}")
    return n


ROW_OPS: dict[str, RowOp] = {
    "cut": RowOp(lambda t: t, missing="N/A"),
    **{k: RowOp(f, False, NAN) for k, f in ROUNDING.items()},
    "bin": RowOp(bin_of, False, NAN, float, 100.0),
    "strbin": RowOp(string_bin, True, 0, _bins, 10),
    "getnum": RowOp(embedded_number, True, NAN, str, "p"),
    "base64": RowOp(lambda t: F.base64(t.cast("binary"))),
    "debase64": RowOp(strict_unbase64),
    "md5": RowOp(lambda t: F.md5(t.cast("binary"))),
    "sha1": RowOp(lambda t: F.sha1(t.cast("binary"))),
    **{f"sha{n}": RowOp(lambda t, n=n: F.sha2(t.cast("binary"), n)) for n in (224, 256, 384, 512)},
    "dirname": RowOp(directory),
    "basename": RowOp(base_name),
    "extname": RowOp(extension),
    "barename": RowOp(bare_name),
}
ROW_ALIASES = {"echo": "cut"}


def row_column(df: DataFrame, name: str, field: str, param: object = None, narm: bool = False, separator: str = ".") -> Column:
    """One per-row operation on a field of ``df``."""
    name = ROW_ALIASES.get(name, name)
    spec = ROW_OPS.get(name)
    if spec is None:
        raise UserError(f"invalid operation '{name}'")
    if param is not None and spec.param is None:
        raise UserError(f"too many parameters for operation '{name}'")
    args = [spec.default if param is None else spec.param(str(param))] if spec.param else []
    kind = df.schema[field].dataType
    column = unless_missing(quoted(field), kind, narm)
    value = spec.build(column.cast("string") if spec.textual else number(column, kind, field, separator), *args)
    return F.when(column.isNull(), F.lit(spec.missing)).otherwise(value) if narm else value
