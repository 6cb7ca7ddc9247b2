"""The command language: options, a mode or operations over fields, planned as DataFrames.

``parse`` checks a command without looking at any data; ``run`` binds it to its input and returns lines of text.
"""

from __future__ import annotations

import getopt
import re
import secrets
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablewright.errors import Refusal, UserError, Violation
from tablewright.functions.display import DEFAULT, parse_format, rounded
from tablewright.operators import compare as comparison, health as table_health, modes, seeded
from tablewright.operators.aggregates import ALIASES, REGISTRY
from tablewright.operators.exact import exact_summary
from tablewright.operators.rows import ROW_ALIASES, ROW_OPS, row_column
from tablewright.operators.summary import Op, op, quoted, summarise
from tablewright.plans.order import ordinals
from tablewright.sources.sinks import header_line, lines, renamed
from tablewright.sources.strict_csv import read_csv
from tablewright.sources.text import TextTable, read_text

SHORT = "zt:Wg:iCHfF:R:c:sS:hV"
LONG = [
    "zero-terminated", "field-separator=", "whitespace", "group=", "ignore-case", "skip-comments", "header-in", "header-out", "headers", "vnlog", "full",
    "filler=", "format=", "round=", "output-delimiter=", "collapse-delimiter=", "sort", "seed=", "no-strict", "narm", "sort-cmd=", "result-name=", "csv-in", "csv-out", "csv", "color", "no-color", "help", "version", "exact",
]
SHORT_OF = {"z": "zero-terminated", "t": "field-separator", "W": "whitespace", "g": "group", "i": "ignore-case", "C": "skip-comments", "H": "headers", "f": "full", "F": "filler", "R": "round", "c": "collapse-delimiter", "s": "sort", "S": "seed"}
_CALCULATION = {"full", "no-strict", "filler", "collapse-delimiter", "seed"}
#: Options that a mode has no use for; where one is given the command is refused, never partly obeyed.
UNSUPPORTED = {
    "health": _CALCULATION | {"result-name", "format", "round", "header-out", "csv-in", "csv-out", "csv", "narm", "sort", "ignore-case", "group", "output-delimiter", "exact"},
    "selection": _CALCULATION - {"full"} | {"result-name", "format", "round", "vnlog", "exact"},
    "compare": _CALCULATION | {"vnlog", "exact"},
}
#: Options that say how other input than CSV, or annotated input, is written.
NOT_CSV, NOT_VNLOG = ("field-separator", "whitespace", "skip-comments"), ("filler", "field-separator", "output-delimiter", "zero-terminated")
#: Fixed value: the longest result name.
NAME_BYTES = 511
CSV_MODES = {"summary", "rows", "top", "bottom", "compare"}
MODES = {"transpose", "reverse", "check", "noop", "nop", "rmdup", "dedup", "crosstab", "ct", "health", "compare", "groupby", "grouping", "gb"}


@dataclass
class Options:
    separator: str = "\t"
    whitespace: bool = False
    zero: bool = False
    group: list[str] = field(default_factory=list)
    ignore_case: bool = False
    skip_comments: bool = False
    header_in: bool = False
    header_out: bool = False
    vnlog: bool = False
    full: bool = False
    filler: str = modes.FILLER
    format: str = DEFAULT
    output_delimiter: str | None = None
    collapse: str = ","
    sort: bool = False
    seed: int | None = None
    strict: bool = True
    narm: bool = False
    result_names: dict[int, str] = field(default_factory=dict)
    csv_in: bool = False
    csv_out: bool = False
    exact: bool = False
    given: tuple[str, ...] = ()

    @property
    def delimiter(self) -> str:
        return self.output_delimiter or (" " if self.vnlog else "\t" if self.whitespace else self.separator)


@dataclass
class Request:
    """One operation as written: its name, parameter and field selectors (pairs for paired operations)."""

    name: str
    param: str | None
    selectors: list[tuple[str, ...]]


@dataclass
class Health:
    """What is declared of a table; rules are (type, required or nonmissing, field selector, type or None)."""

    examples: int = 3
    width: int | None = None
    validate: bool = False
    tsv: bool = False
    rules: list[tuple[str, str, str | None]] = field(default_factory=list)


@dataclass
class Command:
    options: Options
    mode: str
    requests: list[Request] = field(default_factory=list)
    keys: list[str] = field(default_factory=list)
    number: int | None = None
    words: list[str] = field(default_factory=list)
    health: Health = field(default_factory=Health)


def _one_character(text: str, what: str) -> str:
    if len(text) != 1:
        raise UserError(f"the {what} must be a single character")
    return text


def options_of(args: Sequence[str]) -> tuple[Options, list[str]]:
    """Options anywhere among the operands, clustered short ones and unambiguous prefixes of long ones included."""
    try:
        found, rest = getopt.gnu_getopt(list(args), SHORT, LONG)
    except getopt.GetoptError as e:
        raise UserError(str(e)) from None
    o = Options(given=tuple(SHORT_OF.get(name[1:], name.lstrip("-")) for name, _ in found))
    for name, value in found:
        match name:
            case "-z" | "--zero-terminated":
                o.zero = True
            case "-t" | "--field-separator":
                o.separator, o.whitespace = _one_character(value, "field separator"), False
            case "-W" | "--whitespace":
                o.whitespace = True
            case "-g" | "--group":
                o.group += selectors(value)
            case "-i" | "--ignore-case":
                o.ignore_case = True
            case "-C" | "--skip-comments":
                o.skip_comments = True
            case "--header-in":
                o.header_in = True
            case "--header-out":
                o.header_out = True
            case "-H" | "--headers":
                o.header_in = o.header_out = True
            case "--vnlog":
                o.vnlog = o.whitespace = o.skip_comments = o.header_in = o.header_out = True
            case "-f" | "--full":
                o.full = True
            case "-F" | "--filler":
                o.filler = value
            case "--format":
                parse_format(value)
                o.format = value
            case "-R" | "--round":
                o.format = rounded(int(value) if value.isdigit() else 0)
            case "--output-delimiter":
                o.output_delimiter = _one_character(value, "output delimiter")
            case "-c" | "--collapse-delimiter":
                o.collapse = _one_character(value, "collapse delimiter")
            case "-s" | "--sort":
                o.sort = True
            case "-S" | "--seed":
                if not value.isdigit():
                    raise UserError(f"invalid seed '{value}'")
                o.seed = int(value) & 0xFFFFFFFF
            case "--no-strict":
                o.strict = False
            case "--narm":
                o.narm = True
            case "--result-name":
                i, colon, label = value.partition(":")
                if not colon or not i.isdigit() or int(i) in o.result_names:
                    raise UserError(f"invalid result name '{value}'")
                o.result_names[int(i)] = label
            case "--csv-in":
                o.csv_in = True
            case "--csv-out":
                o.csv_out = True
            case "--csv":
                o.csv_in = o.csv_out = True
            case "--exact":
                o.exact = True
            case "--sort-cmd":
                raise Refusal("an external sort command isn't supported")
            case "-h" | "--help" | "-V" | "--version":
                raise UserError(f"{name} takes no other part in a command: give it alone")
    if o.csv_in or o.csv_out:
        for name in ("zero-terminated", "vnlog", *NOT_CSV * o.csv_in, *["output-delimiter"] * o.csv_out):
            if name in o.given:
                raise UserError(f"CSV conflicts with --{name}")
    if o.csv_in:
        o.separator = ","
    if o.vnlog:
        for name in NOT_VNLOG:
            if name in o.given:
                raise UserError(f"vnlog conflicts with --{name}")
    return o, rest


def selectors(text: str) -> list[str]:
    """A list of selectors; ascending ranges of numbers are written out, a backslash keeps the next character."""
    out = []
    for part in re.findall(r"(?:\\.|[^,\\])+", text):
        found = re.fullmatch(r"(\d+)-(\d+)", part)
        if found:
            low, high = int(found[1]), int(found[2])
            if low >= high:
                raise UserError(f"invalid field range {part}")
            out += map(str, range(low, high + 1))
        else:
            out.append(re.sub(r"\\(.)", r"\1", part))
    if not out or text.startswith(",") or text.endswith(","):
        raise UserError(f"invalid field list '{text}'")
    return out


def _requests(words: list[str]) -> list[Request]:
    out, at = [], 0
    while at < len(words):
        name, colon, param = words[at].partition(":")
        name = ALIASES.get(ROW_ALIASES.get(name, name), name) if name not in ROW_ALIASES else ROW_ALIASES[name]
        known = REGISTRY.get(name) or ROW_OPS.get(name)
        if known is None:
            raise UserError(f"invalid operation '{words[at]}'")
        if colon and known.param is None:
            raise UserError(f"too many parameters for operation '{name}'")
        if colon:
            known.param(param)
        if at + 1 >= len(words):
            raise UserError(f"missing field for operation '{name}'")
        arity = getattr(known, "arity", 1)
        fields: list[tuple[str, ...]] = []
        if arity == 2:
            for part in words[at + 1].split(","):
                pair = part.split(":")
                if len(pair) != 2 or not all(pair):
                    raise UserError(f"operation '{name}' takes pairs of fields")
                fields.append(tuple(pair))
        else:
            if re.search(r"(?<!\\):", words[at + 1]):
                raise UserError(f"operation '{name}' does not take a pair of fields")
            fields = [(s,) for s in selectors(words[at + 1])]
        out.append(Request(name, param if colon else None, fields))
        at += 2
    kinds = {r.name in ROW_OPS for r in out}
    if len(kinds) == 2:
        raise UserError("conflicting operation found: per-row and summary operations don't mix")
    return out


def _health(words: list[str], o: Options) -> Health:
    out, seen, rest = Health(), {}, iter(words)
    for word in rest:
        if word in ("examples", "width"):
            n = next(rest, "")
            if not re.fullmatch("[0-9]+", n):
                raise UserError(f"health: {word} requires a nonnegative decimal integer")
            if seen.setdefault(word, int(n)) != int(n):
                raise UserError(f"health: conflicting {word}")
            setattr(out, word, int(n))
        elif word == "validate":
            out.validate = True
        elif word == "tsv":
            out.tsv = True
        elif word in ("type", "required", "nonmissing"):
            found = selectors(next(rest, ""))
            if len(found) != 1:
                raise UserError(f"health: {word} takes one field")
            if not found[0].isdigit() and not o.header_in:
                raise UserError("health: named fields require a header")
            kind = next(rest, None) if word == "type" else None
            if word == "type" and kind not in ("integer", "number", "text"):
                raise UserError("health: type requires integer, number or text")
            out.rules.append((word, found[0], kind))
        else:
            raise UserError(f"health: unknown control '{word}'")
    if out.validate and out.width is None and not out.rules:
        raise UserError("health: validate requires a type, required, nonmissing or width rule")
    return out


def parse(args: Sequence[str]) -> Command:
    """A checked command. Nothing is read."""
    command = _parsed(args)
    o, mode = command.options, command.mode
    for name in UNSUPPORTED.get("selection" if mode in ("top", "bottom") else mode, ()):
        if name in o.given:
            raise (UserError if mode == "health" else Refusal)(f"{mode} does not support --{name}")
    if (o.csv_in or o.csv_out) and mode not in CSV_MODES:
        raise Refusal(f"CSV with {mode} isn't supported")
    if mode == "compare" and any(r.name in ROW_OPS or REGISTRY[r.name].kind == "text" for r in command.requests):
        raise Refusal("compare takes numeric summary operations")
    selected = [*command.keys, *(s for r in command.requests for pair in r.selectors for s in pair), *(command.words if mode in ("top", "bottom") else ())]
    if not o.header_in and not all(s.isdigit() for s in selected):
        raise UserError("named fields need a header: use -H or --header-in")
    for name in o.result_names.values():
        if len(name.encode()) > NAME_BYTES:
            raise Refusal(f"a result name has more than {NAME_BYTES} bytes")
    return command


def _parsed(args: Sequence[str]) -> Command:
    o, words = options_of(args)
    if not words:
        raise UserError("missing operation")
    head, rest = words[0], words[1:]
    keys = list(o.group)
    if head in ("groupby", "grouping", "gb"):
        if not rest:
            raise UserError("missing field for grouping")
        keys, head, rest = selectors(rest[0]), rest[1] if len(rest) > 1 else "", rest[2:]
        if not head:
            raise UserError("missing operation")
        words = [head, *rest]
    chosen = re.fullmatch(r"(top|bottom):(\d+)", head)
    if chosen:
        if len(rest) != 1:
            raise UserError("a selection takes one field")
        return Command(o, chosen[1], keys=keys, number=int(chosen[2]), words=selectors(rest[0]))
    if head not in MODES:
        requests = _requests(words)
        if requests[0].name in ROW_OPS and keys:
            raise UserError("per-row operations take no groups")
        if o.exact and o.full:
            raise Refusal("full rows with extended precision aren't supported")
        return Command(o, "rows" if requests[0].name in ROW_OPS else "summary", requests, keys)
    mode = {"nop": "noop", "dedup": "rmdup", "ct": "crosstab"}.get(head, head)
    if mode == "rmdup":
        if len(rest) != 1:
            raise UserError("duplicate removal takes one field")
        keys = selectors(rest[0])
        if len(keys) != 1:
            raise Refusal("duplicate removal takes exactly one field")
        return Command(o, mode, keys=keys)
    if mode == "crosstab":
        keys = selectors(rest[0]) if rest else []
        if len(keys) != 2:
            raise UserError("crosstab requires exactly 2 fields")
        requests = _requests(rest[1:])
        if len(requests) > 1 or requests and (requests[0].name in ROW_OPS or len(requests[0].selectors) != 1):
            raise UserError("crosstab takes one operation")
        return Command(o, mode, requests, keys)
    if mode == "compare":
        if len(rest) < 3:
            raise UserError("compare takes two inputs and operations")
        inputs, rest, words = rest[:2], rest[2:], []
        number = by = limit = None
        while rest and rest[0] in ("rank", "limit", "absolute", "percent"):
            if rest[0] == "rank":
                number, rest = rest[1], rest[2:]
            elif rest[0] == "limit":
                limit, rest = rest[1], rest[2:]
            else:
                by, rest = rest[0], rest[1:]
        return Command(o, mode, _requests(rest), keys, int(number) if number else None, [*inputs, by or "absolute", limit or ""])
    if mode == "check":
        counts = {}
        while rest:
            if len(rest) < 2 or not rest[0].isdigit():
                raise UserError("check takes counts of lines and fields")
            unit = {"lines": "lines", "line": "lines", "rows": "lines", "row": "lines", "fields": "fields", "field": "fields", "columns": "fields", "column": "fields", "col": "fields"}.get(rest[1])
            if unit is None or unit in counts:
                raise UserError(f"invalid check '{rest[1]}'")
            counts[unit], rest = int(rest[0]), rest[2:]
        return Command(o, mode, words=[str(counts.get("lines", "")), str(counts.get("fields", ""))])
    if mode == "health":
        return Command(o, mode, keys=keys, health=_health(rest, o))
    if rest:
        raise UserError(f"extra operand '{rest[0]}'")
    return Command(o, mode, keys=keys)


def source(spark: SparkSession, o: Options, path: str) -> TextTable:
    if o.csv_in:
        return read_csv(spark, path, o.separator, o.header_in)
    return read_text(spark, path, o.separator, o.whitespace, o.zero, o.skip_comments, o.header_in, o.vnlog)


def _bound(command: Command, table: TextTable) -> tuple[DataFrame, list[str], list[tuple[Request, tuple[str, ...]]], dict[str, str]]:
    """The rows with a column for every selected field, key columns, each request's columns, and the columns' labels."""
    positions: dict[str, int] = {}

    def column(selector: str) -> str:
        at = table.position(selector)
        positions[f"f{at}"] = at
        return f"f{at}"

    keys = [column(k) for k in command.keys]
    wanted = [(r, tuple(column(s) for s in pair)) for r in command.requests for pair in r.selectors]
    df = table.columns(positions) if positions else table.rows.select("rid")
    return df, keys, wanted, {c: table.label(p) for c, p in positions.items()}


def _label(r: Request, columns: tuple[str, ...], labels: dict[str, str]) -> str:
    spec = REGISTRY.get(r.name) or ROW_OPS[r.name]
    own = f":{r.param}" if r.param is not None and r.name in ("perc", "trimmean") else f":{spec.default}" if r.name == "perc" else ""
    return f"{r.name}{own}({','.join(labels[c] for c in columns)})"


def run(spark: SparkSession, args: Sequence[str], path: str | None = None) -> DataFrame:
    """(value): the command's output, a row for each line, in order; the header line, if any, comes first."""
    command = parse(args)
    o = command.options
    if command.mode == "compare":
        return _compare(spark, command)
    if path is None:
        raise UserError("this command reads one input")
    table = source(spark, o, path)
    names: list[str] = []
    if command.mode == "summary":
        df, keys, wanted, labels = _bound(command, table)
        ops = [replace(op(r.name, *cols, param=r.param), alias=f"r{i}") for i, (r, cols) in enumerate(wanted)]
        shown_keys = [f"GroupBy({labels[k]})" for k in keys]
        names = shown_keys + [_label(r, cols, labels) for r, cols in wanted]
        if o.exact:
            result = exact_summary(df, ops, "rid", keys, o.sort, o.format, o.narm, o.ignore_case)
        else:
            whole = df
            if o.full:
                width = len(table.names) if table.names else table.rows.agg(F.max(F.size("fields"))).first()[0] or 0
                whole = df.join(table.rows, "rid")
                names = [table.label(i + 1) for i in range(width)] + names[len(keys) :]
            if any(x.name == "rand" for x in ops) and (o.seed is not None or o.full):
                # The full row is the chosen one, which takes draws that can be repeated: any seed will do.
                seed = secrets.randbits(32) if o.seed is None else o.seed
                result = seeded.seeded_rand(whole, ops, seed, "rid", keys, o.sort or not keys, o.narm, o.ignore_case, o.full, o.collapse)
            else:
                result = summarise(whole, ops, keys, "rid", o.sort, o.narm, o.ignore_case, o.full, o.collapse)
            if o.full:
                result = result.select(*[F.get("fields", F.lit(i)).alias(f"w{i}") for i in range(width)], *[x.alias for x in ops])
    elif command.mode == "rows":
        df, _, wanted, labels = _bound(command, table)
        names = [_label(r, cols, labels) for r, cols in wanted]
        made = [row_column(df, r.name, cols[0], r.param, o.narm).alias(f"r{i}") for i, (r, cols) in enumerate(wanted)]
        if o.full:
            width = len(table.names) if table.names else table.rows.agg(F.max(F.size("fields"))).first()[0] or 0
            df = df.join(table.rows, "rid")
            made = [F.get("fields", F.lit(i)).alias(f"w{i}") for i in range(width)] + made
            names = [table.label(i + 1) for i in range(width)] + names
        result = df.orderBy("rid").select(*made)
    elif command.mode in ("top", "bottom"):
        command.requests = [Request("count", None, [(s,) for s in command.words])]
        df, keys, wanted, _ = _bound(command, table)
        picked = modes.top(df.join(table.rows, "rid"), wanted[0][1][0], command.number, "rid", command.mode == "bottom", keys, o.sort, o.narm, o.ignore_case)
        names, result = list(table.names or ()), picked.select(F.concat_ws(o.delimiter, "fields").alias("value"))
        if o.csv_out:
            from tablewright.sources.sinks import csv_quoted

            result = picked.select(F.array_join(F.transform("fields", csv_quoted), ",").alias("value"))
        return _with_header(spark, result, names, o) if o.header_out and table.names else result
    else:
        return _table_mode(spark, command, table)
    names = renamed(names, o.result_names)
    out = lines(result, o.delimiter, o.csv_out, o.format)
    return _with_header(spark, out, names, o) if o.header_out else out


def _with_header(spark: SparkSession, out: DataFrame, names: list[str], o: Options) -> DataFrame:
    top = spark.createDataFrame([(("# " if o.vnlog else "") + header_line(names, o.delimiter, o.csv_out),)], "value string")
    return top.unionAll(out)


def _table_mode(spark: SparkSession, command: Command, table: TextTable) -> DataFrame:
    o = command.options
    joined = lambda df: df.select(F.concat_ws(o.delimiter, "fields").alias("value"))
    if command.mode == "noop":
        return joined(modes.noop(table.rows, o.full).orderBy("rid"))
    if command.mode == "reverse":
        if o.strict:
            modes.check(table.rows, rid="rid")
        out = joined(modes.reverse(table.rows).orderBy("rid"))
        return _with_header(spark, out, list(reversed(table.names or ())), o) if o.header_out and table.names else out
    if command.mode == "transpose":
        return joined(modes.transpose(table.rows, "rid", o.strict, o.filler))
    if command.mode == "check":
        want = [int(w) if w else None for w in command.words]
        found = modes.check(table.rows, *want, rid="rid")
        return found.select(F.concat(F.col("n_lines").cast("string"), F.lit(" lines, "), F.col("n_fields").cast("string"), F.lit(" fields")).alias("value"))
    if command.mode == "rmdup":
        df, keys, _, _ = _bound(command, table)
        out = joined(modes.remove_duplicates(df.join(table.rows, "rid"), keys, "rid", o.sort))
        return _with_header(spark, out, list(table.names or ()), o) if o.header_out and table.names else out
    if command.mode == "crosstab":
        df, keys, wanted, _ = _bound(command, table)
        what = replace(op(wanted[0][0].name, *wanted[0][1], param=wanted[0][0].param), alias="cell") if wanted else None
        made = modes.crosstab(df, keys[0], keys[1], what, "rid", o.sort, o.ignore_case, o.filler, narm=o.narm)
        top = spark.createDataFrame([(o.delimiter.join(["", *made.columns[1:]]),)], "value string")
        return top.unionAll(lines(made, o.delimiter, format=o.format))
    if command.mode == "health":
        return spark.createDataFrame([(x,) for x in _health_report(command, table)], "value string")
    raise UserError(f"invalid mode '{command.mode}'")


def _health_report(command: Command, table: TextTable) -> list[str]:
    """The report's lines; a Violation that has them if validation is asked for and a declared rule doesn't hold."""
    o, asked, types, presence = command.options, command.health, {}, {}
    for word, selector, kind in asked.rules:
        if table.names and table.names.count(selector) > 1 and (o.vnlog or not selector.isdigit()):
            raise UserError(f"health: field name '{selector}' is ambiguous in the header")
        at = table.position(selector)
        if word == "type":
            if types.setdefault(at, kind) != kind:
                raise UserError(f"health: conflicting types for field {at}")
        elif presence.get(at) != "nonmissing":
            presence[at] = word
    rows = table.rows
    if o.skip_comments:  # lines that were left out have no number
        rows = ordinals(rows, "rid").select((F.col("_line") + int(table.names is not None)).alias("rid"), "raw", "fields")
    report = table_health.inspect(rows, table.names, asked.width, types, presence, asked.examples, o.separator.join(table.names or ()))
    settings = [
        ("separator_kind", "whitespace" if o.whitespace else "literal"), ("separator", "" if o.whitespace else o.separator), ("record_terminator", "nul" if o.zero else "lf"),
        ("numeric_decimal_separator", "."), ("input_header", "yes" if o.header_in else "no"), ("comment_filter", "vnlog" if o.vnlog else "comments" if o.skip_comments else "none"),
        ("vnlog", "yes" if o.vnlog else "no"), ("record_numbering", "accepted_records_1based"),
    ]
    lines = table_health.tsv(report, settings) if asked.tsv else table_health.readable(report, settings, asked.validate)
    if asked.validate and report.violated:
        raise Violation("declared rules are violated", lines)
    return lines


def _compare(spark: SparkSession, command: Command) -> DataFrame:
    o = command.options
    a, b, by, limit = command.words
    sides = [_bound(command, source(spark, o, p)) for p in (a, b)]
    (df, keys, wanted, labels), (other, other_keys, other_wanted, _) = sides
    back = {x: y for x, y in zip(other_keys + [c for _, cols in other_wanted for c in cols], keys + [c for _, cols in wanted for c in cols])}
    other = other.select("rid", *[quoted(x).alias(y) for x, y in back.items()])
    ops = [replace(op(r.name, *cols, param=r.param), alias=f"r{i}") for i, (r, cols) in enumerate(wanted)]
    result = comparison.compare(df, other, ops, keys, command.number, by, int(limit) if limit else None, o.narm, o.ignore_case)
    out = lines(result, o.delimiter, o.csv_out, o.format)
    if not o.header_out:
        return out
    names = [labels[k] for k in keys] + ["presence", "rank_state"]
    for r, cols in wanted:
        names += [f"{_label(r, cols, labels)} {part}" for part in ("before", "after", "difference", "difference_state", "percentage", "percentage_state")]
    return _with_header(spark, out, names, o)
