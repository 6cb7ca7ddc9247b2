"""Table health: what every field's cells are, what looks wrong, and whether declared rules hold.

One scan profiles the table: each task counts widths of records and classes of cells and keeps the earliest few of each,
and what the tasks found is added up, a row for each field and class. The report is made from that, so its size follows
the number of fields, not of rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablewright.functions.values import MISSING, NUMBER

#: The classes that partition a field's cells, what a report counts them as, and a cell's name in examples.
CLASSES = ("absent", "empty", "missing", "integer", "other_number", "text")
COUNTERS = {c: f"{c}_values" for c in CLASSES}
OBSERVED = {c: c for c in CLASSES} | {"missing": "missing_indicator"}
INTEGER = r"^[ \t\n\r\x0B\f]*[+-]?[0-9]+$"
#: Categories of findings with their unit, readable title and advice.
CATEGORIES = {
    "header_width_mismatch": ("header_records", "Header width mismatch", "Check the input header, field separator and supplied width."),
    "width_mismatch": ("data_records", "Record width mismatch", "Check the field separator and records with unexpected widths."),
    "blank_header": ("header_fields", "Blank header names", "Give unnamed fields a name if you want to select them by name."),
    "duplicate_header": ("header_fields", "Repeated header names", "Use distinct header names when selecting fields by name."),
    "absent_field": ("cells", "Absent fields", "Check the field separator and whether every record should contain this field."),
    "empty_field": ("cells", "Empty field values", "Check whether empty values are allowed for this field."),
    "missing_indicator": ("cells", "Missing value indicators", "Check whether these tokens mean missing data or are legitimate codes."),
    "mixed_types": ("fields", "Mixed value types", "Check whether this field should contain numbers or text, then supply a type rule if needed."),
    "type_mismatch": ("cells", "Type mismatch", "Check the affected values and the expected type."),
    "presence_mismatch": ("cells", "Presence rule not met", "Check the affected values and the supplied presence rule."),
}
#: The report's columns.
COLUMNS = "row_kind category basis field_index field_name count count_unit record_index expected observed sample sample_truncated examples_omitted".split()
SAMPLE_BYTES = 128
_EXAMPLES = "array<struct<rid:bigint,sample:binary,truncated:boolean>>"
_KIND = pa.list_(pa.struct([("rid", pa.int64()), ("sample", pa.binary()), ("truncated", pa.bool_())]))


@dataclass(frozen=True)
class Example:
    record: int
    observed: str
    sample: bytes
    truncated: bool


@dataclass
class FieldState:
    """A field (numbered from 1): counts and earliest examples by class, and what is declared of it."""

    position: int
    name: str = ""
    counts: dict[str, int] = field(default_factory=lambda: dict.fromkeys(CLASSES, 0))
    examples: dict[str, list[Example]] = field(default_factory=lambda: {c: [] for c in CLASSES})
    declared: str | None = None
    presence: str | None = None

    @property
    def numeric(self) -> int:
        return self.counts["integer"] + self.counts["other_number"]

    @property
    def expectation(self) -> str:
        if self.declared:
            return self.declared
        text = self.counts["text"]
        if self.numeric == text:
            return "undetermined"
        return "text" if text > self.numeric else "number" if self.counts["other_number"] else "integer"

    @property
    def basis(self) -> str:
        return "declared" if self.declared else "observation" if self.expectation == "undetermined" else "inferred"


@dataclass(frozen=True)
class Finding:
    category: str
    basis: str
    field: FieldState | None
    count: int
    expected: str
    candidates: int
    examples: list[Example]


@dataclass
class Report:
    """Everything that a table's profile and its declared rules tell."""

    records: int
    header: Sequence[str] | None
    baseline: int | None
    source: str
    widest: int | None
    limit: int
    fields: list[FieldState]
    findings: list[Finding]

    @property
    def violated(self) -> bool:
        return any(f.basis == "declared" for f in self.findings)


def classes(values: pa.Array) -> np.ndarray:
    """The number in CLASSES of each present cell, given as bytes."""
    is_ = lambda pattern: pc.match_substring_regex(values, pattern).to_numpy(zero_copy_only=False)
    kinds = [
        pc.equal(pc.binary_length(values), 0).to_numpy(zero_copy_only=False),
        is_("(?i)^(?:" + "|".join(MISSING) + ")$"),
        is_(INTEGER),
        is_(NUMBER),
    ]
    return np.select(kinds, range(1, 5), 5)


def profile(df: DataFrame, limit: int) -> DataFrame:
    """(what, at, n, examples) of ``df(rid, raw, fields)``: records of each width (what 0), cells of each field and class.

    ``what`` is 1 to 5 for cells, as in CLASSES, and ``at`` their field from 1. Examples are the ``limit`` earliest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], tuple[int, list]] = {}

        def add(what: np.ndarray, at: np.ndarray, rid: np.ndarray, values: pa.Array) -> None:
            by = np.lexsort((rid, at, what))
            new = np.flatnonzero((np.diff(what[by], prepend=-1) != 0) | (np.diff(at[by], prepend=-1) != 0))
            for s, n in zip(new.tolist(), np.diff(np.append(new, len(by))).tolist()):
                key = int(what[by[s]]), int(at[by[s]])
                before, held = found.get(key, (0, []))
                least = held[-1][0] if len(held) == limit and held else None
                own = by[s : s + min(n, limit)]
                if limit and (least is None or int(rid[own[0]]) < least):
                    more = [(int(rid[i]), v[:SAMPLE_BYTES], len(v) > SAMPLE_BYTES) for i, v in zip(own.tolist(), values.take(pa.array(own)).to_pylist())]
                    held = sorted(held + more, key=lambda e: e[0])[:limit]
                found[key] = before + n, held

        for batch in batches:
            rid, lists = batch.column(0).to_numpy(), batch.column(2)
            size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            add(np.zeros(len(rid), np.int64), size, rid, batch.column(1))
            if size.sum():
                cells = lists.flatten()
                place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + 1
                add(classes(cells), place, np.repeat(rid, size), cells)
        rows = [(what, at, n, [dict(zip(("rid", "sample", "truncated"), e)) for e in held]) for (what, at), (n, held) in found.items()]
        kinds = [pa.int32(), pa.int64(), pa.int64(), _KIND]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 4, kinds)], names=["what", "at", "n", "examples"])

    bare = df.select(F.col("rid").cast("long"), F.col("raw").cast("binary"), F.transform("fields", lambda v: v.cast("binary")))
    parts = bare.mapInArrow(run, f"what int, at long, n long, examples {_EXAMPLES}")
    # A task gives at most ``limit`` examples of each, so what is collected here is bounded by the tasks.
    merged = F.slice(F.sort_array(F.flatten(F.collect_list("examples"))), 1, limit) if limit else F.expr(f"cast(array() as {_EXAMPLES})")
    return parts.groupBy("what", "at").agg(F.sum("n").alias("n"), merged.alias("examples"))


def _earliest(limit: int, *lists: list[Example]) -> list[Example]:
    return sorted((e for x in lists for e in x), key=lambda e: e.record)[:limit]


def _mixed(state: FieldState, limit: int) -> list[Example]:
    """The earliest cells of a field with numbers and text; where two fit, one of each kind at least."""
    numeric = _earliest(limit, state.examples["integer"], state.examples["other_number"])
    text = state.examples["text"]
    if limit < 2:
        return _earliest(limit, numeric, text)
    return _earliest(limit, [numeric[0], text[0]], _earliest(limit - 2, numeric[1:], text[1:]))


def inspect(
    df: DataFrame,
    header: Sequence[str] | None = None,
    width: int | None = None,
    types: dict[int, str] | None = None,
    presence: dict[int, str] | None = None,
    examples: int = 3,
    header_raw: str | None = None,
) -> Report:
    """The report on a ragged table ``df(rid, raw, fields)``, whose rid numbers accepted records, a header's included.

    ``width``, ``types`` (field from 1 to integer, number or text) and ``presence`` (to required or nonmissing) are
    declared; what goes against them is a violation, all other findings are advice. An empty table gives a report, too.
    """
    found = profile(df, examples).collect()
    widths = {r.at: (r.n, [Example(e.rid, str(r.at), bytes(e.sample or b""), e.truncated) for e in r.examples]) for r in found if r.what == 0}
    names = list(header or ())
    positions = {*range(1, max([len(names), *widths], default=0) + 1), *(types or {}), *(presence or {})}
    states = {p: FieldState(p, names[p - 1] if p <= len(names) else "", declared=(types or {}).get(p), presence=(presence or {}).get(p)) for p in sorted(positions)}
    for r in found:
        if r.what:
            kind = CLASSES[r.what]
            states[r.at].counts[kind] = r.n
            states[r.at].examples[kind] = [Example(e.rid, OBSERVED[kind], bytes(e.sample), e.truncated) for e in r.examples]
    # A field is absent from every narrower record.
    narrower, n, earliest = sorted(widths), 0, []
    for p, state in states.items():
        while narrower and narrower[0] < p:
            more, held = widths[narrower.pop(0)]
            n, earliest = n + more, _earliest(examples, earliest, [Example(e.record, "absent", b"", False) for e in held])
        state.counts["absent"], state.examples["absent"] = n, earliest
    if width is not None:
        base, source = width, "declared"
    elif header is not None:
        base, source = len(names), "header"
    else:
        base = max(sorted(widths), key=lambda w: widths[w][0], default=None)
        source = "unavailable" if base is None else "modal"
    total = sum(n for n, _ in widths.values())
    report = Report(total, header, base, source, max(widths, default=None), examples, list(states.values()), [])
    report.findings = list(_findings(report, widths, header_raw))
    return report


def _findings(report: Report, widths: dict[int, tuple[int, list[Example]]], header_raw: str | None) -> Iterator[Finding]:
    limit, fields, names = report.limit, report.fields, list(report.header or ())
    shown = lambda observed, text: [Example(1, observed, text.encode()[:SAMPLE_BYTES], len(text.encode()) > SAMPLE_BYTES)] if limit else []
    if report.header is not None and report.source == "declared" and len(names) != report.baseline:
        yield Finding("header_width_mismatch", "declared", None, 1, str(report.baseline), 1, shown(str(len(names)), header_raw or "\t".join(names)))
    others = [x for w, x in widths.items() if w != report.baseline]
    if others:
        n = sum(n for n, _ in others)
        yield Finding("width_mismatch", "declared" if report.source == "declared" else "inferred", None, n, str(report.baseline), n, _earliest(limit, *(e for _, e in others)))
    for category, observed, there in (("blank_header", "blank", lambda s: s == ""), ("duplicate_header", "duplicate", lambda s: s and names.count(s) > 1)):
        for state, name in zip(fields, names):
            if there(name):
                yield Finding(category, "observation", state, 1, "", 1, shown(observed, name))
    for category, kind in (("absent_field", "absent"), ("empty_field", "empty"), ("missing_indicator", "missing")):
        for state in fields:
            if n := state.counts[kind]:
                yield Finding(category, "observation", state, n, "", n, state.examples[kind])
    for state in fields:
        if state.numeric and state.counts["text"]:
            yield Finding("mixed_types", "observation", state, 1, "", state.numeric + state.counts["text"], _mixed(state, limit))
    for basis in ("inferred", "declared"):
        for state in fields:
            if state.expectation in ("integer", "number") and basis == ("declared" if state.declared else "inferred"):
                wrong = ["text", "other_number"] if state.declared == "integer" else ["text"]
                if n := sum(state.counts[c] for c in wrong):
                    yield Finding("type_mismatch", basis, state, n, state.expectation, n, _earliest(limit, *(state.examples[c] for c in wrong)))
    for state in fields:
        wrong = ["absent", "empty", "missing"][: {None: 0, "required": 2, "nonmissing": 3}[state.presence]]
        if n := sum(state.counts[c] for c in wrong):
            yield Finding("presence_mismatch", "declared", state, n, state.presence or "", n, _earliest(limit, *(state.examples[c] for c in wrong)))


def escaped(data: bytes) -> str:
    """Bytes as printable ASCII."""
    plain = {0x5C: "\\\\", 0x09: "\\t", 0x0A: "\\n", 0x0D: "\\r", 0x00: "\\0"}
    return "".join(plain.get(b) or (chr(b) if 0x20 <= b <= 0x7E else f"\\x{b:02X}") for b in data)


def rows(report: Report, settings: Sequence[tuple[str, str]] = ()) -> list[dict[str, object]]:
    """The report's rows by COLUMNS, schema version 1; ``settings`` are summary rows on how the input was read."""
    out: list[dict[str, object]] = []
    count = lambda category, n, unit, basis="observation": out.append({"row_kind": "summary", "category": category, "basis": basis, "count": n, "count_unit": unit})
    out.append({"row_kind": "summary", "category": "schema_version", "observed": "1"})
    headers = int(report.header is not None)
    count("data_records", report.records, "data_records")
    count("header_records", headers, "header_records")
    count("accepted_records", report.records + headers, "records")
    known = report.baseline is not None
    count("baseline_width", report.baseline, "fields" if known else "", ("declared" if report.source == "declared" else "inferred") if known else "")
    out.append({"row_kind": "summary", "category": "baseline_width_source", "observed": report.source})
    count("maximum_observed_width", report.widest, "fields")
    out.extend({"row_kind": "summary", "category": category, "observed": value} for category, value in settings)
    count("example_limit", report.limit, "examples")
    count("sample_byte_limit", SAMPLE_BYTES, "bytes")
    for state in report.fields:
        own = {"row_kind": "field", "field_index": state.position, "field_name": state.name}
        out.extend(own | {"category": COUNTERS[c], "basis": "observation", "count": state.counts[c], "count_unit": "cells"} for c in CLASSES)
        out.append(own | {"category": "type_expectation", "basis": state.basis, "expected": state.expectation})
        if state.presence:
            out.append(own | {"category": "presence_requirement", "basis": "declared", "expected": state.presence})
    for f in report.findings:
        own = {"category": f.category, "basis": f.basis, "expected": f.expected}
        if f.field:
            own |= {"field_index": f.field.position, "field_name": f.field.name}
        out.append(own | {"row_kind": "finding", "count": f.count, "count_unit": CATEGORIES[f.category][0], "examples_omitted": f.candidates - len(f.examples)})
        out.extend(own | {"row_kind": "example", "record_index": e.record, "observed": e.observed, "sample": escaped(e.sample), "sample_truncated": "yes" if e.truncated else "no"} for e in f.examples)
    return out


def table(spark: SparkSession, report: Report, settings: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """The report's rows in order, with their place and typed columns; what a row hasn't got is null."""
    numbers = ("field_index", "count", "record_index", "examples_omitted")
    schema = "place long, " + ", ".join(f"{c} {'long' if c in numbers else 'string'}" for c in COLUMNS)
    return spark.createDataFrame([(i, *(r.get(c) for c in COLUMNS)) for i, r in enumerate(rows(report, settings))], schema)


def tsv(report: Report, settings: Sequence[tuple[str, str]] = ()) -> list[str]:
    """The report as lines for scripts."""
    cell = lambda name, value: "" if value is None else value if name == "sample" else escaped(str(value).encode())
    return ["\t".join(COLUMNS)] + ["\t".join(cell(c, r.get(c)) for c in COLUMNS) for r in rows(report, settings)]


def readable(report: Report, settings: Sequence[tuple[str, str]] = (), validate: bool = False) -> list[str]:
    """The report as lines for people."""
    many = lambda n, what: f"{n} {what if n == 1 else what + 's'}"
    if report.violated:
        verdict = "Validation failed: supplied rules were not met" if validate else "Inspection complete: supplied rules were not met"
    elif validate:
        verdict = "Validation passed: supplied rules were met"
    else:
        verdict = f"Inspection complete: {'advisory' if report.findings else 'no'} findings"
    out = ["Table health report", verdict]
    if not report.records:
        out.append("No data records were read, so there are no field values to check.")
    headers = int(report.header is not None)
    out += [f"Data records: {report.records}", f"Header records: {headers}", f"Accepted records: {report.records + headers}"]
    origin = {"declared": "supplied width", "header": "input header", "modal": "most frequent data width"}
    out.append("Baseline width: " + ("unavailable" if report.baseline is None else f"{many(report.baseline, 'field')} ({origin[report.source]})"))
    out.append("Maximum data-record width: " + ("unavailable" if report.widest is None else many(report.widest, "field")))
    out += ["", "Field observations (data-record cells):"] + ["  none"] * (not report.fields)
    for s in report.fields:
        told = "; ".join(f"{c.replace('_', ' ')} {s.counts[c]}" for c in CLASSES)
        out += [f'  field {s.position}, name "{escaped(s.name.encode())}": {told}', f"    Expected type: {s.expectation} ({s.basis})"]
        if s.presence:
            out.append(f"    Presence rule: {s.presence} (declared)")
    out += ["", "Findings (counts may overlap):", "Advisory findings do not fail validation. Violations of supplied rules do."] + ["  none"] * (not report.findings)
    for f in report.findings:
        unit, title, advice = CATEGORIES[f.category]
        what = unit.replace("_", " ")
        line = f"  {title} [{f.basis}, {'violation' if f.basis == 'declared' else 'advisory'}]: {f.count} {what[:-1] if f.count == 1 else what}"
        if f.expected:
            line += f"; expected {many(int(f.expected), 'field') if f.expected.isdigit() else f.expected}"
        if f.field:
            line += f'; field {f.field.position}, name "{escaped(f.field.name.encode())}"'
        out += [f"{line}; examples retained {len(f.examples)}, omitted {f.candidates - len(f.examples)}", f"    {advice}"]
        for e in f.examples:
            place = f", field {f.field.position}" if f.field else ""
            seen = many(int(e.observed), "field") if e.observed.isdigit() else e.observed.replace("_", " ")
            out.append(f'    accepted record {e.record}{place}: observed {seen}; sample "{escaped(e.sample)}"; truncated {"yes" if e.truncated else "no"}')
    out += ["", "Input and reporting"] + [f"{k.replace('_', ' ').capitalize()}: {escaped(v.encode())}" for k, v in settings]
    return out + [f"Example limit: {report.limit} per finding", f"Sample byte limit: {SAMPLE_BYTES} raw bytes"]
