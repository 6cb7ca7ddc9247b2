"""Strict quoted CSV: what isn't well formed is an error with its line, never guessed at.

A quote decides about every byte after it, so a first pass counts the quotes of every block of a file: where their
number before a block is odd, the block begins inside quotes. Blocks are then parsed by tasks of their own. A record that
goes on in the next block leaves a fragment in each, and fragments, a few for each block, are put together at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tablewright.errors import UserError
from tablewright.sources.text import TextTable

BATCH = 4096


def records(text: str, separator: str = ",", line: int = 1) -> Iterator[tuple[int, list[str]]]:
    """(line on which it begins, fields) of each record. Records end with LF or CRLF; a blank one has one empty field."""
    at, n = 0, len(text)
    while at < n:
        fields: list[str] = []
        begin = line

        def fail(what: str) -> UserError:
            return UserError(f"invalid CSV: {what} in line {line}")

        while True:
            if at < n and text[at] == '"':
                parts, at = [], at + 1
                while True:
                    close = text.find('"', at)
                    if close < 0:
                        raise fail("end of input inside quotes")
                    parts.append(text[at:close])
                    line += text.count("\n", at, close)
                    at = close + 1
                    if at < n and text[at] == '"':
                        parts.append('"')
                        at += 1
                    else:
                        break
                fields.append("".join(parts))
                if at < n and text[at] not in (separator, "\n") and text[at : at + 2] != "\r\n":
                    raise fail("text after a closing quote")
            else:
                end = at
                while end < n and text[end] not in (separator, "\n", "\r", '"'):
                    end += 1
                if end < n and text[end] == '"':
                    raise fail("a quote in an unquoted field")
                fields.append(text[at:end])
                at = end
            if at < n and text[at] == "\r":
                if text[at : at + 2] != "\r\n":
                    raise fail("a bare carriage return")
                at += 1
            if at >= n:
                yield begin, fields
                return
            if text[at] == "\n":
                at, line = at + 1, line + 1
                yield begin, fields
                break
            at += 1


def _blocks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Lines (_path, _at, _seq, value) in the order of the file, and a row for each block: see read_csv."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_seq"), "value"
    )
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    found = lines.groupBy("_path", "_at").agg(F.count("*").alias("_n"), F.min("_seq").alias("_least"), F.sum(quotes).alias("_quotes"))
    every = Window.orderBy("_path", "_at").rowsBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy("_path").orderBy("_at")
    before = F.coalesce(F.sum("_quotes").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = F.coalesce(F.sum("_n").over(every), F.lit(0)) - F.col("_least") + 1
    return lines, found.select("_path", "_at", shift.alias("_shift"), (before % 2 == 1).alias("_open"), F.lead("_at").over(own).isNull().alias("_last"))


def read_csv(spark: SparkSession, path: str, separator: str = ",", header: bool = False) -> TextTable:
    """The records of a CSV file or folder as a table, in order of file and place; rid is the line that a record begins on.

    Lines never move: the blocks' rows (number of the first line, does it begin inside quotes, is it the file's last) are
    joined back, and each block is parsed where it is read.
    """
    lines, blocks = _blocks(spark, path)
    table = spark.createDataFrame(blocks.collect(), blocks.schema)  # a row for each block
    crossing = table.where("_open").limit(1).count() > 0
    dealt = lines.join(F.broadcast(table), ["_path", "_at"]).select("_path", "_at", (F.col("_seq") + F.col("_shift")).alias("rid"), "_open", "_last", "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, last, held, begin, inside, starts = None, True, [], 0, False, True
        out: list[tuple] = []  # (rid, fields, fragment, does it begin a record)

        def end() -> None:
            """The block is over: what is held goes on in the next one."""
            if held:
                if inside and last:
                    list(records("\n".join(held), separator, begin))  # raises: the file ends inside quotes
                out.append((begin, None, "\n".join(held), starts))
                held.clear()

        def batch_of() -> pa.RecordBatch:
            rid, fields, fragment, first = zip(*out) if out else [()] * 4
            out.clear()
            return pa.record_batch([pa.array(rid, pa.int64()), pa.array(fields, pa.list_(pa.string())), pa.array(fragment, pa.string()), pa.array(first, pa.bool_())], names=["rid", "fields", "fragment", "starts"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("_path", "_at", "rid", "_open", "_last", "value")]
            for path_, at, rid, open_, is_last, value in zip(*columns):
                if (path_, at) != block:
                    end()
                    block, last, inside, starts = (path_, at), is_last, open_, not open_
                if not inside and '"' not in value and "\r" not in value[:-1]:
                    out.append((rid, (value[:-1] if value.endswith("\r") else value).split(separator), None, True))
                    continue
                if not held:
                    begin = rid
                held.append(value)
                inside ^= value.count('"') % 2 == 1
                if not inside:
                    if starts:
                        out.extend((begin, fields, None, True) for _, fields in records("\n".join(held) + "\n", separator, begin))
                    else:
                        out.append((begin, None, "\n".join(held), False))
                    held.clear()
                    starts = True
            if len(out) >= BATCH:
                yield batch_of()
        end()
        yield batch_of()

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(rid, fields) for rid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for _, fields in records(text + "\n", separator, rid)]
            yield pa.record_batch([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.list_(pa.string()))], names=["rid", "fields"])

    parsed = dealt.mapInArrow(run, "rid long, fields array<string>, fragment string, starts boolean")
    rows = parsed.where("fields is not null").select("rid", "fields")
    if crossing:
        # Fragments are a few for each block: each begins a record or belongs to the last that began one.
        parts = parsed.where("fields is null").withColumn("first", F.max(F.when(F.col("starts"), F.col("rid"))).over(Window.orderBy("rid")))
        whole = parts.groupBy("first").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rid", "fragment"))), lambda x: x["fragment"]), "\n").alias("text"))
        rows = rows.unionByName(whole.mapInArrow(assemble, "rid long, fields array<string>"))
    if not header:
        return TextTable(rows)
    top = rows.orderBy("rid").first()
    return TextTable(rows.where(F.col("rid") > (top.rid if top else 0)), tuple(top.fields) if top else ())
