"""Chat formatting by a finite-state machine over roles.

Conversations stream through in turn order. The machine checks each turn against the template's moves and emits text
segments, each with its loss flag: a turn's opening, its escaped text and its closing. Escaping is reversible and
leaves no control string in a text: one backslash is put into every ``<``, backslashes, ``|`` sequence.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablewright.llm.storage import bound_batches, pieces, width


@dataclass(frozen=True)
class Template:
    """Declarative chat template: control strings, the roles whose text is learnt, and the role machine's moves."""

    start: str = "<|im_start|>"
    end: str = "<|im_end|>"
    loss_roles: frozenset[str] = frozenset({"assistant"})
    moves: dict[str, frozenset[str]] = field(
        default_factory=lambda: {
            "": frozenset({"system", "user"}),
            "system": frozenset({"user"}),
            "user": frozenset({"assistant"}),
            "assistant": frozenset({"user"}),
        }
    )
    final: frozenset[str] = frozenset({"assistant"})

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        name = escape(role.replace("\\", "\\\\").replace("\n", "\\n"))
        return [(f"{self.start}{name}\n", False), (escape(text), role in self.loss_roles), (f"{self.end}\n", False)]

    def read_turn(self, formatted: str) -> tuple[str, str]:
        """(role, text) of one whole formatted turn."""
        tail = f"{self.end}\n"
        if not formatted.startswith(self.start) or not formatted.endswith(tail):
            raise ValueError("not a formatted turn")
        name, _, body = formatted[len(self.start) : -len(tail)].partition("\n")
        role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(name))
        return role, unescape(body)


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def format_turns(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """Segments (conv_id, seq, segment, loss, valid) of ``turns(conv_id, turn, role, text)``, in order per partition.

    Turns go by (turn, role, text), nulls first, so repeated and tied rows have one order. A null role or text is
    empty. ``valid`` tells whether the machine accepts the move to this turn; turns that it rejects are formatted all
    the same. A null conv_id is a conversation of its own. Other columns are ignored. A conversation of any length
    streams through; none is held in memory.
    """
    spark = turns.sparkSession
    bound_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, seq = object(), "", 0
        for batch in pieces(batches):
            ids = batch.column(0).to_pylist()
            out = ([], [], [], [], [])
            for conv, role, text in zip(ids, batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if conv != current:
                    current, state, seq = conv, "", 0
                role = role or ""
                valid = role in template.moves.get(state, frozenset())
                state = role
                for segment, loss in template.segments(role, text or ""):
                    for column, value in zip(out, (conv, seq, segment, loss, valid)):
                        column.append(value)
                    seq += 1
            yield pa.record_batch(
                [pa.array(out[0], batch.schema.field(0).type), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.bool_()), pa.array(out[4], pa.bool_())],
                names=["conv_id", "seq", "segment", "loss", "valid"],
            )

    rows = turns.select("conv_id", "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    kind = rows.schema["conv_id"].dataType.simpleString()
    return (
        rows.repartition(width(spark), "conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .mapInArrow(run, f"conv_id {kind}, seq long, segment string, loss boolean, valid boolean")
    )


def read_back(segments: DataFrame, template: Template = Template(), ordered: bool = False) -> DataFrame:
    """Per conversation, what its formatted text and loss mask say: see the columns below.

    n_turns, turns_sha256 (role, newline, text, newline of each turn), loss_chars and loss_sha256 (the text under the
    mask, unescaped), formatted_chars, valid (every move allowed and the last state final). The reader joins segments
    into a turn's text and parses that; it doesn't use how the text was cut. ``ordered``: the segments come straight
    from :func:`format_turns` and need no exchange.
    """
    spark = segments.sparkSession
    if not ordered:
        segments = segments.repartition(width(spark), "conv_id").sortWithinPartitions("conv_id", "seq")
    kind = segments.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        started, current = False, None
        done: list[tuple] = []
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]

        def flush(type_: pa.DataType) -> pa.RecordBatch:
            kinds = [type_, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
            columns = list(zip(*done)) if done else [()] * 7
            return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        def close() -> None:
            if pending:
                raise ValueError("a turn is not closed")
            done.append((current, n, turns.hexdigest(), loss_chars, learnt.hexdigest(), chars, valid and role in template.final))

        pending: list[tuple[str, bool]] = []
        tail, type_ = f"{template.end}\n", pa.int64()
        for batch in batches:
            type_ = batch.schema.field(0).type
            rows = zip(*(batch.column(c).to_pylist() for c in ("conv_id", "segment", "loss", "valid")))
            for conv, segment, loss, ok in rows:
                if not started or conv != current:
                    if started:
                        close()
                    started, current = True, conv
                    n = loss_chars = chars = 0
                    turns, learnt, valid, role = hashlib.sha256(), hashlib.sha256(), True, ""
                pending.append((segment, loss))
                chars += len(segment)
                valid &= ok
                if segment.endswith(tail):
                    role, text = template.read_turn("".join([s for s, _ in pending]))
                    masked = unescape("".join([s for s, x in pending if x]))
                    turns.update(f"{role}\n{text}\n".encode())
                    learnt.update(masked.encode())
                    loss_chars += len(masked)
                    n += 1
                    pending.clear()
            if len(done) > 1024:
                yield flush(type_)
                done.clear()
        if started:
            close()
        yield flush(type_)

    return segments.select("conv_id", "segment", "loss", "valid").mapInArrow(
        run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"
    )
