"""Adjacent runs over a stream: finished groups are emitted as soon as the next key arrives."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

RESULT = "source string, run long, key string, n long, total double, first_at long, last_at long"
STATE = "run long, key string, n long, total double, first_at long, last_at long"


def adjacent_runs(stream: DataFrame, source: str, key: str, value: str, rid: str, final: str | None = None) -> DataFrame:
    """Count and sum of each run of equal keys, for each ``source`` (an ordered partition of the stream).

    Rows of a source must not be overtaken by rows of a later micro-batch; within one they are put in order of ``rid``.
    The state is one open run for each source. ``final`` names a boolean column whose true rows close the run after
    them, so that a stream's last group comes out too.
    """
    chosen = [source, key, value, rid, *([final] if final else [])]

    def step(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run, current, n, total, first, last = state.get if state.exists else (0, None, 0, 0.0, 0, 0)
        rows = pd.concat(list(parts)).sort_values(rid)
        done = []
        for k, v, at, end in zip(rows[key], rows[value], rows[rid], rows[final] if final else [False] * len(rows)):
            if n and k != current:
                done.append((group[0], run, current, n, total, first, last))
                n = 0
            if not n:
                run, current, total, first = run + 1, k, 0.0, at
            n, total, last = n + 1, total + float(v), at
            if end:
                done.append((group[0], run, current, n, total, first, last))
                n = 0
        state.update((int(run), current, int(n), float(total), int(first), int(last)))
        yield pd.DataFrame(done, columns=["source", "run", "key", "n", "total", "first_at", "last_at"])

    return stream.select(*chosen).groupBy(source).applyInPandasWithState(step, RESULT, STATE, "append", GroupStateTimeout.NoTimeout)
