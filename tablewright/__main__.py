"""The command language from a shell: python -m tablewright [--input PATH] COMMAND..."""

from __future__ import annotations

import os
import sys
import tempfile
from collections.abc import Sequence
from pathlib import Path
from typing import TextIO

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from tablewright import __version__
from tablewright.errors import InternalFailure, Refusal, UserError, Violation
from tablewright.operators.aggregates import REGISTRY
from tablewright.operators.rows import ROW_OPS
from tablewright.plans.language import MODES, SHORT_OF, Command, parse, run
from tablewright.session import local_session

HELP = f"""usage: python -m tablewright [--input PATH] [options] operation field [operation field ...]

Statistics and transformations of delimited tables. Without --input the table is read from standard input.

Summary operations: {", ".join(sorted(REGISTRY))}
Per-row operations: {", ".join(sorted(ROW_OPS))}
Modes: {", ".join(sorted(MODES))}, top:N, bottom:N
Short options: {", ".join(f"-{k} --{v}" for k, v in sorted(SHORT_OF.items()))}

Exit statuses: 0 done, 1 the command or the data is wrong or a declared rule doesn't hold, 77 deliberately not
supported, 70 a defect of the library.
"""


def _category(name: str) -> str:
    """The locale of a category as the environment sets it."""
    return os.environ.get("LC_ALL") or os.environ.get(name) or os.environ.get("LANG") or "C"


def refuse_locale(command: Command) -> None:
    """Byte order and decimal points are all there is: a command that depends on a language's rules is refused, not run by others."""
    plain = lambda name: _category(name).split(".")[0] in ("C", "POSIX")
    ordered = command.options.sort or command.mode in ("crosstab", "compare") or any(r.name in ("unique", "countunique") for r in command.requests)
    if ordered and not plain("LC_COLLATE"):
        raise Refusal(f"sorting by the rules of {_category('LC_COLLATE')} isn't supported: set LC_ALL=C")
    if not plain("LC_NUMERIC") and not _category("LC_NUMERIC").startswith("en_"):
        raise Refusal(f"numbers by the rules of {_category('LC_NUMERIC')} aren't supported: set LC_NUMERIC=C")


def main(args: Sequence[str], out: TextIO = sys.stdout, err: TextIO = sys.stderr, spark: SparkSession | None = None) -> int:
    """Run a command, write its lines and return its exit status."""
    args = list(args)
    if args in (["--help"], ["-h"]):
        out.write(HELP)
        return 0
    if args in (["--version"], ["-V"]):
        out.write(f"tablewright {__version__}\n")
        return 0
    path = None
    if args[:1] == ["--input"]:
        path, args = (args[1] if len(args) > 1 else None), args[2:]
    try:
        command = parse(args)
        refuse_locale(command)
        end = "\0" if command.options.zero else "\n"
        own = spark or local_session()
        with tempfile.TemporaryDirectory() as folder:
            if path in (None, "-") and command.mode != "compare":
                # Standard input belongs to this machine: without a shared copy it suits local masters only.
                if not own.sparkContext.master.startswith("local"):
                    raise Refusal("on a cluster give --input and a path that all executors read")
                path = str(Path(folder) / "input")
                with open(path, "wb") as copy:
                    while part := sys.stdin.buffer.read(1 << 20):
                        copy.write(part)
            for row in run(own, args, path).toLocalIterator():
                out.write(row.value + end)
        return 0
    except Violation as e:
        out.write("".join(line + "\n" for line in e.lines))
        return e.status
    except (UserError, Refusal, InternalFailure) as e:
        err.write(f"tablewright: {e}\n")
        return e.status
    except PySparkException as e:
        # Errors in the data are raised by the plan itself.
        told = "USER_RAISED_EXCEPTION" in str(e) or "UserError" in str(e)
        err.write(f"tablewright: {str(e).splitlines()[0]}\n")
        return UserError.status if told else InternalFailure.status


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
