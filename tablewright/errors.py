"""What a command can end with besides a result."""

from __future__ import annotations


class UserError(ValueError):
    """The command or the data is wrong (status 1)."""

    status = 1


class Violation(UserError):
    """Declared rules of a table don't hold (status 1); ``lines`` is the whole report."""

    def __init__(self, message: str, lines: list[str]):
        super().__init__(message)
        self.lines = lines


class Refusal(NotImplementedError):
    """The command is well formed but deliberately not supported (status 77)."""

    status = 77


class InternalFailure(RuntimeError):
    """A defect of the library itself (status 70)."""

    status = 70
