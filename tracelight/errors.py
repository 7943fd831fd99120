"""Errors of the three dialects. All are ``ValueError``s."""

from __future__ import annotations


class SyntaxProblem(ValueError):
    """Text that a dialect's grammar doesn't accept, with the place where reading stopped."""

    def __init__(self, message: str, line: int | None = None, column: int | None = None):
        super().__init__(message if line is None else f"line {line}, column {column}: {message}")
        self.line, self.column = line, column


class QueryError(SyntaxProblem):
    """A search query that can't be read."""


class RuleError(SyntaxProblem):
    """A detection rule that can't be read."""


class ProgramError(SyntaxProblem):
    """A parser program that can't be read, or one that uses a plugin or an operation that doesn't exist."""


class CompileError(ValueError):
    """Something that can be read but not compiled: an unknown field, a wrong enum value, an unsupported function."""


class ExecutionError(ValueError):
    """A parser program that failed on a message."""
