"""Errors of the query language, with a place in the text where there is one."""

from __future__ import annotations

PARSE, RUNTIME = 1001, 2001


class QueryError(ValueError):
    """A query that can't be compiled. str() has the line, the column and a caret under the place."""

    code = PARSE

    def __init__(self, message: str, text: str = "", start: int | None = None, end: int | None = None, kind: str = "syntax"):
        self.message, self.text, self.start, self.kind = message, text, start, kind
        self.end = end if end is not None else (None if start is None else start + 1)
        super().__init__(self.describe())

    @property
    def line(self) -> int | None:
        return None if self.start is None else self.text.count("\n", 0, self.start) + 1

    @property
    def column(self) -> int | None:
        return None if self.start is None else self.start - (self.text.rfind("\n", 0, self.start) + 1) + 1

    def describe(self) -> str:
        if self.start is None:
            return f"{self.kind} error: {self.message}"
        row = self.text.split("\n")[self.line - 1]
        caret = " " * (self.column - 1) + "^" * max(1, min(self.end, self.start + len(row) - self.column + 1) - self.start)
        return f"{self.kind} error at line {self.line}, column {self.column}: {self.message}\n{row}\n{caret}"


class RuntimeQueryError(RuntimeError):
    """A query that failed on an event; code 2001."""

    code = RUNTIME
