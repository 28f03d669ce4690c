"""The query's syntax tree: frozen dataclasses, compared by value. `at` is the span in the text and isn't compared."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, fields, is_dataclass, replace
from typing import Any

Span = tuple[int, int] | None


def span() -> Any:
    return field(default=None, compare=False, repr=False)


@dataclass(frozen=True)
class Literal:
    value: Any  # None, bool, int, float or str
    at: Span = span()


@dataclass(frozen=True)
class Field:
    name: str
    path: tuple[str | int, ...] = ()
    optional: bool = False
    scoped: bool = False  # written with $
    at: Span = span()


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple[Any, ...]
    at: Span = span()


@dataclass(frozen=True)
class Math:
    op: str
    left: Any
    right: Any
    at: Span = span()


@dataclass(frozen=True)
class Compare:
    op: str
    left: Any
    right: Any
    at: Span = span()


@dataclass(frozen=True)
class IsNull:
    term: Any
    negated: bool = False
    at: Span = span()


@dataclass(frozen=True)
class In:
    term: Any
    values: tuple[Any, ...]
    at: Span = span()


@dataclass(frozen=True)
class Not:
    term: Any
    at: Span = span()


@dataclass(frozen=True)
class Logic:
    op: str  # and, or
    terms: tuple[Any, ...]
    at: Span = span()


@dataclass(frozen=True)
class Relation:
    kind: str  # event, child, descendant
    stage: Stage
    at: Span = span()


@dataclass(frozen=True)
class Stage:
    type: str
    where: Any
    by: tuple[Any, ...] = ()
    fork: bool | None = None
    negative: bool = False
    alias: str | None = None
    at: Span = span()


@dataclass(frozen=True)
class Pipe:
    name: str
    args: tuple[Any, ...] = ()
    at: Span = span()


@dataclass(frozen=True)
class Query:
    form: str  # event, sequence, join, sample
    stages: tuple[Stage, ...]
    by: tuple[Any, ...] = ()
    maxspan: int | None = None  # in ticks of 100 ns
    until: Stage | None = None
    pipes: tuple[Pipe, ...] = ()


def rebuild(node: Any, change: Callable[[Any], Any]) -> Any:
    """node with change() applied to each part, bottom up, and then to itself."""
    if isinstance(node, tuple):
        return tuple(rebuild(x, change) for x in node)
    if not is_dataclass(node):
        return node
    new = {f.name: rebuild(v, change) for f in fields(node) if f.name != "at" and (isinstance(v := getattr(node, f.name), tuple) or is_dataclass(v)) and not (isinstance(node, Field) and f.name == "path")}
    return change(replace(node, **new) if new else node)


def walk(node: Any):
    """node and all its parts, outside in."""
    if isinstance(node, tuple):
        for x in node:
            yield from walk(x)
    elif is_dataclass(node):
        yield node
        for f in fields(node):
            if f.name not in ("at", "path"):
                yield from walk(getattr(node, f.name))
