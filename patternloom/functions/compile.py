"""Expressions to compiled values. Logic is three-valued; the errors of a term count only if no term before it decides."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError
from ..plans.nodes import Call, Compare, Field, In, IsNull, Literal, Logic, Math, Not, Relation
from . import scalar
from .values import Value, boolean, constant, equal, errors, null, truth, typed, unknown


@dataclass(frozen=True)
class Scope:
    """Where names lead: the event's columns, match members, lambda variables and relations."""

    field: Callable[[str], Value | None]
    fold: bool = True
    scoped_only: bool = False  # variables only with $
    variables: dict[str, Value] = field(default_factory=dict)
    relations: dict[Relation, Column] = field(default_factory=dict)


def columns(schema: T.StructType, get: Callable[[str], Column]) -> Callable[[str], Value | None]:
    kinds = {f.name: f.dataType for f in schema.fields}
    return lambda name: typed(get(name), kinds[name]) if name in kinds else None


def step(v: Value, part: str | int) -> Value:
    """One step of a path: a member, an element, or a string compared with its name. Absent is null."""
    if isinstance(part, int):
        return typed(F.get(v.col, F.lit(part)), v.dtype.elementType, v.error) if v.kind == "array" else null()
    if isinstance(v.dtype, T.StructType):
        found = next((f for f in v.dtype.fields if f.name == part), None)
        return typed(v.col.getField(part), found.dataType, v.error) if found else null()
    if isinstance(v.dtype, T.MapType):
        return typed(F.try_element_at(v.col, F.lit(part)), v.dtype.valueType, v.error)
    if v.kind == "string":
        return boolean(v.col == F.lit(part), v.error)
    return null()


class Compiler:
    def __init__(self, scope: Scope):
        self.scope = scope

    def value(self, node: Any) -> Value:
        return getattr(self, f"_{type(node).__name__.lower()}")(node)

    def test(self, node: Any) -> tuple[Column, Column | None]:
        """Whether a row satisfies node (never null), and its error."""
        v = self.value(node)
        return F.coalesce(truth(v), F.lit(False)), v.error

    def _literal(self, node: Literal) -> Value:
        return constant(node.value)

    def _field(self, node: Field) -> Value:
        v = None
        if node.scoped or not self.scope.scoped_only:
            v = self.scope.variables.get(node.name)
        if v is None:
            v = self.scope.field(node.name) or null()
        for part in node.path:
            v = step(v, part)
        return v

    def _relation(self, node: Relation) -> Value:
        if node not in self.scope.relations:
            raise QueryError(f"{node.kind} of isn't available here", kind="semantic")
        return boolean(self.scope.relations[node])

    def _math(self, node: Math) -> Value:
        return scalar.arithmetic(node.op, self.value(node.left), self.value(node.right))

    def _compare(self, node: Compare) -> Value:
        a, b = self.value(node.left), self.value(node.right)
        error = errors(a.error, b.error)
        fold = self.scope.fold and all(isinstance(x, (Field, Call, Literal)) for x in (node.left, node.right))
        if node.op in ("==", "!="):
            same = equal(a, b, fold)
            if same is None:
                return replace(unknown(), error=error)
            return boolean(same if node.op == "==" else ~same, error)
        if not (a.number and b.number or a.kind == b.kind == "string" or a.kind == b.kind == "bool"):
            return replace(unknown(), error=error)
        x, y = (F.lower(a.col), F.lower(b.col)) if fold and a.kind == "string" else (a.col, b.col)
        return boolean({"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[node.op], error)

    def _isnull(self, node: IsNull) -> Value:
        v = self.value(node.term)
        out = F.lit(v.kind == "null") if v.kind == "null" or v.literal is not None and isinstance(node.term, Literal) else v.col.isNull()
        return boolean(~out if node.negated else out, v.error)

    def _in(self, node: In) -> Value:
        v, members = self.value(node.term), [self.value(x) for x in node.values]
        fixed = all(isinstance(x, Literal) for x in node.values)
        if isinstance(node.term, Literal) and node.term.value is None and fixed and any(m.kind == "null" for m in members):
            return constant(True)
        error = errors(v.error, *(m.error for m in members))
        if v.kind == "null":
            return replace(unknown(), error=error)
        if fixed:
            same = [m.literal for m in members if m.kind == v.kind or m.number and v.number]
            if v.kind == "string" and self.scope.fold:
                out = F.lower(v.col).isin([x.lower() for x in same])
            else:
                out = v.col.isin(same)
            return boolean(F.when(v.col.isNotNull(), out if same else F.lit(False)), error)
        terms = [x if (x := equal(v, m, self.scope.fold)) is not None else F.lit(None).cast("boolean") if m.kind == "null" else F.when(m.col.isNotNull(), F.lit(False)) for m in members]
        out = terms[0]
        for t in terms[1:]:
            out = out | t
        return boolean(F.when(v.col.isNotNull(), out), error)

    def _not(self, node: Not) -> Value:
        v = self.value(node.term)
        return boolean(~truth(v), v.error)

    def _logic(self, node: Logic) -> Value:
        out = error = open_ = None
        for term in node.terms:
            v = self.value(term)
            t = truth(v)
            if v.error is not None:
                error = errors(error, v.error if open_ is None else F.when(open_, v.error))
            if node.op == "and":
                out, going = (t if out is None else out & t), ~F.coalesce(~t, F.lit(False))
            else:
                out, going = (t if out is None else out | t), ~F.coalesce(t, F.lit(False))
            open_ = going if open_ is None else open_ & going
        return boolean(out, error)

    def _call(self, node: Call) -> Value:
        if node.name in ("arraySearch", "arrayCount"):
            source, name = self.value(node.args[0]), node.args[1]

            def body(e: Value) -> Value:
                inner = replace(self.scope, variables={**self.scope.variables, name.name: e})
                v = Compiler(inner).value(node.args[2])
                return replace(v, error=None)

            return scalar.array_search(source, body, node.name == "arrayCount")
        return scalar.call(node.name, [self.value(a) for a in node.args], self.scope.fold)
