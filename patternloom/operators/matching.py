"""Shared parts of the query forms: scopes over bound events, stage tests, keys."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.compile import Compiler, Scope, columns
from ..functions.values import Value, folded, truth, typed
from ..plans.nodes import Relation, Stage
from ..sources.binding import EventBinding


@dataclass(frozen=True)
class Settings:
    """What a compiled rule tells its operators."""

    binding: EventBinding = field(default_factory=EventBinding)
    fold: bool = True
    scoped_only: bool = False
    by_opcode: bool = False  # lifecycle of processes by opcode


def event_scope(df: DataFrame, settings: Settings, relations: dict[Relation, Column] | None = None) -> Scope:
    schema = df.schema["event"].dataType
    return Scope(columns(schema, lambda name: F.col("event").getField(name)), settings.fold, settings.scoped_only, relations=relations or {})


def group_scope(df: DataFrame, settings: Settings) -> Scope:
    """Names over whole matches: plain fields are the first event's, `events` is all of them."""
    kind = df.schema["events"].dataType
    first = columns(kind.elementType, lambda name: F.get("events", F.lit(0)).getField(name))
    return Scope(lambda name: typed(F.col("events"), kind) if name == "events" else first(name), settings.fold, settings.scoped_only)


def strict(test: tuple[Column, Column | None]) -> Column:
    """A test that raises its error."""
    good, error = test
    return good if error is None else F.when(error.isNotNull(), F.raise_error(error).cast("boolean")).otherwise(good)


def fits(stage: Stage) -> Column:
    return F.lit(True) if stage.type == "any" else F.col("type") == F.lit(stage.type)


def stage_test(stage: Stage, compiler: Compiler) -> Column:
    """Type and predicate; the predicate's errors count only where the type fits."""
    good, error = compiler.test(stage.where)
    if error is not None:
        good = F.when(fits(stage) & error.isNotNull(), F.raise_error(error).cast("boolean")).otherwise(good)
    return fits(stage) & good


def select(df: DataFrame, stage: Stage, settings: Settings, relations: dict[Relation, Column]) -> DataFrame:
    """Single-event queries: one filter."""
    compiler = Compiler(event_scope(df, settings, relations))
    v = compiler.value(stage.where)
    if v.error is None:  # null drops a row as false does, and a bare predicate reaches the scan
        return df.where(fits(stage) & truth(v))
    return df.where(stage_test(stage, compiler))


def key_column(values: list[Value], fold: bool) -> Column:
    """A key of some values; strings in lower case. Never null itself, so null parts are ordinary keys."""
    return F.struct(*[(folded(v.col, v.dtype) if fold else v.col).alias(f"k{i}") for i, v in enumerate(values)])


def stage_keys(stages: list[Stage], by: tuple, compiler: Compiler, settings: Settings) -> tuple[list[Column], bool]:
    """The key of each stage, and whether all are the same expression. Keys whose types differ are compared as JSON."""
    nodes = [(*by, *s.by) for s in stages]
    if not any(nodes):
        return [F.struct(F.lit(0).alias("k0"))] * len(stages), True
    values = [[compiler.value(n) for n in keys] for keys in nodes]
    kinds = [[v.dtype for v in vs] for vs in values]
    keys = [key_column(vs, settings.fold) for vs in values]
    if any(isinstance(k, T.MapType) for ks in kinds for k in ks) or any(ks != kinds[0] for ks in kinds):
        keys = [F.struct(F.to_json(k, {"ignoreNullFields": "false"}).alias("k0")) for k in keys]
    return keys, all(n == nodes[0] for n in nodes)
