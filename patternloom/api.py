"""The public interface: compile a query to a Rule, run Rules over DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .errors import QueryError
from .functions.compile import Compiler
from .operators.join import join
from .operators.matching import Settings, event_scope, select, strict
from .operators.pipes import Pipes
from .operators.relations import related, relations_of
from .operators.sample import sample
from .operators.sequence import sequence
from .plans.check import Checker
from .plans.definitions import Definitions, definitions
from .plans.fold import Folder
from .plans.nodes import Query, Stage
from .plans.parser import Dialect, implied, parse, parse_expression
from .plans.schemas import EventSchema
from .plans.types import SchemaChecker
from .sources.binding import EventBinding

FORMS = {"sequence": sequence, "join": join, "sample": sample}


@dataclass(frozen=True)
class Options:
    """How queries are read and checked. The flags open parts of the language beyond its classic form."""

    case_sensitive: bool = False
    definitions: str | Definitions | None = None
    schema: EventSchema | None = None
    strict_booleans: bool = False
    non_nullable: bool = False
    extended: bool = False
    validate_optional: bool = False
    scoped: bool = False
    allow_sample: bool = False
    allow_negation: bool = False
    allow_runs: bool = False
    allow_enum: bool = False
    implied_any: bool = False
    implied_base: bool = False
    lifecycle: str = "subtype"  # or "opcode": which field tells that a process starts or ends

    @property
    def dialect(self) -> Dialect:
        return Dialect(self.extended, self.scoped, self.allow_sample, self.allow_negation, self.allow_runs, self.implied_any, self.implied_base)


@dataclass(frozen=True)
class Rule:
    """A compiled query. frame() gives bound matches, run() flat rows."""

    text: str
    query: Query
    options: Options = Options()
    name: str = ""

    def settings(self, binding: EventBinding) -> Settings:
        return Settings(binding, not self.options.case_sensitive, self.options.scoped, self.options.lifecycle == "opcode")

    @property
    def groups(self) -> bool:
        return self.query.form != "event"

    def frame(self, events: DataFrame, binding: EventBinding = EventBinding()) -> DataFrame:
        """Matches as `ord` and `event`, or `events` for sequence, join and sample."""
        settings, query = self.settings(binding), self.query
        if not relations_of(query):
            events = binding.only(events, {s.type for s in (*query.stages, *([query.until] if query.until else []))})
        bound = binding.bind(events, self.groups or bool(query.pipes))
        bound, columns = related(bound, query, settings)
        if self.groups:
            df = FORMS[query.form](bound, query, settings, columns)
        else:
            df = select(bound, query.stages[0], settings, columns)
        return Pipes(df, self.groups, settings, columns).run(query.pipes)

    def run(self, events: DataFrame, binding: EventBinding = EventBinding()) -> DataFrame:
        """The events of all matches as rows: the payload's columns; for groups also match_id and pos (from 0).

        match_id is the digest of the match's place in the order, so it needs no numbering."""
        df = self.frame(events, binding)
        if not self.groups:
            return df.select("event.*")
        rows = df.select(F.sha2(F.to_json(F.struct("ord", "events")), 256).alias("match_id"), F.posexplode("events").alias("pos", "event"))
        return rows.select("match_id", "pos", "event.*")


def compile(text: str, options: Options = Options(), name: str = "") -> Rule:  # noqa: A001
    """A Rule from a query's text; QueryError if it isn't one."""
    full = implied(text, options.dialect)
    query = parse(text, options.dialect)
    found = definitions(options.definitions, options.dialect) if isinstance(options.definitions, str) else options.definitions
    if found is not None:
        query = found.expand(query)
    checker = Checker(full)
    query = checker.query(query)
    if options.schema is not None:
        query = SchemaChecker(options.schema, options, full).query(query)
    elif options.allow_enum:
        raise QueryError("enum fields need a schema", kind="semantic")
    query = Folder(not options.case_sensitive, not options.extended)(query)
    return Rule(full, checker.query(query), options, name)


def expression(text: str, events: DataFrame, options: Options = Options(), binding: EventBinding = EventBinding()) -> DataFrame:
    """One expression evaluated on each row: its columns and `value`."""
    node = parse_expression(text, options.dialect)
    Checker(text).expression(node)
    bound = binding.bind(events, False)
    value = Compiler(event_scope(bound, Settings(binding, not options.case_sensitive, options.scoped))).value(node)
    out = value.col if value.error is None else F.when(value.error.isNotNull(), F.raise_error(value.error).cast(value.dtype)).otherwise(value.col)
    return bound.select("event.*", out.alias("value"))


def matches(text: str, events: DataFrame, options: Options = Options(), binding: EventBinding = EventBinding()) -> DataFrame:
    """events with `matched`: whether each satisfies a single-event query, without state."""
    rule = compile(text, options)
    if rule.groups:
        raise QueryError("only single-event queries can be matched row by row", kind="semantic")
    bound = binding.bind(events, False)
    stage: Stage = rule.query.stages[0]
    test = strict(Compiler(event_scope(bound, rule.settings(binding))).test(stage.where))
    return bound.select("event.*", ((F.lit(stage.type == "any") | (F.col("type") == stage.type)) & test).alias("matched"))


class Engine:
    """Several rules over the same events: the union of their matches, tagged by rule, in the rules' order."""

    def __init__(self, rules: list[Rule], binding: EventBinding = EventBinding(), normalise: Callable[[DataFrame], DataFrame] | None = None):
        self.rules, self.binding, self.normalise = rules, binding, normalise

    def run(self, events: DataFrame) -> DataFrame:
        """rule_id, match_id, pos and the payload of each matched event; columns that a rule lacks are null."""
        events = self.normalise(events) if self.normalise else events
        out = []
        for i, rule in enumerate(self.rules):
            df = rule.frame(events, self.binding)
            body = F.posexplode("events") if rule.groups else F.posexplode(F.array("event"))
            rows = df.select(F.sha2(F.to_json(F.struct("ord", F.col("events" if rule.groups else "event"))), 256).alias("match_id"), body.alias("pos", "event"))
            out.append(rows.select(F.lit(rule.name or str(i)).alias("rule_id"), "match_id", "pos", "event.*"))
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), out)


__all__ = ["Engine", "EventBinding", "Options", "QueryError", "Rule", "compile", "expression", "matches", "replace"]
