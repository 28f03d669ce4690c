"""Rules over streaming DataFrames.

Stateless queries (single events and `filter`) are the batch plan itself. Keyed sequences, joins, samples and
`unique` run as state per key by applyInPandasWithState: a key's rows wait in its state until the watermark has passed
them, and are then fed in the order of order_cols to a small state machine whose state is kept as JSON. So matches are
those of the batch form, however rows are spread over micro-batches, and come out as late as the watermark's delay. Rows
later than the watermark are dropped by Spark. State goes when it holds nothing, and in sequences with maxspan when
event time has passed it, so idle keys leave none behind; other forms keep their slots, as their meaning has no end.

Aggregating pipes run in `complete` mode as Spark aggregations: use Rule.run with a batch DataFrame in foreachBatch, or an
availableNow trigger; `count` without keys is one here. `head`, `tail` and `sort` need an end of input and are refused, as are
stages with keys of their own (one event would then change several keys' states).

Single-event queries with relations are folded per scope (binding.scope_cols): the state is the ids of known processes. As an
event's tests may depend on its relations, each is computed for all answers that the relations can give."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..api import Rule
from ..errors import QueryError
from ..functions.compile import Compiler
from ..operators.matching import Settings, event_scope, fits, select, stage_keys, stage_test, strict
from ..operators.pipes import Pipes
from ..operators.relations import lifecycle, relations_of
from ..plans.nodes import Relation, Stage
from ..sources.binding import EventBinding

OUT = "key string, at bigint, pos int, event string"
STATE = "state string"
#: Relations of a streamed query; an event carries its tests for all 2^n answers.
MOST_RELATIONS = 4


def stream(rule: Rule, events: DataFrame, binding: EventBinding, watermark: str = "1 hour") -> DataFrame:
    """Matched events of a streaming DataFrame. Single events: the payload's columns. Groups: key, at (order of the match's
    last event), pos, event (JSON). binding.order_cols must start with a timestamp column."""
    query, settings = rule.query, rule.settings(binding)
    relations = relations_of(query)
    if relations:
        if query.form != "event" or query.pipes or not binding.scope_cols or len(relations) > MOST_RELATIONS:
            raise QueryError("only single-event queries without pipes, with scope_cols and few relations, are streamed with relations", kind="semantic")
        return _related(query.stages[0], relations, binding.bind(events, True), settings, watermark)
    if query.form == "event" and [p.name for p in query.pipes][-1:] == ["count"] and not query.pipes[-1].args and all(p.name == "filter" for p in query.pipes[:-1]):
        bound = binding.bind(events, False)
        return Pipes(select(bound, query.stages[0], settings, {}), False, settings).run(query.pipes).select("event.*")
    bad = [p.name for p in query.pipes if p.name not in ("filter", "unique")]
    if bad:
        raise QueryError(f"{bad[0]} needs an end of input; run it in foreachBatch", kind="semantic")
    bound = binding.bind(events, True)
    if query.form == "event":
        df = select(bound, query.stages[0], settings, {})
        unique = None
        for p in query.pipes:
            if p.name == "filter":
                df = df.where(strict(Compiler(event_scope(df, settings)).test(p.args[0])))
            elif unique is None:
                unique = p
            else:
                raise QueryError("only one unique can be streamed", kind="semantic")
        if unique is None:
            return df.select("event.*")
        compiler = Compiler(event_scope(df, settings))
        keys = F.to_json(F.struct(*[(F.lower(v.col) if v.kind == "string" and settings.fold else v.col).alias(f"k{i}") for i, v in enumerate(map(compiler.value, unique.args))]))
        rows = df.select(keys.alias("key"), "ts", "ord", F.to_json("event").alias("event"), F.lit("[]").alias("flags"))
        return _stateful(rows, lambda: _First(), None, watermark)
    if query.pipes:
        raise QueryError("pipes over groups aren't streamed", kind="semantic")
    stages = [*query.stages, *([query.until] if query.until else [])]
    compiler = Compiler(event_scope(bound, settings))
    keys, same = stage_keys(stages, query.by, compiler, settings)
    if not same:
        raise QueryError("stages with keys of their own aren't streamed", kind="semantic")
    flags = F.to_json(F.array(*[F.array(fits(s), stage_test(s, compiler)) for s in stages]))
    any_part = fits(stages[0])
    for s in stages[1:]:
        any_part = any_part | fits(s)
    rows = bound.where(any_part).select(F.to_json(keys[0], {"ignoreNullFields": "false"}).alias("key"), "ts", "ord", F.to_json("event").alias("event"), flags.alias("flags"))
    n, until = len(query.stages), query.until is not None
    if query.form == "sequence":
        shape = [(s.fork or False, s.negative) for s in query.stages]
        return _stateful(rows, lambda: _Sequence(shape, until, query.maxspan), query.maxspan, watermark)
    make = (lambda: _Join(n, until)) if query.form == "join" else (lambda: _Sample(n))
    return _stateful(rows, make, None, watermark)


def _related(stage: Stage, relations: list[Relation], bound: DataFrame, settings: Settings, watermark: str) -> DataFrame:
    def under(n: int, answers: int) -> Compiler:
        known = {r: F.lit(bool(answers >> i & 1)) for i, r in enumerate(relations[:n])}
        return Compiler(event_scope(bound, settings, known))

    sources = [F.array(*[stage_test(r.stage, under(i, x)) for x in range(1 << i)]) for i, r in enumerate(relations)]
    final = F.array(*[stage_test(stage, under(len(relations), x)) for x in range(1 << len(relations))])
    flags = F.to_json(F.struct(*lifecycle(bound, settings, {}), F.array(*sources).alias("w"), final.alias("t")), {"ignoreNullFields": "false"})
    scope = F.to_json(F.struct(*[F.col("event").getField(c).alias(c) for c in settings.binding.scope_cols]), {"ignoreNullFields": "false"})
    rows = bound.select(scope.alias("key"), "ts", "ord", F.to_json("event").alias("event"), flags.alias("flags"))
    kinds = [r.kind for r in relations]
    return _stateful(rows, lambda: _Related(kinds), None, watermark)


class _Related:
    """state: the ids marked dead, then for each relation its sources and the processes under them."""

    def __init__(self, kinds):
        self.kinds = kinds
        self.sets = [(set(), set()) for _ in kinds]
        self.dead: str | None = None

    @property
    def state(self):
        held = [[sorted(a), sorted(b)] for a, b in self.sets]
        return [self.dead, held if any(a or b for a, b in held) else None]

    @state.setter
    def state(self, value):
        self.dead = value[0]
        if value[1]:
            self.sets = [(set(a), set(b)) for a, b in value[1]]

    def feed(self, ts, event, flags):
        dead, answers = self.dead, 0
        if flags["_p"]:
            self.dead = flags["_pid"] if flags["_e"] else None
        for i, (kind, (sources, under)) in enumerate(zip(self.kinds, self.sets)):
            if flags["_p"]:
                sources.discard(dead)
                under.discard(dead)
                if flags["_r"]:
                    sources.clear()
                    under.clear()
                elif flags["_c"] and kind != "event" and flags["_pid"] is not None and flags["_parent"] is not None:
                    if flags["_parent"] in sources or kind == "descendant" and flags["_parent"] in under:
                        under.add(flags["_pid"])
            if flags["w"][i][answers] and flags["_own"] is not None:
                sources.add(flags["_own"])
            if flags["_own"] in sources if kind == "event" else flags["_pid"] in under:
                answers |= 1 << i
        if flags["t"][answers]:
            yield [event]


class _First:
    """unique: the first event of a key."""

    state: list = []

    def feed(self, ts, event, flags):
        if not self.state:
            self.state = [1]
            yield [event]


class _Sequence:
    def __init__(self, shape, until, maxspan):
        self.shape, self.until, self.maxspan = shape, until, maxspan
        self.state: list = [None] * len(shape)

    def feed(self, ts, event, flags):
        n = len(self.shape)
        if self.maxspan is not None:
            self.state = [None if p and ts - p[0][0] > self.maxspan else p for p in self.state]
        if self.until and flags[n][1]:
            self.state = [None] * n
        for s in range(n - 1, -1, -1):
            (typed, hit), (fork, negative) = flags[s], self.shape[s]
            if not typed or s and self.state[s - 1] is None:
                continue
            good = not hit if negative else hit
            new = None
            if good:
                before = self.state[s - 1] if s else []
                new = before if negative else [*before, [ts, event]]
            if s and (good or negative) and not fork:
                self.state[s - 1] = None
            if new is None:
                continue
            if s == n - 1:
                if new:
                    yield [e for _, e in new]
            else:
                self.state[s] = new

    @property
    def oldest(self):
        return min((p[0][0] for p in self.state if p), default=None)


class _Join:
    def __init__(self, n, until):
        self.n, self.until, self.state = n, until, [None] * n

    def feed(self, ts, event, flags):
        if self.until and flags[self.n][1]:
            self.state = [None] * self.n
        for s in range(self.n):
            if flags[s][1] and self.state[s] is None:
                self.state[s] = event
                if None not in self.state:
                    yield self.state
                    self.state = [None] * self.n


class _Sample:
    def __init__(self, n):
        self.n, self.state = n, []

    def feed(self, ts, event, flags):
        for s in range(self.n - 1, -1, -1):
            if flags[s][1]:
                self.state.append(event)
                if len(self.state) == self.n:
                    yield self.state
                    self.state = []


def _stateful(rows: DataFrame, make, maxspan: int | None, watermark: str) -> DataFrame:
    ranks = [f"o{i}" for i in range(len(rows.schema["ord"].dataType.fields))]
    kinds = {c: str(f.dataType.typeName()) for c, f in zip(ranks, rows.schema["ord"].dataType.fields)}
    # times as microseconds, so that what waits is plain JSON
    plain = [(F.unix_micros(F.col("ord")[c].cast("timestamp")) if kinds[c] in ("timestamp", "timestamp_ntz", "date") else F.col("ord")[c]).alias(c) for c in ranks]
    rows = rows.select("key", "ts", *plain, "event", "flags", F.expr("timestamp_micros(ts div 10)").alias("seen")).withWatermark("seen", watermark)

    def rank(row):
        return [(x is not None, x) for x in row[: len(ranks)]]

    def step(key, batches: Iterator, state) -> Iterator:
        import pandas as pd

        machine, waiting = make(), []
        if state.exists:
            machine.state, waiting = json.loads(state.get[0])
        for batch in [] if state.hasTimedOut else batches:
            part = batch[[*ranks, "ts", "event", "flags"]].astype(object)
            waiting += part.where(part.notna(), None).values.tolist()
        waiting.sort(key=rank)
        passed = state.getCurrentWatermarkMs() * 10_000
        ready, waiting = [w for w in waiting if w[-3] <= passed], [w for w in waiting if w[-3] > passed]
        out = [(key[0], w[-3], pos, e) for w in ready for found in machine.feed(int(w[-3]), w[-2], json.loads(w[-1])) for pos, e in enumerate(found)]
        held = [x for x in machine.state if x is not None]
        ends = maxspan is not None and all(held)  # prefixes that are too old some day
        if not waiting and (not held or ends and state.hasTimedOut and not ready):
            if state.exists:
                state.remove()
        else:
            state.update((json.dumps([machine.state, waiting], default=float),))
            due = min(w[-3] for w in waiting) if waiting else max(machine.oldest, passed) + maxspan if ends else None
            if due is not None:
                state.setTimeoutTimestamp(max(int(due) // 10_000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", "at", "pos", "event"])

    return rows.groupBy("key").applyInPandasWithState(step, OUT, STATE, "append", "EventTimeTimeout")
