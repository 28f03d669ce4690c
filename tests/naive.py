"""A deliberately naive state machine for the query forms: one event at a time, as the semantics are told. Tests only."""

from __future__ import annotations

from collections import defaultdict


class Stage:
    def __init__(self, type_, test=lambda e: True, key=lambda e: (), fork=False, negative=False):
        self.type, self.test, self.key, self.fork, self.negative = type_, test, key, fork, negative

    def typed(self, e):
        return self.type in ("any", e["type"])

    def hits(self, e):
        return self.typed(e) and bool(self.test(e))


def sequence(events, stages, maxspan=None, until=None):
    pending = [{} for _ in stages]  # pending[s][key]: prefix that has completed stage s
    out = []
    for e in events:
        if maxspan is not None and any(s.typed(e) for s in stages):
            for waiting in pending:
                for k in [k for k, p in waiting.items() if p and e["ts"] - p[0]["ts"] > maxspan]:
                    del waiting[k]
        if until and until.hits(e):
            for waiting in pending:
                waiting.pop(until.key(e), None)
        for s in range(len(stages) - 1, -1, -1):
            stage = stages[s]
            if not stage.typed(e):
                continue
            key, hit = stage.key(e), stage.hits(e)
            if s == 0:
                if stage.negative and not hit:
                    pending[0][key] = []
                elif not stage.negative and hit:
                    pending[0][key] = [e]
                continue
            before = pending[s - 1]
            if stage.negative:
                if key not in before:
                    continue
                prefix = before[key]
                if hit:
                    if not stage.fork:
                        del before[key]
                    continue
                if not stage.fork:
                    del before[key]
                new = prefix
            else:
                if not hit or key not in before:
                    continue
                new = [*before[key], e]
                if not stage.fork:
                    del before[key]
            if s == len(stages) - 1:
                if new:
                    out.append((e["id"], [x["id"] for x in new]))
            else:
                pending[s][key] = new
    return sorted(out)


def join(events, stages, until=None):
    slots = defaultdict(lambda: [None] * len(stages))
    out = []
    for e in events:
        if until and until.hits(e):
            slots.pop(until.key(e), None)
        for s, stage in enumerate(stages):
            if not stage.hits(e):
                continue
            own = slots[stage.key(e)]
            if own[s] is None:
                own[s] = e
            if None not in own:
                out.append((e["id"], [x["id"] for x in own]))
                del slots[stage.key(e)]
    return sorted(out)


def sample(events, stages):
    held = defaultdict(list)
    out = []
    for e in events:
        for stage in reversed(stages):
            if stage.hits(e):
                own = held[stage.key(e)]
                own.append(e)
                if len(own) == len(stages):
                    out.append((e["id"], [x["id"] for x in own]))
                    own.clear()
    return sorted(out)


def relation(events, kind, source):
    """Ids of events for which the relation holds. source(e): whether e satisfies the inner query."""
    sources, under, dead, out = set(), set(), set(), []
    for e in events:
        if e["type"] == "process":
            sources -= dead
            under -= dead
            dead = set()
            if e["subtype"] in ("create", "fork"):
                if e["pid"] == 4 and e["name"] == "System":
                    sources, under = set(), set()
                elif kind != "event" and (e["ppid"] in sources or kind == "descendant" and e["ppid"] in under):
                    under.add(e["pid"])
            elif e["subtype"] == "terminate":
                dead.add(e["pid"])
        if source(e) and e["pid"]:
            sources.add(e["pid"])
        if e["pid"] in (sources if kind == "event" else under):
            out.append(e["id"])
    return out
