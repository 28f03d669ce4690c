"""Sequences, as window functions over one partitioning.

For each event of a key, `adv_s` is the prefix of events that stage s has completed there. A stage takes the latest prefix
of the stage before it, unless something consumed it (this stage without fork), or `until` came in between,
or it is too old. All stages share one exchange and one sort.

Where stages have different keys, an event is first multiplied by its distinct keys; each copy takes part only in the stages
whose key it carries. Time may not decrease along the order if maxspan is used (ticks are compared with the first
event's)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.compile import Compiler
from ..plans.nodes import Query, Relation
from .matching import Settings, event_scope, fits, stage_keys, stage_test


def dealt(df: DataFrame, query: Query, settings: Settings, relations: dict[Relation, Column]) -> DataFrame:
    """ord, ts, key, event, the hits h0.., types t0.. and u of `until`, a row per event and key; events without a part in it left out."""
    compiler = Compiler(event_scope(df, settings, relations))
    stages = [*query.stages, *([query.until] if query.until else [])]
    keys, same = stage_keys(stages, query.by, compiler, settings)
    hits = [stage_test(s, compiler) for s in query.stages]
    types = [fits(s) for s in query.stages]
    until = stage_test(query.until, compiler) if query.until else F.lit(False)
    part = [*(t if s.negative else h for s, h, t in zip(query.stages, hits, types)), *([until] if query.until else [])]
    any_part = part[0]
    for p in part[1:]:
        any_part = any_part | p
    flags = [*(h.alias(f"h{i}") for i, h in enumerate(hits)), *(t.alias(f"t{i}") for i, t in enumerate(types)), until.alias("u")]
    out = df.where(any_part)
    if same:
        return out.select("ord", "ts", "event", keys[0].alias("key"), *flags)
    parts = [F.when(p, k) for p, k in zip(part, keys)]
    out = out.select("ord", "ts", "event", *flags, *[p.alias(f"k{i}") for i, p in enumerate(parts)])
    out = out.withColumn("key", F.explode(F.array_distinct(F.array_compact(F.array(*[f"k{i}" for i in range(len(parts))])))))
    n = len(query.stages)
    mine = lambda i: F.col("key").eqNullSafe(F.col(f"k{i}"))
    cols = [*((F.col(f"h{i}") & mine(i)).alias(f"h{i}") for i in range(n)), *((F.col(f"t{i}") & mine(i)).alias(f"t{i}") for i in range(n))]
    return out.select("ord", "ts", "event", "key", *cols, (F.col("u") & mine(n) if query.until else F.lit(False)).alias("u"))


def sequence(df: DataFrame, query: Query, settings: Settings, relations: dict[Relation, Column]) -> DataFrame:
    """Matches: ord (of the last event) and events."""
    n = len(query.stages)
    rows = dealt(df, query, settings, relations)
    kind = f"array<struct<ts:bigint,event:{df.schema['event'].dataType.simpleString()}>>"
    if n < 2:
        return rows.where("false").select("ord", F.array("event").alias("events"))
    window = Window.partitionBy("key").orderBy("ord")
    before, upto = window.rowsBetween(Window.unboundedPreceding, -1), window.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("rn", F.row_number().over(window))
    own = F.array(F.struct("ts", "event"))
    clear = []
    for s, stage in enumerate(query.stages):
        hit, type_ = F.col(f"h{s}"), F.col(f"t{s}")
        clear.append(F.lit(False) if stage.fork else (type_ if stage.negative else hit))
    first = query.stages[0]
    start = F.when(F.col("t0") & ~F.col("h0"), F.array().cast(kind)) if first.negative else F.when(F.col("h0"), own)
    rows = rows.withColumn("adv", start)
    if query.until:
        rows = rows.withColumn("ru", F.last(F.when(F.col("u"), F.col("rn")), True).over(upto))
    for s in range(1, n):
        stage = query.stages[s]
        rows = rows.select(
            "*",
            F.last("adv", True).over(before).alias("a"),
            F.last(F.when(F.col("adv").isNotNull(), F.col("rn")), True).over(before).alias("ra"),
            F.last(F.when(clear[s], F.col("rn")), True).over(before).alias("rc"),
        )
        good = (F.col(f"t{s}") & ~F.col(f"h{s}")) if stage.negative else F.col(f"h{s}")
        good = good & F.col("ra").isNotNull() & F.coalesce(F.col("rc") <= F.col("ra"), F.lit(True))
        if query.until:
            good = good & F.coalesce(F.col("ru") <= F.col("ra"), F.lit(True))
        if query.maxspan is not None:
            good = good & ((F.size("a") == 0) | (F.col("ts") - F.get("a", F.lit(0)).getField("ts") <= query.maxspan))
        rows = rows.withColumn("adv", F.when(good, F.col("a") if stage.negative else F.concat("a", own))).drop("a", "ra", "rc")
    found = rows.where(F.col("adv").isNotNull() & (F.size("adv") > 0))
    return found.select("ord", F.transform("adv", lambda e: e.getField("event")).alias("events"))
