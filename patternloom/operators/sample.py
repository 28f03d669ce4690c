"""Samples: a buffer per key that is emitted when it has as many events as there are stages.

Each stage that an event satisfies appends it, last stage first; so a key's appends in order, cut into runs of k, are
the matches. row_number gives the runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.compile import Compiler
from ..plans.nodes import Query, Relation
from .matching import Settings, event_scope, stage_keys, stage_test


def sample(df: DataFrame, query: Query, settings: Settings, relations: dict[Relation, Column]) -> DataFrame:
    compiler = Compiler(event_scope(df, settings, relations))
    k = len(query.stages)
    keys, _ = stage_keys(list(query.stages), query.by, compiler, settings)
    appends = [F.when(stage_test(s, compiler), F.struct(F.lit(-i).alias("pos"), key.alias("key"))) for i, (s, key) in enumerate(zip(query.stages, keys))]
    rows = df.select("ord", "event", F.explode(F.array_compact(F.array(*appends))).alias("x")).select("ord", "event", "x.pos", "x.key")
    rows = rows.withColumn("run", F.floor((F.row_number().over(Window.partitionBy("key").orderBy("ord", "pos")) - 1) / k))
    runs = rows.groupBy("key", "run").agg(F.array_sort(F.collect_list(F.struct("ord", "pos", "event")), _by_order).alias("x")).where(F.size("x") == k)
    last = F.get("x", F.lit(k - 1))
    return runs.select(last.getField("ord").alias("ord"), F.transform("x", lambda e: e.getField("event")).alias("events"))


def _by_order(a: Column, b: Column) -> Column:
    x, y = (F.struct(e.getField("ord"), e.getField("pos")) for e in (a, b))
    return F.when(x < y, -1).when(x > y, 1).otherwise(0)
