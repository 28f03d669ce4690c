"""Joins: per key one slot per stage, filled by the first event that fits; a full set is emitted and the slots start anew.

There is no closed form in windows, so each key's events are folded in order. Rows are dealt by key and sorted, and a
task streams them through the slots: it holds one set of slots, whatever a key's size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.nodes import Query, Relation
from .matching import Settings
from .sequence import dealt


def join(df: DataFrame, query: Query, settings: Settings, relations: dict[Relation, Column]) -> DataFrame:
    n = len(query.stages)
    rows = dealt(df, query, settings, relations).repartition("key").sortWithinPartitions("key", "ord")
    rows = rows.select("key", "ord", "event", F.array(*[f"h{i}" for i in range(n)]).alias("hits"), "u")
    schema = T.StructType([T.StructField("ord", rows.schema["ord"].dataType), T.StructField("events", T.ArrayType(rows.schema["event"].dataType))])

    def fold(batches):
        import pyarrow as pa

        key, slots, fresh = None, [None] * n, True
        for batch in batches:
            ords, events, done = batch.column(1), batch.column(2), []
            for i, (k, hits, until) in enumerate(zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist())):
                if fresh or k != key:
                    key, slots, fresh = k, [None] * n, False
                if until:
                    slots = [None] * n
                for s, hit in enumerate(hits):
                    if hit and slots[s] is None:
                        slots[s] = events.slice(i, 1)
                        if None not in slots:
                            done.append((i, slots))
                            slots = [None] * n
            if done:
                flat = pa.concat_arrays([e for _, found in done for e in found])
                lists = pa.ListArray.from_arrays(pa.array([n * j for j in range(len(done) + 1)], pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([ords.take(pa.array([i for i, _ in done])), lists], ["ord", "events"])

    return rows.mapInArrow(fold, schema)
