"""Pipes: left to right over events, or over whole matches for sequence, join and sample.

Order travels as the column `ord`; `sort` puts its keys before it, so head behind sort is a top-k and nothing is
numbered in one place. Aggregating pipes group on folded keys with partial aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError
from ..functions.compile import Compiler
from ..functions.values import Value, folded
from ..plans.nodes import Literal, Pipe, Relation
from .matching import Settings, event_scope, group_scope, strict

DEFAULT = 50  # of head and tail
#: What stands for null among values of a kind.
EMPTY = {"string": "", "int": 0, "float": 0.0, "bool": False}


class Pipes:
    def __init__(self, df: DataFrame, groups: bool, settings: Settings, relations: dict[Relation, Column] | None = None):
        self.df, self.groups, self.settings, self.relations = df, groups, settings, relations or {}

    @property
    def body(self) -> str:
        return "events" if self.groups else "event"

    def compiler(self, relations: bool = True) -> Compiler:
        scope = group_scope(self.df, self.settings) if self.groups else event_scope(self.df, self.settings, self.relations if relations else {})
        return Compiler(scope)

    def run(self, pipes: tuple[Pipe, ...]) -> DataFrame:
        for pipe in pipes:
            self.df = getattr(self, f"_{pipe.name}")(pipe.args)
        return self.df

    def _size(self, args: tuple) -> int:
        if not args:
            return DEFAULT
        if not isinstance(args[0], Literal) or type(args[0].value) is not int or args[0].value <= 0:
            raise QueryError("head and tail expect a positive integer", kind="semantic")
        return args[0].value

    def _filter(self, args: tuple) -> DataFrame:
        return self.df.where(strict(self.compiler().test(args[0])))

    def _head(self, args: tuple) -> DataFrame:
        return self.df.orderBy("ord").limit(self._size(args))

    def _tail(self, args: tuple) -> DataFrame:
        return self.df.orderBy(F.col("ord").desc()).limit(self._size(args))

    def _sort(self, args: tuple) -> DataFrame:
        values = [self.compiler(False).value(a) for a in args]
        keys = []
        for v in values:
            if v.kind not in EMPTY:
                raise QueryError(f"can't sort by values of kind {v.kind}", kind="semantic")
            keys.append(F.coalesce(F.lower(v.col) if v.kind == "string" and self.settings.fold else v.col, F.lit(EMPTY[v.kind])))
        return self.df.withColumn("ord", F.struct(*[k.alias(f"s{i}") for i, k in enumerate(keys)], F.col("ord").alias("then")))

    def _keys(self, args: tuple) -> tuple[list[Value], list[Column]]:
        values = [self.compiler().value(a) for a in args]
        for v in values:
            if v.kind == "object":
                raise QueryError("unhashable type: objects can't be keys", kind="semantic")
        return values, [(folded(v.col, v.dtype) if self.settings.fold else v.col).alias(f"k{i}") for i, v in enumerate(values)]

    def _unique(self, args: tuple) -> DataFrame:
        _, keys = self._keys(args)
        return self.df.groupBy(*keys).agg(F.min("ord").alias("_o"), F.min_by(self.body, "ord").alias(self.body)).select(F.col("_o").alias("ord"), self.body)

    def _first(self, name: str) -> Value | None:
        return self.compiler().scope.field(name)

    def _hosts(self, empty: bool) -> Column:
        """The hosts of a group in order, null if there are none."""
        host = self._first(self.settings.binding.host_col)
        if host is None or host.kind != "string":
            return F.lit(None).cast("array<string>")
        found = F.array_sort(F.collect_set(host.col if empty else F.when(F.length(host.col) > 0, host.col)))
        return F.when(F.size(found) > 0, found)

    def _emit(self, rows: DataFrame, ord_: Column, fields: list[Column]) -> DataFrame:
        event = F.struct(*fields)
        return rows.select(ord_.alias("ord"), *([] if self.groups else [F.lit(0).cast("long").alias("ts"), F.lit("generic").alias("type")]), (F.array(event) if self.groups else event).alias(self.body))

    def _with_total(self, rows: DataFrame) -> DataFrame:
        """Each group with its share; the total is one row."""
        total = rows.agg(F.sum("count").alias("_total"))
        return rows.join(F.broadcast(total)).withColumn("percent", F.col("count") / F.col("_total"))

    def _count(self, args: tuple) -> DataFrame:
        summary = [F.count(F.lit(1)).alias("count"), self._hosts(True).alias("hosts")]
        shown = [F.col("hosts"), F.when(F.col("hosts").isNotNull(), F.size("hosts")).alias("total_hosts")]
        if not args:
            rows = self.df.agg(*summary)
            return self._emit(rows, F.lit(0), [F.lit("totals").alias("key"), F.col("count"), *shown])
        values, keys = self._keys(args)
        if any(v.kind == "array" for v in values):
            raise QueryError("unhashable type: lists can't be counted", kind="semantic")
        raw = [F.min_by(v.col, "ord").alias(f"r{i}") for i, v in enumerate(values)]
        rows = self._with_total(self.df.groupBy(*keys).agg(*raw, *summary))
        names = [F.coalesce(F.col(f"r{i}"), F.lit(EMPTY.get(v.kind, ""))) for i, v in enumerate(values)]
        alike = len({v.dtype for v in values}) == 1
        key = names[0] if len(names) == 1 else F.array(*[n if alike else n.cast("string") for n in names])
        return self._emit(rows, F.struct("count", F.struct(*names).alias("key")), [key.alias("key"), F.col("count"), F.col("percent"), *shown])

    def _unique_count(self, args: tuple) -> DataFrame:
        _, keys = self._keys(args)
        old = self._first("count")
        one = F.coalesce(old.col, F.lit(1)) if old is not None and old.number else F.lit(1)
        first = F.min_by(F.get("events", F.lit(0)) if self.groups else F.col("event"), "ord").alias("_first")
        hosts = self._hosts(False)
        rows = self._with_total(self.df.groupBy(*keys).agg(F.min("ord").alias("_o"), first, F.sum(one).alias("count"), hosts.alias("hosts")))
        schema = self.df.schema[self.body].dataType
        schema = schema.elementType if isinstance(schema, T.ArrayType) else schema
        own = ("count", "percent", "hosts", "total_hosts", self.settings.binding.host_col)
        kept = [F.col("_first").getField(f.name).alias(f.name) for f in schema.fields if f.name not in own]
        return self._emit(rows, F.col("_o"), [*kept, F.col("count"), F.col("percent"), F.col("hosts"), F.when(F.col("hosts").isNotNull(), F.size("hosts")).alias("total_hosts")])
