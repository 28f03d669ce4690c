"""How a DataFrame's rows are events: which column is the type, the time, the order and the host.

The bound frame has `ord` (comparable; the stream's order), `ts` (ticks of 100 ns), `type` and `event` (the payload as one
struct). Catalyst looks through the struct, so filters and column pruning still reach the scan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError

#: Ticks of 100 ns in one unit of a numeric time column.
UNITS = {"ticks": 1, "us": 10, "ms": 10_000, "s": 10_000_000}


@dataclass(frozen=True)
class EventBinding:
    type_col: str | None = None  # None: event_type, else event_type_full without _event, else generic
    time_col: str | None = None  # None: timestamp if there is one, else 0
    order_cols: tuple[str, ...] = ()  # needed by everything but single-event queries without pipes
    host_col: str = "hostname"
    time_unit: str = "ticks"
    scope_cols: tuple[str, ...] = ()  # process relations are kept apart by these; empty: one state for all events
    pid_col: str = "pid"
    ppid_col: str = "ppid"

    def type(self, df: DataFrame) -> Column:
        if self.type_col:
            return F.coalesce(F.col(self.type_col).cast("string"), F.lit("generic"))
        found = []
        if "event_type" in df.columns:
            found.append(F.col("event_type").cast("string"))
        if "event_type_full" in df.columns:
            found.append(F.regexp_replace(F.col("event_type_full").cast("string"), r"_event\z", ""))
        return F.coalesce(*found, F.lit("generic"))

    def time(self, df: DataFrame) -> Column:
        name = self.time_col or ("timestamp" if "timestamp" in df.columns else None)
        if name is None:
            return F.lit(0).cast("long")
        kind = df.schema[name].dataType
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            return F.unix_micros(F.col(name).cast("timestamp")) * 10
        # whole numbers stay exact; fractions are scaled before they are cut to ticks
        unit, value = UNITS[self.time_unit], F.col(name)
        whole = F.lit(None).cast("long") if isinstance(kind, (T.FractionalType, T.DecimalType)) else value.try_cast("long") * unit
        scaled = F.lit(None).cast("long") if isinstance(kind, T.IntegralType) else (value.try_cast("double") * unit).cast("long")
        return F.coalesce(whole, scaled, F.lit(0).cast("long"))

    def only(self, df: DataFrame, types: set[str]) -> DataFrame:
        """df with no rows of other event types where one column tells the type, as a filter that reaches the scan."""
        name = self.type_col or ("event_type" if "event_type" in df.columns and "event_type_full" not in df.columns else None)
        if name is None or types & {"any", "generic"} or not isinstance(df.schema[name].dataType, T.StringType):
            return df
        return df.where(F.col(name).isin(*sorted(types)))

    def bind(self, df: DataFrame, ordered: bool = True) -> DataFrame:
        order = self.order_cols or tuple(c for c in (self.time_col or "timestamp",) if c in df.columns)
        if ordered and not order:
            raise QueryError("this query needs the order of events: give order_cols", kind="semantic")
        ord_ = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)]) if order else F.lit(0)
        return df.select(ord_.alias("ord"), self.time(df).alias("ts"), self.type(df).alias("type"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("event"))


def normalised(df: DataFrame) -> DataFrame:
    """Rows whose `data_buffer` is a struct are replaced by it."""
    field = next((f for f in df.schema.fields if f.name == "data_buffer" and isinstance(f.dataType, T.StructType)), None)
    if field is None:
        return df
    names = list(dict.fromkeys([*(c for c in df.columns if c != "data_buffer"), *field.dataType.names]))
    inner, outer, kinds = set(field.dataType.names), set(df.columns), {}
    for f in (*df.schema.fields, *field.dataType.fields):
        kinds[f.name] = f.dataType
    out = []
    for c in names:
        own = F.col(f"`{c}`") if c in outer else F.lit(None)
        new = F.col("data_buffer").getField(c) if c in inner else F.lit(None)
        out.append(F.when(F.col("data_buffer").isNotNull(), new.cast(kinds[c])).otherwise(own.cast(kinds[c])).alias(c))
    return df.select(*out)
