"""Event schemas: event type -> field -> type, as given, learned from data, merged, or turned into Spark types and back.

A type is a name (string, number, boolean, array, object, null, mixed), a list (an array: [element type], or [] for any),
or a dict (an object with these fields)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError

NAMES = ("array", "boolean", "mixed", "null", "number", "object", "string")
#: Fixed order in which an `any` query looks for a field.
ANY_ORDER = ("process", "file", "registry", "network", "dns")

_SPARK = {"string": T.StringType(), "number": T.DoubleType(), "boolean": T.BooleanType(), "null": T.NullType(), "mixed": T.VariantType(), "array": T.ArrayType(T.VariantType()), "object": T.MapType(T.StringType(), T.VariantType())}


def check_type(given, where: str = "") -> None:
    if isinstance(given, str):
        if given not in NAMES:
            raise QueryError(f"unknown type {given!r}{where}", kind="schema")
    elif isinstance(given, (list, tuple)):
        for g in given:
            check_type(g, where)
    elif isinstance(given, dict):
        for k, g in given.items():
            check_type(g, f" of {k}")
    else:
        raise QueryError(f"bad type {given!r}{where}", kind="schema")


def to_spark(given) -> T.DataType:
    if isinstance(given, dict):
        return T.StructType([T.StructField(k, to_spark(v)) for k, v in given.items()])
    if isinstance(given, (list, tuple)):
        return T.ArrayType(to_spark(given[0]) if len(given) == 1 else T.VariantType())
    return _SPARK[given]


def from_spark(dtype: T.DataType):
    if isinstance(dtype, T.StructType):
        return {f.name: from_spark(f.dataType) for f in dtype.fields}
    if isinstance(dtype, T.ArrayType):
        return [from_spark(dtype.elementType)]
    if isinstance(dtype, T.MapType):
        return "object"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, T.NumericType):
        return "number"
    if isinstance(dtype, T.VariantType):
        return "mixed"
    return "null" if isinstance(dtype, T.NullType) else "string"


def wider(a, b):
    """A type that holds both."""
    if a == b or b == "null":
        return a
    if a == "null":
        return b
    if isinstance(a, dict) and isinstance(b, dict):
        return {k: wider(a[k], b[k]) if k in a and k in b else a.get(k, b.get(k)) for k in [*a, *(k for k in b if k not in a)]}
    if isinstance(a, list) and isinstance(b, list):
        return [wider(a[0], b[0])] if a and b else a or b
    return "mixed"


@dataclass(frozen=True)
class EventSchema:
    types: dict[str, dict] = field(default_factory=dict)
    allow_generic: bool = False  # event type generic without being declared
    allow_any: bool = True
    allow_missing: bool = False  # fields that aren't declared are mixed

    def __post_init__(self):
        for name, fields in self.types.items():
            check_type(fields, f" in {name}")

    def knows(self, event_type: str) -> bool:
        return event_type in self.types or event_type == "any" and self.allow_any or event_type == "generic" and self.allow_generic

    def lookup(self, event_type: str, name: str, path: tuple = ()):
        """The type of a field, or None if there is none."""
        if event_type == "any":
            order = [*(t for t in ANY_ORDER if t in self.types), *sorted(t for t in self.types if t not in ANY_ORDER)]
            return next((found for t in order if (found := self.lookup(t, name, path)) is not None), "mixed" if self.allow_missing else None)
        fields = self.types.get(event_type)
        if fields is None:
            return "mixed" if event_type == "generic" and self.allow_generic or self.allow_missing else None
        found = fields.get(name)
        for part in path:
            if found in ("mixed", "object") and not isinstance(part, int) or found in ("mixed", "array"):
                return "mixed"
            if isinstance(part, int) and isinstance(found, (list, tuple)):
                found = found[0] if found else "mixed"
            elif isinstance(part, str) and isinstance(found, dict):
                found = found.get(part)
            else:
                found = None
        return "mixed" if found is None and self.allow_missing else found

    def merge(self, other: EventSchema) -> EventSchema:
        """This one overlaid by the other, field by field; nested types are replaced whole."""
        types = {t: {**self.types.get(t, {}), **other.types.get(t, {})} for t in [*self.types, *(t for t in other.types if t not in self.types)]}
        return EventSchema(types, self.allow_generic or other.allow_generic, self.allow_any and other.allow_any, self.allow_missing or other.allow_missing)

    def flatten(self) -> EventSchema:
        """All fields under generic; of types in sorted order the later win."""
        fields: dict = {}
        for t in sorted(self.types):
            fields.update(self.types[t])
        return EventSchema({"generic": fields}, True, self.allow_any, self.allow_missing)

    def struct(self, event_type: str) -> T.StructType:
        return to_spark(self.types[event_type])


def learn(events: DataFrame, binding) -> EventSchema:
    """The schema of each event type that occurs: the typed columns that are ever filled in its rows. One aggregation."""
    bound = binding.bind(events, False)
    fields = bound.schema["event"].dataType.fields
    filled = [F.max(F.col("event").getField(f.name).isNotNull()).alias(f"f{i}") for i, f in enumerate(fields)]
    rows = bound.groupBy("type").agg(*filled).collect()  # one row per event type
    return EventSchema({r["type"]: {f.name: from_spark(f.dataType) for i, f in enumerate(fields) if r[f"f{i}"]} for r in rows})
