"""Compiled values: a Spark column with the language's kind, and the error it may raise on a row.

Kinds are static, from the columns' types: null, bool, int, float, string, array, object. A mismatch of kinds is null, not
an error. Errors travel as data: `error` is a string column that is null on rows without one, so a failing
term behind a term that already decides does no harm, and `safe` can drop it."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNSET = object()


@dataclass(frozen=True)
class Value:
    kind: str
    col: Column
    dtype: T.DataType | None = None
    literal: Any = UNSET
    error: Column | None = None
    folds: bool = True  # takes part in case folding: fields, calls and string literals

    @property
    def number(self) -> bool:
        return self.kind in ("int", "float")


def kind_of(dtype: T.DataType) -> str:
    if isinstance(dtype, T.BooleanType):
        return "bool"
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int"
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float"
    if isinstance(dtype, T.ArrayType):
        return "array"
    if isinstance(dtype, (T.StructType, T.MapType)):
        return "object"
    return "null" if isinstance(dtype, T.NullType) else "string"


def typed(col: Column, dtype: T.DataType, error: Column | None = None) -> Value:
    kind = kind_of(dtype)
    if kind == "int" and not isinstance(dtype, T.LongType):
        col, dtype = col.cast("long"), T.LongType()
    elif kind == "float" and not isinstance(dtype, T.DoubleType):
        col, dtype = col.cast("double"), T.DoubleType()
    elif kind == "string" and not isinstance(dtype, T.StringType):
        col, dtype = col.cast("string"), T.StringType()
    return Value(kind, col, dtype, error=error)


def null() -> Value:
    return Value("null", F.lit(None), T.NullType(), None)


def constant(value: Any) -> Value:
    if value is None:
        return null()
    kind, dtype = {bool: ("bool", T.BooleanType()), int: ("int", T.LongType()), float: ("float", T.DoubleType()), str: ("string", T.StringType())}[type(value)]
    return Value(kind, F.lit(value).cast(dtype), dtype, value)


def boolean(col: Column, error: Column | None = None) -> Value:
    return Value("bool", col, T.BooleanType(), error=error)


def unknown() -> Value:
    """A null of kind bool."""
    return boolean(F.lit(None).cast("boolean"))


def string(col: Column, error: Column | None = None) -> Value:
    return Value("string", col, T.StringType(), error=error)


def integer(col: Column, error: Column | None = None) -> Value:
    return Value("int", col.cast("long"), T.LongType(), error=error)


def real(col: Column, error: Column | None = None) -> Value:
    return Value("float", col, T.DoubleType(), error=error)


def errors(*found: Column | None) -> Column | None:
    """The first error of those that may be there."""
    some = [x for x in found if x is not None]
    return None if not some else some[0] if len(some) == 1 else F.coalesce(*some)


def when_error(condition: Column, message: str) -> Column:
    return F.when(condition, F.lit(message))


def truth(v: Value) -> Column:
    """A value as a boolean: non-empty, non-zero; null stays null."""
    if v.kind == "null":
        return F.lit(None).cast("boolean")
    if v.kind == "bool":
        return v.col
    if v.kind == "string":
        return F.length(v.col) > 0
    if v.number:
        return v.col != 0
    if v.kind == "array" or isinstance(v.dtype, T.MapType):
        return F.when(v.col.isNotNull(), F.size(v.col) > 0)
    return F.when(v.col.isNotNull(), F.lit(len(v.dtype.fields) > 0))


def equal(a: Value, b: Value, fold: bool) -> Column | None:
    """Equality of two values of comparable kinds, null if either is; None if their kinds can't be compared."""
    if "null" in (a.kind, b.kind):
        return None
    if a.number and b.number or a.kind == b.kind == "bool":
        return a.col == b.col
    if a.kind == b.kind == "string":
        return F.lower(a.col) == F.lower(b.col) if fold else a.col == b.col
    if a.kind == b.kind and a.dtype == b.dtype and not isinstance(a.dtype, T.MapType):
        return a.col == b.col
    return None


def folded(col: Column, dtype: T.DataType) -> Column:
    """A key with its strings in lower case, also inside arrays and objects."""
    if isinstance(dtype, T.StringType):
        return F.lower(col)
    if isinstance(dtype, T.ArrayType):
        return F.transform(col, lambda e: folded(e, dtype.elementType))
    if isinstance(dtype, T.StructType):
        return F.when(col.isNotNull(), F.struct(*[folded(col.getField(f.name), f.dataType).alias(f.name) for f in dtype.fields]))
    return col
