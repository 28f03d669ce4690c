"""The language's scalar functions over compiled values, in Spark's built-in functions wherever they can say it."""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError
from .values import Value, boolean, constant, equal, errors, integer, null, real, string, truth, typed, unknown, when_error

#: Least and most arguments (None: any number).
ARITY: dict[str, tuple[int, int | None]] = {
    "add": (2, 2), "arrayContains": (2, None), "arrayCount": (3, 3), "arraySearch": (3, 3), "between": (3, 4), "cidrMatch": (2, None), "concat": (1, None),
    "divide": (2, 2), "endsWith": (2, 2), "indexOf": (2, 3), "length": (1, 1), "match": (2, None), "matchLite": (2, None), "modulo": (2, 2), "multiply": (2, 2),
    "number": (1, 2), "safe": (1, 1), "startsWith": (2, 2), "string": (1, 1), "stringContains": (2, 2), "substring": (2, 3), "subtract": (2, 2), "wildcard": (2, None),
}


def _fold(col: Column, fold: bool) -> Column:
    return F.lower(col) if fold else col


# arithmetic


def floor_mod(a: Column, b: Column) -> Column:
    r = F.try_mod(a, b)
    return F.when((r != 0) & ((r > 0) != (b > 0)), r + b).otherwise(r)


def _whole_div(a: Column, b: Column) -> Column:
    # by way of div, as a quotient of doubles would lose digits
    safe = F.when(b != 0, b)
    q, r = F.call_function("div", a, safe), F.try_mod(a, safe)
    return F.when((r != 0) & ((r > 0) != (b > 0)), q - 1).otherwise(q)


def arithmetic(op: str, a: Value, b: Value) -> Value:
    error = errors(a.error, b.error)
    if not (a.number and b.number):
        return Value("null", F.lit(None), T.NullType(), error=error)
    whole = a.kind == b.kind == "int"
    x, y = (a.col, b.col) if whole else (a.col.cast("double"), b.col.cast("double"))
    if op in "+-*":
        out = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](x, y)
    elif op == "/":
        out = _whole_div(x, y) if whole else F.try_divide(x, y)
    else:
        error = errors(a.error, b.error, when_error(y == 0, "integer modulo by zero" if whole else "float modulo by zero"))
        out = floor_mod(x, y)
    return integer(out, error) if whole else real(out, error)


# strings


def like(source: Value, patterns: list[Value], fold: bool) -> Value:
    """Whether any pattern with * fits the whole string."""
    if source.kind != "string":
        return Value("bool", F.lit(None).cast("boolean"), T.BooleanType(), error=source.error)
    terms = []
    for p in patterns:
        if p.kind != "string":
            continue
        if isinstance(p.literal, str):
            text = F.lit(re.sub(r"([%_\\])", r"\\\1", p.literal.lower() if fold else p.literal).replace("*", "%"))
        else:
            text = F.replace(F.regexp_replace(_fold(p.col, fold), r"([%_\\])", r"\\$1"), F.lit("*"), F.lit("%"))
        terms.append(F.like(_fold(source.col, fold), text, F.lit("\\")))
    out = F.lit(False) if not terms else terms[0]
    for t in terms[1:]:
        out = out | t
    return boolean(F.when(source.col.isNotNull(), F.coalesce(out, F.lit(False))), errors(source.error, *(p.error for p in patterns)))


def java_pattern(pattern: str) -> str:
    """A pattern in Python's dialect, written in Java's; refuses what the language refuses. Inside character classes nothing
    is special but what Java would take for a nested class or an intersection."""
    names: dict[str, str] = {}
    out, at, inside = [], 0, False
    while at < len(pattern):
        part = pattern[at : at + 2] if pattern[at] == "\\" else pattern[at]
        if inside:
            if part == "]":
                inside = False
            elif part == "[":
                part = "\\["
            elif part == "&" and pattern[at + 1 : at + 2] == "&":
                out.append("\\")
            out.append(part)
            at += len(part) if part != "\\[" or pattern[at] == "\\" else 1
            continue
        if part == "[":
            inside = True
            begin = re.compile(r"\[\^?\]?").match(pattern, at)[0]
            out.append(begin.replace("]", "\\]"))
            at += len(begin)
            continue
        if part == "\\z" or part == "(" and re.compile(r"\(\?>|\(\?-[a-z]+\)").match(pattern, at):
            raise QueryError(f"invalid regular expression {pattern!r}", kind="semantic")
        if part == "\\Z":
            out.append("\\z")
        elif part == "(" and (named := re.compile(r"\(\?P<([A-Za-z_]\w*)>").match(pattern, at)):
            out.append(f"(?<{names.setdefault(named[1], f'g{len(names)}')}>")
            part = named[0]
        elif part == "(" and (named := re.compile(r"\(\?P=([A-Za-z_]\w*)\)").match(pattern, at)):
            out.append(f"\\k<{names.get(named[1], named[1])}>")
            part = named[0]
        else:
            out.append(part)
        at += len(part)
    return "".join(out)


def regex(source: Value, patterns: list[Value], fold: bool) -> Value:
    error = errors(source.error, *(p.error for p in patterns))
    if source.kind != "string":
        return Value("bool", F.lit(None).cast("boolean"), T.BooleanType(), error=error)
    flags = "(?isu)" if fold else "(?su)"
    fixed = [java_pattern(p.literal) for p in patterns if isinstance(p.literal, str)]
    out = F.rlike(source.col, F.lit(f"{flags}\\A(?:{'|'.join(fixed)})")) if fixed else F.lit(False)
    for p in patterns:
        if p.kind == "string" and not isinstance(p.literal, str):
            out = out | F.coalesce(F.rlike(source.col, F.concat(F.lit(f"{flags}\\A(?:"), p.col, F.lit(")"))), F.lit(False))
    return boolean(F.when(source.col.isNotNull(), out), error)


def _both(a: Value, b: Value, test: Callable[[Column, Column], Column], fold: bool) -> Value:
    error = errors(a.error, b.error)
    if a.kind != "string" or b.kind != "string":
        return Value("bool", F.lit(None).cast("boolean"), T.BooleanType(), error=error)
    return boolean(test(_fold(a.col, fold), _fold(b.col, fold)), error)


def contains(a: Value, b: Value, fold: bool) -> Value:
    out = _both(a, b, F.contains, fold)
    return boolean(F.coalesce(out.col, F.lit(False)), out.error)


def _repr(x):
    return x.map(lambda v: None if v is None else repr(float(v)), na_action="ignore").where(x.notna(), None)


def float_text(col: Column) -> Column:
    """A double as Python writes it, which Spark does not for large and small numbers."""
    return F.pandas_udf(_repr, T.StringType(), 200)(col)


def text_of(v: Value) -> Value:
    """string(): numbers, booleans and nested values as text; null stays null."""
    if v.kind == "null":
        return v
    if v.kind == "float":
        return string(float_text(v.col), v.error)
    if v.kind in ("array", "object"):
        return string(F.pandas_udf(_nested, T.StringType(), 200)(F.to_json(v.col, {"ignoreNullFields": "false"})), v.error)
    return string(v.col.cast("string"), v.error)


def _nested(text):
    import json

    def ordered(x):
        return {k: ordered(x[k]) for k in sorted(x)} if isinstance(x, dict) else [ordered(y) for y in x] if isinstance(x, list) else x

    return text.map(lambda t: None if t is None else repr(ordered(json.loads(t))), na_action="ignore")


def number(source: Value, base: Value | None) -> Value:
    error = errors(source.error, base.error if base else None)
    if source.kind != "string":
        return Value("null", F.lit(None), T.NullType(), error=error)
    explicit = base is not None and base.kind != "null"
    given = (base.literal if isinstance(base.literal, int) else None) if explicit else 10
    if given is None:
        raise QueryError("number base must be an integer literal", kind="semantic")
    s, parse = source.col, given or 10
    digits = s.rlike(r"\A[+-]*[0-9]+\z")
    fraction = (F.length(s) - F.length(F.replace(s, F.lit("."), F.lit("")))) == 1 if not explicit or given == 10 else F.lit(False)
    if digits_only := explicit and (given < 0 or given == 1 or given > 36):
        whole = F.lit(None).cast("long")
    elif parse == 10:
        whole = F.when(s.rlike(r"\A[+-]?[0-9]+\z"), s.try_cast("long"))
    else:
        sign = F.when(s.startswith("-"), -1).otherwise(1)
        allowed = "".join("0123456789"[: min(parse, 10)])
        whole = F.when(s.rlike(rf"\A[+-]?[{allowed}]+\z"), sign * F.conv(F.regexp_replace(s, r"\A[+-]", ""), parse, 10).try_cast("long"))
    hexed = s.startswith("0x") if not explicit or given == 16 else F.lit(False)
    from_hex = F.when(s.rlike(r"\A0x[0-9A-Fa-f]{1,15}\z"), F.conv(F.substr(s, F.lit(3)), 16, 10).try_cast("long"))
    as_float = F.when(s.rlike(r"\A[+-]?(?:[0-9]+\.[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"), s.try_cast("double"))
    bad = F.when(fraction, F.when(as_float.isNull(), F.lit("could not convert string to float"))).when(hexed, F.when(from_hex.isNull(), F.lit("invalid hexadecimal number"))).when(
        digits, F.lit("number base must be >= 2 and <= 36, or 0") if digits_only else F.when(whole.isNull(), F.lit("invalid number")))
    bad = F.when(s.isNotNull(), bad)
    error = errors(error, bad)
    if isinstance(source.literal, str):  # the kind is known
        text = source.literal
        if text.count(".") == 1 and (not explicit or given == 10):
            return real(as_float, error)
        return integer(F.when(hexed, from_hex).otherwise(whole), error)
    if explicit and given != 10:
        return integer(F.when(hexed, from_hex).otherwise(whole), error)
    # one column has one kind: with or without a decimal point it is a float, which compares alike
    return real(F.when(fraction, as_float).when(hexed, from_hex.cast("double")).otherwise(whole.cast("double")), error)


def _slice(col: Column, length: Column) -> Column:
    """A slice index: negative from the end, cut to 0..length."""
    at = F.when(col < 0, col + length).otherwise(col)
    return F.greatest(F.lit(0), F.least(at, length))


def _index(v: Value | None, name: str, default: Column) -> tuple[Column, Column | None]:
    if v is None or v.kind == "null":
        return default, None
    if v.kind != "int":
        return default, errors(v.error, when_error(v.col.isNotNull(), f"{name} must be an integer"))
    return F.coalesce(v.col, default), v.error


def index_of(source: Value, sub: Value, start: Value | None, fold: bool) -> Value:
    at, bad = _index(start, "indexOf start", F.lit(0).cast("long"))
    error = errors(source.error, sub.error, bad)
    if source.kind != "string" or sub.kind != "string":
        return Value("null", F.lit(None), T.NullType(), error=error)
    s, x = _fold(source.col, fold), _fold(sub.col, fold)
    size = F.length(s)
    begin = _slice(at, size)
    found = F.when(F.length(x) == 0, begin).otherwise(F.position(x, s, (begin + 1).cast("int")) - 1)
    error = errors(error, when_error((F.length(x) == 0) & (at > size), "substring not found"))
    return integer(F.when(found >= 0, found), error)


def substring(source: Value, start: Value, end: Value | None) -> Value:
    a, bad_a = _index(start, "substring start", F.lit(0).cast("long"))
    error = errors(source.error, bad_a)
    if source.kind != "string":
        return Value("null", F.lit(None), T.NullType(), error=error)
    size = F.length(source.col).cast("long")
    b, bad_b = _index(end, "substring end", size)
    a, b = _slice(a, size), _slice(b, size)
    return string(F.substr(source.col, (a + 1).cast("int"), F.greatest(F.lit(0), b - a).cast("int")), errors(error, bad_b))


def between(source: Value, left: Value, right: Value, greedy: Value | None, fold: bool) -> Value:
    error = errors(source.error, left.error, right.error, greedy.error if greedy else None)
    if "string" != source.kind or left.kind != "string" or right.kind != "string":
        return Value("null", F.lit(None), T.NullType(), error=error)
    s, x, y = (_fold(v.col, fold) for v in (source, left, right))
    at = F.position(x, s)
    start = at - 1 + F.length(x)
    first = F.when(F.length(y) == 0, start).otherwise(F.position(y, s, (start + 1).cast("int")) - 1)
    last = F.when(F.length(y) == 0, F.length(s)).otherwise(F.length(s) - F.position(F.reverse(y), F.reverse(s)) + 1 - F.length(y))
    last = F.when((F.length(y) > 0) & ~F.contains(s, y), -1).otherwise(last)
    stop = F.when(F.coalesce(truth(greedy), F.lit(False)), last).otherwise(first) if greedy else first
    out = F.when((at > 0) & (stop >= start), F.substr(source.col, (start + 1).cast("int"), (stop - start).cast("int")))
    return string(out, error)


# addresses


OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
V4 = rf"\A{OCTET}(?:\.{OCTET}){{3}}\z"


def _inside(net: ipaddress.IPv4Network) -> str:
    """A pattern of the dotted addresses in a network: octets that are fixed, a range, or any."""
    low, high = net.network_address.packed, net.broadcast_address.packed
    parts = [OCTET if (a, b) == (0, 255) else "(?:" + "|".join(map(str, range(a, b + 1))) + ")" for a, b in zip(low, high)]
    return r"\.".join(parts)


def cidr_match(source: Value, patterns: list[Value]) -> Value:
    if source.kind != "string":
        return boolean(F.lit(False), source.error)
    nets = []
    for p in patterns:
        if not isinstance(p.literal, str):
            raise QueryError("cidrMatch expects literal networks", kind="semantic")
        try:
            text = p.literal.strip()
            if "/" not in text:
                raise ValueError("no prefix length")
            nets.append(ipaddress.ip_network(text, strict=False))
        except ValueError as bad:
            raise QueryError(f"invalid network {p.literal!r}: {bad}", kind="semantic") from bad
    ip = source.col
    narrow = [_inside(n) for n in nets if n.version == 4]
    hit = ip.rlike(rf"\A(?:{'|'.join(narrow)})\z") if narrow else F.lit(False)
    four = ip.rlike(V4)
    wide = [str(n) for n in nets if n.version == 6]

    @F.pandas_udf("int")
    def six(text):  # 1 inside, 0 outside, -1 no address; only for what isn't IPv4
        known = [ipaddress.ip_network(w) for w in wide]

        def one(t):
            if t is None:
                return None
            try:
                address = ipaddress.ip_address(t)
            except ValueError:
                return -1
            return int(any(address.version == n.version and address in n for n in known))

        import pandas as pd

        return pd.Series([one(t) for t in text], dtype="Int32")

    if wide:
        state = six(F.when(~hit & ~four, ip))
    else:
        state = F.when(~hit, F.when(four | ip.rlike(r"\A[0-9A-Fa-f:.]*:[0-9A-Fa-f:.]*(?:%.+)?\z"), 0).otherwise(-1))
    error = errors(source.error, when_error(state == -1, "invalid address"))
    inside = hit | F.coalesce(state == 1, F.lit(False)) if wide else hit
    return boolean(F.coalesce(inside, F.lit(False)), error)


# arrays


def elements(v: Value) -> tuple[Column, T.DataType] | None:
    """What a value's members are: elements, characters or keys."""
    if v.kind == "array":
        return v.col, v.dtype.elementType
    if v.kind == "string":
        return F.filter(F.split(v.col, ""), lambda c: c != ""), T.StringType()
    if isinstance(v.dtype, T.MapType):
        return F.map_keys(v.col), v.dtype.keyType
    if v.kind == "object":
        names = F.array(*[F.when(v.col.getField(f.name).isNotNull(), F.lit(f.name)) for f in v.dtype.fields])
        return F.when(v.col.isNotNull(), F.array_compact(names)), T.StringType()
    return None


def array_contains(source: Value, wanted: list[Value], fold: bool) -> Value:
    error = errors(source.error, *(w.error for w in wanted))
    if source.kind == "null":
        return Value("bool", F.lit(None).cast("boolean"), T.BooleanType(), error=error)
    members = elements(source)
    if members is None:
        return boolean(F.lit(None).cast("boolean"), errors(error, when_error(source.col.isNotNull(), "argument is not iterable")))
    items, dtype = members

    def one(e: Column) -> Column:
        out = F.lit(False)
        for w in wanted:
            if w.kind == "null":
                out = out | e.isNull()
            elif (same := equal(typed(e, dtype), w, fold)) is not None:
                out = out | F.coalesce(same, e.isNull() & w.col.isNull())
        return out

    return boolean(F.when(items.isNotNull(), F.exists(items, one)), error)


def array_search(source: Value, body: Callable[[Value], Value], count: bool) -> Value:
    if source.kind != "array":
        return constant(0) if count else constant(False)
    dtype = source.dtype.elementType
    test = lambda e: F.coalesce(truth(body(typed(e, dtype))), F.lit(False))
    if count:
        return integer(F.coalesce(F.size(F.filter(source.col, test)), F.lit(0)), source.error)
    return boolean(F.coalesce(F.exists(source.col, test), F.lit(False)), source.error)


def length(v: Value) -> Value:
    if v.kind == "string":
        return integer(F.length(v.col), v.error)
    if v.kind == "array" or isinstance(v.dtype, T.MapType):
        return integer(F.when(v.col.isNotNull(), F.size(v.col)), v.error)
    if v.kind == "object":
        return integer(F.size(elements(v)[0]), v.error)
    return Value("null", F.lit(None), T.NullType(), error=v.error)


def call(name: str, args: list[Value], fold: bool) -> Value:
    """A function without its own scope applied to values."""
    pick = lambda i: args[i] if len(args) > i else None
    if name == "length":
        return length(args[0])
    if name == "wildcard":
        return like(args[0], args[1:], fold)
    if name in ("match", "matchLite"):
        return regex(args[0], args[1:], fold)
    if name == "startsWith":
        return _both(args[0], args[1], F.startswith, fold)
    if name == "endsWith":
        return _both(args[0], args[1], F.endswith, fold)
    if name == "stringContains":
        return contains(args[0], args[1], fold)
    if name == "string":
        return text_of(args[0])
    if name == "number":
        return number(args[0], pick(1))
    if name == "concat":
        parts = [text_of(a) for a in args]
        error = errors(*(p.error for p in parts))
        return Value("null", F.lit(None), T.NullType(), error=error) if any(p.kind == "null" for p in parts) else string(F.concat(*[p.col for p in parts]), error)
    if name in ("add", "subtract", "multiply", "divide", "modulo"):
        return arithmetic({"add": "+", "subtract": "-", "multiply": "*", "divide": "/", "modulo": "%"}[name], args[0], args[1])
    if name == "safe":
        v = args[0]
        return v if v.error is None else Value(v.kind, F.when(v.error.isNull(), v.col), v.dtype)
    if name == "indexOf":
        return index_of(args[0], args[1], pick(2), fold)
    if name == "substring":
        return substring(args[0], args[1], pick(2))
    if name == "between":
        return between(args[0], args[1], args[2], pick(3), fold)
    if name == "cidrMatch":
        return cidr_match(args[0], args[1:])
    if name == "arrayContains":
        return array_contains(args[0], args[1:], fold)
    raise QueryError(f"unknown function {name}", kind="semantic")


__all__ = ["ARITY", "arithmetic", "array_search", "call", "null", "unknown"]
