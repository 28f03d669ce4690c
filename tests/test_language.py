"""Parser, checks, folding, definitions and schemas; no Spark here."""

import pytest

from patternloom.api import Options, compile
from patternloom.errors import QueryError
from patternloom.plans.fold import Folder
from patternloom.plans.nodes import Call, Compare, Field, In, IsNull, Literal, Logic, Math, Not
from patternloom.plans.parser import Dialect, parse, parse_expression
from patternloom.plans.schemas import EventSchema

x, y = Field("x"), Field("y")


@pytest.mark.parametrize("text,tree", [
    ("x == 1 and not y or x < 2", Logic("or", (Logic("and", (Compare("==", x, Literal(1)), Not(y))), Compare("<", x, Literal(2))))),
    ("x + 2 * y", Math("+", x, Math("*", Literal(2), y))),
    ("-x", Math("-", Literal(0), x)),
    ("x != null", IsNull(x, True)),
    ("x not in (1, 'a',)", Not(In(x, (Literal(1), Literal("a"))))),
    ("a.b[3].c", Field("a", ("b", 3, "c"))),
    ("`odd name` = 1", Compare("==", Field("odd name"), Literal(1))),
    ("x:length(y):foo()", Call("foo", (Call("length", (x, y)),))),
    (r"x == 'a\n\"b' // end", Compare("==", x, Literal('a\n"b'))),
    (r"x == ?'a\n'", Compare("==", x, Literal(r"a\n"))),
    ("not not x", x),
])
def test_expression(text, tree):
    assert parse_expression(text) == tree


def test_query_parts():
    q = parse("sequence by u with maxspan=1500ms [a where true] [b where x] fork=false by y until [c where true] | head 3 | sort a b, c")
    assert (q.form, q.maxspan, q.by, q.until.type) == ("sequence", 10_000_000, (Field("u"),), "c")
    assert (q.stages[1].fork, q.stages[1].by) == (False, (y,))
    assert [(p.name, len(p.args)) for p in q.pipes] == [("head", 1), ("sort", 3)]


REJECTED = [
    "process where", "process", "where where true", "process where x ==", "process where x == 'open", "process where (x", "process where x in ()", "process where 1", "process where 'a'",
    "sequence [a where true]", "sequence by u [a where true] [b where true] by v", "sequence [a where true] fork [b where true]", "sequence with maxspan=1.5s [a where true] [b where true]",
    "sequence with maxspan=1w [a where true] [b where true]", "join [a where true] [b where true] fork", "join [a where true]", "sample [a where true] [b where true]",
    "process where foo(x)", "process where length()", "process where length(x, y)", "process where match(x, y)", "process where match(x, '(')", "process where cidrMatch(x, 'a')", "process where cidrMatch(x, '1.2.3.4')",
    "process where x + 'a' == 1", "process where true < x", "process where startsWith(1, 'a')", "process where arraySearch(x, 'a', true)", "process where true | head 0", "process where true | head x",
    "process where true | sort 1", "process where true | nothing", "process where true | filter", "process where x : 'a'", "process where ?x == 1", "process where x in~ ('a')", "process where $x",
    "sequence [a where true] ![b where true]", "sequence [a where true] [b where true] with runs=2", "sequence [a where true] as p [b where true]", "process where x == 1 == 2", "process where true | sort event of [a where true]",
]


@pytest.mark.parametrize("text", REJECTED)
def test_rejected(text):
    with pytest.raises(QueryError):
        compile(text)


def test_diagnostic_place():
    with pytest.raises(QueryError) as bad:
        compile("process where true and\n  x == $")
    assert (bad.value.line, bad.value.column) == (2, 8)
    assert "^" in str(bad.value)


def test_dialects():
    es = Options(extended=True, allow_runs=True, allow_negation=True, allow_sample=True)
    compile('process where x : ("a*", "b") and ?y regex "c" and x in~ ("d")', es)
    compile('process where x == """raw "text" """', es)
    compile("sequence with maxspan=1s [a where true] ![b where true] [c where true] with runs=3", es)
    for text in ("process where x = 1", "process where x == 'a'", "sequence [a where true] ![b where true]"):
        with pytest.raises(QueryError):
            compile(text, es)
    compile("sequence [a where true] as p [b where p.x == 1]", Options(scoped=True))
    assert parse("x == 1", Dialect(implied_any=True)).stages[0].type == "any"
    assert parse("| head 1", Dialect(implied_base=True)).pipes[0].name == "head"


@pytest.mark.parametrize("text,tree", [
    ("1 + 2 * 3 == 7", Literal(True)), ("-7 / 2", Literal(-4)), ("7 % -3", Literal(-2)), ("1 / 0", Math("/", Literal(1), Literal(0))), ("'A' == 'a'", Literal(True)), ("1 == true", Literal(None)),
    ("x == x", Literal(True)), ("x != x", Literal(False)), ("not (x == 1)", Compare("!=", x, Literal(1))), ("not (x == null)", IsNull(x, True)), ("null == null", Literal(True)),
    ("x in ('a', 'A', 'b')", In(x, (Literal("a"), Literal("b")))), ("x and true and true", x), ("x == 'a*'", Call("wildcard", (x, Literal("a*")))), ("x != 'a*'", Not(Call("wildcard", (x, Literal("a*"))))),
    ("wildcard(x, 'a') or wildcard(x, 'b', 'c')", Call("wildcard", (x, Literal("a"), Literal("b"), Literal("c")))), ("x == 1 and false", Literal(False)), ("x == 1 or true", Literal(True)),
])
def test_folding(text, tree):
    assert Folder()(parse_expression(text)) == tree


def test_definitions():
    found = "const N = 5\nmacro BIG(a) a > N\nmacro BOTH(a, b) BIG(a) and BIG(b.c)"
    rule = compile("process where BOTH(x, y)", Options(definitions=found))
    assert rule.query.stages[0].where == Logic("and", (Compare(">", x, Literal(5)), Compare(">", Field("y", ("c",)), Literal(5))))
    for bad in ("const N = 1 const N = 2", "const N = x", "macro A(x, x) x", "nothing"):
        with pytest.raises(QueryError):
            compile("process where true", Options(definitions=bad))
    with pytest.raises(QueryError):
        compile("process where BIG(x, y)", Options(definitions=found))


SCHEMA = EventSchema({"process": {"name": "string", "pid": "number", "args": ["string"], "user": {"id": "number"}}, "file": {"name": "number", "path": "string"}})


@pytest.mark.parametrize("text,good", [
    ("process where name == 'a' and user.id > 3 and args[0] == 'x'", True), ("process where nothing == 1", False), ("process where pid == 'a'", False), ("nothing where true", False), ("file where name == 1", True),
    ("any where path == 'a'", True), ("process where pid + name == 1", False), ("process where arraySearch(args, a, a == 1)", False), ("process where length(pid) == 1", False),
    ("process where true | count name | filter count > 1", True), ("process where true | count name | filter pid > 1", False), ("sequence by name [process where true] [process where true] | filter events[1].pid == 1", True),
])
def test_schema(text, good):
    if good:
        compile(text, Options(schema=SCHEMA))
    else:
        with pytest.raises(QueryError):
            compile(text, Options(schema=SCHEMA))


def test_enum_and_strict():
    rule = compile("process where name.bash", Options(schema=SCHEMA, allow_enum=True))
    assert rule.query.stages[0].where == Compare("==", Field("name"), Literal("bash"))
    with pytest.raises(QueryError):
        compile("process where name", Options(schema=SCHEMA, strict_booleans=True))
    with pytest.raises(QueryError):
        compile("process where name == null", Options(schema=SCHEMA, non_nullable=True))


def test_schema_tools():
    other = EventSchema({"file": {"size": "number"}, "network": {"ip": "string"}})
    merged = SCHEMA.merge(other)
    assert merged.types["file"] == {"name": "number", "path": "string", "size": "number"}
    assert merged.flatten().types["generic"]["name"] == "string"
    assert merged.lookup("any", "name") == "string" and merged.lookup("any", "ip") == "string" and merged.lookup("any", "zzz") is None
    assert merged.struct("process").simpleString() == "struct<name:string,pid:double,args:array<string>,user:struct<id:double>>"
