"""Expressions on rows: values, three-valued logic, errors."""

import pytest
from pyspark.sql import functions as F

from patternloom.api import Engine, EventBinding, Options, compile, expression, matches
from patternloom.plans.schemas import learn
from patternloom.sources.binding import normalised
from patternloom.sources.json_events import detect, read_json, read_numbered, write_lines

BINDING = EventBinding(type_col="type", order_cols=("i",))


@pytest.fixture(scope="module")
def row(spark):
    schema = "i long, type string, s string, n long, z long, f double, b boolean, none string, xs array<string>, os array<struct<a:long,c:array<struct<d:string>>>>, o struct<v:long,w:string>, ip string"
    return spark.createDataFrame([(1, "t", "Hello World", 10, 0, 2.5, True, None, ["a", "B", None], [(1, [("q",)]), (2, [])], (7, "W"), "10.1.2.3")], schema)


CASES = {
    "s == 'hello world'": True, "s != 'x'": True, "none == 'x'": None, "n == 10.0": True, "n == '10'": None, "b == 1": None, "s < 'i'": True, "missing == 1": None, "missing == null": True,
    "n / 3": 3, "-n / 3": -4, "n % -3": -2, "n / z": None, "n / 4.0": 2.5, "n + f": 12.5, "9223372036854775807 + n": None, "s + 1": None, "f * 2": 5.0,
    "n in (1, 10, null)": True, "n in (1, null)": False, "none in ('a')": None, "s in ('HELLO WORLD')": True, "not none == 'x'": None, "none == 'x' and n == 1": False, "none == 'x' or n == 10": True,
    "length(s)": 11, "length(xs)": 3, "length(o)": 2, "length(n)": None, "wildcard(s, 'h*d')": True, "wildcard(s, 'h_llo*')": False, "startsWith(s, 'HELL')": True, "endsWith(s, 'LD')": True, "stringContains(s, 'O W')": True,
    "stringContains(n, 'a')": False, "match(s, 'hel+o')": True, "match(s, 'world')": False, "match(s, '(?P<a_b>l)', 'h')": True, "string(n)": "10", "string(f)": "2.5", "string(b)": "true", "string(1e10)": "10000000000.0", "string(xs)": "['a', 'B', None]",
    "number('12')": 12, "number('1.5')": 1.5, "number('0x1f')": 31, "number('abc')": None, "number('101', 2)": 5, "number('-7')": -7, "concat(s, '-', n)": "Hello World-10", "concat(s, none)": None,
    "add(n, 1)": 11, "subtract(n, 1)": 9, "multiply(n, 2)": 20, "divide(n, 4)": 2, "modulo(n, 4)": 2,
    "arrayContains(xs, 'b')": True, "arrayContains(xs, 'z', null)": True, "arrayContains(xs, 'z')": False, "arrayContains(s, 'h')": True, "arrayContains(o, 'w')": True,
    "arraySearch(os, e, e.a == 2)": True, "arraySearch(os, e, arraySearch(e.c, g, g.d == 'Q'))": True, "arraySearch(s, e, true)": False, "arrayCount(os, e, e.a > 0)": 2, "arrayCount(none, e, true)": 0,
    "safe(n % z)": None, "safe(n % 3)": 1, "indexOf(s, 'o')": 4, "indexOf(s, 'O', 5)": 7, "indexOf(s, 'x')": None, "indexOf(s, 'l', -2)": 9, "indexOf(s, '')": 0,
    "substring(s, 1, 4)": "ell", "substring(s, -5)": "World", "substring(s, 4, 2)": "", "substring(s, 0, -6)": "Hello", "substring(s, 0, 99)": "Hello World",
    "between(s, 'h', ' ')": "ello", "between(s, 'l', 'l')": "", "between(s, 'l', 'l', true)": "lo Wor", "between(s, 'x', 'l')": None, "between(s, 'd', 'x')": None,
    "cidrMatch(ip, '10.0.0.0/8')": True, "cidrMatch(ip, '11.0.0.0/8')": False, "cidrMatch(n, '10.0.0.0/8')": False, "cidrMatch(ip, '2001:db8::/32', '10.1.2.0/24')": True, "cidrMatch('2001:db8::1', '2001:db8::/32')": True,
    "os[0].a": 1, "os[9].a": None, "o.v": 7, "o.zzz": None, "o.w.W": True, "o.w.w": False, "xs[1]": "B", "s:length() == 11": True, "n and s": True,
}


def test_values(row):
    texts = list(CASES)
    got = {}
    for at in range(0, len(texts), 20):
        part = texts[at : at + 20]
        df = row
        cols = []
        for k, text in enumerate(part):
            value = expression(text, row, binding=BINDING)
            cols.append(value.select(F.to_json(F.struct("value"), {"ignoreNullFields": "false"}).alias("j"), F.lit(text).alias("t")))
        del df
        union = cols[0]
        for c in cols[1:]:
            union = union.unionByName(c)
        import json

        got.update({r.t: json.loads(r.j).get("value") for r in union.collect()})
    wrong = {t: (got[t], want) for t, want in CASES.items() if got[t] != want or isinstance(got[t], bool) != isinstance(want, bool)}
    assert not wrong


@pytest.mark.parametrize("text", ["n % z == 1", "cidrMatch(s, '10.0.0.0/8')", "indexOf(s, '', 99) == 1", "arrayContains(n, 1)", "number('9', 2) == 1"])
def test_errors_raise(row, text):
    with pytest.raises(Exception):
        compile(f"any where {text}").run(row, BINDING).collect()


def test_errors_behind_a_decision_do_not_count(row):
    assert compile("any where n == 1 and n % z == 1").run(row, BINDING).count() == 0
    assert compile("any where n == 10 or n % z == 1").run(row, BINDING).count() == 1
    assert compile("other where n % z == 1").run(row, BINDING).count() == 0
    assert compile("any where safe(n % z) == null").run(row, BINDING).count() == 1


def test_case_sensitive(row):
    exact = Options(case_sensitive=True)
    assert compile("any where s == 'hello world'", exact).run(row, BINDING).count() == 0
    assert compile("any where s == 'Hello*'", exact).run(row, BINDING).count() == 1
    assert compile("any where match(s, 'hello')", exact).run(row, BINDING).count() == 0


def test_empty_table_and_matches(row):
    empty = row.where("false")
    assert compile("any where true | count").run(empty, BINDING).collect()[0]["count"] == 0
    assert compile("sequence by n [t where true] [t where true]").run(empty, BINDING).count() == 0
    assert [r.matched for r in matches("t where n > 5", row, binding=BINDING).collect()] == [True]


def test_pushdown(spark, row, tmp_path):
    row.drop("os", "xs", "o").write.parquet(str(tmp_path / "p"))
    df = compile("t where n > 5").run(spark.read.parquet(str(tmp_path / "p")), BINDING).select("s")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(n,5)" in plan and "EqualTo(type,t)" in plan
    assert "ReadSchema: struct<type:string,s:string,n:bigint>" in plan


def test_types_and_normaliser(spark):
    df = spark.createDataFrame([("process", None, 1), (None, "file_event", 2), (None, None, 3)], "event_type string, event_type_full string, timestamp long")
    counts = {t: compile(f"{t} where true").run(df).count() for t in ("process", "file", "generic", "any")}
    assert counts == {"process": 1, "file": 1, "generic": 1, "any": 3}
    buffered = spark.createDataFrame([(1, (5, "network")), (2, None)], "pid long, data_buffer struct<pid:long,event_type:string>")
    assert {(r.pid, r.event_type) for r in normalised(buffered).collect()} == {(5, "network"), (2, None)}


def test_json_in_and_out(spark, tmp_path):
    lines = tmp_path / "e.jsonl"
    lines.write_text('{"event_type":"a","n":1}\n\n{"event_type":"b","n":2.5,"o":{"p":[1]}}\n')
    array = tmp_path / "e.json"
    array.write_text('[{"event_type":"a","n":1},\n {"event_type":"b","n":2.5}]')
    assert (detect("x.json"), detect("x.log"), detect("x.json", "jsonl")) == ("json", "jsonl", "jsonl")
    assert read_json(spark, str(array)).count() == 2
    df = read_numbered(spark, str(lines))
    rule = compile("any where true | tail 1")
    out = rule.run(df, EventBinding(order_cols=("_line",))).drop("_line")
    write_lines(out, str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ['{"event_type":"b","n":2.5,"o":{"p":[1]}}']
    assert learn(df, EventBinding()).types["a"] == {"event_type": "string", "n": "number", "_line": "number"}


def test_engine_tags_rules(row):
    got = Engine([compile("t where n == 10", name="one"), compile("any where true | count s", name="two")], BINDING).run(row).collect()
    assert sorted((r.rule_id, r.s, r["count"]) for r in got) == [("one", "Hello World", None), ("two", None, 1)]
