"""Sequence, join, sample and relations against the naive state machine, on random streams."""

import random

import pytest
from naive import Stage, join, relation, sample, sequence
from pyspark.sql import functions as F

from patternloom.api import EventBinding, Options, compile

BINDING = EventBinding(type_col="type", time_col="ts", order_cols=("id",))
ES = Options(extended=True, allow_sample=True, allow_negation=True, allow_runs=True)
SECOND = 10_000_000


@pytest.fixture(scope="module")
def stream():
    rng = random.Random(5)
    ts, out = 0, []
    for i in range(3000):
        ts += rng.randrange(3) * SECOND
        out.append({"id": i, "ts": ts, "type": rng.choice("abcd"), "u": rng.choice([None, *range(25)]), "w": rng.randrange(8), "v": rng.randrange(10), "name": rng.choice(["Ann", "ann", "Bo", None])})
    return out


@pytest.fixture(scope="module")
def frame(spark, stream):
    return spark.createDataFrame(stream, "id long, ts long, type string, u long, w long, v long, name string").repartition(5).cache()


def ids(text, frame, options=Options()):
    df = compile(text, options).frame(frame, BINDING)
    return sorted((r.o, list(r.x)) for r in df.select(F.col("ord.o0").alias("o"), F.transform("events", lambda e: e.getField("id")).alias("x")).collect())


u, w = (lambda e: (e["u"],)), (lambda e: (e["w"],))

SEQUENCES = [
    ("sequence [a where true] [b where true]", [Stage("a"), Stage("b")], {}),
    ("sequence by u [a where v > 2] [b where true]", [Stage("a", lambda e: e["v"] > 2, u), Stage("b", key=u)], {}),
    ("sequence by u [a where true] [a where true] [b where true]", [Stage("a", key=u), Stage("a", key=u), Stage("b", key=u)], {}),
    ("sequence by u with maxspan=20s [a where true] [b where true] [any where v == 3]", [Stage("a", key=u), Stage("b", key=u), Stage("any", lambda e: e["v"] == 3, u)], {"maxspan": 20 * SECOND}),
    ("sequence by u [a where true] [b where true] fork [c where true] fork", [Stage("a", key=u), Stage("b", key=u, fork=True), Stage("c", key=u, fork=True)], {}),
    ("sequence by u [a where true] [b where true] until [c where v < 5]", [Stage("a", key=u), Stage("b", key=u)], {"until": Stage("c", lambda e: e["v"] < 5, u)}),
    ("sequence [a where true] by u [b where true] by w [any where v > 5] by u", [Stage("a", key=u), Stage("b", key=w), Stage("any", lambda e: e["v"] > 5, u)], {}),
    ("sequence [a where true] by u [b where true] by w until [d where v > 6] by w", [Stage("a", key=u), Stage("b", key=w)], {"until": Stage("d", lambda e: e["v"] > 6, w)}),
    ("sequence by name [a where true] [b where true]", [Stage("a", key=lambda e: e["name"] and e["name"].lower()), Stage("b", key=lambda e: e["name"] and e["name"].lower())], {}),
]


@pytest.mark.parametrize("text,stages,extra", SEQUENCES, ids=[s[0][:60] for s in SEQUENCES])
def test_sequence(frame, stream, text, stages, extra):
    assert ids(text, frame) == sequence(stream, stages, **extra)


@pytest.mark.parametrize("text,stages,span", [
    ("sequence by u with maxspan=40s [a where true] ![c where v > 3] [b where true]", [Stage("a", key=u), Stage("c", lambda e: e["v"] > 3, u, negative=True), Stage("b", key=u)], 40),
    ("sequence by u with maxspan=40s ![a where v > 3] [b where true]", [Stage("a", lambda e: e["v"] > 3, u, negative=True), Stage("b", key=u)], 40),
    ("sequence by u with maxspan=60s [a where true] [b where true] with runs=2", [Stage("a", key=u), Stage("b", key=u), Stage("b", key=u)], 60),
])
def test_gated_sequence(frame, stream, text, stages, span):
    assert ids(text, frame, ES) == sequence(stream, stages, maxspan=span * SECOND)


@pytest.mark.parametrize("text,stages,until", [
    ("join by u [a where true] [b where true] [any where v > 4]", [Stage("a", key=u), Stage("b", key=u), Stage("any", lambda e: e["v"] > 4, u)], None),
    ("join [a where true] by u [b where true] by w until [c where true] by w", [Stage("a", key=u), Stage("b", key=w)], Stage("c", key=w)),
    ("join [a where v == 1] [any where v == 1]", [Stage("a", lambda e: e["v"] == 1), Stage("any", lambda e: e["v"] == 1)], None),
])
def test_join(frame, stream, text, stages, until):
    assert ids(text, frame) == join(stream, stages, until)


@pytest.mark.parametrize("text,stages", [
    ("sample by u [a where true] [any where v > 2]", [Stage("a", key=u), Stage("any", lambda e: e["v"] > 2, u)]),
    ("sample [a where true] by u [b where true] by w [c where true] by u", [Stage("a", key=u), Stage("b", key=w), Stage("c", key=u)]),
])
def test_sample(frame, stream, text, stages):
    assert ids(text, frame, ES) == sample(stream, stages)


def test_one_stage_never_matches(frame):
    assert ids('sequence [a where true]', frame, ES) == []


def test_sequence_plan_has_one_exchange(frame):
    df = compile("sequence by u with maxspan=1h [a where true] [b where true] [c where true]").frame(frame, BINDING)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


@pytest.fixture(scope="module")
def processes():
    rng = random.Random(9)
    out = []
    for i in range(4000):
        type_ = rng.choice(["process", "process", "file"])
        sub = rng.choice(["create", "fork", "terminate", None]) if type_ == "process" else None
        out.append({"id": i, "host": rng.choice("xyz"), "type": type_, "subtype": sub, "pid": rng.randrange(12), "ppid": rng.randrange(12), "v": rng.randrange(12), "name": rng.choice(["System", "cmd"])})
    return out


@pytest.mark.parametrize("kind", ["event", "child", "descendant"])
def test_relation(spark, processes, kind):
    df = spark.createDataFrame(processes, "id long, host string, type string, subtype string, pid long, ppid long, v long, name string").withColumnRenamed("name", "process_name")
    binding = EventBinding(type_col="type", order_cols=("id",), scope_cols=("host",))
    got = compile(f"any where {kind} of [process where v == 0]").run(df, binding).select("id").collect()
    want = [i for h in "xyz" for i in relation([e for e in processes if e["host"] == h], kind, lambda e: e["type"] == "process" and e["v"] == 0)]
    assert sorted(r.id for r in got) == sorted(want)


def test_nested_relation(spark, processes):
    df = spark.createDataFrame(processes, "id long, host string, type string, subtype string, pid long, ppid long, v long, name string").withColumnRenamed("name", "process_name")
    got = compile("any where child of [process where event of [file where v == 1]]").run(df, EventBinding(type_col="type", order_cols=("id",))).select("id").collect()
    inner = set(relation(processes, "event", lambda e: e["type"] == "file" and e["v"] == 1))
    want = relation(processes, "child", lambda e: e["type"] == "process" and e["id"] in inner)
    assert sorted(r.id for r in got) == sorted(want)


@pytest.mark.parametrize("kind", ["event", "child"])
def test_relation_stays_in_the_jvm(spark, processes, kind):
    df = spark.createDataFrame(processes, "id long, host string, type string, subtype string, pid long, ppid long, v long, name string").withColumnRenamed("name", "process_name")
    out = compile(f"any where {kind} of [process where v == 0]").run(df, EventBinding(type_col="type", order_cols=("id",), scope_cols=("host",)))
    assert "Arrow" not in out._jdf.queryExecution().executedPlan().toString()


def most_read(spark, run):
    """The largest share of a stage's shuffled rows that one task reads while run() runs, over stages that read 2,000 rows or more."""
    sc = spark.sparkContext
    store, none = sc._jsc.sc().statusStore(), sc._gateway.new_array(spark._jvm.double, 0)
    stages = lambda: [store.stageList(None, False, False, none, None).apply(i) for i in range(store.stageList(None, False, False, none, None).size())]
    before, changed, shares = {s.stageId() for s in stages()}, {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false"}, []
    old = {k: spark.conf.get(k) for k in changed}
    try:
        for k, v in changed.items():
            spark.conf.set(k, v)
        run()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    for stage in (s for s in stages() if s.stageId() not in before and s.shuffleReadRecords() >= 2000):
        tasks = store.taskList(stage.stageId(), stage.attemptId(), 1000)
        shares.append(max(tasks.apply(i).taskMetrics().get().shuffleReadMetrics().recordsRead() for i in range(tasks.size())) / stage.shuffleReadRecords())
    assert shares
    return max(shares)


@pytest.mark.parametrize("text,lifecycle", [
    pytest.param("any where child of [process where event of [file where v < 6]]", "subtype", id="relation_nested"),
    pytest.param("any where child of [process where v < 6]", "opcode", id="relation_by_opcode"),
    pytest.param("any where child of [process where v < 6]", "subtype", id="relation_child_of"),
    pytest.param("any where child of [process where v < 9] and pid != 4", "subtype", id="relation_reset"),  # some starts are those of System
    pytest.param("file where event of [process where v < 6]", "subtype", id="relation_event_of"),
])
def test_scope_is_no_single_task(spark, processes, monkeypatch, text, lifecycle):
    """All events are of one scope, with 50 ids; no task gets most of them."""
    monkeypatch.setattr("patternloom.operators.relations.SAMPLE", 200, raising=False)  # one task reads this bounded number
    rows = [{**e, "pid": e["id"] * 7919 % 50 + 4, "ppid": e["id"] * 104729 % 50 + 4, "opcode": {"create": 1, "fork": 3, "terminate": 2}.get(e["subtype"])} for e in processes]
    df = spark.createDataFrame(rows, "id long, host string, type string, subtype string, opcode long, pid long, ppid long, v long, name string").withColumnRenamed("name", "process_name")
    out = compile(text, Options(lifecycle=lifecycle)).run(df, EventBinding(type_col="type", order_cols=("id",)))
    assert most_read(spark, lambda: out.write.format("noop").mode("overwrite").save()) < 0.35


def test_relations_of_few_or_unordered_rows(spark, processes):
    """Fewer rows than cuts, none at all, and an order that is one number for all."""
    schema = "id long, host string, type string, subtype string, pid long, ppid long, v long, name string"
    for rows in (processes[:40], []):
        df = spark.createDataFrame(rows, schema).withColumnRenamed("name", "process_name")
        got = compile("any where child of [process where v < 9]").run(df, EventBinding(type_col="type", order_cols=("id",))).select("id").collect()
        assert sorted(r.id for r in got) == relation(rows, "child", lambda e: e["type"] == "process" and e["v"] < 9)
    df = spark.createDataFrame([e for e in processes if e["type"] == "process"][:1], schema)
    assert compile("any where event of [process where true]").run(df, EventBinding(type_col="type")).count() == 1


def test_fractional_times(spark):
    """Fractions of a unit count: 0.9 s lie between 1.5 and 2.4, more between 1.0 and 2.4."""
    df = spark.createDataFrame([(1, "a", 1.0, 1), (2, "a", 1.5, 2), (3, "b", 2.4, 1), (4, "b", 2.4, 2)], "id long, type string, t double, u long")
    binding = EventBinding(type_col="type", time_col="t", time_unit="s", order_cols=("t", "id"))
    got = compile("sequence by u with maxspan=1s [a where true] [b where true]").frame(df, binding).select(F.transform("events", lambda e: e.getField("id")).alias("x")).collect()
    assert [list(r.x) for r in got] == [[2, 4]]
    text = df.withColumn("t", F.col("t").cast("string"))
    assert compile("sequence by u with maxspan=1s [a where true] [b where true]").frame(text, binding).count() == 1
