"""Streams give what batches give on the same input."""

import pytest
from pyspark.sql import functions as F

from patternloom.api import EventBinding, Options, compile
from patternloom.errors import QueryError
from patternloom.streaming.forms import stream

BINDING = EventBinding(type_col="type", time_col="ts", order_cols=("ts",))
ES = Options(extended=True, allow_sample=True)


@pytest.fixture(scope="module")
def path(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("s") / "events")
    df = spark.range(600).select("id", F.timestamp_seconds(F.col("id") * 10 + 1_700_000_000).alias("ts"), F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.hash("id") % 3 + 3).cast("int") % 3 + 1).alias("type"), (F.abs(F.hash(F.col("id") + 7)) % 6).alias("u"))
    df.coalesce(1).write.parquet(out)
    return out


def run(spark, text, path, options=Options(), binding=BINDING, files=1000, watermark="0 seconds"):
    events = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files).parquet(path)
    name = f"t{abs(hash((text, path)))}"
    query = stream(compile(text, options), events, binding, watermark).writeStream.format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name)


@pytest.mark.parametrize("text,options", [
    ("sequence by u with maxspan=300s [a where true] [b where true] [c where true]", Options()), ("join by u [a where true] [b where true] until [c where u == 2]", Options()), ("sample by u [a where true] [b where true]", ES),
])
def test_groups(spark, path, text, options):
    got = run(spark, text, path, options).groupBy("key", "at").agg(F.array_sort(F.collect_list(F.struct("pos", F.get_json_object("event", "$.id").cast("long").alias("id")))).alias("x"))
    want = compile(text, options).frame(spark.read.parquet(path), BINDING).select(F.transform("events", lambda e: e.getField("id")).alias("x"))
    assert sorted([i.id for i in r.x] for r in got.collect()) == sorted(list(r.x) for r in want.collect())


@pytest.mark.parametrize("text", ["sequence by u with maxspan=300s [a where true] [b where true]", "join by u [a where true] [b where true]"])
def test_many_batches_with_ties(spark, path, tmp_path, text):
    """Times that tie, rows out of order inside the watermark's delay: matches are those of the batch form."""
    binding = EventBinding(type_col="type", time_col="ts", order_cols=("ts", "id"))
    tied = spark.read.parquet(path).withColumn("ts", F.expr("timestamp_seconds(unix_seconds(ts) div 50 * 50)")).cache()
    for n in range(4):  # the files overlap in time by one tie
        tied.where(f"id between {n * 150} and {n * 150 + 149}").orderBy(F.desc("id")).coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
    end = tied.limit(1).selectExpr("100000L AS id", "timestamp_seconds(2000000000) AS ts", "'a' AS type", "cast(-1 as int) AS u")
    end.coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
    got = run(spark, text, str(tmp_path / "e"), binding=binding, files=1, watermark="100 seconds")
    found = got.select(F.get_json_object("event", "$.id").cast("long").alias("id"))
    want = compile(text).frame(tied, binding).select(F.explode("events").alias("e")).select("e.id")
    assert sorted(r.id for r in found.collect()) == sorted(r.id for r in want.collect())


def test_events_and_unique(spark, path):
    batch = spark.read.parquet(path)
    assert run(spark, "a where u > 2", path).count() == batch.where("type = 'a' and u > 2").count()
    got = run(spark, "any where true | unique u, type", path)
    assert got.count() == batch.select("u", "type").distinct().count()


def test_refused(spark, path):
    events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    for text in ("a where true | head 1", "a where event of [a where true]", "any where true | count u", "sequence [a where true] by u [b where true] by id"):
        with pytest.raises(QueryError):
            stream(compile(text), events, BINDING)


def test_relations(spark, tmp_path):
    kind = F.when(F.hash("id") % 3 == 0, "file").otherwise("process")
    sub = F.element_at(F.array(F.lit("create"), F.lit("terminate"), F.lit("fork"), F.lit("other")), (F.abs(F.hash(F.col("id") + 1)) % 4 + 1).cast("int"))
    some = lambda salt, n: F.abs(F.hash(F.col("id") + salt)) % n
    df = spark.range(800).select(
        "id", F.timestamp_seconds(F.col("id") * 10 + 1_700_000_000).alias("ts"), kind.alias("type"), sub.alias("subtype"), some(2, 9).alias("pid"), some(3, 9).alias("ppid"),
        some(4, 10).alias("v"), some(5, 3).alias("host"), F.when(some(6, 4) == 0, "System").otherwise("x").alias("process_name"),
    )
    for n in range(3):
        df.where(f"id between {n * 300} and {n * 300 + 299}").coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
    spark.createDataFrame([(9999, 2_000_000_000)], "id long, s long").selectExpr("id", "timestamp_seconds(s) as ts", "'z' as type", "'' as subtype", "null as pid", "null as ppid", "0 as v", "id % 3 as host", "'' as process_name").select(*[F.col(c).cast(df.schema[c].dataType) for c in df.columns]).coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
    binding = EventBinding(type_col="type", time_col="ts", order_cols=("ts",), scope_cols=("host",))
    for text in ("any where descendant of [process where v == 0]", "process where v > 3 and not child of [process where event of [file where v < 3]] or event of [any where v == 9]"):
        got = run(spark, text, str(tmp_path / "e"), binding=binding, files=1)
        want = compile(text).run(df, binding).select("id").collect()
        assert sorted(r.id for r in got.select(F.get_json_object("event", "$.id").cast("long").alias("id")).collect() if r.id != 9999) == sorted(r.id for r in want)


def test_count(spark, path):
    events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    query = stream(compile("a where u > 2 | count"), events, BINDING).writeStream.format("memory").outputMode("complete").queryName("counted").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [r["count"] for r in spark.table("counted").collect()] == [spark.read.parquet(path).where("type = 'a' and u > 2").count()]
