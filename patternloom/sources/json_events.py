"""JSON events: readers for lines and arrays, and the sink that writes every event of every match on a line.

Columns are typed by Spark's inference or by a given schema; integers are long and other numbers double. A file's
order isn't kept by Spark, so readers add `_line` where it can be known: the position in the file for arrays and
lines read by read_numbered, which needs one pass per file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def detect(path: str, given: str | None = None) -> str:
    """json (an array or one object) or jsonl."""
    if given not in (None, "json", "jsonl"):
        raise ValueError(f"unknown format {given!r}")
    return given or ("json" if path.lower().endswith(".json") else "jsonl")


def read_json(spark: SparkSession, path: str, format: str | None = None, schema: T.StructType | None = None) -> DataFrame:  # noqa: A002
    """Events of files in either format; blank lines are skipped. Splittable for lines."""
    reader = spark.read.option("multiLine", detect(path, format) == "json").option("mode", "FAILFAST")
    if schema is not None:
        reader = reader.schema(schema)
    return reader.json(path)


def read_numbered(spark: SparkSession, path: str, format: str | None = None, schema: T.StructType | None = None, number: str = "_line") -> DataFrame:
    """Events with their place in the file order as a column: text lines keep their order inside a file and its splits."""
    if detect(path, format) == "json":
        df = read_json(spark, path, format, schema)
        return df.withColumn(number, F.monotonically_increasing_id())
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias(number), "value").where(F.trim("value") != "")
    if schema is None:
        schema = read_json(spark, path, format).schema
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("event"), number).select("event.*", number)


def to_lines(df: DataFrame) -> DataFrame:
    """Rows as JSON text, absent fields left out."""
    return df.select(F.to_json(F.struct("*")).alias("value"))


def write_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    to_lines(df).write.mode(mode).text(path)
