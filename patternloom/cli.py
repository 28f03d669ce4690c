"""Command line: `python -m patternloom query [-f FILE] [--format json|jsonl] QUERY` prints matched events as JSON lines.

A bare expression means `any where …`, a bare pipe `any where true | …`. Without -f, lines are read from the input. Queries that
are none, files that can't be read and errors while events are evaluated end with a message and status 1. `--master`
names where Spark runs."""

from __future__ import annotations

import argparse
import sys
import tempfile

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from .api import EventBinding, Options, compile
from .errors import QueryError
from .sources.json_events import read_numbered, to_lines


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="patternloom")
    commands = parser.add_subparsers(dest="command", required=True)
    query = commands.add_parser("query")
    query.add_argument("-f", "--file")
    query.add_argument("--format", choices=["json", "jsonl"])
    query.add_argument("--case-sensitive", action="store_true")
    query.add_argument("--master", default="local[*]")
    query.add_argument("query")
    given = parser.parse_args(argv)
    try:
        rule = compile(given.query, Options(implied_any=True, implied_base=True, case_sensitive=given.case_sensitive))
    except QueryError as bad:
        print(bad, file=sys.stderr)
        return 1
    spark = SparkSession.builder.master(given.master).config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    with tempfile.NamedTemporaryFile("w", suffix=".jsonl") as piped:  # only for events that come by the input
        if not given.file:
            piped.write(sys.stdin.read())
            piped.flush()
        try:
            events = read_numbered(spark, given.file or piped.name, given.format or (None if given.file else "jsonl"))
            df = rule.frame(events, EventBinding(order_cols=("_line",))).orderBy("ord")
            rows = df.selectExpr("ord", "posexplode(events) as (pos, event)").orderBy("ord", "pos") if rule.groups else df
            for row in to_lines(rows.select("event.*").drop("_line")).toLocalIterator():
                print(row["value"])
        except (PySparkException, QueryError) as bad:
            print(str(bad).split("\n", 1)[0], file=sys.stderr)
            return 1
    return 0
