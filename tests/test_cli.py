"""The command line and the JSON sources."""

import io
import json

import pytest

from patternloom.cli import main
from patternloom.sources.json_events import detect, read_json, read_numbered, write_lines

EVENTS = [{"event_type": "process", "timestamp": i, "name": f"cmd{i}", "pid": i % 3, "text": "1" if i else "x."} for i in range(6)] + [{"event_type": "file", "timestamp": 9, "name": "CMD1", "pid": 1}]


@pytest.fixture
def lines(tmp_path):
    path = tmp_path / "e.jsonl"
    path.write_text("\n\n".join(map(json.dumps, EVENTS)) + "\n")
    return str(path)


def printed(capsys):
    return [json.loads(x) for x in capsys.readouterr().out.splitlines()]


def test_query(spark, lines, tmp_path, capsys):
    assert main(["query", "-f", lines, 'process where name == "CMD*" and pid == 1']) == 0
    assert printed(capsys) == [EVENTS[1], EVENTS[4]]
    assert main(["query", "-f", lines, "--case-sensitive", 'name == "CMD1"']) == 0
    assert printed(capsys) == [EVENTS[6]]
    array = tmp_path / "e.json"
    array.write_text(json.dumps(EVENTS))
    assert main(["query", "-f", str(array), "sequence by pid [process where true] [file where true]"]) == 0
    assert printed(capsys) == [EVENTS[4], EVENTS[6]]


def test_input(spark, lines, monkeypatch, capsys):
    with open(lines) as file:
        monkeypatch.setattr("sys.stdin", io.StringIO(file.read()))
    assert main(["query", "| count"]) == 0
    assert printed(capsys)[0]["count"] == len(EVENTS)


def test_errors(spark, lines, capsys):
    for query, file in (("process where", lines), ("process where true", lines + ".none"), ("process where number(text) == 1", lines)):
        assert main(["query", "-f", file, query]) == 1
        out = capsys.readouterr()
        assert out.err and not out.out


def test_round_trip(spark, lines, tmp_path):
    assert (detect("a.json"), detect("a.log"), detect("a.json", "jsonl")) == ("json", "jsonl", "jsonl")
    with pytest.raises(ValueError):
        detect("a", "xml")
    df = read_numbered(spark, lines)
    assert [r.name for r in df.orderBy("_line").collect()] == [e["name"] for e in EVENTS]
    write_lines(df.drop("_line"), str(tmp_path / "out"))
    again = read_json(spark, str(tmp_path / "out"), "jsonl")
    assert sorted(map(str, again.select("name", "pid").collect())) == sorted(map(str, df.select("name", "pid").collect()))
