"""The command lines, and the shell of queries."""

import io
import json

import pytest

from tracelight.cli import Shell, main, parse_main, query_main

PROGRAM = 'filter { json { on_error => "e" } mutate { replace => { "event.idm.read_only_udm.metadata.id" => "%{message}" } merge => { "@output" => "event" } } }'


@pytest.fixture
def files(tmp_path):
    (tmp_path / "p.conf").write_text(PROGRAM)
    (tmp_path / "lines").write_text("a\n\nb\n")
    (tmp_path / "list").write_text('{"logs": ["x", {"message": "y"}]}')
    (tmp_path / "one").write_text('{"message": "z"}')
    (tmp_path / "events").write_text(json.dumps([{"metadata": {"id": "1"}, "principal": {"ip": ["1.1.1.1"]}}, {"metadata": {"id": "2"}}]))
    return tmp_path


@pytest.mark.parametrize("name, ids", [("lines", ["a", "b"]), ("list", ["x", "y"]), ("one", ["z"])])
def test_parse(files, capsys, name, ids):
    assert main(["parse", "-p", str(files / "p.conf"), str(files / name)]) == 0
    assert [e["metadata"]["id"] for e in json.loads(capsys.readouterr().out)["events"]] == ids


def test_parse_problems(files, capsys):
    (files / "bad").write_text("filter {")
    assert parse_main(["-p", str(files / "bad"), str(files / "lines")]) == 1
    assert parse_main(["-p", str(files / "p.conf"), str(files / "nothing")]) == 1
    (files / "field").write_text('filter { mutate { replace => { "event.idm.read_only_udm.none" => "x" } } }')
    assert parse_main(["-p", str(files / "field"), str(files / "lines")]) == 1
    assert parse_main(["--no-schema", "-p", str(files / "field"), str(files / "lines")]) == 0
    assert "error" in capsys.readouterr().err
    assert main(["other"]) == 2


def test_query(spark, files, capsys):
    assert query_main(["-e", str(files / "events"), "-q", 'metadata.id = "2"'], spark) == 0
    assert len(json.loads(capsys.readouterr().out)["events"]) == 1
    assert query_main(["-q", "none = 1"], spark) == 1
    assert query_main(["-e", str(files / "events"), "--sql"], spark, io.StringIO("outcome: $n = count(metadata.id)")) == 0
    shown = capsys.readouterr()
    assert json.loads(shown.out) == {"results": [{"n": 2}]} and "Physical Plan" in shown.err
    assert query_main(["-e", str(files / "lines")], spark) == 1


def test_shell(spark, files):
    out, notes = io.StringIO(), io.StringIO()
    text = f""".load {files / "events"}
.ref bad ip 1.1.1.1,2.2.2.2
.ref bad
.sql
.sql
.help
.nothing
.load {files / "none"}
principal.ip
in %bad.ip

nothing = 1

outcome: $n = count(metadata.id)
"""
    Shell(spark, out, notes).run(io.StringIO(text))
    shown = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [len(shown[0]["events"]), shown[1]] == [1, {"results": [{"n": 2}]}]
    assert notes.getvalue().count("error") == 2 and "usage" in notes.getvalue()
    Shell(spark, out, notes).run(io.StringIO(".exit\nmetadata.id\n\n"))
    assert len(out.getvalue().splitlines()) == 2
