"""Command lines: ``parse`` runs a parser program over raw logs, ``query`` searches events, one query or one after the other."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence
from pathlib import Path
from typing import Any, TextIO

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from tracelight.errors import CompileError, ExecutionError, SyntaxProblem
from tracelight.operators.logs.run import run_program
from tracelight.operators.search import compile_query, search_response
from tracelight.plans.program import parse_program
from tracelight.plans.query import parse
from tracelight.session import session
from tracelight.sources.events import EVENTS, list_values, load_events, load_reference_list

HELP = """Type a query and end it with an empty line.
.load PATH                events from a file
.ref LIST COLUMN V1,V2    a reference list's column
.sql                      show plans, or stop showing them
.help  .exit  .quit"""


def read_text(path: str) -> str:
    return sys.stdin.read() if path == "-" else Path(path).read_text(encoding="utf-8")


def raw_logs(text: str) -> list[Any]:
    """JSON (a list, an object with a list under ``logs``, or one message), else a message a line."""
    if text.lstrip()[:1] in ("[", "{"):
        data = json.loads(text)
        return data.get("logs", [data]) if isinstance(data, dict) else data
    return [line for line in text.splitlines() if line.strip()]


def parse_main(arguments: Sequence[str] | None = None) -> int:
    """Prints ``{"events": […]}``; 1 and a message where the program or a message fails."""
    options = argparse.ArgumentParser(prog="tracelight parse", description="Run a parser program over raw logs.")
    options.add_argument("-p", "--parser", required=True, help="the program's file, - for standard input")
    options.add_argument("logs", help="the logs' file, - for standard input")
    options.add_argument("--no-schema", action="store_true", help="neither check fields nor shape repeated ones")
    given = options.parse_args(arguments)
    try:
        program = parse_program(read_text(given.parser))
        events = run_program(program, raw_logs(read_text(given.logs)), False if given.no_schema else None)
    except (SyntaxProblem, CompileError, ExecutionError, ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    print(json.dumps({"events": events}))
    return 0


class Shell:
    """Queries one after the other. Results go to ``out``, all else to ``notes``."""

    def __init__(self, spark: SparkSession, out: TextIO, notes: TextIO, plans: bool = False):
        self.spark, self.out, self.notes, self.plans = spark, out, notes, plans

    def note(self, text: str) -> None:
        print(text, file=self.notes, flush=True)

    def load(self, path: str) -> None:
        self.note(f"loaded {load_events(self.spark, Path(path))} events from {path}")

    def query(self, text: str) -> bool:
        try:
            if self.plans:
                found = compile_query(parse(text), self.spark.table(EVENTS), lists=lambda n, c: list_values(self.spark, n, c))
                self.note(found._jdf.queryExecution().toString())
            print(json.dumps(search_response(text, self.spark), default=str), file=self.out, flush=True)
        except (SyntaxProblem, CompileError, PySparkException, ValueError) as e:
            self.note(f"error: {e}")
            return False
        return True

    def command(self, line: str) -> bool:
        """Does what a line with a point in front says; false when the shell is to end."""
        word, _, rest = line.partition(" ")
        if word in (".exit", ".quit"):
            return False
        if word == ".help":
            self.note(HELP)
        elif word == ".sql":
            self.plans = not self.plans
            self.note(f"plans are {'shown' if self.plans else 'not shown'}")
        elif word == ".load":
            try:
                self.load(rest.strip())
            except (ValueError, OSError) as e:
                self.note(f"error: {e}")
        elif word == ".ref":
            parts = rest.split()
            if len(parts) != 3:
                self.note("usage: .ref LIST COLUMN V1,V2")
            else:
                values = parts[2].split(",")
                load_reference_list(self.spark, parts[0], parts[1], values)
                self.note(f"loaded {parts[0]}.{parts[1]} ({len(values)} values)")
        else:
            self.note(f"unknown command {word}")
        return True

    def run(self, lines: TextIO) -> None:
        self.note(HELP)
        held: list[str] = []
        for line in lines:
            line = line.rstrip("\n")
            if not held and line.strip().startswith("."):
                if not self.command(line.strip()):
                    return
            elif line.strip():
                held.append(line)
            elif held:
                self.query("\n".join(held))
                held = []
        if held:
            self.query("\n".join(held))


def query_main(arguments: Sequence[str] | None = None, spark: SparkSession | None = None, lines: TextIO | None = None) -> int:
    """One query (``-q``, or all of a piped input), or a shell."""
    options = argparse.ArgumentParser(prog="tracelight query", description="Search events.")
    options.add_argument("-e", "--events", help="a JSON file of events")
    options.add_argument("-q", "--query", help="run this query and end")
    options.add_argument("--sql", action="store_true", help="show plans")
    given = options.parse_args(arguments)
    lines = lines or sys.stdin
    shell = Shell(spark or session(), sys.stdout, sys.stderr, given.sql)
    try:
        if given.events:
            shell.load(given.events)
        else:
            load_events(shell.spark, [])
            shell.note("no events; .load brings some")
    except (ValueError, OSError) as e:
        shell.note(f"error: {e}")
        return 1
    if given.query is not None:
        return 0 if shell.query(given.query) else 1
    if not lines.isatty():
        text = lines.read().strip()
        return 0 if not text or shell.query(text) else 1
    shell.run(lines)
    return 0


def main(arguments: Sequence[str] | None = None) -> int:
    given = list(sys.argv[1:] if arguments is None else arguments)
    commands = {"parse": parse_main, "query": query_main}
    if not given or given[0] not in commands:
        print(f"usage: tracelight {{{','.join(commands)}}} …", file=sys.stderr)
        return 2
    return commands[given[0]](given[1:])


if __name__ == "__main__":
    raise SystemExit(main())
