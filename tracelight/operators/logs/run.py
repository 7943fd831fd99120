"""Parser programs over DataFrames of raw messages, batch and streaming, and over plain lists."""

from __future__ import annotations

import json
from collections.abc import Iterable
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelight.errors import ExecutionError
from tracelight.functions.schema import Schema
from tracelight.operators.logs.compiler import Runner, now
from tracelight.plans.program import Program, parse_program
from tracelight.sources.events import event_relation


#: Messages whose events a worker holds at a time.
MESSAGES = 1024


def runner(program: Program | str, schema: Schema | bool | None, created: str | None) -> Runner:
    read = parse_program(program) if isinstance(program, str) else program
    used = Schema.builtin() if schema is None or schema is True else None if schema is False else schema
    return Runner(read, used, created or now())


def run_program(program: Program | str, messages: str | Iterable[Any], schema: Schema | bool | None = None, created: str | None = None) -> list[dict]:
    """The events of some messages, on the driver. A text alone is one message; ``schema=False`` skips checks and shaping."""
    made = runner(program, schema, created)
    return [e for m in ([messages] if isinstance(messages, str) else messages) for e in made.events(m)]


def parse_logs(
    program: Program | str,
    logs: DataFrame,
    schema: Schema | bool | None = None,
    created: str | None = None,
    failures: str = "raise",
    partitions: int | None = None,
) -> DataFrame:
    """An event relation of what a program makes of ``logs``, whose column ``message`` holds the messages.

    Its other columns become system variables of the same name, where they
    aren't null. A null message is empty. The program is checked here, on the driver,
    and run in Arrow batches on the executors; ``created`` is fixed here, too, so
    that a task that is run again makes the same events. A message that fails ends
    the query with ``failures="raise"``, gives nothing with ``"skip"``, and with ``"keep"`` gives a
    row whose column ``error`` says why (the column is null on events). Messages stay where
    they are read, unless ``partitions`` says how many parts they are dealt to first (few files keep most cores idle).
    """
    if failures not in ("raise", "skip", "keep"):
        raise ValueError("failures is raise, skip or keep")
    read = parse_program(program) if isinstance(program, str) else program
    made_at = created or now()
    runner(read, schema, made_at)
    ready: list[Runner] = []

    def batches(it):
        if not ready:
            ready.append(runner(read, schema, made_at))
        # messages become events a few at a time, so that a worker holds few of either
        for part in (batch.slice(at, MESSAGES) for batch in it for at in range(0, batch.num_rows, MESSAGES)):
            events, errors = [], []
            for row in part.to_pylist():
                given = {k: v for k, v in row.items() if v is not None}
                given.setdefault("message", "")
                try:
                    for e in ready[0].events(given):
                        events.append(json.dumps(e, default=str))
                        errors.append(None)
                except ExecutionError as e:
                    if failures == "raise":
                        raise
                    if failures == "keep":
                        events.append(None)
                        errors.append(str(e))
            yield pa.RecordBatch.from_arrays([pa.array(events, pa.string()), pa.array(errors, pa.string())], names=["event", "error"])

    if partitions is not None:
        logs = logs.repartition(partitions)
    found = logs.mapInArrow(batches, "event string, error string")
    if failures != "keep":
        return event_relation(found)
    return found.select(
        F.concat(F.lit("event-"), F.md5("event")).alias("name"), "event", F.parse_json("event").alias("v"), "error"
    )
