"""Streams give what the same rows give at rest."""

from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracelight.errors import CompileError
from tracelight.operators.logs.run import parse_logs
from tracelight.operators.search import search
from tracelight.sources.events import event_relation
from tracelight.streaming.streams import stream_rule, suppress

RULE = """rule s { events: $e.metadata.log_type = "x" $u = $e.principal.user.userid match: $u over 10m
  outcome: $n = count($e.metadata.id), $m = max($e.target.port) condition: #e >= 2 and not $m > 90 }"""


def rows():
    times = pd.date_range("2026-01-01", periods=60, freq="47s")
    return [
        (f'{{"metadata":{{"id":"{i}","log_type":"{"x" if i % 5 else "y"}","event_timestamp":"{t.isoformat()}Z"}},"principal":{{"user":{{"userid":"u{i % 3}"}}}},"target":{{"port":{i}}}}}',)
        for i, t in enumerate(times)
    ]


def drained(spark, stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


@pytest.fixture
def source(spark, tmp_path):
    path = str(tmp_path / "in")
    late = '{"metadata":{"log_type":"x","event_timestamp":"2026-01-02T00:00:00Z"}}'
    spark.createDataFrame([*rows(), (late,)], "event string").repartition(1).write.parquet(path)
    return path


def test_rules_by_window(spark, source):
    events = event_relation(spark.readStream.schema("event string").parquet(source))
    found = sorted(tuple(r) for r in drained(spark, stream_rule(RULE, events), "rules").collect())
    rest = spark.createDataFrame(rows(), "event string").select(
        F.get_json_object("event", "$.metadata.log_type").alias("l"), F.get_json_object("event", "$.principal.user.userid").alias("u"),
        F.get_json_object("event", "$.target.port").cast("long").alias("p"), F.to_timestamp(F.get_json_object("event", "$.metadata.event_timestamp")).alias("t"),
    )
    there = rest.where("l = 'x'").groupBy(F.window("t", "10 minutes").alias("w"), "u").agg(F.count("*").alias("n"), F.max("p").alias("m")).where("n >= 2 AND m <= 90")
    assert found == sorted(tuple(r) for r in there.select("w.start", "u", "n", "m").collect()) and found


def test_programs_and_searches_run_on_streams(spark, source):
    logs = spark.readStream.schema("event string").parquet(source).select(F.col("event").alias("message"))
    program = 'filter { json { } mutate { rename => { "target" => "event.idm.read_only_udm.target" } merge => { "@output" => "event" } on_error => "none" } }'
    events = parse_logs(program, logs)
    found = drained(spark, search("target.port >= 55", spark, events=events), "searched")
    assert found.count() == 5


def test_suppression(spark, tmp_path):
    at = [0, 60, 120, 400, 420, 1000]
    frame = spark.createDataFrame([(datetime(2026, 1, 1) + timedelta(seconds=s), "a", s) for s in at], "window_start timestamp, u string, n long")
    frame.repartition(1).write.parquet(str(tmp_path / "d"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "d")).withWatermark("window_start", "1 minute")
    assert sorted(r.n for r in drained(spark, suppress(stream, ["u"], 300), "suppressed").collect()) == [0, 400, 1000]


@pytest.mark.parametrize(
    "text",
    [
        'rule x { events: $a.metadata.id = "1" $u = $a.metadata.id $b.metadata.id = $u match: $u over 1h condition: $a }',
        'rule x { events: $a.metadata.id = "1" condition: $a }',
        'rule x { events: $a.metadata.id = "1" match: $a.metadata.id over 1h outcome: $n = array($a.metadata.id) condition: $a }',
        'rule x { events: $a.metadata.id = "1" match: $a.metadata.id over 1h condition: $b }',
    ],
)
def test_what_streams_cant_do(spark, text):
    events = event_relation(spark.createDataFrame([("{}",)], "event string"))
    with pytest.raises(CompileError):
        stream_rule(text, events)
