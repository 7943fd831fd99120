"""Searches over small documents: what each condition and section finds."""

import json

import pytest
from pyspark.sql import functions as F

from tracelight.errors import CompileError
from tracelight.functions.schema import Field, Schema
from tracelight.functions.values import Node
from tracelight.operators.search import search, search_response
from tracelight.sources.events import event_relation, load_events, load_reference_list, read_events, write_events
from tracelight.sources.responses import camel, camelized

EVENTS = [
    {
        "metadata": {"id": "1", "event_type": "NETWORK_CONNECTION", "event_timestamp": "2026-03-15T10:00:20.021Z", "ingestion_labels": [{"key": "team", "value": "sec"}, {"key": "env", "value": "prod"}, {"key": "team", "value": "late"}]},
        "principal": {"hostname": "web-01", "ip": ["10.0.0.5", "10.0.0.6"]},
        "target": {"hostname": "db", "port": 443},
        # a scalar where the schema says repeated
        "security_result": [{"action": "BLOCK", "description": "no"}, {"action": ["ALLOW", "FAIL"]}],
        "additional": {"pod_name": "p1", "we ird": "x", "it's \"q\"": "y"},
        "network": {"dns": {"response": True, "questions": [{"name": "a.example"}, {"name": "b.example"}]}},
    },
    {
        "metadata": {"id": "2", "event_type": "NETWORK_CONNECTION", "event_timestamp": "2026-03-15T12:00:00+02:00"},
        "principal": {"hostname": "WEB-01", "ip": ["10.0.0.7"]},
        "target": {"port": "443.7", "user": {"userid": "10.0.0.7"}},
        "security_result": [{"action": "ALLOW"}],
        "network": {"dns": {"response": False, "questions": []}},
    },
    {"metadata": {"id": "3", "event_type": "USER_LOGIN", "event_timestamp": None}, "principal": {"hostname": "", "ip": []}, "target": {"port": 8080}},
    {"metadata": {"id": "4"}, "principal": {"ip": "10.0.0.9"}},
]


@pytest.fixture(scope="module", autouse=True)
def events(spark):
    assert load_events(spark, {"events": EVENTS}) == 4
    load_reference_list(spark, "bad", "ip", ["10.0.0.9", "10.0.0.99"])
    load_reference_list(spark, "bad", "port", [443, 444])


def found(spark, text, **more):
    rows = search(text, spark, **more).select(F.get_json_object("event", "$.metadata.id").alias("i")).collect()
    return "".join(sorted(r.i for r in rows))


@pytest.mark.parametrize(
    "text, ids",
    [
        ('metadata.event_type = "NETWORK_CONNECTION"', "12"),
        ('not metadata.event_type = "NETWORK_CONNECTION"', "3"),  # a missing field is neither
        ('metadata.event_type != ""', "123"),
        ("target.port = 443", "1"),
        ("target.port = 444", "2"),  # text that is no integer is rounded
        ("target.port = 443.6", "2"),
        ("target.port >= 444", "23"),
        ("444 > $e.target.port", "1"),
        ("444 < target.port", "1234"),  # an unquoted word is a text
        ('principal.hostname = "web-01"', "1"),
        ('principal.hostname = "web-01" nocase', "12"),
        ("principal.hostname = /eb-0/", "1"),
        ("principal.hostname = /^web/ nocase", "12"),
        ("/^w/ = $e.principal.hostname", "1"),
        ("principal.hostname != /web/", "23"),
        ("principal.hostname", "12"),
        ("not principal.hostname", "34"),
        ('security_result.action = "BLOCK"', "1"),
        ('any security_result.action = "ALLOW"', "12"),
        ('security_result.action = "FAIL"', "1"),
        ('security_result[0].action = "ALLOW"', "2"),
        ('security_result[1].action = "ALLOW"', "1"),
        ('security_result.action[1] = "FAIL"', "1"),
        ('principal.ip = "10.0.0.6"', "1"),
        ('principal.ip != "10.0.0.6"', "124"),
        ('not principal.ip = "10.0.0.6"', "234"),
        ('principal.ip = "10.0.0.9"', "4"),
        ('principal.ip[0] = "10.0.0.7"', "2"),
        ("principal.ip != /10/", ""),
        ('network.dns.questions.name = "b.example"', "1"),
        ("network.dns.response = true", "1"),
        ("network.dns.response = false", "2"),
        ('additional["pod_name"] = "p1"', "1"),
        ('additional.fields["we ird"] = "x"', "1"),
        ('additional["it\'s \\"q\\""] = "y"', "1"),
        ('metadata.ingestion_labels["team"] = "sec"', "1"),
        ('metadata.ingestion_labels["team"] = "late"', ""),  # the first of equal keys
        ('metadata.ingestion_labels["none"] = "sec"', ""),
        ('metadata.ingestion_labels.key = "env"', "1"),
        ('ip = "10.0.0.7"', "2"),
        ('hostname = "db" or user = "10.0.0.7"', "12"),
        ("principal.ip in %bad.ip", "4"),
        ("not principal.ip in %bad.ip", "123"),
        ("target.port in %bad.port", "12"),
        ("principal.ip in %bad", ""),
        ("principal.ip in %none.ip", ""),
        ("target.user.userid = $e.principal.ip[0]", "2"),
        ('metadata.event_timestamp < "2026-03-15T11:00:00"', "1"),
        ('metadata.event_timestamp = "2026-03-15T12:00:00Z"', "2"),  # offsets are passed over
        ('$h = principal.hostname\n$h = "web-01"', "1"),
        ('(target.port = 443 or target.port = 8080) and not principal.hostname = "x"', "13"),
        ("", "1234"),
    ],
)
def test_conditions(spark, text, ids):
    assert found(spark, text) == ids


def test_parameters(spark):
    assert found(spark, "principal.hostname = ${h}", parameters={"h": "web-01"}) == "1"
    with pytest.raises(CompileError, match="template"):
        found(spark, "principal.hostname = ${h}")


@pytest.mark.parametrize(
    "text",
    [
        'principal.hostnam = "x"',
        'principal.hostname.more = "x"',
        'metadata.event_type = "NETWORK"',
        'metadata.event_type = "user_login" nocase',
        'security_result.action = "no"',
        "target.port = abc",
        '$x = "y"',
        'timestamp.now(target.port) = 3',
        "principal.hostname in 3",
        '"x" in %bad.ip',
        "/a/ = 3",
        "match: principal.ip",
        "match: ip",
        "match: $x",
        "outcome: $x = median(target.port)",
        "outcome: $x = count(target.port, target.port)",
        "outcome: $x = sum(principal.hostname)",
        "outcome: $x = if(target.port > 1, 1, 2)",
        "match: target.port outcome: $x = principal.hostname",
        "match: target.port order: principal.hostname",
    ],
)
def test_what_cant_be_compiled(spark, text):
    with pytest.raises(CompileError):
        search(text, spark)


def test_graph_fields_are_plain_paths_in_searches(spark):
    assert found(spark, 'graph.entity.hostname = "x"') == ""


def rows(spark, text):
    return [tuple(r) for r in search(text, spark).collect()]


def test_groups(spark):
    assert sorted(rows(spark, "match: metadata.event_type"), key=str) == [("NETWORK_CONNECTION",), ("USER_LOGIN",), (None,)]
    assert rows(spark, "match: metadata.event_type outcome: $n = count(target.port), $m = max(target.port) order: $m desc") == [
        ("USER_LOGIN", 1, 8080), ("NETWORK_CONNECTION", 2, 444), (None, 0, None),
    ]
    assert rows(spark, "$t = metadata.event_type\nmatch: $t outcome: $one = 1, $same = $t order: $t limit: 1") == [("NETWORK_CONNECTION", "1", "NETWORK_CONNECTION")]


def test_aggregates_without_groups(spark):
    assert rows(spark, "outcome: $n = count(target.port), $s = sum(target.port), $d = count_distinct(principal.hostname)") == [(3, 8967, 3)]
    assert rows(spark, 'metadata.id = "9"\noutcome: $n = count(target.port), $s = sum(target.port), $a = array(target.port)') == [(0, None, None)]


def test_arrays_keep_nulls(spark):
    [(a, d)] = rows(spark, "outcome: $a = array(target.port), $d = array_distinct(target.port)")
    assert sorted(a, key=str) == [443, 444, 8080, None] and d == [443, 444, 8080, None]


def test_rows_of_outcomes(spark):
    assert rows(spark, "target.port outcome: $p = target.port, $h = principal.hostname order: target.port desc limit: 2") == [(8080, ""), (444, "WEB-01")]


def test_dedup_keeps_the_first_in_order(spark):
    text = "dedup: metadata.event_type order: target.port desc, metadata.id limit: 2"
    assert [json.loads(r.event)["metadata"]["id"] for r in search(text, spark).collect()] == ["3", "2"]
    assert found(spark, "dedup: metadata.event_type") in ("134", "234")


def test_nulls_come_last(spark):
    for way in ("asc", "desc"):
        assert json.loads(search(f"order: target.port {way}", spark).collect()[-1].event)["metadata"]["id"] == "4"


def test_responses(spark):
    [e] = search_response('principal.hostname = "web-01"', spark)["events"]
    assert e["udm"]["metadata"]["eventType"] == "NETWORK_CONNECTION" and e["udm"]["additional"]["podName"] == "p1"
    assert search_response('target.port = 443 match: principal.hostname outcome: $my_count = count(metadata.id)', spark) == {
        "results": [{"principalHostname": "web-01", "myCount": 1}]
    }
    assert camel("_id") == "Id" and camelized([{"a_b": {"c_d": (1,)}}]) == [{"aB": {"cD": [1]}}]


def test_sources(spark, tmp_path):
    path = tmp_path / "e.json"
    path.write_text(json.dumps({"events": [{"name": "n1", "udm": EVENTS[0]}, EVENTS[1]]}))
    assert load_events(spark, str(path), "other") == 2 == load_events(spark, path, "other") == load_events(spark, path.read_text(), "other")
    names = [r.name for r in spark.table("other").collect()]
    assert "n1" in names and len(set(names)) == 2
    lines = tmp_path / "lines.json"
    lines.write_text("\n".join(json.dumps(e) for e in [{"name": "n1", "udm": EVENTS[0]}, EVENTS[2]]) + "\n\n")
    read = read_events(spark, str(lines))
    assert search("target.port", spark, events=read).count() == 2 and "n1" in [r.name for r in read.collect()]
    assert load_events(spark, read, "third") == 2
    read.select("name", "event").write.parquet(str(tmp_path / "e.parquet"))
    assert search("target.port = 443", spark, events=read_events(spark, str(tmp_path / "e.parquet"))).count() == 1
    write_events(read, str(tmp_path / "parsed.parquet"))
    kept = read_events(spark, str(tmp_path / "parsed.parquet"))
    assert kept.schema["v"].dataType.simpleString() == "variant" and search("target.port = 443", spark, events=kept).count() == 1
    assert load_events(spark, [], "none") == 0
    for bad in ({"no": 1}, "3"):
        with pytest.raises(ValueError):
            load_events(spark, bad, "none")
    with pytest.raises(TypeError):
        load_events(spark, 3, "none")


def test_reference_lists_are_replaced(spark):
    load_reference_list(spark, "r", "c", ["a"])
    load_reference_list(spark, "r", "d", ["b"])
    load_reference_list(spark, "r", "c", ["10.0.0.7"])
    assert found(spark, "principal.ip in %r.c") == "2" and found(spark, "principal.ip in %r.d") == ""


def test_elements_of_what_isnt_a_list(spark):
    cases = {"[1,2]": 2, '{"a":1,"b":[2]}': 2, "5": 1, "null": 1}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", F.size(Node(F.parse_json("t")).elements()[0]).alias("n"))
    assert {r.t: r.n for r in rows.collect()} == cases


def test_a_schema_from_files(spark, tmp_path):
    (tmp_path / "f.csv").write_text("root,path,type,label,enum\nevent,a,message,,False\nevent,a.b,Kind,repeated,True\nentity,e,string,,False\nother,x,string,,False\n")
    (tmp_path / "e.json").write_text('{"enums": {"Kind": [{"name": "K1"}]}}')
    schema = Schema.from_files(tmp_path / "f.csv", tmp_path / "e.json")
    assert schema.lookup("a.b") == Field("a.b", "Kind", True, True) and schema.lookup("graph.e") and not schema.lookup("x")
    relation = event_relation(spark.createDataFrame([('{"a":{"b":["K1"]}}',)], "event string"))
    assert search('a.b = "K1"', spark, schema, events=relation).count() == 1
    with pytest.raises(CompileError):
        search('a.b = "K2"', spark, schema, events=relation)


def test_every_prefix_of_a_builtin_field_is_one():
    fields = Schema.builtin().fields
    assert all(p.rpartition(".")[0] in fields for p in fields if "." in p)
