"""Parser programs: what plugins, conditions and loops make of messages."""

import json

import pytest
from pyspark.sql import functions as F

from tracelight.errors import CompileError, ExecutionError
from tracelight.functions.schema import Schema
from tracelight.operators.logs.grok import GrokProblem, compile_grok, patterns
from tracelight.operators.logs.run import parse_logs, run_program
from tracelight.operators.search import search
from tracelight.operators.rules import run_rule

U = "event.idm.read_only_udm"
OUT = 'mutate { merge => { "@output" => "event" } }'
TYPE = f'mutate {{ replace => {{ "{U}.metadata.event_type" => "GENERIC_EVENT" }} }}'
FIREWALL = f"""filter {{
  grok {{ match => {{ "message" => "%{{SYSLOGTIMESTAMP:when}} %{{DATA:device}}: FW-%{{INT:number}}: (?P<action>Accepted|Denied) connection %{{WORD:protocol}} %{{IP:from}}/%{{INT:port}}" }} on_error => "unread" }}
  if ![unread] {{
    mutate {{ replace => {{ "{U}.metadata.event_type" => "NETWORK_CONNECTION" "{U}.principal.ip" => "%{{from}}" "{U}.network.ip_protocol" => "%{{protocol}}" }} convert => {{ "port" => "uinteger" }} }}
    mutate {{ rename => {{ "port" => "{U}.principal.port" }} }}
    if [action] == "Denied" {{ mutate {{ replace => {{ "{U}.security_result.action" => "BLOCK" }} }} }}
    date {{ match => ["when", "MMM dd HH:mm:ss"] rebase => true }}
    {OUT}
  }}
}}"""
LINES = [
    "Mar 15 11:08:06 gw: FW-112: Denied connection TCP 10.0.0.1/9988",
    "Mar  5 11:08:07 gw: FW-113: Accepted connection UDP 10.0.0.2/53",
    "something else",
]


def state(body: str, message, **more):
    """What a program leaves in the state, as fields of an event."""
    made = run_program(f"filter {{ {body} {OUT} }}", [message], schema=False, created="2026-01-01T00:00:00Z", **more)
    return made[0] if made else None


def value(body: str, message="", name="v"):
    """The place ``v`` after some statements."""
    made = state(f'{body} mutate {{ copy => {{ "{U}.out" => "{name}" }} }}', message)
    return made["out"]


def test_firewall(spark):
    events = run_program(FIREWALL, LINES, created="2026-05-01T00:00:00Z")
    assert events == [
        {
            "metadata": {"event_type": "NETWORK_CONNECTION", "event_timestamp": "2026-03-15T11:08:06Z"},
            "principal": {"ip": ["10.0.0.1"], "port": 9988}, "network": {"ip_protocol": "TCP"}, "security_result": [{"action": ["BLOCK"]}],
        },
        {
            "metadata": {"event_type": "NETWORK_CONNECTION", "event_timestamp": "2026-03-05T11:08:07Z"},
            "principal": {"ip": ["10.0.0.2"], "port": 53}, "network": {"ip_protocol": "UDP"},
        },
    ]
    logs = spark.createDataFrame([(x,) for x in LINES], "message string")
    relation = parse_logs(FIREWALL, logs, created="2026-05-01T00:00:00Z")
    assert sorted(json.loads(r.event)["principal"]["port"] for r in relation.collect()) == [53, 9988]
    assert search('security_result.action = "BLOCK" and ip = "10.0.0.1"', spark, events=relation).count() == 1
    rule = 'rule r { events: $e.principal.port > 1 $p = $e.network.ip_protocol match: $p outcome: $n = count($e.metadata.event_type) condition: $e }'
    assert sorted(tuple(r) for r in run_rule(rule, spark, events=relation).collect()) == [("TCP", 1), ("UDP", 1)]


@pytest.mark.parametrize(
    "body, message, expected",
    [
        ('grok { match => { "message" => ["%{INT:n}x", "%{WORD:v}"] } }', "abc", "abc"),
        ('grok { match => { "message" => "%{IP:v}" } match_all => true }', "10.0.0.1 10.0.0.2", {"0": "10.0.0.1", "1": "10.0.0.2"}),
        ('grok { match => { "message" => "%{WORD:v} %{WORD:v}" } }', "a b", "a"),
        ('grok { match => { "message" => "(?<v>b+)" } }', "abbc", "bb"),
        ('grok { match => { "message" => "%{WORD:message}" } overwrite => ["message"] } mutate { copy => { "v" => "message" } }', "a b", "a"),
        ('json { }', '{"v": {"a": [1, "x"]}}', {"a": [1, "x"]}),
        ('json { array_function => "split_columns" }', '{"v": [["a"], {"b": ["c"]}]}', {"0": {"0": "a"}, "1": {"b": {"0": "c"}}}),
        ('kv { }', "u=1 v=x=y z", "x=y"),
        ('kv { field_split => "|" value_split => ":" trim_value => "\\"" }', 'a:b|v : "q" |c', "q"),
        ('kv { field_split => "|" whitespace => "strict" }', "v= q |c", " q "),
        ('csv { separator => ";" } mutate { rename => { "column2" => "v" } }', 'a;"b;c"', "b;c"),
        ('base64 { source => "message" target => "v" }', "aG9zdA==", "host"),
        ('base64 { source => "message" target => "v" encoding => "RawURL" }', "w7_DvsO9", "ÿþý"),
        ('mutate { replace => { "v" => "<%{message}-%{[a][b]}-%{t}>" } }', "m", "<m-%{[a][b]}-%{t}>"),
        ('mutate { replace => { "v" => true } }', "m", "true"),
        ('mutate { replace => { "v" => 3 } }', "m", 3),
        ('mutate { copy => { "v" => "message" } uppercase => ["v", "none"] }', "m", "m"),  # copy runs after uppercase
        ('mutate { copy => { "v" => "message" } } mutate { uppercase => ["v"] }', "m", "M"),
        ('mutate { split => { source => "message" separator => "," target => "v" } }', "a,b", ["a", "b"]),
        ('mutate { split => { "v" => "-" } rename => { "message" => "v" } }', "a-b", ["a", "b"]),  # rename runs first
        ('mutate { gsub => ["message", "(a)(b)", "\\\\2\\\\1", "message", "c", "d", "none", "x", "y"] } mutate { copy => { "v" => "message" } }', "abc", "bad"),
        ('mutate { replace => { "v" => "" } merge => { "v" => "message" } }', "m", ["", "m"]),
        ('mutate { merge => { "v" => "message" "w" => "nothing" } }', "m", "m"),
        ('json { } mutate { merge => { "v" => "w" } }', '{"v": [1], "w": [2, 3]}', [1, 2, 3]),
        ('mutate { replace => { "x" => "v" } } mutate { replace => { "%{x}" => "y" } }', "m", "y"),
    ],
)
def test_plugins(body, message, expected):
    assert value(body, message) == expected


@pytest.mark.parametrize(
    "given, kind, expected",
    [
        ("1,234.9", "integer", 1234), (True, "integer", 1), ("7", "uinteger", 7), ("1,5", "float", 15.0), (2, "string", "2"), (True, "string", "true"),
        ("Yes", "boolean", True), ("", "boolean", False), (0, "boolean", False), ("0.0", "boolean", False), ("ff", "hextodec", 255),
        ("68 69", "hextoascii", "hi"), (["a", 1, "b", 2], "integer", None), ("10.0.0.1", "ipaddress", "10.0.0.1"), ("::1", "ipaddress", "::1"),
        ("00:1a:2B:3c:4d:5e", "macaddress", "00:1a:2B:3c:4d:5e"), (["1", "2"], "integer", [1, 2]), ("x", "integer", None), ("-1", "uinteger", None),
        ("2", "boolean", None), ("010.0.0.1", "ipaddress", None), ("0:1", "macaddress", None), ("x", "none", None), ("zz", "hextodec", None),
    ],
)
def test_conversions(given, kind, expected):
    body = f'json {{ }} mutate {{ convert => {{ "v" => "{kind}" }} on_error => "failed" }} if [failed] {{ mutate {{ replace => {{ "w" => "no" }} }} }} else {{ mutate {{ copy => {{ "w" => "v" }} }} }}'
    assert value(body, json.dumps({"v": given}), "w") == ("no" if expected is None else expected)


@pytest.mark.parametrize(
    "text, formats, expected",
    [
        ("2025-01-15 10:00:01", '"yyyy-MM-dd HH:mm:ss"', "2025-01-15T10:00:01Z"),
        ("15/Jan/25 01:02 PM", '"UNIX", "dd/MMM/yy hh:mm a"', "2025-01-15T13:02:00Z"),
        ("1736928000", '"UNIX"', "2025-01-15T08:00:00Z"),
        ("1736928000123", '"UNIX_MS"', "2025-01-15T08:00:00.123000Z"),
        ("2025-01-15T10:00:00.5+02:00", '"ISO8601"', "2025-01-15T08:00:00.500000Z"),
        ("at 2025 % 01", "\"'at' yyyy % MM\"", "2025-01-01T00:00:00Z"),
        ("Jan 15", '"MMM dd"', "1900-01-15T00:00:00Z"),
    ],
)
def test_dates(text, formats, expected):
    assert value(f'date {{ match => ["message", {formats}] target => "v" }}', text) == expected


def test_time_zones_and_rebasing():
    assert value('date { match => ["message", "yyyy-MM-dd HH:mm"] timezone => "America/New_York" target => "v" }', "2025-01-15 10:00") == "2025-01-15T15:00:00Z"
    assert value('date { match => ["message", "MMM dd"] rebase => true target => "v" }', "Jan 15") == "2026-01-15T00:00:00Z"
    assert run_program(f"filter {{ {TYPE} {OUT} }}", [{"message": "", "@timestamp": "2020-01-01T00:00:00Z"}])[0]["metadata"]["event_timestamp"] == "2020-01-01T00:00:00Z"


def test_leap_days_are_rebased_to_the_year_of_each_message():
    program = f'filter {{ {TYPE} date {{ match => ["message", "MMM dd"] rebase => true on_error => "none" }} {OUT} }}'
    found = run_program(program, [{"message": "Feb 29", "@createTimestamp": f"{y}-03-01T00:00:00Z"} for y in (2024, 2028, 2025)])
    assert [e["metadata"].get("event_timestamp") for e in found] == ["2024-02-29T00:00:00Z", "2028-02-29T00:00:00Z", None]


@pytest.mark.parametrize(
    "test, holds",
    [
        ('[a] == "1"', True), ("[a] == 1", True), ('[a] == "1.0"', False), ("[a] != 2", True), ('[a] < "10"', True), ('[b] < "a"', False), ('[b] > "a"', True),
        ('[b] =~ "^x.$"', True), ('[b] !~ "z"', True), ('[b] in ["xy", 3]', True), ("[a] in [1]", True), ("[a] in [2]", False), ("[c]", False), ("[d]", True),
        ("![c] and [d]", True), ('([c] or [e][f] == "g") and [a] >= 1', True), ("[h] == true", True), ('[h] == "true"', False),
    ],
)
def test_conditions(test, holds):
    message = json.dumps({"a": "1", "b": "xy", "c": "", "d": "false", "e": {"f": "g"}, "h": True})
    body = f'json {{ }} if {test} {{ mutate {{ replace => {{ "v" => "yes" }} }} }} else {{ mutate {{ replace => {{ "v" => "no" }} }} }}'
    assert value(body, message) == ("yes" if holds else "no")


@pytest.mark.parametrize(
    "loop, expected",
    [("x in l", "ab"), ("i, x in l", "0a1b"), ("x in o", "pq"), ("x in o map", "pq"), ("k, x in o map", "mpnq")],
)
def test_loops(loop, expected):
    inner = "%{i}%{k}%{x}".replace("%{i}", "%{i}" if "i," in loop else "").replace("%{k}", "%{k}" if "k," in loop else "")
    body = f'json {{ }} mutate {{ replace => {{ "v" => "" }} }} for {loop} {{ mutate {{ replace => {{ "v" => "%{{v}}{inner}" }} }} }}'
    assert value(body, '{"l": ["a", "b"], "o": {"m": "p", "n": "q"}}') == expected


@pytest.mark.parametrize(
    "body, message",
    [
        ("if [nothing] { drop { } }", ""),
        ('mutate { convert => { "nothing" => "string" } on_error => "e" }', ""),  # unset fields crash, on_error or not
        ('grok { match => { "message" => "%{INT:x}" } }', "a"),
        ('grok { match => { "message" => "%{NOSUCH:x}" } }', "a"),
        ('grok { match => { "message" => "%{WORD:message}" } }', "a"),
        ("json { }", "[1]"),
        ('csv { separator => ";;" }', "a"),
        ('date { match => ["message", "yyyy"] }', "x"),
        ('date { match => ["message", "yyyy"] timezone => "Nowhere/None" }', "2020"),
        ('for x in message { }', "a"),
        ('for x in message map { }', "a"),
        ('if [message] =~ "(" { drop { } }', "a"),
        ('if [message] in "a" { drop { } }', "a"),
        ('json { } mutate { convert => { "v" => "integer" } on_error => "e" }', '{"v": "inf"}'),
        ('mutate { replace => { } }', "a"),
        ('mutate { merge => { "@output" => "message" } }', "a"),
    ],
)
def test_what_ends_a_program(body, message):
    with pytest.raises(ExecutionError):
        run_program(f"filter {{ {body} }}", [message], schema=False)


def test_failures_that_are_caught():
    made = state(f'json {{ on_error => "a.b" }} kv {{ on_error => "c" }} mutate {{ copy => {{ "{U}.x" => "a" "{U}.y" => "c" "{U}.n" => "@onErrorCount" }} }}', "k=v")
    assert made == {"x": {"b": True}, "y": False, "n": 1}


def test_a_mutation_that_fails_keeps_what_was_done():
    body = f'mutate {{ replace => {{ "{U}.a" => "done" }} convert => {{ "message" => "integer" }} on_error => "e" }}'
    assert state(body, "x") == {"a": "done"}


def test_several_events_and_snapshots():
    p = f"""filter {{ {TYPE} {OUT} mutate {{ replace => {{ "{U}.metadata.event_type" => "USER_LOGIN" }} }} {OUT}
      mutate {{ replace => {{ "event1.idm.read_only_udm.metadata.event_type" => "USER_LOGOUT" }} merge => {{ "@output" => "event1" }} }} }}"""
    assert [e["metadata"]["event_type"] for e in run_program(p, "x")] == ["GENERIC_EVENT", "USER_LOGIN", "USER_LOGOUT"]


def test_dropped_messages_and_ones_without_output():
    assert run_program(f"filter {{ {TYPE} {OUT} drop {{ }} }}", ["a", "b"]) == []
    assert run_program(f"filter {{ {TYPE} }}", "a") == []


def test_repeated_fields_become_lists():
    p = f"""filter {{ json {{ }} mutate {{ rename => {{ "s" => "{U}.security_result" "l" => "{U}.target.resource.attribute.labels" }} }} {OUT} }}"""
    assert run_program(p, json.dumps({"s": {"action": "ALLOW", "x": 1}, "l": [{"key": "k", "value": "v"}]})) == [
        {"security_result": [{"action": ["ALLOW"], "x": 1}], "target": {"resource": {"attribute": {"labels": [{"key": "k", "value": "v"}]}}}}
    ]


@pytest.mark.parametrize(
    "body",
    [
        f'mutate {{ replace => {{ "{U}.principal.nothing" => "x" }} }}',
        f'if [a] {{ for x in y {{ mutate {{ rename => {{ "a" => "{U}.nothing" }} }} }} }}',
        f'mutate {{ replace => {{ "{U}.metadata.event_type" => "NO_SUCH" }} }}',
        'mutate { merge => { "event2.idm.read_only_udm.target.ips" => "a" } }',
    ],
)
def test_targets_are_checked_before_anything_runs(body):
    with pytest.raises(CompileError):
        run_program(f"filter {{ {body} }}", [])
    run_program(f"filter {{ {body} }}", [], schema=False)


def test_targets_that_are_only_known_later():
    assert run_program(f'filter {{ mutate {{ replace => {{ "{U}.additional.%{{message}}" => "v" "{U}.metadata.event_type" => "%{{message}}" }} }} {OUT} }}', "k")[0]["additional"] == {"k": "v"}


def test_failing_rows_of_a_table(spark):
    program = f'filter {{ json {{ }} {TYPE} mutate {{ rename => {{ "id" => "{U}.metadata.id" }} }} {OUT} }}'
    logs = spark.createDataFrame([('{"id": "1"}',), ("broken",), (None,)], "message string")
    assert parse_logs(program, logs, failures="skip").count() == 1
    kept = parse_logs(program, logs, failures="keep")
    assert sorted((r.event is None, r.error is None) for r in kept.collect()) == [(False, True), (True, False), (True, False)]
    with pytest.raises(Exception, match="json failed"):
        parse_logs(program, logs).collect()
    with pytest.raises(CompileError):
        parse_logs(f'filter {{ mutate {{ replace => {{ "{U}.nothing" => "x" }} }} }}', logs)


def test_columns_are_system_variables(spark):
    logs = spark.createDataFrame([("m", "2020-01-01T00:00:00Z", ["a"])], "message string, `@timestamp` string, l array<string>")
    [row] = parse_logs(f'filter {{ for x in l {{ mutate {{ replace => {{ "{U}.metadata.id" => "%{{x}}" }} }} }} {OUT} }}', logs).collect()
    assert json.loads(row.event) == {"metadata": {"id": "a", "event_timestamp": "2020-01-01T00:00:00Z"}}


def test_other_names():
    import tracelight

    assert tracelight.run_parser is run_program and tracelight.parse_parser("filter { }").statements == ()
    assert all(hasattr(tracelight, n) for n in tracelight.__all__)


def test_statedump(capsys):
    run_program('filter { statedump { label => "here" } }', "m", created="x")
    assert json.loads(capsys.readouterr().err)["state"]["message"] == "m"


def test_grok_dictionary():
    assert len(patterns()) == 70
    for name in patterns():
        compile_grok(f"%{{{name}:x}}")
    with pytest.raises(GrokProblem):
        compile_grok("(")
    pattern, labels = compile_grok("%{COMBINEDAPACHELOG}")
    line = '127.0.0.1 - frank [10/Oct/2000:13:55:36 -0700] "GET /a.gif HTTP/1.0" 200 2326 "http://x/" "Mozilla"'
    found = pattern.search(line)
    assert found["clientip"] == "127.0.0.1" and found["response"] == "200" and found["request"] == "/a.gif" and "agent" in labels


def test_names_agree_on_reruns(spark):
    logs = spark.createDataFrame([("a",), ("b",)], "message string")
    relation = parse_logs(f'filter {{ {TYPE} mutate {{ copy => {{ "{U}.metadata.id" => "message" }} }} {OUT} }}', logs)
    assert sorted(r.name for r in relation.collect()) == sorted(r.name for r in relation.collect())
    assert relation.select(F.countDistinct("name")).first()[0] == 2
    assert Schema.builtin() is Schema.builtin()
