"""Detection rules over small documents."""

import pytest

from tracelight.errors import CompileError
from tracelight.operators.rules import compile_rule, rule_response, run_rule
from tracelight.plans.rule import parse_rule
from tracelight.sources.events import load_events


def event(i, kind, time, who=None, place="target", action=None, **more):
    e = {"metadata": {"id": i, "event_type": kind, "event_timestamp": f"2026-03-15T{time}Z"}}
    if who:
        e[place] = {"user": {"userid": who}}
    if action:
        e["security_result"] = [{"action": action}]
    return e | more


EVENTS = [
    *[event(f"a{n}", "USER_LOGIN", f"10:0{n}:00", "alice", action="BLOCK") for n in range(6)],
    event("b1", "USER_LOGIN", "10:00:00", "bob", action="BLOCK"),
    event("c1", "USER_LOGIN", "09:00:00", "carol", "principal", "ALLOW"),
    event("c2", "FILE_CREATION", "09:02:00", "carol", "principal"),
    event("d1", "USER_LOGIN", "08:00:00", "dave", action="ALLOW"),
]


@pytest.fixture(scope="module", autouse=True)
def events(spark):
    load_events(spark, EVENTS)


def results(spark, text):
    return rule_response(text, spark)["results"]


def test_threshold_and_score(spark):
    text = """rule t { events: $e.metadata.event_type = "USER_LOGIN" $e.security_result.action = "BLOCK" $user = $e.target.user.userid
      match: $user over 10m
      outcome: $failed_count = count($e.metadata.id), $risk = if($failed_count > 20, 90, if($failed_count > 3, 50, 10)), $label = "x"
      condition: #e >= 5 }"""
    assert results(spark, text) == [{"user": "alice", "failedCount": 6, "risk": 50, "label": "x"}]


JOIN = """rule j {{ events: $login.metadata.event_type = "USER_LOGIN" $login.principal.user.userid = $user
  $get.metadata.event_type = "FILE_CREATION" $get.principal.user.userid = $user
  match: $user {} condition: {} }}"""


@pytest.mark.parametrize(
    "window, condition, users",
    [
        ("over 10m", "$login and $get", {"carol"}),
        ("", "$login and #get = 1", {"carol"}),
        ("over 5m after $login", "$login and $get", {"carol"}),
        ("over 2m after $login", "$get", {"carol"}),  # ends are included
        ("over 1m after $login", "$get", set()),
        ("over 5m before $login", "$get", set()),
        ("", "!$get", {None}),
        ("", "$get or $login", {"carol", None}),
    ],
)
def test_joins(spark, window, condition, users):
    assert {r["user"] for r in results(spark, JOIN.format(window, condition))} == users


def test_negation_of_a_joined_variable(spark):
    text = """rule n { events: $in.metadata.event_type = "USER_LOGIN" $user = $in.target.user.userid
      $out.metadata.event_type = "USER_LOGOUT" $user = $out.target.user.userid match: $user over 1h condition: $in and !$out }"""
    # carol has no user at the target: a group of its own
    assert {r["user"] for r in results(spark, text)} == {"alice", "bob", "dave", None}


@pytest.mark.parametrize("kind, n", [("USER_LOGOUT", 9), ("FILE_CREATION", None)])
def test_gates(spark, kind, n):
    text = f"""rule g {{ events: $e.metadata.event_type = "USER_LOGIN" $x.metadata.event_type = "{kind}" condition: $e and !$x }}"""
    assert results(spark, text) == ([] if n is None else [{"matches": n}])


def test_equal_documents_count_once(spark):
    same = event("s", "USER_LOGIN", "10:00:00", "sam")
    load_events(spark, [same, same, same], "same")
    rule = parse_rule('rule s { events: $e.metadata.id = "s" $u = $e.target.user.userid match: $u outcome: $n = count($e.metadata.id) condition: #e = 1 }')
    assert [tuple(r) for r in compile_rule(rule, spark.table("same")).collect()] == [("sam", 3)]


def test_outcomes_multiply_with_pairs(spark):
    text = """rule m { events: $a.security_result.action = "BLOCK" $u = $a.target.user.userid $b.metadata.event_type = "USER_LOGIN" $u = $b.target.user.userid
      match: $u outcome: $n = count($a.metadata.id) condition: #a = 6 and #b = 6 }"""
    assert results(spark, text) == [{"u": "alice", "n": 36}]


@pytest.mark.parametrize(
    "times, floor, users",
    [
        # half of a bucket's length goes to the even neighbour
        (("10:10:00", "10:15:00"), False, set()),
        (("10:00:00", "10:05:00"), False, {"p"}),
        (("10:10:00", "10:15:00"), True, {"p"}),
        (("10:09:00", "10:10:00"), True, set()),
    ],
)
def test_buckets(spark, times, floor, users):
    load_events(spark, [event("1", "USER_LOGIN", times[0], "p"), event("2", "USER_LOGOUT", times[1], "p")], "two")
    text = """rule b { events: $a.metadata.event_type = "USER_LOGIN" $u = $a.target.user.userid $b.metadata.event_type = "USER_LOGOUT"
      $u = $b.target.user.userid match: $u over 10m condition: $a and $b }"""
    assert {r.u for r in compile_rule(parse_rule(text), spark.table("two"), floor_buckets=floor).collect()} == users


def test_inner_join_only_where_groups_match_as_a_whole(spark, capsys):
    run_rule(JOIN.format("", "$login and $get"), spark).explain()
    assert "Inner" in capsys.readouterr().out
    run_rule(JOIN.format("over 5m after $login", "$login and $get"), spark).explain()
    assert "LeftOuter" in capsys.readouterr().out
    run_rule(JOIN.format("", "$login or $get"), spark).explain()
    assert "LeftOuter" in capsys.readouterr().out


@pytest.mark.parametrize(
    "body",
    [
        '$a.metadata.id = "1" $b.metadata.id = "2" condition: $a and $b',
        "$a.metadata.id = $b.metadata.id condition: $a",
        '$a.metadata.id = "1" metadata.id = "2" $b.metadata.id = "3" condition: $a',
        'metadata.id = "2" condition: $a',
        '$a.graph.entity.ip = "1" condition: $a',
        '$a.metadata.id = "1" condition: $b',
        '$a.metadata.id = "1" condition: $a and $n > 1',
        '$a.metadata.id = "1" $b.metadata.id = "2" condition: $a and !#b',
        '$a.metadata.id = "1" $b.metadata.id = "2" condition: $a and !$b and #b = 0',
        '$a.metadata.id = "1" match: $u condition: $a',
        '$a.metadata.id = "1" match: $a.metadata.id over 1h after $b condition: $a',
        '$a.metadata.id = "1" outcome: $n = if($a.metadata.id > 1, 2) condition: $a',
        '$a.metadata.id = "1" outcome: $n = $a.metadata.id condition: $a',
        '$a.metadata.id = "1" outcome: $n = concat($a.metadata.id) condition: $a',
        '$a.metadata.id = "1" condition: $a options: suppression_window = 5m',
        '$u = "x" $a.metadata.id = "1" condition: $a',
    ],
)
def test_what_cant_be_compiled(spark, body):
    with pytest.raises(CompileError):
        run_rule(f"rule x {{ events: {body} }}", spark)


def test_options_without_meaning_are_passed_over(spark):
    assert results(spark, 'rule o { events: metadata.id = "1" $e.metadata.id = "1" condition: $e options: allow_zero_values = true }') == []


@pytest.mark.parametrize("direction", ["before", "after"])
@pytest.mark.parametrize("unit, seconds", [("m", 60), ("h", 3600), ("d", 86400), ("w", 604800)])
def test_pivot_windows_against_all_pairs(spark, direction, unit, seconds):
    import random
    from datetime import datetime, timedelta

    r = random.Random(seconds)
    start = datetime(2026, 3, 1)
    rows = []
    for i in range(150):
        at = start + timedelta(seconds=r.choice([0, seconds, 2 * seconds, r.randrange(0, 9 * seconds)]))
        rows.append((r.choice(["USER_LOGIN", "USER_LOGOUT"]), r.choice("pq"), at if i % 10 else None))
    load_events(spark, [{"metadata": {"id": str(i), "event_type": k, "event_timestamp": t and t.isoformat()}, "target": {"user": {"userid": u}}} for i, (k, u, t) in enumerate(rows)], "near")
    text = f"""rule w {{ events: $a.metadata.event_type = "USER_LOGIN" $u = $a.target.user.userid $b.metadata.event_type = "USER_LOGOUT"
      $u = $b.target.user.userid match: $u over 1{unit} {direction} $a outcome: $n = count($b.metadata.id), $all = count($a.metadata.id) condition: $a }}"""
    found = {x.u: (x.n, x["all"]) for x in compile_rule(parse_rule(text), spark.table("near")).collect()}
    expected = {}
    for k, u, t in rows:
        if k == "USER_LOGIN":
            sign = 1 if direction == "after" else -1
            hits = sum(1 for k2, u2, t2 in rows if k2 == "USER_LOGOUT" and u2 == u and t and t2 and 0 <= sign * (t2 - t).total_seconds() <= seconds)
            n, every = expected.get(u, (0, 0))
            expected[u] = (n + hits, every + max(1, hits))
    assert found == expected
