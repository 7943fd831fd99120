"""Detection rules as lazy DataFrames: event variables joined on placeholders, grouped, and filtered by the condition.

Each event variable is a filtered projection of the event relation that holds
only what the rule needs of it, taken out of the documents once. The first
variable is joined with the others from the left on the placeholders they
share, on the time bucket if ``match:`` has a window, and on the distance in time if the window is
relative to a pivot.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelight.errors import CompileError
from tracelight.functions.aggregates import aggregate
from tracelight.functions.conditions import OPERATORS, Context, literal_value, operand
from tracelight.functions.schema import Schema
from tracelight.functions.paths import single, walk
from tracelight.plans.nodes import (
    All, Assignment, Call, Comparison, Either, EventCount, EventSeen, Grain, MatchItem, Not, Path, Placeholder, Rule, Value,
)
from tracelight.plans.rule import parse_rule
from tracelight.sources.events import EVENTS, View, list_values, viewed
from tracelight.sources.responses import result_response

#: Seconds of a window's unit; a month counts as 30 days.
SECONDS = {"minute": 60, "hour": 3600, "day": 86400, "week": 604800, "month": 2592000}
TIME = ("metadata", "event_timestamp")


def fields_of(x: Any) -> list[Path]:
    """All fields in a statement."""
    if isinstance(x, Path):
        return [x]
    if isinstance(x, (All, Either)):
        return [p for t in x.terms for p in fields_of(t)]
    if isinstance(x, Not):
        return fields_of(x.term)
    if isinstance(x, Comparison):
        return fields_of(x.left) + fields_of(x.right)
    if isinstance(x, Call):
        return [p for t in x.arguments for p in fields_of(t)]
    if isinstance(x, Assignment):
        return fields_of(x.value)
    return []


def definition(x: Any) -> tuple[str, Path] | None:
    """The placeholder that a statement defines and its field: ``$p = $e.field``, either way round."""
    if isinstance(x, Assignment):
        return (x.name, x.value) if isinstance(x.value, Path) and x.value.variable else None
    if isinstance(x, Comparison) and x.op == "=":
        for a, b in ((x.left, x.right), (x.right, x.left)):
            if isinstance(a, Path) and a.variable and isinstance(b, Placeholder):
                return b.name, a
    return None


@dataclass
class Variables:
    """What the events section says of each event variable, in the order of their first mention."""

    filters: dict[str, list[Any]] = field(default_factory=dict)
    #: of each placeholder, the fields that it is bound to, the first of each variable
    bound: dict[str, dict[str, Path]] = field(default_factory=dict)

    @property
    def names(self) -> list[str]:
        return list(self.filters)

    def anchor(self, placeholder: str) -> str:
        """The first variable that has the placeholder."""
        return min(self.bound[placeholder], key=self.names.index)


def event_variables(rule: Rule) -> Variables:
    found, unowned = Variables(), []
    for x in rule.events:
        defined = definition(x)
        if defined:
            name, path = defined
            found.filters.setdefault(path.variable, [])
            found.bound.setdefault(name, {}).setdefault(path.variable, path)
            continue
        owners = {p.variable for p in fields_of(x)} - {None}
        if len(owners) > 1:
            told = ", ".join("$" + o for o in sorted(owners))
            raise CompileError(f"a condition names several event variables ({told}); relate them by a shared placeholder")
        if owners:
            found.filters.setdefault(owners.pop(), []).append(x)
        else:
            unowned.append(x)
    if unowned:
        if len(found.filters) != 1:
            raise CompileError("a condition without an event variable is ambiguous in a rule that doesn't have exactly one")
        found.filters[found.names[0]] += unowned
    if not found.filters:
        raise CompileError("the events section has no event variable")
    return found


def polarities(x: Any, negated: bool = False) -> list[tuple[str, bool]]:
    """Each event variable that a condition names, and whether it stands there unnegated."""
    if isinstance(x, (EventSeen, EventCount)):
        return [(x.name, not negated)]
    if isinstance(x, Not):
        return polarities(x.term, not negated)
    if isinstance(x, (All, Either)):
        return [p for t in x.terms for p in polarities(t, negated)]
    if isinstance(x, Comparison):
        return [(s.name, not negated) for s in (x.left, x.right) if isinstance(s, EventCount)]
    return []


def required(x: Any) -> set[str]:
    """Event variables without which a condition can't hold."""
    if isinstance(x, All):
        return set().union(*map(required, x.terms))
    if isinstance(x, (EventSeen, EventCount)):
        return {x.name}
    if isinstance(x, Comparison) and isinstance(x.left, EventCount) and isinstance(x.right, Value) and x.right.kind == "number":
        if x.op == ">=" and x.right.value > 0 or x.op == ">" and x.right.value >= 0 or x.op == "=" and x.right.value > 0:
            return {x.left.name}
    return set()


class Compiler:
    def __init__(self, rule: Rule, events: DataFrame | View, schema: Schema, parameters: dict[str, str], lists, floor_buckets: bool):
        view = viewed(events)
        self.rule, self.events, self.schema, self.floor = rule, view.rows, schema, floor_buckets
        self.document = view.document
        # equal documents count once; a name that tells documents apart, or their digest, stands for the text
        self.identity = view.name if view.unique else F.sha2(view.event, 256)
        self.context = Context(schema, self.document, {}, parameters)
        if lists is not None:
            self.context.list_values = lists
        if "suppression_window" in rule.options:
            raise CompileError("suppression_window needs state that outlives a run and is not supported")
        if any(p.steps[0] == "graph" for x in (*rule.events, *(o.value for o in rule.outcome)) for p in fields_of(x)):
            raise CompileError("graph fields are not supported in rules")
        self.variables = event_variables(rule)
        self.first = self.variables.names[0]
        self.signs: dict[str, set[bool]] = {}
        for name, sign in polarities(rule.condition):
            if name not in self.variables.filters:
                raise CompileError(f"the condition names the undefined event variable ${name}")
            self.signs.setdefault(name, set()).add(sign)
        self.counted = {n for n in self.variables.names if self.counts(rule.condition, n)}
        if not rule.match and not rule.outcome:
            self.counted.add(self.first)
        self.windows()
        #: of each event variable, the fields that are needed after the joins, by the name of their column
        self.wanted: dict[str, dict[str, Path]] = {n: {} for n in self.variables.names}

    def counts(self, x: Any, name: str) -> bool:
        if isinstance(x, EventCount):
            return x.name == name
        if isinstance(x, (All, Either)):
            return any(self.counts(t, name) for t in x.terms)
        if isinstance(x, Not):
            return self.counts(x.term, name)
        return isinstance(x, Comparison) and (self.counts(x.left, name) or self.counts(x.right, name))

    def windows(self) -> None:
        self.bucket_seconds: int | None = None
        self.pivot: Grain | None = None
        for item in self.rule.match:
            g = item.grain
            if g is None:
                continue
            if g.direction is None:
                self.bucket_seconds = self.bucket_seconds or SECONDS[g.unit] * g.quantity
            elif self.pivot is None:
                if g.pivot != self.first:
                    raise CompileError(f"a window before or after takes the first event variable, ${self.first}, not ${g.pivot}")
                self.pivot = g

    # what is needed of each variable

    def want(self, path: Path, variable: str) -> tuple[Column, str]:
        """The typed value of a variable's field after the joins, and its kind."""
        bare = Path(path.steps)
        _, found = single(bare, self.schema, self.document)
        name = next((n for n, p in self.wanted[variable].items() if p == bare), f"{variable}__x{len(self.wanted[variable])}")
        self.wanted[variable][name] = bare
        return F.col(f"`{name}`"), found.kind if found else "string"

    def want_placeholder(self, name: str) -> tuple[Column, str]:
        owner = self.variables.anchor(name)
        return self.want(self.variables.bound[name][owner], owner)

    def value(self, x: Any) -> tuple[Column, str]:
        """A placeholder, field or literal of an outcome."""
        if isinstance(x, Placeholder):
            if x.name not in self.variables.bound:
                raise CompileError(f"undefined variable ${x.name}")
            return self.want_placeholder(x.name)
        if isinstance(x, Path):
            owner = x.variable or self.first
            if owner not in self.variables.filters:
                raise CompileError(f"undefined event variable ${owner}")
            return self.want(x, owner)
        return operand(x, self.context).typed(), "string"

    def projection(self, name: str) -> DataFrame:
        """The events of a variable, with the columns that joins and outcomes need of them."""
        terms = self.variables.filters[name]
        rows = self.events
        if terms:
            rows = self.context.holding(rows, terms[0] if len(terms) == 1 else All(tuple(terms)))
        columns = [F.lit(True).alias(f"{name}__seen")]
        if name in self.counted:
            columns.append(self.identity.alias(f"{name}__event"))
        for p, owners in self.variables.bound.items():
            if name in owners and len(owners) > 1:
                columns.append(self.typed(owners[name]).alias(f"{name}__on_{p}"))
        if self.pivot or self.bucket_seconds:
            time = walk(TIME, self.schema, self.document, lambda x, f: x.cast("timestamp_ntz"))
            columns.append(time.alias(f"{name}__time"))
            if self.bucket_seconds:
                seconds = F.unix_micros(time.cast("timestamp")).cast("double") / 1e6 / self.bucket_seconds
                columns.append((F.floor(seconds) if self.floor else F.bround(seconds)).cast("bigint").alias(f"{name}__bucket"))
            if self.pivot:
                columns.append(self.near_buckets(name, time))
        columns += [self.typed(p).alias(n) for n, p in self.wanted[name].items()]
        return rows.select(*columns)

    def near_buckets(self, name: str, time: Column) -> Column:
        """Buckets of time, as long as the window at least, that an event can meet a pivot in.

        A pivot has the bucket of its time. An event within the window after
        it is in that bucket or the next, so it is dealt to its own and the one before; before the pivot,
        the other way round. The pair meets in the pivot's bucket and nowhere else, so a key with a
        long history is joined piece by piece.
        """
        longest = {**SECONDS, "month": 31 * 86400}[self.pivot.unit] * self.pivot.quantity
        own = F.floor(F.unix_micros(time.cast("timestamp")) / F.lit(longest * 1_000_000)).cast("bigint")
        if name == self.first:
            return own.alias(f"{name}__near")
        return F.explode(F.array(own, own + (-1 if self.pivot.direction == "after" else 1))).alias(f"{name}__near")

    def typed(self, path: Path) -> Column:
        value, found = single(Path(path.steps), self.schema, self.document)
        return value.cast(found.kind if found else "string")

    # joins

    def joined(self) -> tuple[DataFrame, set[str]]:
        """The first variable's events joined with all others', and the variables that only gate the result."""
        names, bound = self.variables.names, self.variables.bound
        inside, gates = {self.first}, set()
        rows = self.projection(self.first)
        keys = {i.value.name for i in self.rule.match if isinstance(i.value, Placeholder)}
        must = required(self.rule.condition)
        waiting = []
        for name in names[1:]:
            shared = [p for p, owners in bound.items() if name in owners and (a := self.variables.anchor(p)) != name and a in inside]
            if not shared:
                if self.signs.get(name) == {False}:
                    gates.add(name)
                    continue
                raise CompileError(
                    f"the event variable ${name} shares no placeholder with one that is declared before it, so nothing relates it to the others"
                )
            inside.add(name)
            waiting.append((name, shared))
        for name, shared in waiting:
            on = [F.col(f"{name}__on_{p}") == F.col(f"{self.variables.anchor(p)}__on_{p}") for p in shared]
            if self.bucket_seconds:
                on.append(F.col(f"{name}__bucket") == F.col(f"{self.first}__bucket"))
            if self.pivot:
                on += [F.col(f"{name}__near") == F.col(f"{self.first}__near"), self.near(name)]
            # where the join depends on the group's keys alone, a group has all its rows matched or none
            whole = not self.bucket_seconds and not self.pivot and set(shared) <= keys
            kind = "inner" if whole and name in must else "left"
            rows = rows.join(self.projection(name), reduce(and_, on), kind)
        for name in sorted(gates):
            terms = self.variables.filters[name]
            there = self.events
            if terms:
                there = self.context.holding(there, terms[0] if len(terms) == 1 else All(tuple(terms)))
            # one row at most, which rules everything out
            rows = rows.join(F.broadcast(there.limit(1).select(F.lit(1).alias("there"))), F.lit(True), "left_anti")
        return rows, gates

    def near(self, name: str) -> Column:
        """Not further from the pivot's time than the window, on the side that it names, both ends included."""
        span = F.expr(f"INTERVAL {self.pivot.quantity} {self.pivot.unit}")
        time, pivot = F.col(f"{name}__time"), F.col(f"{self.first}__time")
        return time.between(pivot, pivot + span) if self.pivot.direction == "after" else time.between(pivot - span, pivot)

    # outcomes and condition

    def compile(self) -> DataFrame:
        keys: dict[str, Column] = {}
        matched: dict[Any, str] = {}
        for item in self.rule.match:
            name = item.value.name if isinstance(item.value, Placeholder) else item.value.alias
            keys[name] = self.key(item, name)
            matched[item.value] = name
        measures: dict[str, Column] = {}
        outcomes: list[tuple[str, Callable[[], Column]]] = []
        defined: set[str] = set()
        for o in self.rule.outcome:
            outcomes.append((o.name, self.outcome(o.value, measures, matched, set(defined))))
            defined.add(o.name)
        if not keys and not outcomes:
            measures["m_matches"] = F.count_distinct(F.col(f"{self.first}__event"))
            outcomes.append(("matches", lambda: F.col("m_matches")))
        # which variables gate is known once they are joined, the condition's measures before the grouping
        rows, gates = self.joined()
        holds = self.holds(self.rule.condition, measures, {o.name for o in self.rule.outcome}, gates)
        grouping = rows.groupBy(*[c.alias(f"k_{i}") for i, c in enumerate(keys.values())])
        found = grouping.agg(*[c.alias(n) for n, c in (measures or {"m_none": F.count(F.lit(1))}).items()])
        for name, made in outcomes:
            found = found.withColumn(f"o_{name}", made())
        found = found.where(holds())
        return found.select(
            *[F.col(f"k_{i}").alias(n) for i, n in enumerate(keys)], *[F.col(f"o_{n}").alias(n) for n, _ in outcomes]
        )

    def key(self, item: MatchItem, name: str) -> Column:
        if isinstance(item.value, Placeholder) and item.value.name not in self.variables.bound:
            raise CompileError(f"match names the undefined placeholder ${name}")
        if item.grain and item.grain.first and item.grain.direction is None and self.bucket_seconds:
            return F.timestamp_seconds(F.col(f"{self.first}__bucket") * self.bucket_seconds)
        return self.value(item.value)[0]

    def measure(self, measures: dict[str, Column], column: Column) -> Callable[[], Column]:
        name = f"m_{len(measures)}"
        measures[name] = column
        return lambda: F.col(name)

    def outcome(self, x: Any, measures: dict[str, Column], matched: dict[Any, str], defined: set[str]) -> Callable[[], Column]:
        """What an outcome is after the grouping; its aggregates are added to the measures."""
        if isinstance(x, Call) and x.name == "if":
            if len(x.arguments) != 3:
                raise CompileError("if() takes three arguments")
            test = self.test(x.arguments[0], matched, defined)
            one, other = (self.outcome(a, measures, matched, defined) for a in x.arguments[1:])
            return lambda: F.when(test(), one()).otherwise(other())
        if isinstance(x, Call):
            if len(x.arguments) != 1:
                raise CompileError(f"{x.name}() takes one argument")
            if isinstance(x.arguments[0], Call):
                raise CompileError(f"the function {x.arguments[0].name!r} is not supported inside {x.name}()")
            column, kind = self.value(x.arguments[0])
            return self.measure(measures, aggregate(x.name, column, kind))
        return self.after(x, matched, defined)

    def after(self, x: Any, matched: dict[Any, str], defined: set[str]) -> Callable[[], Column]:
        """A literal, an earlier outcome or a match field, after the grouping."""
        if isinstance(x, Value):
            found = literal_value(x, self.context)
            return lambda: F.lit(found)
        if isinstance(x, Placeholder) and x.name in defined:
            return lambda: F.col(f"o_{x.name}")
        if x in matched:
            place = list(matched.values()).index(matched[x])
            return lambda: F.col(f"k_{place}")
        if isinstance(x, (Placeholder, Path)):
            self.value(x)
            raise CompileError(f"{x} is neither an aggregate, an earlier outcome nor a match field")
        raise CompileError(f"a {type(x).__name__} can't be an outcome")

    def test(self, x: Any, matched: dict[Any, str], defined: set[str]) -> Callable[[], Column]:
        if isinstance(x, (All, Either)):
            terms, joint = [self.test(t, matched, defined) for t in x.terms], and_ if isinstance(x, All) else or_
            return lambda: reduce(joint, [t() for t in terms])
        if isinstance(x, Not):
            inner = self.test(x.term, matched, defined)
            return lambda: ~inner()
        if isinstance(x, Comparison):
            if x.op not in OPERATORS:
                raise CompileError(f"the operator {x.op!r} is not supported in if()")
            left, right = (self.after(s, matched, defined) for s in (x.left, x.right))
            return lambda: OPERATORS[x.op](left(), right())
        if isinstance(x, Path):
            there = self.after(x, matched, defined)
            return lambda: there().isNotNull() & (there().cast("string") != "")
        raise CompileError(f"a {type(x).__name__} can't be tested in if()")

    def holds(self, x: Any, measures: dict[str, Column], outcomes: set[str], gates: set[str]) -> Callable[[], Column]:
        if isinstance(x, (All, Either)):
            terms, joint = [self.holds(t, measures, outcomes, gates) for t in x.terms], and_ if isinstance(x, All) else or_
            return lambda: reduce(joint, [t() for t in terms])
        if isinstance(x, Not):
            if isinstance(x.term, EventSeen) and x.term.name in gates:
                return lambda: F.lit(True)
            inner = self.holds(x.term, measures, outcomes, gates)
            return lambda: ~inner()
        if isinstance(x, (EventSeen, EventCount)):
            if x.name in gates:
                raise CompileError(f"${x.name} shares no placeholder with another event variable and can only be negated, !${x.name}")
            if isinstance(x, EventSeen):
                n = self.measure(measures, F.count(F.col(f"{x.name}__seen")))
            else:
                n = self.number(x, measures)
            return lambda: n() > 0
        if isinstance(x, Comparison):
            if x.op not in OPERATORS:
                raise CompileError(f"the operator {x.op!r} is not supported in the condition")
            left, right = (self.side(s, measures, outcomes, gates) for s in (x.left, x.right))
            return lambda: OPERATORS[x.op](left(), right())
        raise CompileError(f"a {type(x).__name__} is no condition")

    def number(self, x: EventCount, measures: dict[str, Column]) -> Callable[[], Column]:
        return self.measure(measures, F.count_distinct(F.col(f"{x.name}__event")))

    def side(self, x: Any, measures: dict[str, Column], outcomes: set[str], gates: set[str]) -> Callable[[], Column]:
        if isinstance(x, EventCount):
            if x.name in gates:
                raise CompileError(f"${x.name} shares no placeholder with another event variable and can't be counted")
            return self.number(x, measures)
        if isinstance(x, Placeholder):
            if x.name not in outcomes:
                raise CompileError(f"the condition names the unknown outcome ${x.name}")
            return lambda: F.col(f"o_{x.name}")
        if isinstance(x, Value):
            found = literal_value(x, self.context)
            return lambda: F.lit(found)
        raise CompileError(f"a {type(x).__name__} can't be compared in the condition")


def compile_rule(
    rule: Rule,
    events: DataFrame | View,
    schema: Schema | None = None,
    parameters: dict[str, str] | None = None,
    lists: Callable[[str, str | None], Sequence[str] | DataFrame] | None = None,
    floor_buckets: bool = False,
) -> DataFrame:
    """The rule's detections over an event relation: match fields, then outcomes; ``matches`` where it has neither.

    A window puts an event into the bucket whose number is its time over the
    window's length, rounded half to even; with ``floor_buckets``, rounded down. Windows
    decide what is joined; groups are those of the match fields alone. A placeholder
    that an event lacks joins with nothing, and forms a group of its own.
    """
    return Compiler(rule, events, schema or Schema.builtin(), parameters or {}, lists, floor_buckets).compile()


def run_rule(
    text: str, spark: SparkSession, schema: Schema | None = None, parameters: dict[str, str] | None = None, events: DataFrame | View | str = EVENTS
) -> DataFrame:
    """The detections of a rule's text over the loaded events, or any event relation."""
    relation = spark.table(events) if isinstance(events, str) else events
    return compile_rule(parse_rule(text), relation, schema, parameters, lambda n, c: list_values(spark, n, c))


def rule_response(text: str, spark: SparkSession, schema: Schema | None = None, parameters: dict[str, str] | None = None) -> dict:
    """The detections of a rule's text as plain data."""
    return result_response(run_rule(text, spark, schema, parameters))
