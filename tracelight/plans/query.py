"""Search queries: text to ``Query``.

Sections come in the order events, match, outcome, dedup, order, limit; the
events header may be left out. In the events section, conditions that follow
one another, on lines of their own or after a blank, are joined by AND.
Ordered choice decides where a text could be read in several ways: the right
side of a comparison is a literal (also an unquoted word with points) before it
is a field, and ``$x = field`` is an assignment where ``$x = "text"`` is a condition.
"""

from __future__ import annotations

import re
from typing import Any

from tracelight.errors import QueryError
from tracelight.plans.nodes import (
    All, Assignment, Call, Comparison, Either, Grain, Key, ListColumn, MatchItem, Not, OrderItem, Path, Placeholder, Query, Value,
)
from tracelight.plans.scanner import Miss, Scanner

BLANK = r"//[^\n]*|/\*(?s:.*?)\*/|\s"
IDENT = r"[A-Za-z_][A-Za-z0-9_]*"
SECTIONS = "events|match|outcome|dedup|order|limit|condition|meta|options"
#: Unit words and what they stand for.
UNITS = {
    "m": "minute", "min": "minute", "mins": "minute", "minute": "minute", "minutes": "minute",
    "h": "hour", "hr": "hour", "hrs": "hour", "hour": "hour", "hours": "hour",
    "d": "day", "day": "day", "days": "day",
    "w": "week", "wk": "week", "wks": "week", "week": "week", "weeks": "week",
    "mo": "month", "mos": "month", "month": "month", "months": "month",
}


def unescape(text: str) -> str:
    """A quoted string's text: a backslash stands before a quote or another backslash, and for itself elsewhere."""
    out, i = [], 0
    while i < len(text):
        if text[i] == "\\" and text[i + 1 : i + 2] in ('"', "\\") and i + 1 < len(text):
            i += 1
        out.append(text[i])
        i += 1
    return "".join(out)


class QueryReader(Scanner):
    def __init__(self, text: str, problem=QueryError):
        super().__init__(text, BLANK, problem)

    # tokens

    def word(self, *words: str) -> str:
        """A keyword, in any case, that no further letter, digit or underscore follows."""
        return self.take(rf"(?i:{'|'.join(words)})(?![A-Za-z0-9_])").lower()

    def symbol(self, text: str) -> None:
        self.take(re.escape(text))

    def header(self, name: str) -> None:
        self.skip()
        self.word(name)
        self.skip()
        self.symbol(":")
        self.skip()

    def no_header(self) -> None:
        if self.peek(rf"(?i:{SECTIONS})(?![A-Za-z0-9_])(?:{BLANK})*:"):
            raise Miss("a section begins")

    def line_gap(self) -> None:
        """What stands between two items on lines of their own: blanks with a line break among them."""
        at = self.at
        self.skip()
        if "\n" not in self.text[at : self.at]:
            self.at = at
            raise Miss("line break")
        self.no_header()

    def item_gap(self) -> None:
        """A comma or a line break."""

        def comma() -> None:
            self.skip()
            self.symbol(",")
            self.skip()
            self.no_header()

        self.first_of(comma, self.line_gap)

    def statement_gap(self) -> None:
        """A line break or just blanks."""

        def blanks() -> None:
            self.take(r"[ \t\r]+")
            self.no_header()

        self.first_of(self.line_gap, blanks)

    # literals, fields and calls

    def literal(self) -> Value:
        return self.first_of(
            lambda: Value(self.take(r"\$\{[A-Za-z_][A-Za-z0-9_]*\}")[2:-1], "template"),
            lambda: Value(self.string(), "string"),
            lambda: Value(self.take(r"/(?:\\.|[^/\\])+/")[1:-1].replace("\\/", "/"), "regex"),
            self.number,
            lambda: Value(self.word("true", "false") == "true", "boolean"),
            lambda: Value(self.take(r"[A-Za-z0-9_][A-Za-z0-9_.\-]*"), "bare"),
        )

    def string(self) -> str:
        return unescape(self.take(r'"(?:\\.|[^"\\])*"')[1:-1])

    def number(self) -> Value:
        text = self.take(r"-?[0-9]+(?:\.[0-9]+)?(?![A-Za-z0-9_.])")
        return Value(float(text) if "." in text else int(text), "number")

    def placeholder(self) -> Placeholder:
        return Placeholder(self.take(rf"\${IDENT}(?!\.)(?![A-Za-z0-9_])")[1:])

    def list_column(self) -> ListColumn:
        parts = self.take(rf"%{IDENT}(?:\.{IDENT})*")[1:].split(".")
        return ListColumn(parts[0], parts[1] if len(parts) > 1 else None)

    def path(self) -> Path:
        owner = self.maybe(lambda: self.take(rf"\${IDENT}\."))
        steps: list[Any] = [self.take(IDENT)]
        while True:
            step = self.maybe(self.step)
            if step is None:
                return Path(tuple(steps), owner[1:-1] if owner else None)
            steps.append(step[0])

    def step(self) -> tuple[Any]:
        def bracket() -> tuple[Any]:
            self.symbol("[")
            self.skip()
            inner = self.first_of(lambda: Key(self.string()), lambda: int(self.take("[0-9]+")))
            self.skip()
            self.symbol("]")
            return (inner,)

        return self.first_of(lambda: (self.take(rf"\.{IDENT}")[1:],), bracket)

    def call(self) -> Call:
        name = self.take(rf"{IDENT}(?:\.{IDENT})*\(")[:-1].lower()
        self.skip()

        def comma() -> None:
            self.skip()
            self.symbol(",")
            self.skip()

        arguments = self.maybe(lambda: self.many(self.expression, comma)) or []
        self.skip()
        self.symbol(")")
        return Call(name, tuple(arguments))

    def expression(self) -> Any:
        """What an outcome is assigned, and what a function takes: a condition is tried before a bare value."""
        return self.first_of(self.call, self.either, self.list_column, self.placeholder, self.path, self.literal)

    # conditions

    def either(self) -> Any:
        return self.joined(self.every, "or", Either)

    def every(self) -> Any:
        return self.joined(self.unary, "and", All)

    def joined(self, term, word: str, kind) -> Any:
        def gap() -> None:
            self.skip()
            self.word(word)
            self.skip()

        terms = self.many(term, gap)
        return terms[0] if len(terms) == 1 else kind(tuple(terms))

    def unary(self) -> Any:
        def negated() -> Any:
            self.word("not")
            self.skip()
            return Not(self.unary())

        def group() -> Any:
            self.symbol("(")
            self.skip()
            inner = self.either()
            self.skip()
            self.symbol(")")
            return inner

        return self.first_of(negated, group, self.comparison, self.path)

    def comparison(self) -> Comparison:
        quantified = self.maybe(lambda: (self.word("any"), self.skip()))
        left = self.first_of(self.call, self.placeholder, self.path, self.literal)
        self.skip()
        op = self.operator()
        self.skip()
        right = self.first_of(self.call, self.list_column, self.placeholder, self.literal, self.path)
        nocase = self.maybe(lambda: (self.skip(), self.word("nocase")))
        return Comparison(left, op, right, nocase is not None, quantified is not None)

    def operator(self) -> str:
        return self.take(r"<=|>=|!=|=|<|>|(?i:in)(?![A-Za-z0-9_])").lower()

    # sections

    def statement(self) -> Any:
        def assignment() -> Assignment:
            name = self.placeholder().name
            self.skip()
            self.symbol("=")
            self.skip()
            return Assignment(name, self.first_of(self.call, self.path))

        return self.first_of(assignment, self.either)

    def statements(self) -> tuple[Any, ...]:
        return tuple(self.many(self.statement, self.statement_gap))

    def match_section(self) -> tuple[MatchItem, ...]:
        self.header("match")
        return tuple(self.many(self.match_item, self.item_gap))

    def match_item(self) -> MatchItem:
        value = self.first_of(self.placeholder, self.path)
        return MatchItem(value, self.maybe(self.grain))

    def grain(self) -> Grain:
        self.skip()
        if self.word("over", "by") == "over":
            self.maybe(lambda: (self.skip(), self.word("every")))
        self.skip()
        first = self.maybe(lambda: (self.word("first"), self.skip()))
        quantity = self.maybe(lambda: self.take("[0-9]+"))
        self.skip()
        unit = UNITS[self.word(*sorted(UNITS, key=len, reverse=True))]

        def anchor() -> tuple[str, str]:
            self.skip()
            direction = self.word("before", "after")
            self.skip()
            return direction, self.placeholder().name

        direction, pivot = self.maybe(anchor) or (None, None)
        return Grain(unit, int(quantity or 1), first is not None, direction, pivot)

    def outcome_section(self) -> tuple[Assignment, ...]:
        self.header("outcome")

        def item() -> Assignment:
            name = self.placeholder().name
            self.skip()
            self.symbol("=")
            self.skip()
            return Assignment(name, self.expression())

        return tuple(self.many(item, self.item_gap))

    def dedup_section(self) -> tuple[Any, ...]:
        self.header("dedup")
        return tuple(self.many(lambda: self.first_of(self.placeholder, self.path), self.item_gap))

    def order_section(self) -> tuple[OrderItem, ...]:
        self.header("order")

        def item() -> OrderItem:
            value = self.first_of(self.placeholder, self.path)
            direction = self.maybe(lambda: (self.skip(), self.word("asc", "desc")))
            return OrderItem(value, direction is not None and direction[1] == "desc")

        return tuple(self.many(item, self.item_gap))

    def limit_section(self) -> int:
        self.header("limit")
        return int(self.take("[0-9]+"))

    def query(self) -> Query:
        self.skip()

        def events() -> tuple[Any, ...]:
            self.maybe(lambda: self.header("events"))
            self.no_header()
            return self.statements()

        return Query(
            self.maybe(events) or (),
            self.maybe(self.match_section) or (),
            self.maybe(self.outcome_section) or (),
            self.maybe(self.dedup_section) or (),
            self.maybe(self.order_section) or (),
            self.maybe(self.limit_section),
        )


def parse(text: str) -> Query:
    """The query that a text holds; ``QueryError`` where it can't be read."""
    reader = QueryReader(text)
    return reader.whole(reader.query)
