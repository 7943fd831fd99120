"""Detection rules: text to ``Rule``.

``rule name { meta: events: match: outcome: condition: options: }``, in this
order; only the condition is required. Sections that queries have, too, are
read as in queries.
"""

from __future__ import annotations

from typing import Any

from tracelight.errors import RuleError
from tracelight.plans.nodes import All, Comparison, Either, EventCount, EventSeen, Not, Placeholder, Rule
from tracelight.plans.query import IDENT, QueryReader


class RuleReader(QueryReader):
    def __init__(self, text: str):
        super().__init__(text, RuleError)

    def settings(self, section: str) -> dict[str, Any]:
        self.header(section)

        def item() -> tuple[str, Any]:
            name = self.take(IDENT)
            self.skip()
            self.symbol("=")
            self.skip()
            return name, self.literal().value

        return dict(self.many(item, self.statement_gap))

    def events_section(self) -> tuple[Any, ...]:
        self.header("events")
        return self.statements()

    def condition_section(self) -> Any:
        self.header("condition")
        return self.holds()

    def holds(self) -> Any:
        return self.joined(lambda: self.joined(self.holds_unary, "and", All), "or", Either)

    def holds_unary(self) -> Any:
        def negated() -> Any:
            self.first_of(lambda: self.symbol("!"), lambda: self.word("not"))
            self.skip()
            return Not(self.holds_unary())

        def group() -> Any:
            self.symbol("(")
            self.skip()
            inner = self.holds()
            self.skip()
            self.symbol(")")
            return inner

        def compared() -> Comparison:
            left = self.operand()
            self.skip()
            op = self.operator()
            self.skip()
            return Comparison(left, op, self.operand())

        return self.first_of(negated, group, compared, self.count, lambda: EventSeen(self.placeholder().name))

    def count(self) -> EventCount:
        return EventCount(self.take(rf"#{IDENT}")[1:])

    def operand(self) -> EventCount | Placeholder | Any:
        return self.first_of(self.count, self.placeholder, self.literal)

    def rule(self) -> Rule:
        self.skip()
        self.word("rule")
        self.skip()
        name = self.take(IDENT)
        self.skip()
        self.symbol("{")
        self.skip()
        meta = self.maybe(lambda: self.settings("meta")) or {}
        events = self.maybe(self.events_section) or ()
        match = self.maybe(self.match_section) or ()
        outcome = self.maybe(self.outcome_section) or ()
        condition = self.condition_section()
        options = self.maybe(lambda: self.settings("options")) or {}
        self.skip()
        self.symbol("}")
        return Rule(name, condition, meta, events, match, outcome, options)


def parse_rule(text: str) -> Rule:
    """The rule that a text holds; ``RuleError`` where it can't be read, or has no condition."""
    reader = RuleReader(text)
    return reader.whole(reader.rule)
