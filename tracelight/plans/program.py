"""Parser programs: the text of ``filter { … }`` to ``Program``.

Statements are plugin calls, ``if`` and ``for``. Keywords are lower case, ``#``
begins a comment, hashes take ``=>`` or ``:`` and no commas, arrays take commas.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

from tracelight.errors import ProgramError
from tracelight.plans.nodes import All, Comparison, Either, Not, Value
from tracelight.plans.scanner import Miss, Scanner

IDENT = r"[A-Za-z_][A-Za-z0-9_]*"
BARE = r"[A-Za-z_@][A-Za-z0-9_.@]*"
PLUGINS = ("grok", "json", "kv", "csv", "mutate", "date", "base64", "drop", "statedump")
MUTATIONS = ("rename", "replace", "convert", "gsub", "uppercase", "lowercase", "split", "merge", "copy", "remove_field")


@dataclass(frozen=True)
class Ref:
    """``[a][b]``: a place in the state."""

    steps: tuple[str, ...]


@dataclass(frozen=True)
class Plugin:
    name: str
    arguments: dict[str, Any]


@dataclass(frozen=True)
class If:
    test: Any
    then: tuple[Any, ...]
    otherwise: tuple[Any, ...] = ()


@dataclass(frozen=True)
class For:
    names: tuple[str, ...]
    over: str
    of_map: bool
    body: tuple[Any, ...]


@dataclass(frozen=True)
class Program:
    statements: tuple[Any, ...]


class ProgramReader(Scanner):
    def __init__(self, text: str):
        super().__init__(text, r"#[^\n]*|\s", ProgramError)

    def word(self, *words: str) -> str:
        return self.take(rf"(?:{'|'.join(words)})(?![A-Za-z0-9_])")

    def mark(self, text: str) -> None:
        """A symbol, with blanks around it."""
        self.skip()
        self.take(re.escape(text))
        self.skip()

    def program(self) -> Program:
        self.skip()
        self.word("filter")
        return Program(self.block())

    def block(self) -> tuple[Any, ...]:
        self.mark("{")
        found = []
        while (s := self.maybe(self.statement)) is not None:
            found.append(s)
            self.skip()
        self.mark("}")
        return tuple(found)

    def statement(self) -> Any:
        return self.first_of(self.branch, self.loop, self.plugin)

    def branch(self) -> If:
        self.word("if")
        self.skip()
        test = self.either()
        then = self.block()

        def otherwise() -> tuple[Any, ...]:
            self.word("else")
            self.skip()
            return self.first_of(lambda: (self.branch(),), self.block)

        return If(test, then, self.maybe(otherwise) or ())

    def loop(self) -> For:
        self.word("for")
        self.skip()
        names = tuple(self.many(lambda: self.take(IDENT), lambda: self.mark(",")))
        if len(names) > 2:
            raise Miss("two names at most")
        self.skip()
        self.word("in")
        self.skip()
        if self.peek(r"xml(?![A-Za-z0-9_])(?:#[^\n]*|\s)*\("):
            raise ProgramError("loops over xml() are not supported")
        over = self.take(IDENT)
        self.skip()
        of_map = self.maybe(lambda: self.word("map")) is not None
        return For(names, over, of_map, self.block())

    def plugin(self) -> Plugin:
        name = self.take(IDENT)
        self.mark("{")
        arguments = {}

        def pair() -> tuple[str, Any]:
            key = self.take(IDENT)
            self.mark("=>")
            return key, self.value()

        while (p := self.maybe(pair)) is not None:
            arguments[p[0]] = p[1]
            self.skip()
        self.mark("}")
        return Plugin(name, arguments)

    # values

    def value(self) -> Any:
        # each choice is wrapped, as a value may be false or empty
        return self.first_of(lambda: (self.array(),), lambda: (self.hash(),), self.scalar, lambda: (self.take(BARE),))[0]

    def scalar(self) -> tuple[Any]:
        return self.first_of(lambda: (self.string(),), lambda: (self.word("true", "false") == "true",), lambda: (self.number(),))

    def array(self) -> list[Any]:
        self.take(r"\[")
        self.skip()
        found = self.maybe(lambda: self.many(self.value, lambda: self.mark(","))) or []
        self.skip()
        self.take(r"\]")
        return found

    def hash(self) -> dict[str, Any]:
        self.take(r"\{")
        self.skip()

        def pair() -> tuple[str, Any]:
            key = self.first_of(self.string, lambda: self.take(BARE))
            self.skip()
            self.take("=>|:")
            self.skip()
            return key, self.value()

        found = {}
        while (p := self.maybe(pair)) is not None:
            found[p[0]] = p[1]
            self.skip()
        self.take(r"\}")
        return found

    def string(self) -> str:
        """Quoted either way. A backslash stands before the quote or another backslash, and for itself elsewhere."""
        text = self.take(r'"(?:\\.|[^"\\])*"|\'(?:\\.|[^\'\\])*\'')
        return re.sub(rf"\\([\\{text[0]}])", r"\1", text[1:-1])

    def number(self) -> int | float:
        text = self.take(r"-?[0-9]+(?:\.[0-9]+)?")
        return float(text) if "." in text else int(text)

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
        def negated() -> Not:
            self.take("!")
            self.skip()
            return Not(self.unary())

        def group() -> Any:
            self.mark("(")
            inner = self.either()
            self.mark(")")
            return inner

        return self.first_of(negated, group, self.comparison, self.ref)

    def comparison(self) -> Comparison:
        left = self.operand()
        self.skip()
        op = self.take(r"=~|!~|==|!=|<=|>=|<|>|in(?![A-Za-z0-9_])")
        self.skip()
        return Comparison(left, op, self.operand())

    def operand(self) -> Any:
        return self.first_of(self.ref, lambda: Value(self.scalar()[0], "scalar"), lambda: Value(self.array(), "array"))

    def ref(self) -> Ref:
        def step() -> str:
            self.take(r"\[")
            self.skip()
            name = self.first_of(self.string, lambda: self.take(BARE))
            self.skip()
            self.take(r"\]")
            return name

        return Ref(tuple(self.many(step, lambda: None)))


def check(statements: tuple[Any, ...]) -> None:
    """Plugins and mutations that don't exist are found before anything runs."""
    for s in statements:
        if isinstance(s, If):
            check(s.then)
            check(s.otherwise)
        elif isinstance(s, For):
            check(s.body)
        elif s.name == "xml":
            raise ProgramError("the xml plugin is not supported")
        elif s.name not in PLUGINS:
            raise ProgramError(f"unknown plugin {s.name!r}")
        elif s.name == "mutate":
            for op in s.arguments:
                if op != "on_error" and op not in MUTATIONS:
                    raise ProgramError(f"unknown mutate operation {op!r}")


def parse_program(text: str) -> Program:
    """The program that a text holds; ``ProgramError`` where it can't be read or uses what doesn't exist."""
    reader = ProgramReader(text)
    made = reader.whole(reader.program)
    check(made.statements)
    return made
