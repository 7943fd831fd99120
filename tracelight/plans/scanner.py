"""A cursor over a text for recursive-descent parsers with ordered choice."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache
from typing import TypeVar

from tracelight.errors import SyntaxProblem

T = TypeVar("T")


class Miss(Exception):
    """The text at the cursor isn't what a parser function reads; the caller may try something else."""


@lru_cache(maxsize=512)
def compiled(pattern: str) -> re.Pattern:
    return re.compile(pattern)


class Scanner:
    """Position in a text. ``blank`` is a pattern for what may stand between tokens."""

    def __init__(self, text: str, blank: str, problem: type[SyntaxProblem]):
        self.text, self.blank, self.problem = text, compiled(f"(?:{blank})*"), problem
        self.at = 0
        self.furthest = 0

    def skip(self) -> None:
        self.at = self.blank.match(self.text, self.at).end()

    def peek(self, pattern: str) -> bool:
        return compiled(pattern).match(self.text, self.at) is not None

    def take(self, pattern: str) -> str:
        """The text that the pattern matches at the cursor, which moves behind it; else a miss."""
        m = compiled(pattern).match(self.text, self.at)
        if not m:
            self.furthest = max(self.furthest, self.at)
            raise Miss(pattern)
        self.at = m.end()
        return m[0]

    def maybe(self, read: Callable[[], T]) -> T | None:
        """What ``read`` returns, or none and the cursor where it was."""
        at = self.at
        try:
            return read()
        except Miss:
            self.furthest = max(self.furthest, self.at)
            self.at = at
            return None

    def first_of(self, *reads: Callable[[], T]) -> T:
        """What the first of several functions returns that doesn't miss."""
        for read in reads:
            at = self.at
            try:
                return read()
            except Miss:
                self.furthest = max(self.furthest, self.at)
                self.at = at
        raise Miss("no choice fits")

    def many(self, item: Callable[[], T], gap: Callable[[], object]) -> list[T]:
        """One item, and more of them as long as ``gap`` and another item follow."""
        found = [item()]
        while True:
            more = self.maybe(lambda: (gap(), item()))
            if more is None:
                return found
            found.append(more[1])

    def whole(self, read: Callable[[], T]) -> T:
        """What ``read`` makes of the whole text; anything left over, or a miss, is a syntax problem."""
        try:
            made = read()
            self.skip()
            if self.at < len(self.text):
                raise Miss("end")
            return made
        except Miss:
            place = max(self.furthest, self.at)
            before = self.text[:place]
            near = self.text[place : place + 30].split("\n")[0]
            raise self.problem(
                f"can't read {near!r}" if near else "the text ends too early", before.count("\n") + 1, place - (before.rfind("\n") + 1) + 1
            ) from None
