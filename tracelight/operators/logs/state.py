"""The state that a parser program works on: one nested dictionary per message."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from functools import lru_cache
from typing import Any

from tracelight.errors import ExecutionError

#: What a place in the state holds where nothing was ever put.
UNSET = object()
REFERENCE = re.compile(r"%\{([^}]+)\}")


class Failure(Exception):
    """A plugin that couldn't do its work; ``on_error`` catches it."""


class State(dict):
    """Places are tuples of names; ``a.b`` is ``("a", "b")``."""

    dropped = False

    def find(self, place: Sequence[str]) -> Any:
        here: Any = self
        for name in place:
            if not isinstance(here, dict) or name not in here:
                return UNSET
            here = here[name]
        return here

    def need(self, place: Sequence[str]) -> Any:
        """What a place holds. Reading one that was never set ends the program, ``on_error`` or not."""
        found = self.find(place)
        if found is UNSET:
            raise ExecutionError(f"the field {'.'.join(place)} is not set; give it a value first, for example by replace")
        return found

    def need_text(self, place: Sequence[str], plugin: str) -> str:
        found = self.need(place)
        if not isinstance(found, str):
            raise Failure(f"the {plugin} source {'.'.join(place)!r} is not a text")
        return found

    def put(self, place: Sequence[str], value: Any) -> None:
        """Sets a place; what stands in its way and is no dictionary is replaced by one."""
        here: dict = self
        for name in place[:-1]:
            if not isinstance(here.get(name), dict):
                here[name] = {}
            here = here[name]
        here[place[-1]] = value

    def remove(self, place: Sequence[str]) -> None:
        parent = self.find(place[:-1])
        if isinstance(parent, dict):
            parent.pop(place[-1], None)

    def filled(self, text: str) -> str:
        """A text with each ``%{a.b}`` or ``%{[a][b]}`` replaced by what is there; one with nothing there stays."""
        return "".join([x if isinstance(x, str) else self.written(*x) for x in references(text)]) if "%{" in text else text

    def written(self, reference: str, place: Sequence[str]) -> str:
        value = self.find(place)
        if isinstance(value, str):
            return value
        if value is UNSET:
            return reference
        if isinstance(value, bool):
            return str(value).lower()
        return json.dumps(value) if isinstance(value, (dict, list)) else str(value)


@lru_cache(maxsize=4096)
def references(text: str) -> tuple[str | tuple[str, tuple[str, ...]], ...]:
    """A text's references, each with the place it names, and what stands between them."""
    out: list[str | tuple[str, tuple[str, ...]]] = []
    at = 0
    for m in REFERENCE.finditer(text):
        name = m[1]
        out += text[at : m.start()], (m[0], tuple(re.findall(r"\[([^\]]+)\]", name) if name.startswith("[") else name.split(".")))
        at = m.end()
    return tuple(x for x in (*out, text[at:]) if x)


@lru_cache(maxsize=4096)
def place_of(name: str) -> tuple[str, ...]:
    return tuple(name.split("."))


def place(name: Any) -> tuple[str, ...]:
    return place_of(str(name))


def copied(value: Any) -> Any:
    """A copy of a value that shares nothing that can change with it."""
    if isinstance(value, dict):
        return {k: copied(v) for k, v in value.items()}
    if isinstance(value, list):
        return [copied(v) for v in value]
    return value
