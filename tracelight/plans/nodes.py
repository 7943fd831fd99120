"""What queries and rules are made of."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Key:
    """A step ``["text"]`` of a path."""

    text: str


@dataclass(frozen=True)
class Path:
    """A field: names, list indexes and keys, and the event variable it belongs to (``$e.`` in front), if any."""

    steps: tuple[Any, ...]
    variable: str | None = None

    @property
    def alias(self) -> str:
        return "_".join(s.text if isinstance(s, Key) else str(s) for s in self.steps)


@dataclass(frozen=True)
class Placeholder:
    name: str


@dataclass(frozen=True)
class ListColumn:
    """A reference list's column, ``%list.column``."""

    name: str
    column: str | None


@dataclass(frozen=True)
class Value:
    """A literal. Kinds: string, regex, number, boolean, bare (an unquoted word) and template (``${name}``)."""

    value: Any
    kind: str


@dataclass(frozen=True)
class Call:
    name: str
    arguments: tuple[Any, ...]


@dataclass(frozen=True)
class Comparison:
    left: Any
    op: str
    right: Any
    nocase: bool = False
    #: written ``any``; elements of repeated fields are compared so in any case
    any_element: bool = False


@dataclass(frozen=True)
class All:
    terms: tuple[Any, ...]


@dataclass(frozen=True)
class Either:
    terms: tuple[Any, ...]


@dataclass(frozen=True)
class Not:
    term: Any


@dataclass(frozen=True)
class Assignment:
    name: str
    value: Any


@dataclass(frozen=True)
class Grain:
    unit: str
    quantity: int = 1
    first: bool = False
    #: before or after, and the event variable that the window is relative to
    direction: str | None = None
    pivot: str | None = None


@dataclass(frozen=True)
class MatchItem:
    value: Any
    grain: Grain | None = None


@dataclass(frozen=True)
class OrderItem:
    value: Any
    descending: bool = False


@dataclass(frozen=True)
class Query:
    events: tuple[Any, ...] = ()
    match: tuple[MatchItem, ...] = ()
    outcome: tuple[Assignment, ...] = ()
    dedup: tuple[Any, ...] = ()
    order: tuple[OrderItem, ...] = ()
    limit: int | None = None

    @property
    def placeholders(self) -> dict[str, Any]:
        """Of each placeholder that the events section defines, what it stands for."""
        return {e.name: e.value for e in self.events if isinstance(e, Assignment)}

    @property
    def condition(self) -> Any | None:
        """All conditions of the events section together."""
        terms = tuple(e for e in self.events if not isinstance(e, Assignment))
        return None if not terms else terms[0] if len(terms) == 1 else All(terms)


@dataclass(frozen=True)
class EventSeen:
    """``$e`` in a rule's condition: the event variable has an event."""

    name: str


@dataclass(frozen=True)
class EventCount:
    """``#e`` in a rule's condition: how many distinct events the variable has."""

    name: str


@dataclass(frozen=True)
class Rule:
    name: str
    condition: Any
    meta: dict[str, Any] = field(default_factory=dict)
    events: tuple[Any, ...] = ()
    match: tuple[MatchItem, ...] = ()
    outcome: tuple[Assignment, ...] = ()
    options: dict[str, Any] = field(default_factory=dict)
