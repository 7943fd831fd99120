"""Conditions of queries and rules as boolean columns, with SQL's three-valued logic."""

from __future__ import annotations

import operator
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelight.errors import CompileError
from tracelight.functions.paths import asked_of, exists, single, texts_of
from tracelight.functions.schema import Field, Schema
from tracelight.functions.values import Node, literal_as, literal_text
from tracelight.plans.nodes import All, Call, Comparison, Either, ListColumn, Not, Path, Placeholder, Value

OPERATORS: dict[str, Callable[[Any, Any], Column]] = {
    "=": operator.eq, "!=": operator.ne, "<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge,
}


@dataclass
class Context:
    """What names mean while a query or rule is compiled."""

    schema: Schema
    #: the document of an event
    base: Node
    placeholders: dict[str, Any] = field(default_factory=dict)
    parameters: dict[str, str] = field(default_factory=dict)
    #: values of a reference list's column, or a table of them where they are many
    list_values: Callable[[str, str | None], Sequence[str] | DataFrame] = lambda name, column: ()
    #: the events that a condition is put to
    rows: DataFrame | None = None

    def holding(self, rows: DataFrame, asked: Any) -> DataFrame:
        """The rows that a condition holds for."""
        self.rows = rows
        return rows.where(condition(asked, self))


@dataclass
class Operand:
    """One side of a comparison that isn't asked of a field's elements: a literal or a single value."""

    literal: Any = None
    value: Node | None = None
    field: Field | None = None

    def cast(self, kind: str) -> Column:
        return literal_as(self.literal, kind) if self.value is None else self.value.cast(kind)

    def text(self) -> Column:
        return F.lit(literal_text(self.literal)) if self.value is None else self.value.text()

    def typed(self) -> Column:
        return self.cast(self.field.kind if self.field else "string")


def literal_value(x: Value, context: Context) -> Any:
    if x.kind == "template":
        if x.value not in context.parameters:
            raise CompileError(f"no value for the template variable ${{{x.value}}}")
        return str(context.parameters[x.value])
    if x.kind == "regex":
        raise CompileError("a regular expression is compared with a field, by = or !=")
    return x.value


def operand(x: Any, context: Context) -> Operand:
    if isinstance(x, Value):
        return Operand(literal=literal_value(x, context))
    if isinstance(x, Placeholder):
        if x.name not in context.placeholders:
            raise CompileError(f"undefined placeholder ${x.name}")
        return operand(context.placeholders[x.name], context)
    if isinstance(x, Path):
        value, found = single(x, context.schema, context.base)
        return Operand(value=value, field=found)
    if isinstance(x, Call):
        raise CompileError(f"the function {x.name!r} is not supported in conditions")
    raise CompileError(f"a {type(x).__name__} is no value")


def check_enum(found: Field | None, other: Any, schema: Schema) -> None:
    """A text that is compared with an enum is one of its members, or empty (whether the field is set)."""
    if found is None or not found.enum or not isinstance(other, Value) or other.kind not in ("string", "bare") or other.value == "":
        return
    members = schema.enum_values(found.type)
    if members is not None and other.value not in members:
        raise CompileError(f"{other.value!r} is no value of the enum {found.type} (field {found.path!r})")


def comparison(x: Comparison, context: Context) -> Column:
    if x.op == "in":
        return in_list(x, context)
    for side, other in ((x.right, x.left), (x.left, x.right)):
        if isinstance(side, Value) and side.kind == "regex":
            return matches(side, other, x, context)
    compare = OPERATORS[x.op]
    asked, other = (x.left, x.right) if isinstance(x.left, Path) else (x.right, x.left)
    if not isinstance(asked, Path):
        left, right = operand(x.left, context), operand(x.right, context)
        if x.nocase:
            return compare(F.lower(left.text()), F.lower(right.text()))
        found = left.field or right.field
        kind = found.kind if found else "string"
        return compare(left.cast(kind), right.cast(kind))
    against = operand(other, context)

    def leaf(value: Node, found: Field | None) -> Column:
        check_enum(found, other, context.schema)
        if x.nocase:
            own, theirs = F.lower(value.text()), F.lower(against.text())
        else:
            own = value.cast(found.kind if found else "string")
            known = found or against.field
            theirs = against.cast(known.kind if known else "string")
        return compare(own, theirs) if asked is x.left else compare(theirs, own)

    return asked_of(asked, context.schema, context.base, leaf)


def matches(pattern: Value, asked: Any, x: Comparison, context: Context) -> Column:
    """A regular expression found anywhere in a field's text; with ``!=``, an element that it isn't found in."""
    if not isinstance(asked, Path):
        raise CompileError("a regular expression is compared with a field")
    expression = ("(?i)" if x.nocase else "") + pattern.value

    def leaf(value: Node, found: Field | None) -> Column:
        hit = value.text().rlike(expression)
        return ~hit if x.op == "!=" else hit

    return asked_of(asked, context.schema, context.base, leaf)


def in_list(x: Comparison, context: Context) -> Column:
    if not isinstance(x.right, ListColumn):
        raise CompileError("in takes a reference list, %list.column, on its right")
    if not isinstance(x.left, Path):
        raise CompileError("in takes a field on its left")
    # without a column nothing is in the list
    values = context.list_values(x.right.name, x.right.column) if x.right.column else ()

    def text(value: Node, found: Field | None) -> Column:
        return value.cast(found.kind if found else "string").cast("string")

    if isinstance(values, DataFrame):
        return in_table(x.left, values, text, context)
    listed = list(values)

    def leaf(value: Node, found: Field | None) -> Column:
        return F.coalesce(text(value, found).isin(listed), F.lit(False)) if listed else F.lit(False)

    return asked_of(x.left, context.schema, context.base, leaf)


def in_table(asked: Path, values: DataFrame, text: Callable[[Node, Field | None], Column], context: Context) -> Column:
    """Whether a value of the field is in the one column of ``values``: a semi-join, so that a list of any size stays on the executors.

    Of a field with several values, the distinct arrays that hold a listed one are found by a join on their elements.
    """
    texts, several = texts_of(asked, context.schema, context.base, text)
    if not several:
        return F.coalesce(texts[0].isin(values), F.lit(False))
    if context.rows is None:
        raise CompileError("a large reference list is asked of events only")
    whole = F.array_distinct(texts)
    [name] = values.columns
    arrays = context.rows.select(whole.alias("held")).distinct().select("held", F.explode("held").alias("one"))
    hits = arrays.join(values, F.col("one") == values[name], "left_semi").select("held").distinct()
    return F.coalesce(whole.isin(hits), F.lit(False))


def condition(x: Any, context: Context) -> Column:
    if isinstance(x, All):
        return reduce(operator.and_, [condition(t, context) for t in x.terms])
    if isinstance(x, Either):
        return reduce(operator.or_, [condition(t, context) for t in x.terms])
    if isinstance(x, Not):
        return ~condition(x.term, context)
    if isinstance(x, Comparison):
        return comparison(x, context)
    if isinstance(x, Path):
        return asked_of(x, context.schema, context.base, exists)
    raise CompileError(f"a {type(x).__name__} is no condition")
