"""Search queries as lazy DataFrames over an event relation."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelight.errors import CompileError
from tracelight.functions.aggregates import aggregate
from tracelight.functions.conditions import Context, operand
from tracelight.functions.schema import Schema
from tracelight.plans.nodes import Call, OrderItem, Path, Placeholder, Query, Value
from tracelight.plans.query import parse
from tracelight.sources.events import EVENTS, View, list_values, viewed
from tracelight.sources.responses import event_response, result_response


#: The column of an event's place among those with the same dedup fields.
PLACE = "place of the event"


def named(x: Any, context: Context) -> tuple[Column, str]:
    """A placeholder or field as a typed column, and its name."""
    if not isinstance(x, (Placeholder, Path)):
        raise CompileError(f"a {type(x).__name__} can't stand here")
    return operand(x, context).typed(), x.name if isinstance(x, Placeholder) else x.alias


def ordering(column: Column, item: OrderItem) -> Column:
    return column.desc_nulls_last() if item.descending else column.asc_nulls_last()


def compile_query(
    query: Query,
    events: DataFrame | View,
    schema: Schema | None = None,
    parameters: dict[str, str] | None = None,
    lists: Callable[[str, str | None], Sequence[str] | DataFrame] | None = None,
) -> DataFrame:
    """The query's result over an event relation, ``name``, ``event`` and ``v`` (a variant) or ``doc`` (a struct).

    Without match and outcome: ``name`` and ``event`` of the events that the
    conditions hold for, one per combination of the dedup fields, the first in the
    query's order, then by name. Else: a row per combination of the match
    fields with the outcomes, or the combinations alone; outcomes without match are one row of
    aggregates, or a row per event where none is an aggregate.
    """
    view = viewed(events)
    context = Context(schema or Schema.builtin(), view.document, query.placeholders, parameters or {})
    if lists is not None:
        context.list_values = lists
    rows = view.rows if query.condition is None else context.holding(view.rows, query.condition)
    if query.match or query.outcome:
        return grouped(query, rows, context)
    orders = [ordering(named(o.value, context)[0], o) for o in query.order]
    if query.dedup:
        keys = [named(d, context)[0] for d in query.dedup]
        rows = first_of_each(query, rows, view, keys, context)
    if orders:
        rows = rows.orderBy(*orders)
    rows = rows.select(view.name.alias("name"), view.event.alias("event"))
    return rows if query.limit is None else rows.limit(query.limit)


def rank(column: Column, kind: T.DataType, descending: bool) -> Column | None:
    """A value whose rising order is the column's rising or falling one, nulls last; none for what can't be turned round."""
    if descending:
        match kind:
            case T.TimestampType():
                turned = F.bitwise_not(F.unix_micros(column))
            case T.ByteType() | T.ShortType() | T.IntegerType() | T.LongType():
                turned = F.bitwise_not(column)
            case T.DateType():
                turned = F.bitwise_not(F.unix_date(column))
            case T.BooleanType():
                turned = ~column
            case T.FloatType() | T.DoubleType():
                # not a number is above all others
                turned = F.struct(~F.isnan(column), -column)
            case _:
                return None
        return F.struct(column.isNull(), turned)
    return F.struct(column.isNull(), column)


def first_of_each(query: Query, rows: DataFrame, view: View, keys: list[Column], context: Context) -> DataFrame:
    """One event per combination of the keys, the first in the query's order, then by name (and text, where names repeat).

    A minimum, which is found before rows are shuffled, so that a frequent combination is no task of its own;
    only texts in falling order take a window.
    """
    values = [named(o.value, context)[0] for o in query.order]
    ties = [view.name] if view.unique else [view.name, view.event]
    kinds = [f.dataType for f in rows.select(*values).schema] if values else []
    ranks = [rank(v, k, o.descending) for v, k, o in zip(values, kinds, query.order)]
    if any(r is None for r in ranks):
        orders = [ordering(v, o) for v, o in zip(values, query.order)]
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*orders, *ties))
        return rows.withColumn(PLACE, place).where(F.col(PLACE) == 1)
    whole = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    first = F.struct(*[x.alias(f"by_{i}") for i, x in enumerate([*ranks, *ties])])
    found = rows.groupBy(*[k.alias(f"key_{i}") for i, k in enumerate(keys)]).agg(F.min_by(whole, first).alias(PLACE))
    return found.select(F.col(f"`{PLACE}`.*"))


def grouped(query: Query, rows: DataFrame, context: Context) -> DataFrame:
    keys: dict[str, Column] = {}
    for item in query.match:
        column, name = named(item.value, context)
        keys[name] = column
    matched = {item.value: item.value.name if isinstance(item.value, Placeholder) else item.value.alias for item in query.match}
    aggregates: dict[str, tuple[str, Column, Column]] = {}
    plain: dict[str, Column] = {}
    for o in query.outcome:
        if isinstance(o.value, Call):
            if len(o.value.arguments) != 1:
                raise CompileError(f"{o.value.name}() takes one argument")
            x = operand(o.value.arguments[0], context)
            kind = x.field.kind if x.field else "string"
            slot = f"in_{len(aggregates)}"
            aggregates[o.name] = (slot, x.typed(), aggregate(o.value.name, F.col(slot), kind))
        elif isinstance(o.value, Value) or not keys or o.value in matched:
            plain[o.name] = operand(o.value, context).typed()
        else:
            raise CompileError(f"the outcome ${o.name} is neither an aggregate nor a match field")
    if aggregates and not keys and any(not isinstance(o.value, (Call, Value)) for o in query.outcome):
        raise CompileError("an outcome that is no aggregate stands beside aggregates without match")
    names = [*keys, *(o.name for o in query.outcome)]
    by_row = not keys and not aggregates
    if by_row:
        orders = [ordering(plain[n] if (n := order_name(o, names)) else named(o.value, context)[0], o) for o in query.order]
        found = rows.orderBy(*orders) if orders else rows
        found = found.select(*[plain[n].alias(n) for n in names])
        return found if query.limit is None else found.limit(query.limit)
    # values are taken out of the documents before rows are grouped, so that no more of them is read
    slots = {n: f"key_{i}" for i, n in enumerate(keys)}
    narrow = rows.select(*[c.alias(slots[n]) for n, c in keys.items()], *[c.alias(slot) for slot, c, _ in aggregates.values()])
    if aggregates:
        found = narrow.groupBy(*slots.values()).agg(*[c.alias(f"out_{n}") for n, (_, _, c) in aggregates.items()])
    else:
        found = narrow.distinct()
    of_match = {o.name: matched[o.value] for o in query.outcome if o.value in matched}
    shown = []
    for n in names:
        if n in aggregates:
            shown.append(F.col(f"out_{n}").alias(n))
        elif n in of_match:
            shown.append(F.col(slots[of_match[n]]).alias(n))
        else:
            shown.append((F.col(slots[n]) if n in slots else plain[n]).alias(n))
    found = found.select(*shown)
    orders = []
    for o in query.order:
        name = order_name(o, names)
        if name is None:
            raise CompileError("the order takes match fields and outcomes")
        orders.append(ordering(F.col(f"`{name}`"), o))
    found = found.orderBy(*orders) if orders else found
    return found if query.limit is None else found.limit(query.limit)


def order_name(item: OrderItem, names: Sequence[str]) -> str | None:
    name = item.value.name if isinstance(item.value, Placeholder) else item.value.alias
    return name if name in names else None


def search(
    text: str, spark: SparkSession, schema: Schema | None = None, parameters: dict[str, str] | None = None, events: DataFrame | View | str = EVENTS
) -> DataFrame:
    """The result of a query's text over the loaded events, or any event relation."""
    relation = spark.table(events) if isinstance(events, str) else events
    return compile_query(parse(text), relation, schema, parameters, lambda n, c: list_values(spark, n, c))


def search_response(text: str, spark: SparkSession, schema: Schema | None = None, parameters: dict[str, str] | None = None) -> dict:
    """The result of a query's text as plain data."""
    query = parse(text)
    found = compile_query(query, spark.table(EVENTS), schema, parameters, lambda n, c: list_values(spark, n, c))
    return result_response(found) if query.match or query.outcome else event_response(found)
