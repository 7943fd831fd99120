"""Structured Streaming forms of the operators that have one.

Parser programs and searches without grouping are row by row and run on a
stream as they run on a table (``parse_logs``, ``compile_query``). A rule of one event
variable with a window becomes a watermarked window aggregation that reports each
window once it is complete; detections can then be held back for a while per group.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracelight.errors import CompileError
from tracelight.functions.aggregates import aggregate
from tracelight.functions.conditions import OPERATORS, Context, condition, literal_value, operand
from tracelight.functions.schema import Schema
from tracelight.operators.rules import SECONDS, TIME, event_variables
from tracelight.functions.paths import walk
from tracelight.plans.nodes import All, Call, Comparison, Either, EventCount, EventSeen, Not, Path, Placeholder, Rule, Value
from tracelight.plans.rule import parse_rule
from tracelight.sources.events import View, viewed


def stream_rule(
    rule: Rule | str, events: DataFrame | View, schema: Schema | None = None, late: str = "10 minutes", parameters: dict[str, str] | None = None
) -> DataFrame:
    """Detections of a rule with one event variable and ``over`` a plain window, by tumbling window.

    The rule's window divides time from the epoch on, rounded down as
    Spark's windows are; events later than ``late`` are passed over. Columns are
    ``window_start``, the match fields and the outcomes, which are aggregates of one argument.
    ``#e`` counts events, each row one, as distinct counts have no bound on a stream.
    """
    rule = parse_rule(rule) if isinstance(rule, str) else rule
    schema = schema or Schema.builtin()
    variables = event_variables(rule)
    if len(variables.names) != 1:
        raise CompileError("a rule on a stream has one event variable")
    grains = [m.grain for m in rule.match if m.grain is not None]
    if len(grains) != 1 or grains[0].direction is not None:
        raise CompileError("a rule on a stream has one plain window")
    [name] = variables.names
    view = viewed(events)
    context = Context(schema, view.document, {p: Path(owners[name].steps) for p, owners in variables.bound.items()}, parameters or {})
    terms = variables.filters[name]
    rows = view.rows.where(condition(All(tuple(terms)), context)) if terms else view.rows
    seconds = SECONDS[grains[0].unit] * grains[0].quantity
    time = walk(TIME, schema, context.base, lambda x, f: x.cast("timestamp_ntz")).cast("timestamp")
    keys = {m.value.name if isinstance(m.value, Placeholder) else m.value.alias: operand(bare(m.value), context).typed() for m in rule.match}
    wanted: dict[str, tuple[str, Any]] = {}
    for o in rule.outcome:
        if not isinstance(o.value, Call) or len(o.value.arguments) != 1:
            raise CompileError("an outcome on a stream is an aggregate of one argument")
        wanted[o.name] = (o.value.name, operand(bare(o.value.arguments[0]), context))
    values = {f"in_{n}": x.typed() for n, (_, x) in wanted.items()}
    narrow = rows.select(time.alias("at"), *[c.alias(f"key_{n}") for n, c in keys.items()], *[c.alias(n) for n, c in values.items()])
    made = [F.count(F.lit(1)).alias("seen")]
    for n, (kind, x) in wanted.items():
        if kind in ("count_distinct", "array_distinct", "array"):
            raise CompileError(f"{kind}() has no bound on a stream")
        made.append(aggregate(kind, F.col(f"in_{n}"), x.field.kind if x.field else "string").alias(f"out_{n}"))
    window = F.window("at", f"{seconds} seconds")
    found = narrow.withWatermark("at", late).groupBy(window.alias("window"), *[f"key_{n}" for n in keys]).agg(*made)
    return found.where(holds(rule.condition, name, set(wanted), context)).select(
        F.col("window.start").alias("window_start"), *[F.col(f"key_{n}").alias(n) for n in keys], *[F.col(f"out_{n}").alias(n) for n in wanted]
    )


def bare(x: Any) -> Any:
    return Path(x.steps) if isinstance(x, Path) else x


def holds(x: Any, name: str, outcomes: set[str], context: Context):
    if isinstance(x, (All, Either)):
        parts = [holds(t, name, outcomes, context) for t in x.terms]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if isinstance(x, All) else out | p
        return out
    if isinstance(x, Not):
        return ~holds(x.term, name, outcomes, context)
    if isinstance(x, (EventSeen, EventCount)):
        if x.name != name:
            raise CompileError(f"the condition names the undefined event variable ${x.name}")
        return F.col("seen") > 0
    if isinstance(x, Comparison) and x.op in OPERATORS:
        return OPERATORS[x.op](*(side(s, outcomes, context) for s in (x.left, x.right)))
    raise CompileError("this condition is not supported on a stream")


def side(x: Any, outcomes: set[str], context: Context):
    if isinstance(x, EventCount):
        return F.col("seen")
    if isinstance(x, Placeholder):
        if x.name not in outcomes:
            raise CompileError(f"the condition names the unknown outcome ${x.name}")
        return F.col(f"out_{x.name}")
    if isinstance(x, Value):
        return F.lit(literal_value(x, context))
    raise CompileError("a condition on a stream compares counts, outcomes and literals")


def suppress(detections: DataFrame, keys: list[str], seconds: int, time: str = "window_start", late: str = "10 minutes") -> DataFrame:
    """Of the detections of each group, those that come ``seconds`` or more after the last one that was reported.

    On a stream, a group's last report is state that is let go when the
    watermark has passed its end. A group's detections of one batch go by time.
    """
    fields = detections.schema.fields

    def report(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(time, kind="stable")
        kept = []
        for i, at in enumerate(rows[time]):
            if last is None or at.timestamp() - last >= seconds:
                last = at.timestamp()
                kept.append(i)
        state.update((last,))
        ends = int((last + seconds) * 1000)
        if ends > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(ends)
        yield rows.iloc[kept]

    # the watermark is the one that the detections already carry, or one on their time
    marked = detections if detections.isStreaming else detections.withWatermark(time, late)
    return marked.groupBy(*keys).applyInPandasWithState(
        report, T.StructType(fields), "last double", "append", GroupStateTimeout.EventTimeTimeout
    )
