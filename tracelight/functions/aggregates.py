"""Aggregate functions of outcomes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelight.errors import CompileError


def total(x: Column, kind: str) -> Column:
    # sums of integers may pass 64 bits on the way
    return F.sum(x.cast("decimal(38,0)")).cast("bigint") if kind == "bigint" else F.sum(x)


def listed(x: Column, kind: str) -> Column:
    """All values, NULLs among them; NULL where there is no row."""
    rows = F.collect_list(F.struct(x.alias("x")))
    return F.when(F.size(rows) > 0, F.transform(rows, lambda r: r["x"]))


#: Each takes a typed column and its kind.
AGGREGATES: dict[str, Callable[[Column, str], Column]] = {
    "count": lambda x, kind: F.count(x),
    "count_distinct": lambda x, kind: F.count_distinct(x),
    "sum": total,
    "avg": lambda x, kind: F.avg(x),
    "min": lambda x, kind: F.min(x),
    "max": lambda x, kind: F.max(x),
    "stddev": lambda x, kind: F.stddev_samp(x),
    "array": listed,
    "array_distinct": lambda x, kind: F.array_sort(F.array_distinct(listed(x, kind))),
    "earliest": lambda x, kind: F.min(x),
    "latest": lambda x, kind: F.max(x),
}
NUMERIC = {"sum", "avg", "stddev"}


def aggregate(name: str, x: Column, kind: str) -> Column:
    if name not in AGGREGATES:
        raise CompileError(f"unsupported outcome function {name!r}")
    if name in NUMERIC and kind not in ("bigint", "double"):
        raise CompileError(f"{name}() takes a number, not a {kind}")
    return AGGREGATES[name](x, kind)
