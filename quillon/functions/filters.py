"""Filter trees as Columns, with IEEE comparison of floats (NaN equals nothing and orders with nothing) and three-valued logic."""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.requests import And, Compare, Filter, Literal, Not, Or
from ..plans.schema import SCALARS, Schema

_COMPARE = {"=": "__eq__", "!=": "__ne__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}


def constant(value: Literal) -> Column:
    return F.lit(Decimal(value.value) if value.type == "uint64" else value.value).cast(SCALARS[value.type])


def comparison(column: Column, op: str, value: Literal) -> Column:
    plain = getattr(column, _COMPARE[op])(constant(value))
    if value.type != "float64":
        return plain
    if math.isnan(value.value):
        return F.when(column.isNotNull(), F.lit(op == "!="))
    if op == "!=":
        return F.isnan(column) | plain
    return plain if op in ("<", "<=") else plain & ~F.isnan(column)


def total_order_comparison(column: Column, op: str, value: Literal) -> Column:
    """As `comparison`, but floats by total order: -0.0 before 0.0, NaN equal to itself and above everything."""
    if value.type != "float64":
        return comparison(column, op, value)
    plain = getattr(column, _COMPARE[op])(constant(value))
    if value.value != 0:
        return plain
    sign = lambda x: F.when(x.cast("string") == "-0.0", -1).otherwise(0)
    side = getattr(sign(column), _COMPARE[op])(-1 if math.copysign(1, value.value) < 0 else 0)
    return F.when(column == 0.0, side).otherwise(plain)


def condition(schema: Schema, f: Filter, compare=comparison) -> Column:
    """The Column of a checked filter."""
    if isinstance(f, Compare):
        return compare(F.col(f"`{f.column}`"), f.op, schema.literal(f))
    if isinstance(f, Not):
        return ~condition(schema, f.inner, compare)
    left, right = condition(schema, f.left, compare), condition(schema, f.right, compare)
    return left & right if isinstance(f, And) else left | right


def may_match(schema: Schema, f: Filter | None, stats: dict[str, list], total_order: bool = False) -> bool:
    """Whether a file with these column minima and maxima may hold a row that `f` keeps.

    NOT, != and columns without statistics say nothing, so they never prune; an AND prunes if either side does. In total
    order NaN, which the statistics leave out, is above every number, so of floats only what lies below a number prunes.
    """
    if isinstance(f, And):
        return may_match(schema, f.left, stats, total_order) and may_match(schema, f.right, stats, total_order)
    if isinstance(f, Or):
        return may_match(schema, f.left, stats, total_order) or may_match(schema, f.right, stats, total_order)
    if not isinstance(f, Compare) or f.column not in stats or f.op == "!=":
        return True
    (low, high), value = stats[f.column], schema.literal(f).value
    if isinstance(value, float) and total_order:
        if math.isnan(value) or f.op in (">", ">="):
            return True
        return low <= value if f.op != "=" else low <= value <= high  # -0.0 < 0.0 there, so equal bounds stay
    if isinstance(value, float) and math.isnan(value):
        return False
    if isinstance(value, str):
        low, high, value = low.encode(), high.encode(), value.encode()
    return {"=": low <= value <= high, "<": low < value, "<=": low <= value, ">": high > value, ">=": high >= value}[f.op]


def prunable(schema: Schema, f: Filter | None) -> bool:
    """Whether statistics can prune by `f` at all."""
    if isinstance(f, And):
        return prunable(schema, f.left) or prunable(schema, f.right)
    if isinstance(f, Or):
        return prunable(schema, f.left) and prunable(schema, f.right)
    return isinstance(f, Compare) and f.op != "!=" and schema.field(f.column).type in ("int64", "float64", "utf8")
