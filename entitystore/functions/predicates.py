"""Typed predicates, which test a Python value and build a two-valued Column alike.

A null never passes, but for IS_NULL.  strict=True gives the quirks of the format's first
implementation: >= on instants is >, IS_NULL and NOT_NULL look at the operand, and case-insensitive
operands alone are lowered.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

OPERATORS = ("=", "!=", ">", ">=", "<", "<=", "between", "in", "is_null", "not_null")


@dataclass(frozen=True)
class Predicate:
    op: str
    values: tuple = ()
    ignore_case: bool = False
    strict: bool = False

    def __post_init__(self):
        if self.op not in OPERATORS:
            raise ValueError(f"unknown operator {self.op!r}")
        if self.op == "between" and len(self.values) != 2:
            raise ValueError("between takes two values")
        if self.op in OPERATORS[:6] and not self.values:
            raise ValueError(f"{self.op} takes a value")

    def _operands(self) -> list:
        v = [float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) and self.op in OPERATORS[2:7] else x for x in self.values]
        return [x.lower() for x in v] if self.ignore_case else v

    def test(self, value: object) -> bool:
        v = self._operands()
        if self.op in ("is_null", "not_null"):
            null = (not v or v[0] is None) if self.strict else value is None
            return null == (self.op == "is_null")
        if value is None or any(x is None for x in v):
            return False
        if self.ignore_case and not self.strict:
            value = value.lower()
        if isinstance(value, (int, float)) and self.op in OPERATORS[2:7]:
            value = float(value)
        late = self.strict and isinstance(value, dt.datetime)
        return {
            "=": lambda: value == v[0], "!=": lambda: value not in v, ">": lambda: value > v[0], ">=": lambda: value > v[0] if late else value >= v[0],
            "<": lambda: value < v[0], "<=": lambda: value <= v[0], "between": lambda: v[0] <= value <= v[1], "in": lambda: value in v,
        }[self.op]()

    def column(self, c: Column) -> Column:
        v = self._operands()
        if self.op == "is_null":
            return c.isNull()
        if self.op == "not_null":
            return c.isNotNull()
        if self.ignore_case and not self.strict:
            c = F.lower(c)
        if v and isinstance(v[0], float) and self.op in OPERATORS[2:7]:
            c = c.cast("double")
        late = self.strict and v and isinstance(v[0], dt.datetime)
        made = {
            "=": lambda: c == F.lit(v[0]), "!=": lambda: ~c.isin(v) if len(v) > 1 else c != F.lit(v[0]), ">": lambda: c > F.lit(v[0]), ">=": lambda: c > F.lit(v[0]) if late else c >= F.lit(v[0]),
            "<": lambda: c < F.lit(v[0]), "<=": lambda: c <= F.lit(v[0]), "between": lambda: c.between(v[0], v[1]), "in": lambda: c.isin(v),
        }[self.op]()
        return F.coalesce(made, F.lit(False))


def may_contain(value: float, low: Column, high: Column) -> Column:
    return (low <= value) & (high >= value)


def may_exceed(value: float, high: Column) -> Column:
    return high >= value


def may_fall_below(value: float, low: Column) -> Column:
    return low <= value


def dictionary_test(values: Column, predicate: Predicate) -> Column:
    """Whether any of a dictionary's values (an array, nulls left out) passes; null where it cannot tell.

    A dictionary holds no nulls, so it cannot tell of IS_NULL, and NOT_NULL asks whether it has a value.
    strict=True: != asks whether the value is not among them.
    """
    if predicate.op == "is_null":
        return F.lit(None).cast("boolean")
    if predicate.op == "not_null":
        return F.size(values) > 0
    if predicate.op == "!=" and predicate.strict:
        return ~F.exists(values, lambda x: x.isin(list(predicate.values)))
    return F.exists(values, predicate.column)
