"""What can be asked: filters, projections, scans, groupings, vector searches, lookups."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field
from typing import Any

OPERATORS = ("=", "!=", "<", "<=", ">", ">=")
AGGREGATES = ("count", "sum", "min", "max", "avg")


@dataclass(frozen=True)
class Literal:
    """A typed constant; two are the same only if type and bits are."""

    type: str
    value: Any = field(compare=False)
    bits: Any = field(init=False, repr=False)

    def __post_init__(self):
        object.__setattr__(self, "bits", struct.pack(">d", self.value) if self.type == "float64" else self.value)

    @staticmethod
    def of(value: Any, column_type: str | None = None) -> Literal:
        """The literal a Python value stands for: bool, int64, uint64, float64 or utf8; a uint64 column takes non-negative ints as its own."""
        if isinstance(value, Literal):
            return value
        if isinstance(value, bool):
            return Literal("bool", value)
        if isinstance(value, int):
            if column_type == "uint64" and 0 <= value < 1 << 64:
                return Literal("uint64", value)
            if -(1 << 63) <= value < 1 << 63:
                return Literal("int64", value)
            if 0 <= value < 1 << 64:
                return Literal("uint64", value)
            raise TypeError(f"{value} fits neither int64 nor uint64")
        if isinstance(value, float):
            return Literal("float64", value)
        if isinstance(value, str):
            return Literal("utf8", value)
        raise TypeError(f"unsupported literal {value!r}")


class Filter:
    """A tree of comparisons; frozen, so that equal shapes with equal literal bits are equal keys."""

    def __and__(self, other: Filter) -> And:
        return And(self, other)

    def __or__(self, other: Filter) -> Or:
        return Or(self, other)

    def __invert__(self) -> Not:
        return Not(self)

    def columns(self) -> list[str]:
        """Columns that the tree reads, in tree order, repeats included."""
        raise NotImplementedError


@dataclass(frozen=True)
class Compare(Filter):
    """A column against a constant. Two are the same only if the constant's type and bits are (1, 1.0 and True are three)."""

    column: str
    op: str
    value: Any = field(compare=False)
    identity: Literal = field(init=False, repr=False)

    def __post_init__(self):
        if self.op not in OPERATORS and self.op != "==":
            raise ValueError(f"unknown operator {self.op!r}")
        if self.op == "==":
            object.__setattr__(self, "op", "=")
        object.__setattr__(self, "identity", Literal.of(self.value))

    def columns(self) -> list[str]:
        return [self.column]


@dataclass(frozen=True)
class And(Filter):
    left: Filter
    right: Filter

    def columns(self) -> list[str]:
        return self.left.columns() + self.right.columns()


@dataclass(frozen=True)
class Or(Filter):
    left: Filter
    right: Filter

    def columns(self) -> list[str]:
        return self.left.columns() + self.right.columns()


@dataclass(frozen=True)
class Not(Filter):
    inner: Filter

    def columns(self) -> list[str]:
        return self.inner.columns()


@dataclass(frozen=True)
class ScanRequest:
    """`columns` None: all logical columns, in schema order."""

    columns: tuple[str, ...] | None = None
    filter: Filter | None = None


@dataclass(frozen=True)
class Aggregate:
    column: str
    function: str
    alias: str

    def __post_init__(self):
        if self.function not in AGGREGATES:
            raise ValueError(f"unknown aggregate {self.function!r}")


@dataclass(frozen=True)
class GroupByRequest:
    group_by: tuple[str, ...]
    aggregates: tuple[Aggregate, ...] = ()
    filter: Filter | None = None


@dataclass(frozen=True)
class VectorSearchRequest:
    """`hydrate` False: hits alone; None: with all logical columns; else with these columns."""

    query: tuple[float, ...]
    k: int
    column: str = "vector"
    filter: Filter | None = None
    hydrate: tuple[str, ...] | None | bool = False


@dataclass(frozen=True)
class RowLookupRequest:
    row_id: int
    columns: tuple[str, ...] | None = None
