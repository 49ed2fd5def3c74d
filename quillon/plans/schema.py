"""Logical types, the dataset's schema, and the checks of requests against it."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import types as T

from .. import errors as E
from .requests import Aggregate, And, Compare, Filter, GroupByRequest, Literal, Not, Or, ScanRequest, VectorSearchRequest

ROW_ID, TIMESTAMP = "_row_id", "_timestamp"
RESERVED = (ROW_ID, TIMESTAMP)
SCALARS = {"bool": T.BooleanType(), "int64": T.LongType(), "uint64": T.DecimalType(20, 0), "float64": T.DoubleType(), "utf8": T.StringType()}
NUMERIC = ("int64", "float64")
_VECTOR = re.compile(r"vector[\[(](\d+)[\])]")


@dataclass(frozen=True)
class Field:
    """A column: name, logical type (bool, int64, uint64, float64, utf8 or vector[N]) and whether it may be null."""

    name: str
    type: str
    nullable: bool = True

    @property
    def dimensions(self) -> int | None:
        found = _VECTOR.fullmatch(self.type)
        return int(found[1]) if found else None

    @property
    def scalar(self) -> bool:
        return self.type in SCALARS

    def spark(self) -> T.StructField:
        if self.scalar:
            return T.StructField(self.name, SCALARS[self.type], self.nullable)
        return T.StructField(self.name, T.ArrayType(T.FloatType(), False), self.nullable, {"dim": self.dimensions})


@dataclass(frozen=True)
class Schema:
    fields: tuple[Field, ...]

    def __post_init__(self):
        seen = set()
        for f in self.fields:
            check_name(f.name)
            if f.name in seen:
                raise E.DuplicateSchemaColumn(f"two columns of the schema are named '{f.name}'", name=f.name)
            seen.add(f.name)
            if not f.scalar and f.dimensions is None:
                raise E.UnsupportedType(f"column '{f.name}': no such type as {f.type!r}", name=f.name)
            if f.dimensions == 0:
                raise E.ZeroVectorDimensions(f"column '{f.name}': a vector without dimensions", name=f.name)

    @staticmethod
    def of(*fields: tuple | Field) -> Schema:
        return Schema(tuple(f if isinstance(f, Field) else Field(*f) for f in fields))

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]

    def spark(self) -> T.StructType:
        return T.StructType([f.spark() for f in self.fields])

    def to_json(self) -> list[list]:
        return [[f.name, f.type, f.nullable] for f in self.fields]

    def field(self, name: str) -> Field:
        check_name(name)
        for f in self.fields:
            if f.name == name:
                return f
        raise E.UnknownColumn(f"the dataset has no column '{name}'", name=name)

    def projection(self, columns) -> list[str]:
        if columns is None:
            return self.names
        seen = set()
        for name in columns:
            self.field(name)
            if name in seen:
                raise E.DuplicateProjection(f"column '{name}' is asked for twice", name=name)
            seen.add(name)
        return list(columns)

    def check_filter(self, f: Filter) -> None:
        if isinstance(f, Compare):
            self._check_comparison(f)
        elif isinstance(f, And | Or):
            self.check_filter(f.left)
            self.check_filter(f.right)
        elif isinstance(f, Not):
            self.check_filter(f.inner)
        else:
            raise TypeError(f"not a filter: {f!r}")

    def literal(self, c: Compare) -> Literal:
        """The constant as the column's type reads it: plain ints are unsigned where the column is."""
        return Literal.of(c.value, self.field(c.column).type)

    def _check_comparison(self, c: Compare) -> None:
        field = self.field(c.column)
        if not field.scalar:
            raise E.NonScalarFilterColumn(f"column '{c.column}' holds vectors, which filters do not compare", name=c.column)
        actual = self.literal(c).type
        if actual != field.type:
            raise E.FilterTypeMismatch(f"column '{c.column}' is {field.type}, but is compared with {actual}", column=c.column, expected=field.type, actual=actual)
        if field.type == "bool" and c.op not in ("=", "!="):
            raise E.InvalidComparisonOperator(f"column '{c.column}' is bool, for which there is no {c.op}", column=c.column, operator=c.op, data_type="bool")

    def check_scan(self, request: ScanRequest) -> list[str]:
        columns = self.projection(request.columns)
        if request.filter is not None:
            self.check_filter(request.filter)
        return columns

    def check_group_by(self, request: GroupByRequest) -> list[tuple[Aggregate, str]]:
        """Each aggregate with the logical type it makes."""
        if not request.group_by:
            raise E.EmptyGroupBy("nothing to group by")
        names = set()
        for name in request.group_by:
            if not self.field(name).scalar:
                raise E.NonScalarGroupColumn(f"column '{name}' holds vectors, which make no groups", name=name)
            if name in names:
                raise E.DuplicateGroupColumn(f"column '{name}' is grouped by twice", name=name)
            names.add(name)
        if request.filter is not None:
            self.check_filter(request.filter)
        out = []
        for a in request.aggregates:
            check_name(a.alias)
            if a.alias in names:
                raise E.DuplicateAggregateAlias(f"two columns of the result would be named '{a.alias}'", alias=a.alias)
            names.add(a.alias)
            out.append((a, self._aggregate_type(a)))
        return out

    def _aggregate_type(self, a: Aggregate) -> str:
        field = self.field(a.column)
        if a.function == "count" and field.scalar:
            return "uint64"
        if a.function != "count" and field.type in NUMERIC:
            return "float64" if a.function == "avg" else field.type
        raise E.InvalidAggregateType(f"no {a.function} of column '{a.column}', which is {field.type}", column=a.column, function=a.function, actual=field.type)

    def check_vector_search(self, request: VectorSearchRequest) -> list[str] | None:
        """The columns that hits are hydrated with, or None."""
        if request.k <= 0:
            raise E.InvalidVectorK(f"k is {request.k}; a search asks for one hit or more")
        if request.column != "vector":
            raise E.UnsupportedVectorColumn(f"searches look at the column 'vector', not at '{request.column}'", name=request.column)
        field = self.field(request.column)
        if field.dimensions is None:
            raise E.NotVectorColumn(f"column '{field.name}' is {field.type}, not a vector", name=field.name, actual=field.type)
        for i, x in enumerate(request.query):
            if not math.isfinite(x):
                raise E.NonFiniteVectorComponent(f"component {i} of the query is {x}", index=i)
        if len(request.query) != field.dimensions:
            raise E.VectorDimensionMismatch(f"the query has {len(request.query)} components, the column {field.dimensions}", expected=field.dimensions, actual=len(request.query))
        if request.filter is not None:
            self.check_filter(request.filter)
        return None if request.hydrate is False else self.projection(request.hydrate)


@dataclass(frozen=True)
class WithHidden(Schema):
    """A schema whose filters may also compare the hidden columns, as primitive scans do."""

    def field(self, name: str) -> Field:
        return Field(name, "int64", False) if name in RESERVED else super().field(name)


def check_name(name: str) -> None:
    if name in RESERVED:
        raise E.ReservedColumn(f"'{name}' names a hidden column", name=name)
