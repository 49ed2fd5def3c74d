"""Collected results, checked: groups and vector hits."""

from __future__ import annotations

import math
from dataclasses import dataclass
from decimal import Decimal
from typing import Any

from pyspark.sql import Row

from .. import errors as E
from .schema import check_name

NOT_REQUESTED, HYDRATED, UNRESOLVED = "not_requested", "hydrated", "unresolved"
#: Why a hit's row could not be shown.
NOT_FOUND, TOMBSTONED = "not_found", "tombstoned"
_KINDS = {"int64": int, "uint64": (int, Decimal), "float64": float}


@dataclass(frozen=True)
class Groups:
    """Rows of a grouping: the keys, then (alias, type) of each aggregate. Raises if a row does not fit."""

    keys: tuple[str, ...]
    aggregates: tuple[tuple[str, str], ...]
    rows: tuple[Row, ...]

    def __post_init__(self):
        seen = set()
        for names, error in ((self.keys, E.DuplicateGroupColumn), ([a for a, _ in self.aggregates], E.DuplicateAggregateAlias)):
            for name in names:
                check_name(name)
                if name in seen:
                    raise error(f"two columns of the result are named '{name}'", name=name)
                seen.add(name)
        for alias, kind in self.aggregates:
            if kind not in _KINDS:
                raise E.InvalidAggregateOutputType(f"aggregate '{alias}' cannot be {kind}", alias=alias, actual=kind)
        for at, row in enumerate(self.rows):
            self._check(at, tuple(row))

    def _check(self, at: int, row: tuple) -> None:
        if len(row) != len(self.keys) + len(self.aggregates):
            raise E.GroupResultShape(f"group {at} has {len(row)} values for {len(self.keys)} keys and {len(self.aggregates)} aggregates", row=at, actual=len(row))
        if any(isinstance(v, list | tuple) for v in row[: len(self.keys)]):
            raise E.NonScalarGroupResult(f"a key of group {at} is a vector", row=at)
        for (alias, kind), value in zip(self.aggregates, row[len(self.keys) :], strict=True):
            if value is None and kind == "uint64":
                raise E.NullCountAggregate(f"count '{alias}' of group {at} is null", alias=alias)
            if value is not None and (isinstance(value, bool) or not isinstance(value, _KINDS[kind])):
                raise E.AggregateResultTypeMismatch(f"'{alias}' is {kind}, but {value!r} in group {at}", alias=alias, expected=kind, actual=type(value).__name__)


@dataclass(frozen=True)
class Hit:
    """A row near the query. `row` is set if it is hydrated, `reason` if it could not be."""

    row_id: int
    distance: float
    state: str = NOT_REQUESTED
    row: Any = None
    reason: str | None = None


@dataclass(frozen=True)
class Hits:
    """Hits of a search for `k` rows, nearest first, ties by row id; `columns` are those asked for. Raises if a hit does not fit."""

    k: int
    columns: tuple[str, ...] | None
    hits: tuple[Hit, ...]

    def __post_init__(self):
        if len(self.hits) > self.k:
            raise E.TooManyVectorHits(f"{len(self.hits)} hits for k = {self.k}", requested_k=self.k, actual=len(self.hits))
        for hit in self.hits:
            if not math.isfinite(hit.distance):
                raise E.NonFiniteVectorDistance(f"row {hit.row_id} is {hit.distance} away", row_id=hit.row_id)
            if hit.distance < 0:
                raise E.NegativeVectorDistance(f"row {hit.row_id} is {hit.distance} away", row_id=hit.row_id)
            self._check_row(hit)
        for one, two in zip(self.hits, self.hits[1:], strict=False):
            if (one.distance, one.row_id) >= (two.distance, two.row_id):
                raise E.NonMonotonicVectorDistances(f"row {two.row_id} at {two.distance} comes after row {one.row_id} at {one.distance}", row_id=two.row_id)

    def _check_row(self, hit: Hit) -> None:
        if self.columns is None and hit.state != NOT_REQUESTED:
            raise E.UnexpectedHydration(f"row {hit.row_id} is {hit.state}, but no columns were asked for", row_id=hit.row_id)
        if self.columns is not None and hit.state == NOT_REQUESTED:
            raise E.MissingHydration(f"row {hit.row_id} comes without its columns", row_id=hit.row_id)
        if hit.state == HYDRATED and tuple(hit.row.asDict()) != self.columns:
            raise E.HydrationProjectionMismatch(f"row {hit.row_id} has columns {list(hit.row.asDict())}, not {list(self.columns)}", row_id=hit.row_id)
