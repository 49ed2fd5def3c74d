"""Transactions: staged inserts, deletes and updates over a snapshot, seen by their own reads, published by commit."""

from __future__ import annotations

from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame, Row

from .. import errors as E
from ..functions import filters
from ..plans import planner as P
from ..plans.requests import GroupByRequest, RowLookupRequest, ScanRequest, VectorSearchRequest
from ..plans.schema import Schema
from ..sources import datafile, deletions
from ..sources.manifest import DataFile, Deletion, holds, normalized
from . import rows
from .snapshot import LIVE, NOT_FOUND, TOMBSTONED, Lookup, Snapshot

ACTIVE, COMMITTED, ABORTED = "active", "committed", "aborted"


class Transaction:
    """One writer's staged work. Data files are written when staged, so overlay reads and the commit see the same rows."""

    def __init__(self, dataset: Any, base: Snapshot):
        self.dataset, self.base, self.state = dataset, base, ACTIVE
        self.attempt = dataset._next_attempt()
        self.files: list[DataFile] = []
        self.targets: dict[int, DataFile | None] = {}
        self.deletions: list[Deletion] = []
        #: (name, micro-batch) of a stream that is committed at most once.
        self.stream: tuple[str, int] | None = None
        self._batches = 0

    @property
    def schema(self) -> Schema:
        return self.base.schema

    @property
    def open(self) -> bool:
        return self.state == ACTIVE

    @property
    def objects(self) -> list[str]:
        """Keys of what the transaction has written."""
        return [*(f.name for f in self.files), *(n for d in self.deletions for n in d.names)]

    def _active(self) -> None:
        if self.state != ACTIVE:
            raise E.TransactionFinished(f"the transaction is {self.state}", state=self.state)

    # -- writes --------------------------------------------------------------------------------------------------------

    def insert(self, batch: DataFrame) -> None:
        """Stage a batch. Its columns must be the schema's: names, order and types; nulls only where allowed."""
        self._active()
        self.files += self._stage(batch)

    def _stage(self, batch: DataFrame) -> list[DataFile]:
        want, got = self.schema.spark().fields, batch.schema.fields
        if [(f.name, _kind(f.dataType)) for f in want] != [(f.name, _kind(f.dataType)) for f in got]:
            raise E.BatchSchemaMismatch(f"the batch has {batch.schema.simpleString()}, the dataset {self.schema.spark().simpleString()}")
        with self.dataset._preparing():
            keys = datafile.write_parts(self.dataset.backend, batch, self.attempt, self._batches)
            self._batches += 1
            try:
                files = datafile.describe(self.dataset.spark, self.dataset.backend, keys, self.schema)
            except E.QuillonError:
                for key in keys:
                    self.dataset.backend.delete(key)
                raise
            return datafile.numbered(files, self.dataset._claim(sum(f.row_count for f in files)))

    def delete(self, row_id: int) -> None:
        """Stage the deletion of a row that is live in the base."""
        self._active()
        self._check_target(row_id)
        self.targets[row_id] = None

    def delete_where(self, f) -> int:
        """Stage the deletion of every live row that the filter keeps; how many.

        The ids go from Spark into a deletion vector, never through the driver or the manifest.
        """
        self._active()
        spark, backend = self.dataset.spark, self.dataset.backend
        with self.dataset._preparing():
            staged = deletions.write(spark, backend, deletions.of_ids(self.base.matching_row_ids(f)), self.attempt, self._batches)
            self._batches += 1
        if staged is None:
            return 0
        twice = self._named_in(staged, list(self.targets))
        if not twice and self.deletions:
            one, two = (deletions.read(spark, backend, d) for d in ((staged,), tuple(self.deletions)))
            both = one.words.join(two.words.withColumnRenamed("mask", "other"), "word").selectExpr("word", "mask & other AS mask").where("mask <> 0")
            twice = [r[0] for r in deletions.ids(deletions.Vector(both, 0)).limit(1).collect()]
        if twice:
            for key in staged.names:
                backend.delete(key)
            raise E.DuplicateTarget(f"row {twice[0]} is already targeted", row_id=twice[0])
        self.deletions.append(staged)
        return staged.count

    def _named_in(self, staged: Deletion, ids: list[int]) -> list[int]:
        return sorted(Snapshot(self.dataset, replace(self.base.manifest, deletions=(staged,))).deleted_ids(ids))

    def update(self, row_id: int, replacement: DataFrame) -> None:
        """Stage a deletion and the one row that takes its place, under a new id."""
        self._active()
        if replacement.limit(2).count() != 1:
            raise E.InvalidUpdateShape("an update takes exactly one row", row_id=row_id)
        self._check_target(row_id)
        files = [f for f in self._stage(replacement.coalesce(1)) if f.row_count]
        self.files += files
        self.targets[row_id] = files[0]

    def _check_target(self, row_id: int) -> None:
        """Raise unless the row is live in the base and not targeted yet. The manifest knows the ids of files that do not store them."""
        if row_id in self.targets or any(self._named_in(d, [row_id]) for d in self.deletions if d.first <= row_id <= d.last):
            raise E.DuplicateTarget(f"row {row_id} is already targeted", row_id=row_id)
        there = self.base.exists(row_id)
        if there is None:
            there = self.base.lookup(RowLookupRequest(row_id, ())).outcome != NOT_FOUND
        if not there:
            raise E.RowNotFound(f"no row {row_id}", row_id=row_id)
        if self.base.deleted(row_id):
            raise E.RowNotLive(f"row {row_id} is deleted", row_id=row_id)

    # -- overlay reads -------------------------------------------------------------------------------------------------

    def frame(self) -> DataFrame:
        """The base without targeted rows, then the staged rows."""
        self._active()
        base = rows.without_tombstones(self.base.frame(ids=bool(self.targets or self.deletions)), normalized(list(self.targets), ()))
        if self.deletions:
            base = deletions.without(base, deletions.read(self.dataset.spark, self.dataset.backend, tuple(self.deletions)))
        base = base.select(*[f"`{n}`" for n in self.schema.names])
        return base.unionByName(datafile.read(self.dataset.spark, self.dataset.backend, self.schema, self.files)) if self.files else base

    def scan(self, request: ScanRequest) -> DataFrame:
        columns = self.schema.check_scan(request)
        df = self.frame()
        return rows.project(df if request.filter is None else df.where(filters.condition(self.schema, request.filter)), columns)

    def group_by(self, request: GroupByRequest) -> DataFrame:
        outputs = self.schema.check_group_by(request)
        df = self.frame()
        df = df if request.filter is None else df.where(filters.condition(self.schema, request.filter))
        return rows.group(df, self.schema, list(request.group_by), [a for a, _ in outputs])

    def lookup(self, request: RowLookupRequest | int) -> Lookup:
        """A base row as this transaction sees it: its replacement if updated, tombstoned if deleted. Staged inserts have no id yet."""
        self._active()
        request = request if isinstance(request, RowLookupRequest) else RowLookupRequest(request)
        wanted = self.schema.projection(request.columns)
        if request.row_id not in self.targets:
            if any(self._named_in(d, [request.row_id]) for d in self.deletions if d.first <= request.row_id <= d.last):
                return Lookup(request.row_id, TOMBSTONED, tuple(wanted))
            return self.base.lookup(request)
        staged = self.targets[request.row_id]
        if staged is None:
            return Lookup(request.row_id, TOMBSTONED, tuple(wanted))
        row: Row = rows.project(datafile.read(self.dataset.spark, self.dataset.backend, self.schema, [staged]), wanted).first()
        return Lookup(request.row_id, LIVE, tuple(wanted), row)

    def vector_search(self, request: VectorSearchRequest) -> DataFrame:
        self._active()
        if self.files or self.targets or self.deletions:
            raise E.UnsupportedTransactionRead("vector search does not see staged changes")
        return self.base.vector_search(request)

    def explain_scan(self, request: ScanRequest) -> P.PhysicalPlan:
        self.schema.check_scan(request)
        return self.base._plan(request.filter, P.Logical("projection"), overlay=True)

    def explain_group_by(self, request: GroupByRequest) -> P.PhysicalPlan:
        self.schema.check_group_by(request)
        return self.base._plan(request.filter, P.Logical("grouping"), overlay=True)

    # -- end -----------------------------------------------------------------------------------------------------------

    def commit(self) -> Snapshot:
        self._active()
        snapshot = self.dataset._commit(self)
        self.state = COMMITTED
        return snapshot

    def abort(self) -> None:
        """Forget everything staged; the files are orphans for vacuum."""
        self._active()
        self.state = ABORTED

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind, error, trace) -> None:
        if self.state == ACTIVE:
            self.commit() if kind is None else self.abort()

    def still_live(self, ranges) -> list[int]:
        """Targets that `ranges` of a later version name."""
        return [i for i in self.targets if holds(ranges, i)]


def _kind(data_type) -> str:
    return data_type.simpleString()
