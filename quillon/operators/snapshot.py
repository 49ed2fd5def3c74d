"""Snapshots: one version of a dataset, read as lazy DataFrames over exactly the files its manifest lists."""

from __future__ import annotations

from contextlib import suppress
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .. import errors as E
from ..functions import filters
from ..plans import planner as P
from ..plans.requests import Filter, GroupByRequest, RowLookupRequest, ScanRequest, VectorSearchRequest
from ..plans.results import HYDRATED, UNRESOLVED, Groups, Hit, Hits
from ..plans.results import NOT_FOUND as UNFOUND
from ..plans.results import TOMBSTONED as DEAD
from ..plans.schema import RESERVED, ROW_ID, TIMESTAMP, WithHidden
from ..sources import datafile, deletions
from ..sources.manifest import DataFile, Manifest, holds
from . import rows, vector_index

LIVE, TOMBSTONED, NOT_FOUND = "live", "tombstoned", "not_found"
#: Bytes of live sets that a snapshot keeps, at most.
LIVE_SET_BYTES = 64 << 20


@dataclass(frozen=True)
class Lookup:
    """`row` is set if the outcome is live."""

    row_id: int
    outcome: str
    columns: tuple[str, ...]
    row: Row | None = None


class Snapshot:
    """An immutable view. Frames it gives must not outlive it: compaction keeps the files of live snapshots only."""

    def __init__(self, dataset: Any, manifest: Manifest):
        self.dataset, self.manifest = dataset, manifest
        self.spark, self.backend = dataset.spark, dataset.backend
        self._live_sets: dict[Filter, DataFrame] = {}
        self._live_bytes = 0

    @property
    def version(self) -> int:
        return self.manifest.version

    @property
    def schema(self):
        return self.manifest.schema

    @property
    def schema_version(self) -> int:
        return self.manifest.schema_version

    # -- files ---------------------------------------------------------------------------------------------------------

    def surviving(self, f: Filter | None, primitive: bool = False) -> list[DataFile]:
        """Files that may hold a row that `f` keeps, by their statistics; for a primitive scan also by ids and commit time, and floats by total order."""
        if f is None:
            return list(self.manifest.files)
        schema = WithHidden(self.schema.fields) if primitive else self.schema
        return [x for x in self.manifest.files if x.row_count and filters.may_match(schema, f, x.stats | hidden_stats(x) if primitive else x.stats, primitive)]

    def deletions(self, files: list[DataFile]) -> deletions.Vector | None:
        """The deletion vectors that may name a row of `files`."""
        found = tuple(d for d in self.manifest.deletions if any(f.row_count and d.first <= f.last and d.last >= f.first for f in files))
        return deletions.read(self.spark, self.backend, found) if found else None

    def frame(self, files: list[DataFile] | None = None, ids: bool = False, timestamps: bool = False) -> DataFrame:
        """Live rows of `files` (all, if not given), with row ids if asked for.

        Only files whose id range meets a tombstone pay for the id column and its filter; others are scanned plainly,
        so pushdown and vectorised decoding stay whole.
        """
        files = list(self.manifest.files) if files is None else files
        dead = [f for f in files if f.row_count and self._meets(f)]
        clean = [f for f in files if not (f.row_count and self._meets(f))]
        names = [*self.schema.names, *([ROW_ID] if ids else []), *([TIMESTAMP] if timestamps else [])]
        parts = []
        if clean or not dead:
            parts.append(datafile.read(self.spark, self.backend, self.schema, clean, ids, timestamps).select(*[f"`{n}`" for n in names]))
        if dead:
            lo, hi = min(f.first for f in dead), max(f.last for f in dead)
            ranges = tuple(r for r in self.manifest.tombstones if r[0] <= hi and r[1] >= lo)
            filtered = rows.without_tombstones(datafile.read(self.spark, self.backend, self.schema, dead, True, timestamps), ranges)
            vector = self.deletions(dead)
            filtered = filtered if vector is None else deletions.without(filtered, vector)
            parts.append(filtered.select(*[f"`{n}`" for n in names]))
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def alive(self, df: DataFrame) -> DataFrame:
        """Rows of `df` (with row ids) that are not deleted in this version."""
        df = rows.without_tombstones(df, self.manifest.tombstones)
        return deletions.without(df, deletions.read(self.spark, self.backend, self.manifest.deletions)) if self.manifest.deletions else df

    def _meets(self, f: DataFile) -> bool:
        return _meets(self.manifest.tombstones, f) or any(d.first <= f.last and d.last >= f.first for d in self.manifest.deletions)

    # -- scans ---------------------------------------------------------------------------------------------------------

    def scan_all(self, columns: list[str] | None = None) -> DataFrame:
        """Every live row, columns by name and in the given order; hidden columns may be among them."""
        columns = self.schema.names if columns is None else columns
        for c in columns:
            if c not in RESERVED:
                self.schema.field(c)
        return rows.project(self.frame(ids=ROW_ID in columns, timestamps=TIMESTAMP in columns), columns)

    def scan_predicate(self, predicate: Filter, columns: list[str] | None = None) -> DataFrame:
        """The primitive scan: floats compare by total order, and the predicate reads the projected columns only, hidden ones too."""
        columns = self.schema.names if columns is None else columns
        schema = WithHidden(self.schema.fields)
        schema.check_filter(predicate)
        for c in predicate.columns():
            if c not in columns:
                raise E.UnknownColumn(f"predicate column '{c}' is not scanned", name=c)
        found = self.frame(self.surviving(predicate, primitive=True), ids=ROW_ID in columns, timestamps=TIMESTAMP in columns)
        return rows.project(found.where(filters.condition(schema, predicate, filters.total_order_comparison)), columns)

    def scan(self, request: ScanRequest | None = None, **kwargs) -> DataFrame:
        """Live rows that the filter keeps, projected in request order."""
        request = request or _scan(**kwargs)
        columns = self.schema.check_scan(request)
        return rows.project(self._filtered(request.filter), columns)

    def collect_scan(self, request: ScanRequest) -> list[Row]:
        """The rows of a scan, collected; a broken data file raises CorruptDataFile."""
        return rows.collected(self.scan(request))

    def read_file(self, name: str, columns: list[str] | None = None) -> DataFrame:
        """All physical rows of one file, deleted ones too, with only `columns` decoded."""
        found = [f for f in self.manifest.files if f.name == name]
        if not found:
            raise E.ObjectNotFound(f"version {self.version} has no file {name!r}", key=name)
        return rows.project(datafile.read(self.spark, self.backend, self.schema, found), self.schema.projection(columns))

    def planned_scan(self, request: ScanRequest) -> tuple[P.PhysicalPlan, DataFrame]:
        return self.explain_scan(request), self.scan(request)

    def _filtered(self, f: Filter | None, ids: bool = False) -> DataFrame:
        df = self.frame(self.surviving(f), ids)
        return df if f is None else df.where(filters.condition(self.schema, f))

    def matching_row_ids(self, f: Filter) -> DataFrame:
        """Ids of live rows that the filter keeps."""
        self.schema.check_filter(f)
        return self._filtered(f, ids=True).select(F.col(ROW_ID).alias("row_id"))

    def live_set(self, f: Filter) -> DataFrame:
        """`matching_row_ids`, kept for later use of the same filter on this snapshot (which never changes).

        What is kept has at most LIVE_SET_BYTES in all; a set that does not fit beside the others is not kept.
        """
        self.schema.check_filter(f)
        if f in self._live_sets:
            return self._live_sets[f]
        found = self.matching_row_ids(f).persist()
        size = 8 * found.count()
        if self._live_bytes + size > LIVE_SET_BYTES:
            found.unpersist()
            return self.matching_row_ids(f)
        self._live_bytes += size
        self._live_sets[f] = found
        return found

    def __del__(self):
        for found in self.__dict__.get("_live_sets", {}).values():
            with suppress(Exception):  # the session may have ended
                found.unpersist()

    # -- lookup --------------------------------------------------------------------------------------------------------

    def owner(self, row_id: int) -> list[DataFile]:
        return [f for f in self.manifest.files if f.row_count and f.first <= row_id <= f.last]

    def lookup(self, request: RowLookupRequest | int, columns: tuple[str, ...] | None = None) -> Lookup:
        """The row of an id: read from the files whose range holds it, and there from the row groups that may."""
        request = request if isinstance(request, RowLookupRequest) else RowLookupRequest(request, columns)
        wanted = self.schema.projection(request.columns)
        files = self.owner(request.row_id)
        if not files:
            return Lookup(request.row_id, NOT_FOUND, tuple(wanted))
        df = datafile.read(self.spark, self.backend, self.schema, files, ids=True).where(F.col(ROW_ID) == request.row_id)
        found = df.select(*[f"`{c}`" for c in wanted]).take(1)
        if not found:
            return Lookup(request.row_id, NOT_FOUND, tuple(wanted))
        if self.deleted(request.row_id):
            return Lookup(request.row_id, TOMBSTONED, tuple(wanted))
        return Lookup(request.row_id, LIVE, tuple(wanted), found[0])

    def deleted(self, row_id: int) -> bool:
        """Whether a tombstone or a deletion vector names the id; the vectors are read only where they may."""
        return holds(self.manifest.tombstones, row_id) or row_id in self.deleted_ids([row_id])

    def deleted_ids(self, ids: list[int]) -> set[int]:
        """Those of `ids` that a deletion vector names, found in one job."""
        wanted = [i for i in ids if any(d.first <= i <= d.last for d in self.manifest.deletions)]
        if not wanted:
            return set()
        table = self.spark.createDataFrame([(i,) for i in wanted], f"{ROW_ID} long")
        return {r[0] for r in deletions.within(table, deletions.read(self.spark, self.backend, self.manifest.deletions)).collect()}

    def exists(self, row_id: int) -> bool | None:
        """Whether a file holds the id, deleted or not, as far as the manifest can say: None if files that store ids may."""
        owners = self.owner(row_id)
        return None if any(f.stored for f in owners) else bool(owners)

    # -- grouping ------------------------------------------------------------------------------------------------------

    def group_by(self, request: GroupByRequest) -> DataFrame:
        """One row for each group; partial aggregation, one shuffle, final aggregation."""
        outputs = self.schema.check_group_by(request)
        return rows.group(self._filtered(request.filter), self.schema, list(request.group_by), [a for a, _ in outputs])

    def collect_groups(self, request: GroupByRequest) -> list[Row]:
        """The groups, collected, after their shape and types are checked."""
        found = rows.checked(self.group_by(request), list(request.aggregates), self.schema)
        kinds = tuple((a.alias, kind) for a, kind in self.schema.check_group_by(request))
        return list(Groups(request.group_by, kinds, tuple(found)).rows)

    def planned_group_by(self, request: GroupByRequest) -> tuple[P.PhysicalPlan, DataFrame]:
        return self.explain_group_by(request), self.group_by(request)

    # -- vectors -------------------------------------------------------------------------------------------------------

    def vector_search(self, request: VectorSearchRequest, probes: int | None = None, live: DataFrame | None = None) -> DataFrame:
        """The k nearest live rows that the filter keeps: row_id, squared distance, hydrated columns.

        Without `probes` they are the true nearest of all rows; with it, of those in so many cells of each index segment
        (`vector_index`). `live` (row_id), if given, restricts the rows further.
        """
        columns = self.schema.check_vector_search(request)
        if probes is not None or live is not None:
            hits = vector_index.search(self, request, probes or 1 << 30, live)
            return hits if columns is None else rows.hydrated(self.frame(ids=True), hits, columns)
        return rows.nearest(self._filtered(request.filter, ids=True), request.query, request.k, columns, column=request.column)

    def vector_search_legacy(self, query: tuple[float, ...], k: int, predicate: Filter | None = None) -> DataFrame:
        """The primitive search: (row_id, distance) of the k nearest rows that a predicate by total order keeps."""
        self.schema.check_vector_search(VectorSearchRequest(query, k))
        found = self.frame(self.surviving(predicate, primitive=True), ids=True, timestamps=predicate is not None and TIMESTAMP in predicate.columns())
        if predicate is not None:
            schema = WithHidden(self.schema.fields)
            schema.check_filter(predicate)
            found = found.where(filters.condition(schema, predicate, filters.total_order_comparison))
        return rows.nearest(found, query, k, None)

    def collect_hits(self, request: VectorSearchRequest) -> Hits:
        """The hits of a search, collected, each with its row if columns are asked for, after count, order and rows are checked."""
        columns = self.schema.check_vector_search(request)
        found = self.vector_search(replace(request, hydrate=False)).collect()
        if columns is None:
            return Hits(request.k, None, tuple(Hit(r.row_id, r.distance) for r in found))
        return Hits(request.k, tuple(columns), tuple(self.hydrate([(r.row_id, r.distance) for r in found], columns)))

    def hydrate(self, found: list[tuple[int, float]], columns: list[str]) -> list[Hit]:
        """Hits (row_id, distance) with their rows, read in one job from the files whose ids may be theirs; why, where there is none."""
        ids = [i for i, _ in found]
        files = list({f.name: f for i in ids for f in self.owner(i)}.values())
        df = datafile.read(self.spark, self.backend, self.schema, files, ids=True).where(F.col(ROW_ID).isin(ids))
        read = {r[0]: r for r in df.select(ROW_ID, *[f"`{c}`" for c in columns]).collect()} if ids else {}
        dead = self.deleted_ids(ids) | {i for i in ids if holds(self.manifest.tombstones, i)}
        out = []
        for i, d in found:
            reason = UNFOUND if i not in read else DEAD if i in dead else None
            out.append(Hit(i, d, UNRESOLVED, reason=reason) if reason else Hit(i, d, HYDRATED, Row(*columns)(*read[i][1:])))
        return out

    def planned_vector_search(self, request: VectorSearchRequest) -> tuple[P.PhysicalPlan, DataFrame]:
        return self.explain_vector_search(request), self.vector_search(request)

    # -- explain -------------------------------------------------------------------------------------------------------

    def explain(self, f: Filter) -> DataFrame:
        """Each file, whether its statistics let a scan by `f` skip it, and whether it has vectors."""
        self.schema.check_filter(f)
        kept = {x.name for x in self.surviving(f)}
        table = [(x.name, x.name in kept, x.vectors > 0) for x in self.manifest.files]
        return self.spark.createDataFrame(table, "file string, scanned boolean, segment boolean")

    def explain_scan(self, request: ScanRequest) -> P.PhysicalPlan:
        self.schema.check_scan(request)
        return self._plan(request.filter, P.Logical("projection"))

    def explain_group_by(self, request: GroupByRequest) -> P.PhysicalPlan:
        self.schema.check_group_by(request)
        return self._plan(request.filter, P.Logical("grouping"))

    def explain_vector_search(self, request: VectorSearchRequest) -> P.PhysicalPlan:
        self.schema.check_vector_search(request)
        return self._plan(request.filter, P.Logical("vector_search", has_filter=request.filter is not None, hydration=request.hydrate is not False))

    def _plan(self, f: Filter | None, terminal: P.Logical, overlay: bool = False) -> P.PhysicalPlan:
        logical = (P.Logical("source"), *([P.Logical("predicate", zone_map_eligible=filters.prunable(self.schema, f))] if f is not None else []), terminal, P.Logical("materialize"))
        total, kept = len(self.manifest.files), len(self.surviving(f))
        segments = [x for x in self.manifest.files if x.vectors]
        seen = [x for x in self.surviving(f) if x.vectors]
        vector = terminal.kind == "vector_search"
        files = (total, kept, total - kept) if not vector or f is not None else (total, 0, 0)
        index = (len(segments), len(seen), len(segments) - len(seen)) if vector else (len(segments), 0, 0)
        return P.plan(logical, P.Observations(*files, *index, transaction_overlay=overlay))

    # -- metadata ------------------------------------------------------------------------------------------------------

    def files(self) -> DataFrame:
        """The manifest's files: name, size, rows, id range, whether they have vectors."""
        table = [(f.name, f.byte_len, f.row_count, f.first, f.last, f.vectors, f.dimension) for f in self.manifest.files]
        return self.spark.createDataFrame(table, "name string, byte_len long, row_count long, first_row_id long, last_row_id long, vectors long, dimension int")

    def zone_maps(self) -> DataFrame:
        """Minimum and maximum of each column of each file, as text."""
        table = [(f.name, f.first, c, str(lo), str(hi)) for f in self.manifest.files if f.row_count for c, (lo, hi) in sorted((f.stats | hidden_stats(f)).items())]
        return self.spark.createDataFrame(table, "file string, first_row_id long, column string, minimum string, maximum string")


def _scan(columns=None, filter=None) -> ScanRequest:
    return ScanRequest(None if columns is None else tuple(columns), filter)


def _meets(ranges, f: DataFile) -> bool:
    import bisect

    at = bisect.bisect_right(ranges, (f.last, 1 << 62)) - 1
    return at >= 0 and ranges[at][1] >= f.first


def hidden_stats(f: DataFile) -> dict[str, list]:
    """Bounds of a file's hidden columns: all its rows have the time of their commit."""
    return {ROW_ID: [f.first, f.last], TIMESTAMP: [f.timestamp, f.timestamp]}
