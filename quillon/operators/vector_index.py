"""An approximate index over vectors: cells around trained centres, stored by cell, searched cell by cell, measured exactly.

A segment covers the vectors of some data files. It holds a copy of them in Parquet, sorted by cell, so that a search
reads the row groups of the cells it probes and nothing else, and a checksummed description with the centres. Segments
are built after commits, for the files that none covers yet; a search measures rows of uncovered files as they are.
Deleted rows leave through tombstones and deletion vectors, and compaction drops segments with the files they cover.
"""

from __future__ import annotations

import base64
import json
import math
import zlib
from dataclasses import dataclass, replace
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import errors as E
from ..functions.vectors import matrix
from ..plans.schema import ROW_ID
from ..sources import manifest as M
from . import rows

#: Vectors that centres are trained on, at most: picked by a hash of their row id. Every vector is indexed.
SAMPLE_ROWS = 20_000
MOST_CELLS, ROUNDS = 4096, 12
#: Bytes of vectors in one file of a segment, about.
FILE_BYTES = 128 << 20


@dataclass(frozen=True)
class Description:
    """Centres of a segment's cells, one a row, and the keys of its Parquet files."""

    centres: np.ndarray
    parts: tuple[str, ...]

    def encode(self) -> bytes:
        shown = base64.b64encode(self.centres.astype("<f4").tobytes()).decode()
        text = json.dumps({"cells": len(self.centres), "dimension": self.centres.shape[1], "centres": shown, "parts": self.parts})
        return json.dumps({"crc32": zlib.crc32(text.encode()), "segment": text}).encode()

    @staticmethod
    def decode(data: bytes, name: str) -> Description:
        try:
            outer = json.loads(data)
            if zlib.crc32(outer["segment"].encode()) != outer["crc32"]:
                raise ValueError("the checksum differs")
            body = json.loads(outer["segment"])
            centres = np.frombuffer(base64.b64decode(body["centres"]), "<f4").reshape(body["cells"], body["dimension"])
            return Description(centres.astype(np.float64), tuple(map(M.check_key, body["parts"])))
        except (ValueError, KeyError, TypeError, AttributeError) as error:
            raise E.CorruptSegment(f"segment {name!r}: {error}", name=name) from error

    def near(self, query, probes: int) -> list[int]:
        """The `probes` cells whose centres are nearest to the query."""
        apart = ((self.centres - np.asarray(query, float)) ** 2).sum(1)
        return np.argsort(apart, kind="stable")[:probes].tolist()


def train(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centres by k-means, from seeded draws; an empty cell takes the vector that is farthest from its centre."""
    draw = np.random.default_rng(3)
    centres = sample[draw.choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(rounds):
        cell, apart = nearest_cell(sample, centres)
        count = np.bincount(cell, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, sample)
        centres = np.where(count[:, None] > 0, sums / np.maximum(1, count)[:, None], centres)
        empty = np.flatnonzero(count == 0)
        centres[empty] = sample[np.argsort(-apart, kind="stable")[: len(empty)]]
    return centres


def nearest_cell(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row and its squared distance, by one matrix product a block."""
    norms, cell, apart = (centres**2).sum(1), [], []
    for i in range(0, len(x), 4096):
        part = x[i : i + 4096]
        d = norms[None, :] - 2 * (part @ centres.T)
        best = d.argmin(1)
        cell.append(best)
        apart.append(np.maximum(0, d[np.arange(len(part)), best] + (part**2).sum(1)))
    return np.concatenate([np.empty(0, np.int64), *cell]), np.concatenate([np.empty(0), *apart])


def build(dataset: Any, cells: int | None = None):
    """Index the vectors of all files that no segment covers, and publish a version that lists the new segment."""
    with dataset._lifecycle.exclusive(), dataset._commit_lock:
        current, spark, backend = dataset._current.manifest, dataset.spark, dataset.backend
        covered = {name for s in current.segments for name in s.files}
        files = [f for f in current.files if f.vectors and f.name not in covered]
        if not files:
            return dataset._current
        found = dataset._current.frame(files, ids=True).where("vector is not null").select(ROW_ID, "vector")
        n = sum(f.vectors for f in files)
        share = min(1.0, 1.2 * SAMPLE_ROWS / n)
        picked = found.where(F.pmod(F.xxhash64(ROW_ID), F.lit(1 << 30)) < int(share * (1 << 30)))
        sample = picked.orderBy(F.xxhash64(ROW_ID), ROW_ID).limit(SAMPLE_ROWS).select("vector").toArrow().column(0).combine_chunks()
        dimension = files[0].dimension
        wanted = cells or min(MOST_CELLS, math.ceil(math.sqrt(n)))
        centres = train(matrix(sample), wanted) if len(sample) else np.zeros((1, dimension))

        def run(batches):
            for batch in batches:
                cell, _ = nearest_cell(matrix(batch.column(1)), centres)
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), *batch.columns], ["cell", ROW_ID, "vector"])

        dealt = found.mapInArrow(run, f"cell int, {ROW_ID} long, vector array<float>")
        dealt = dealt.repartitionByRange(-(-n * dimension * 4 // FILE_BYTES), "cell", ROW_ID).sortWithinPartitions("cell", ROW_ID)
        folder = f"{M.INDEX}/{dataset._next_attempt():020}"
        dealt.write.option("parquet.block.size", 1 << 20).parquet(backend.url(folder))
        parts = [m for m in backend.list(folder) if m.key.endswith(".parquet")]
        backend.put(f"{folder}.json", Description(centres, tuple(m.key for m in parts)).encode())
        segment = M.Segment(f"{folder}.json", tuple(f.name for f in files), sum(m.bytes for m in parts), n)
        now = dataset._timestamp()
        return dataset._publish(replace(current, version=current.version + 1, segments=(*current.segments, segment), next_attempt_id=dataset._attempt, commit_time_high_water=now, committed_at_us=now))


def describe(backend, segment: M.Segment) -> Description:
    try:
        return Description.decode(backend.get(segment.name), segment.name)
    except E.ObjectNotFound as error:
        raise E.CorruptSegment(f"segment {segment.name!r} is missing", name=segment.name) from error


def search(snapshot: Any, request: Any, probes: int, live: DataFrame | None = None) -> DataFrame:
    """(row_id, distance) of the nearest live rows in the `probes` nearest cells of each segment, and in files without one.

    `live` restricts the rows to its ids (row_id); rows that the filter drops are gone before the nearest are picked. If
    fewer than k are found, four times as many cells are probed, and so on to all of them.
    """
    schema, manifest = snapshot.schema, snapshot.manifest
    schema.check_vector_search(request)
    segments = [(s, describe(snapshot.backend, s)) for s in manifest.segments]
    covered = {name for s, _ in segments for name in s.files}
    kept = snapshot.surviving(request.filter)
    bare = snapshot.frame([f for f in kept if f.name not in covered], ids=True).where("vector is not null").select(ROW_ID, "vector")
    wanted = None if request.filter is None else snapshot.matching_row_ids(request.filter).withColumnRenamed("row_id", ROW_ID)
    while True:
        found = bare
        for segment, described in segments:
            if not any(f.name in segment.files for f in kept) or not described.parts:
                continue
            stored = snapshot.spark.read.schema(f"cell int, {ROW_ID} long, vector array<float>").parquet(*[snapshot.backend.url(p) for p in described.parts])
            inside = stored.where(F.col("cell").isin(described.near(request.query, probes))).select(ROW_ID, "vector")
            found = found.unionByName(snapshot.alive(inside))
        for ids in (wanted, None if live is None else live.select(F.col("row_id").alias(ROW_ID))):
            found = found if ids is None else found.join(ids, ROW_ID, "left_semi")
        hits = rows.nearest(found, request.query, request.k, None)
        if probes >= max([0, *(len(d.centres) for _, d in segments)]):
            return hits
        near = hits.collect()  # k rows at most
        if len(near) >= request.k:
            return snapshot.spark.createDataFrame(near, hits.schema)
        probes *= 4


def recall(snapshot: Any, queries: list[tuple[float, ...]], k: int, probes: int) -> float:
    """Share of the true k nearest rows that searches with `probes` find."""
    from ..plans.requests import VectorSearchRequest

    right = total = 0
    for q in queries:
        request = VectorSearchRequest(q, k)
        want = {r.row_id for r in snapshot.vector_search(request).collect()}
        right += len(want & {r.row_id for r in search(snapshot, request, probes).collect()})
        total += len(want)
    return right / max(1, total)
