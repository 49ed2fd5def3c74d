"""Approximate nearest neighbours: p-stable hashing, buckets probed in order of estimated success, exact reranking."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, record_batch, union_all

TABLES = 4
#: Chance that one table's probes hold a neighbour at the target distance; the tables together miss (1 - CHANCE) ** TABLES.
CHANCE = 0.7
#: The same for queries whose probes hold fewer rows than asked for; those that still do meet all rows.
WIDER = (0.9, 0.98)
#: Width of a hash cell, in target distances.
WIDTH = 1.8
#: Hash functions of a table: so many that a cell holds about CELL_ROWS rows, if each cuts the rows as SPLIT, but no more than MOST_HASHES.
CELL_ROWS, SPLIT, MOST_HASHES = 256, 2.6, 10
#: Buckets of a table that a query looks for, at most; the chance is reached long before with MOST_HASHES hashes.
MOST_PROBES = 1 << 14
#: Rows that the target distance is estimated from, at most: picked by hash.
SAMPLE_ROWS, SAMPLE_QUERIES = 2000, 100
#: Rows of one bucket that meet its queries in one task, on average at most; larger buckets are split by row.
SPLIT_ROWS = 4096
#: Rows of result lists that a task holds to merge them; more go on unmerged.
HELD_ROWS = 200_000
SEED = 20


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Rows (vec_id, v) that take part: id and vector not null, components finite and not all zero, of the commonest length (the longest of equals)."""
    x = F.col(vector_col)
    fine = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < math.inf)) & F.exists(x, lambda c: c != 0)
    rows = vectors.where(F.col(id_col).isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), x.alias("v"))
    common = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("m")).orderBy(F.desc("m"), F.desc("n")).first()
    return rows.where(F.size("v") == (common.n if common else 0))


class Hashes:
    """TABLES groups of p-stable hash functions floor((a . v + b) / w), with the target distance that their probes aim at."""

    def __init__(self, dimensions: int, n_rows: int, target: float):
        self.n = max(2, min(MOST_HASHES, round(math.log(max(2, n_rows / CELL_ROWS)) / math.log(SPLIT))))
        draw = np.random.default_rng(SEED)
        self.target, self.width = target, WIDTH * target
        self.a = draw.normal(size=(TABLES, dimensions, self.n))
        self.b = draw.uniform(0, self.width, (TABLES, 1, self.n))
        self.mix = draw.integers(0, 1 << 63, self.n + 1, np.uint64) * np.uint64(2) + np.uint64(1)

    def cells(self, x: np.ndarray) -> np.ndarray:
        """Where each vector lies in each table, in cell widths: (tables, rows, hashes)."""
        return (np.matmul(x[None], self.a) + self.b) / self.width

    def keys(self, table: int, cell: np.ndarray) -> np.ndarray:
        out = np.full(len(cell), np.uint64(table + 1)) * self.mix[0]
        for k in range(self.n):
            out = (out ^ cell[:, k].astype(np.int64).view(np.uint64)) * self.mix[k + 1]
            out ^= out >> np.uint64(29)
        return out.view(np.int64)

    def probes(self, place: np.ndarray, wanted: float = CHANCE) -> tuple[np.ndarray, np.ndarray]:
        """Cells to visit from `place` in order of the chance that a vector at the target distance lies there, up to `wanted` in all, and those chances.

        A projected difference is normal with the target distance as its deviation, so a cell's chance is a product over
        the hashes. The best cells over the first hashes are extended hash by hash; none of the best is lost by that.
        """
        home = np.floor(place)
        shifts = np.arange(-3, 4)
        edges = (home[:, None] + shifts[None, :] - place[:, None]) * WIDTH
        chance = _normal(edges + WIDTH) - _normal(edges)
        found, cells = np.ones(1), np.zeros((1, 0), np.int64)
        for k in range(self.n):
            grown = (found[:, None] * chance[k][None, :]).ravel()
            best = np.argsort(-grown, kind="stable")[:MOST_PROBES]
            found = grown[best]
            cells = np.column_stack([cells[best // len(shifts)], home[k] + shifts[best % len(shifts)]])
        stop = int(np.searchsorted(np.cumsum(found), wanted)) + 1
        return cells[:stop], found[:stop]


def _normal(x: np.ndarray) -> np.ndarray:
    return np.vectorize(lambda t: 0.5 * (1 + math.erf(t / math.sqrt(2))))(x)


def _target(rows: DataFrame, n_rows: int) -> tuple[float, int]:
    """Median distance of sampled rows to their nearest other sampled row, and the dimension."""
    place = F.pmod(F.xxhash64("v"), F.lit(1 << 30)).cast("long")
    some = rows.where(place < int(min(1.0, 1.2 * SAMPLE_ROWS / max(1, n_rows)) * (1 << 30)))
    sample = [r.v for r in some.select("v").orderBy(F.xxhash64("v"), "vec_id").limit(SAMPLE_ROWS).collect()]
    if not sample:
        return 1.0, 1
    x = np.unique(np.array(sample, float), axis=0)
    least = []
    for q in x[:: max(1, len(x) // SAMPLE_QUERIES)]:
        d = np.sqrt(((x - q) ** 2).sum(1))
        least.append(np.partition(d, 1)[1] if len(d) > 1 else 0.0)
    return float(np.median(least)) or 1.0, len(sample[0])


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else np.empty((0, 1))


def _hashed(rows: DataFrame, hashes: Hashes, probing: bool, wanted: float = CHANCE) -> DataFrame:
    """Rows (bucket, kind, vec_id, v): a row in each table's bucket, or a query in all buckets that it probes."""
    inner = dict(rows.dtypes)["v"]

    def run(batches):
        for batch in batches:
            for part in (batch.slice(i, 64 if probing else 4096) for i in range(0, batch.num_rows, 64 if probing else 4096)):
                places = hashes.cells(_matrix(part.column(1)))
                for table in range(TABLES):
                    if probing:
                        cells = [hashes.probes(p, wanted)[0] for p in places[table]]
                        at, buckets = np.repeat(np.arange(len(cells)), [len(c) for c in cells]), hashes.keys(table, np.concatenate(cells))
                    else:
                        at, buckets = np.arange(part.num_rows), hashes.keys(table, np.floor(places[table]))
                    yield pa.RecordBatch.from_arrays([pa.array(buckets), pa.array(np.full(len(at), int(probing), np.int32)), part.column(0).take(pa.array(at)), part.column(1).take(pa.array(at))], ["bucket", "kind", "vec_id", "v"])

    return rows.select("vec_id", "v").mapInArrow(run, f"bucket long, kind int, vec_id long, v {inner}")


def _met(dealt: DataFrame, k: int) -> DataFrame:
    """For each bucket part, its rows against its queries by exact distance: the k nearest of each query that a task finds, or more."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        now, ids, parts, x, held = None, [], [], None, []
        for batch in batches:
            group = np.stack([batch.column(i).to_numpy() for i in range(3)], 1).astype(np.int64)
            names, matrix = batch.column(3).to_numpy(), _matrix(batch.column(4))
            cuts = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]).any(1)]) if len(group) else []
            for lo, hi in zip(cuts, [*cuts[1:], len(group)], strict=True):
                key = tuple(group[lo][:2])
                if key != now:
                    now, ids, parts, x = key, [], [], None
                if group[lo][2] == 0:
                    ids.append(names[lo:hi])
                    parts.append(matrix[lo:hi])
                    x = None
                    continue
                if not parts:
                    continue
                if x is None:
                    ids, parts = [np.concatenate(ids)], [np.concatenate(parts)]
                    x = parts[0]
                out = []
                for q, v in zip(names[lo:hi], matrix[lo:hi], strict=True):
                    d = x - v
                    score = np.sqrt(np.einsum("ij,ij->i", d, d))
                    near = np.lexsort((ids[0], score))[:k]
                    out.append((np.full(len(near), q), ids[0][near], score[near]))
                held.append(tuple(np.concatenate(c) for c in zip(*out, strict=True)))
                if sum(len(h[0]) for h in held) > HELD_ROWS:
                    held = [_merged_lists(held, k)]
                    if len(held[0][0]) > HELD_ROWS // 2:
                        yield record_batch(schema, *held.pop())
        if held:
            yield record_batch(schema, *_merged_lists(held, k))

    return dealt.mapInArrow(run, "query_id long, vec_id long, score double")


def _merged_lists(lists: list[tuple[np.ndarray, ...]], k: int) -> tuple[np.ndarray, ...]:
    """One list of (query, row, score) with the k nearest rows of each query."""
    query, row, score = (np.concatenate(c) for c in zip(*lists, strict=True))
    order = np.lexsort((row, score, query))
    query, row, score = query[order], row[order], score[order]
    once = np.r_[True, (query[1:] != query[:-1]) | (row[1:] != row[:-1])] if len(query) else np.zeros(0, bool)
    query, row, score = query[once], row[once], score[once]
    first = np.searchsorted(query, query, side="left")
    near = np.arange(len(query)) - first < k
    return query[near], row[near], score[near]


def search(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k nearest other rows found for each row of `vectors` that `is_query`, by Euclidean distance.

    Rows alike in all components tie, and ties go to the smaller id, so of equal vectors only the k + 1 smallest ids can
    ever be among anyone's nearest: only these are indexed, and equal queries search once. A bucket with many rows is
    split by a hash of the row. Its probing queries go to every part, each part gives the k + 1 nearest of each query,
    and the parts' lists merge. Rows with null, zero or non-finite vectors or of an odd length take no part. A query
    whose probes hold fewer rows than asked for probes WIDER, step by step, and if that does not help it gets all rows.
    Rows with equal ids are candidates each.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    least = W.partitionBy("v").orderBy("vec_id")
    index = materialize(rows.withColumn("n", F.row_number().over(least)).where(F.col("n") <= k + 1).drop("n"))
    asked = materialize(usable(vectors.where(is_query), id_col, vector_col).groupBy("v").agg(F.min("vec_id").alias("vec_id")).select("vec_id", "v"))
    n_rows = index.count()
    target, dimensions = _target(index, n_rows)
    hashes = Hashes(dimensions, n_rows, target)
    placed, short, lists = materialize(_hashed(index, hashes, False)), asked, []
    for wanted in (CHANCE, *WIDER):
        found = _nearest(placed, _hashed(short.repartition(spark.sparkContext.defaultParallelism * 4, "vec_id"), hashes, True, wanted), k + 1)
        full = found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= min(k + 1, n_rows)).select(F.col("query_id").alias("vec_id"))
        lists.append(found.join(full.withColumnRenamed("vec_id", "query_id"), "query_id", "left_semi"))
        short = materialize(short.join(full, "vec_id", "left_anti"))
        if short.isEmpty():
            break
    else:
        alone = F.lit(0).cast("long")
        everything = lambda df, kind: df.select(alone.alias("bucket"), F.lit(kind).alias("kind"), "vec_id", "v")
        lists.append(_nearest(everything(index, 0), everything(short, 1), k + 1))
    best = union_all(lists)
    asking = usable(vectors.where(is_query), id_col, vector_col).select(F.col("vec_id").alias("query_id"), "v").distinct()
    lists = best.withColumnRenamed("query_id", "rep").join(asked.select(F.col("vec_id").alias("rep"), "v"), "rep").groupBy("rep", "v").agg(F.sort_array(F.collect_list(F.struct("score", "vec_id"))).alias("near"))
    own = asking.join(lists, "v").select("query_id", F.explode(F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)).alias("x"))
    return own.select("query_id", F.row_number().over(W.partitionBy("query_id").orderBy("x.score", "x.vec_id")).alias("rank"), "x.vec_id", "x.score")


def _nearest(placed: DataFrame, probing: DataFrame, k: int) -> DataFrame:
    """The k nearest rows of `placed` for each query of `probing`, of those that share a bucket with it."""
    spark, probing = placed.sparkSession, materialize(probing)
    sizes = placed.groupBy("bucket").agg(F.count("*").alias("n")).select("bucket", F.ceil(F.col("n") / SPLIT_ROWS).cast("int").alias("parts"))
    of_rows = placed.join(sizes, "bucket").select("bucket", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("part"), "kind", "vec_id", "v")
    of_queries = probing.join(sizes, "bucket").select("bucket", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "kind", "vec_id", "v")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism * 4)
    dealt = of_rows.unionByName(of_queries).repartition(n, "bucket", "part").sortWithinPartitions("bucket", "part", "kind")
    lists = _met(dealt, k).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    best = W.partitionBy("query_id").orderBy("score", "vec_id")
    return materialize(lists.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).drop("n"))


def op10_neighbours(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)
