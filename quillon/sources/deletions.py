"""Deletion vectors: deleted row ids as bits, 64 ids a row, in Parquet files beside the data."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.schema import ROW_ID
from .backend import HadoopBackend, LocalBackend
from .datafile import write_parts
from .manifest import Deletion

#: Words (64 ids each, about 16 bytes) that are broadcast, at most.
MOST_BROADCAST_WORDS = 500_000
#: Ids of a block that a wide range of deleted ids is cut into; what is left at its ends becomes words.
BLOCK_BITS = 20

_BIT = "shiftleft(1L, cast({0} & 63 as int))"


@dataclass(frozen=True)
class Vector:
    """Rows (word, mask) of deleted ids, and how many rows those are at most."""

    words: DataFrame
    count: int


def of_ids(ids: DataFrame) -> DataFrame:
    """Rows (word, mask) of a frame of ids: bits are set in each task first, so a shuffle moves a row for 64 ids."""
    name = ids.columns[0]
    return ids.groupBy(F.shiftright(name, 6).alias("word")).agg(F.expr(f"bit_or({_BIT.format(f'`{name}`')})").alias("mask"))


def of_ranges(spark: SparkSession, ranges: list[tuple[int, int]]) -> tuple[Vector | None, Vector | None]:
    """Ranges of ids as words, and as whole blocks (rows of `block`) in between: a range of any width makes few rows."""
    size, edges, blocks = 1 << BLOCK_BITS, [], []
    for lo, hi in ranges:
        first, last = -(-lo >> BLOCK_BITS), (hi + 1 >> BLOCK_BITS) - 1
        if first <= last:
            blocks.append((first, last))
            edges += [(lo, first * size - 1), ((last + 1) * size, hi)]
        else:
            edges.append((lo, hi))
    edges = [e for e in edges if e[0] <= e[1]]
    words = whole = None
    if edges:
        spread = spark.createDataFrame(edges, "lo long, hi long").selectExpr("lo", "hi", "explode(sequence(shiftright(lo, 6), shiftright(hi, 6))) AS word")
        at = "cast(greatest(lo, word * 64) & 63 as int)"
        bits = f"cast(least(hi, word * 64 + 63) & 63 as int) - {at}"
        masks = spread.selectExpr("word", f"shiftleft(shiftrightunsigned(-1L, 63 - ({bits})), {at}) AS mask").groupBy("word").agg(F.bit_or("mask").alias("mask"))
        words = Vector(masks, sum((hi >> 6) - (lo >> 6) + 1 for lo, hi in edges))
    if blocks:
        table = spark.createDataFrame(blocks, "first long, last long").selectExpr("explode(sequence(first, last)) AS block")
        whole = Vector(table, sum(last - first + 1 for first, last in blocks))
    return words, whole


def without(df: DataFrame, vector: Vector) -> DataFrame:
    """Rows of `df` whose id is not set in the vector; it is broadcast only if few words say so."""
    return _joined(df, vector, "left_anti")


def within(df: DataFrame, vector: Vector) -> DataFrame:
    """Rows of `df` whose id is set in the vector."""
    return _joined(df, vector, "left_semi")


def _joined(df: DataFrame, vector: Vector, how: str) -> DataFrame:
    words = F.broadcast(vector.words) if vector.count <= MOST_BROADCAST_WORDS else vector.words
    if vector.words.columns == ["block"]:
        return df.join(words, F.shiftright(ROW_ID, BLOCK_BITS) == F.col("block"), how)
    set_ = F.expr(f"mask & {_BIT.format(ROW_ID)} <> 0")
    return df.join(words, (F.shiftright(ROW_ID, 6) == F.col("word")) & set_, how)


def write(spark: SparkSession, backend: LocalBackend | HadoopBackend, words: DataFrame, attempt: int, batch: int) -> Deletion | None:
    """`words` in Parquet files of their own, sorted, and what a manifest says of them; None if no id is set."""
    keys = write_parts(backend, words.sortWithinPartitions("word"), attempt, batch)
    found = spark.read.schema("word long, mask long").parquet(*[backend.url(k) for k in keys])
    low, high, n, ids = found.agg(F.min("word"), F.max("word"), F.count("*"), F.sum(F.bit_count("mask"))).first() if keys else (None, None, 0, 0)
    if not n:
        for key in keys:
            backend.delete(key)
        return None
    sizes = {m.key: m.bytes for folder in {k.rpartition("/")[0] for k in keys} for m in backend.list(folder)}
    return Deletion(tuple(keys), sum(sizes[k] for k in keys), n, int(ids), low * 64, high * 64 + 63)


def read(spark: SparkSession, backend: LocalBackend | HadoopBackend, deletions: tuple[Deletion, ...]) -> Vector:
    """All of `deletions` as one vector with a row a word."""
    words = spark.read.schema("word long, mask long").parquet(*[backend.url(n) for d in deletions for n in d.names])
    return Vector(words.groupBy("word").agg(F.bit_or("mask").alias("mask")) if len(deletions) > 1 else words, sum(d.words for d in deletions))


def ids(vector: Vector) -> DataFrame:
    """Rows (_row_id) of a vector's ids."""
    bits = vector.words.select("word", F.explode(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.getbit("mask", b) == 1)).alias("b"))
    return bits.select((F.col("word") * 64 + F.col("b")).alias(ROW_ID))
