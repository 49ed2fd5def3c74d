"""What several training-data operators share: shared-folder tables, word patterns, Arrow blocks."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of these characters separate words (space, tab, line feed, vertical tab, form feed, return).
SPACE_CLASS = r"[\x20\x09-\x0D]"
#: bytes.split() separates at the same six characters.
ASCII_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Bytes of text that one vectorised step looks at; bounds the memory of a Python worker.
BLOCK_BYTES = 1 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one is made only where none is set, as in tests."""
    jsc = spark.sparkContext._jsc.sc()
    if spark.sparkContext.getConf().contains("spark.checkpoint.dir"):
        return spark.sparkContext.getConf().get("spark.checkpoint.dir").rstrip("/")
    found = jsc.getCheckpointDir()
    if not found.isDefined():
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quillon-"))
        found = jsc.getCheckpointDir()
    return found.get().rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write `df` once to the shared folder and read it back: lineage ends at files any executor can read.

    The files go when the driver's JVM ends. Unlike ``checkpoint()`` the plan runs once, not twice. Collecting garbage
    lets Spark's cleaner delete the shuffle files of the plan just run, which nothing reads again.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quillon-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    _WRITTEN.add(path)
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


#: Folders that `materialize` wrote and nobody has deleted yet.
_WRITTEN: set[str] = set()


def written() -> set[str]:
    """Folders of the tables that `materialize` wrote and nobody has deleted yet."""
    return set(_WRITTEN)


def sweep(spark: SparkSession, paths: set[str], kept: DataFrame) -> None:
    """Delete those of the tables `paths` that `kept` does not read."""
    used = {f.rpartition("/")[0].rpartition("/")[2] for f in kept.inputFiles()}
    for path in [p for p in paths & _WRITTEN if p.rpartition("/")[2] not in used]:
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _WRITTEN.discard(path)


def release(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete tables that `materialize` wrote and that no later step reads."""
    names = {f.rpartition("/")[0].rpartition("/")[2] for df in frames for f in df.inputFiles()}
    for path in [p for p in _WRITTEN if p.rpartition("/")[2] in names]:
        _delete(spark, path)


def apart(df: DataFrame, *columns: str) -> DataFrame:
    """`df` dealt by another function of `columns` than a join on them uses.

    An aggregate that meets its own rows again shares its shuffle with the join, and then Spark cannot split the partition
    of a very common key. Dealt anew, both sides come to the join by shuffles of their own, which it can.
    """
    return df.repartition(F.hash(*columns))


def fresh(df: DataFrame, stem: str) -> str:
    """A column name starting with `stem` that `df` does not use (Spark compares names without case)."""
    used, name = {c.lower() for c in df.columns}, stem
    while name.lower() in used:
        name += "_"
    return name


def words_of(text: Column) -> Column:
    """All words of a text, in order; null or empty text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), lambda w: w != "")


def let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once, inside one expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def least_count(n_rows: int, per_task: int, spark: SparkSession) -> int:
    """Partitions so that none holds much more than `per_task` rows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_rows // per_task))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def texts_of(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 of each value of a string column, one after the other; null counts as empty."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1].tolist() if len(column) else [0]
    missing = column.is_null().to_numpy(zero_copy_only=False)
    raw = memoryview(data) if data is not None else memoryview(b"")
    for i in range(len(column)):
        yield b"" if missing[i] else raw[at[i] : at[i + 1]].tobytes()


def slices(batches, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in parts of few rows, so that what is made of a part stays small; nothing is copied."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def text_blocks(batch: pa.RecordBatch, name: str, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive rows `[first, last)` of at most `limit` bytes (or one row), as one byte array with row offsets.

    The bytes are a view of the Arrow buffer: nothing is copied or decoded. Null counts as empty.
    """
    column = batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, side="right")) - 1)
        yield first, last, raw[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def record_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
