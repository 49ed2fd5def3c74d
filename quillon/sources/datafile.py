"""Writing and reading data files: staged Parquet parts with ids by position, statistics in one pass, pruned scans."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import errors as E
from ..functions.vectors import finite
from ..plans.schema import ROW_ID, TIMESTAMP, Schema
from .backend import HadoopBackend, LocalBackend
from .manifest import DATA, DataFile

_FILE, _AT = "_file", "_at"
#: Characters of a text that its column's bounds keep.
BOUND_CHARS, LAST_CHAR = 64, "\U0010FFFF"


def write_parts(backend: LocalBackend | HadoopBackend, df: DataFrame, attempt: int, batch: int) -> list[str]:
    """Write `df` once, as Parquet parts of one attempt; their keys, in partition order. Nothing lists them until a manifest does."""
    folder = f"{DATA}/{attempt:020}-{batch}"
    df.write.option("parquet.page.write-checksum.enabled", "true").parquet(backend.url(folder))
    return [m.key for m in backend.list(folder) if m.key.endswith(".parquet")]


def describe(spark: SparkSession, backend: LocalBackend | HadoopBackend, keys: list[str], schema: Schema, stored: bool = False) -> list[DataFile]:
    """Row counts, statistics and vectors of files, in one Spark job grouped by file; NaN is left out of minima and maxima.

    Raises if a column that must not be null is, or a vector has a non-finite component or another dimension. Row ids
    are those stored, or still to be assigned.
    """
    if not keys:
        return []
    df = spark.read.schema(physical(schema, stored)).parquet(*[backend.url(k) for k in keys]).select("*", F.col("_metadata.file_name").alias(_FILE))
    aggs: list[Column] = [F.count("*").alias("n")]
    if stored:
        aggs += [F.min(ROW_ID).alias("first"), F.max(ROW_ID).alias("last")]
    for i, f in enumerate(schema.fields):
        c = F.col(f"`{f.name}`")
        if not f.nullable:
            aggs.append(F.count_if(c.isNull()).alias(f"nulls{i}"))
        if f.dimensions:
            aggs += [F.count(c).alias(f"vectors{i}"), F.count_if(~finite(c)).alias(f"odd{i}"), F.count_if(F.size(c) != f.dimensions).alias(f"long{i}")]
        elif f.type in ("int64", "float64", "utf8"):
            x = F.when(~F.isnan(c), c) if f.type == "float64" else F.substring(c, 1, BOUND_CHARS + 1) if f.type == "utf8" else c
            aggs += [F.min(x).alias(f"min{i}"), F.max(x).alias(f"max{i}")]
    found = {r[_FILE]: r.asDict() for r in df.groupBy(_FILE).agg(*aggs).collect()}
    sizes = {m.key: m.bytes for folder in {k.rpartition("/")[0] for k in keys} for m in backend.list(folder)}
    out = []
    for key in keys:
        r = found.get(key.rpartition("/")[2], {"n": 0})
        for i, f in enumerate(schema.fields):
            if r.get(f"nulls{i}"):
                raise E.BatchSchemaMismatch(f"column '{f.name}' holds nulls", name=f.name)
            if r.get(f"long{i}"):
                raise E.BatchSchemaMismatch(f"column '{f.name}' holds vectors that have not {f.dimensions} components", name=f.name)
            if r.get(f"odd{i}"):
                raise E.NonFiniteStoredComponent(f"column '{f.name}' holds a non-finite component", name=f.name)
        stats = {f.name: _bounds(r[f"min{i}"], r[f"max{i}"]) for i, f in enumerate(schema.fields) if r.get(f"min{i}") is not None}
        vectors = [(r.get(f"vectors{i}", 0), f.dimensions) for i, f in enumerate(schema.fields) if f.dimensions]
        out.append(DataFile(key, sizes[key], r["n"], r.get("first"), r.get("last"), 0, stats, stored, vectors[0][0] if vectors else 0, vectors[0][1] if vectors and vectors[0][0] else None))
    return out


def _bounds(low, high) -> list:
    """Bounds of a column, of long text by its first characters: a prefix is below what it begins, the last code point above what follows."""
    if isinstance(low, str):
        low = low[:BOUND_CHARS]
        high = high if len(high) <= BOUND_CHARS or high[BOUND_CHARS] == LAST_CHAR else high[:BOUND_CHARS] + LAST_CHAR
    return [low, high]


def numbered(files: list[DataFile], first: int) -> list[DataFile]:
    """`files` with consecutive row ids from `first` on; a file without rows has none."""
    out = []
    for f in files:
        out.append(replace(f, first=first if f.row_count else None, last=first + f.row_count - 1 if f.row_count else None))
        first += f.row_count
    return out


def physical(schema: Schema, stored: bool) -> T.StructType:
    """The columns that a file is read with; vectors come back with nullable elements, whatever was written."""
    fields = [T.StructField(f.name, f.dataType if not isinstance(f.dataType, T.ArrayType) else T.ArrayType(T.FloatType()), True) for f in schema.spark().fields]
    return T.StructType([*fields, *([T.StructField(ROW_ID, T.LongType())] if stored else [])])


#: What Spark says of files that it cannot read.
_UNREADABLE = ("FAILED_READ_FILE", "CANNOT_READ_FILE", "PATH_NOT_FOUND", "FILE_NOT_EXIST", "is not a Parquet file", "FileNotFoundException", "Could not read footer", "CorruptedFile", "ChecksumException", "ParquetDecodingException", "ParquetFileReader", "could not verify page integrity")


def raise_if_corrupt(error: Exception) -> None:
    """A typed error if Spark could not read a data file."""
    if any(x in str(error) for x in _UNREADABLE):
        raise E.CorruptDataFile(f"a data file cannot be read: {str(error)[:300]}") from error


def read(spark: SparkSession, backend: LocalBackend | HadoopBackend, schema: Schema, files: list[DataFile], ids: bool = False, timestamps: bool = False) -> DataFrame:
    """The logical columns of `files`, with row ids and commit times only if asked for.

    Columns that a file lacks are null. Ids by position come from the file's first id and the reader's row index; the
    first ids of many files arrive by a join on the file's name, so the plan stays small.
    """
    parts = []
    for stored in (False, True):
        some = [f for f in files if f.stored == stored and f.row_count]
        if not some:
            continue
        try:
            df = spark.read.schema(physical(schema, stored)).parquet(*[backend.url(f.name) for f in some])
        except Exception as error:  # a file is gone
            raise_if_corrupt(error)
            raise
        columns = [F.col(f"`{n}`") for n in schema.names]
        if ids and stored:
            columns.append(F.col(ROW_ID))
        if timestamps or (ids and not stored):
            # part names carry the writer's unique id, so they tell files apart
            table = spark.createDataFrame([(f.name.rpartition("/")[2], f.first, f.timestamp) for f in some], f"{_FILE} string, _first long, _time long")
            df = df.select("*", F.col("_metadata.file_name").alias(_FILE), F.col("_metadata.row_index").alias(_AT)).join(_small(table, len(some)), _FILE)
            columns += [(F.col("_first") + F.col(_AT)).alias(ROW_ID)] if ids and not stored else []
            columns += [F.col("_time").alias(TIMESTAMP)] if timestamps else []
        parts.append(df.select(*columns))
    if not parts:
        extra = [T.StructField(n, T.LongType()) for n, wanted in ((ROW_ID, ids), (TIMESTAMP, timestamps)) if wanted]
        return spark.createDataFrame([], T.StructType([*physical(schema, False).fields, *extra]))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


#: A table of at most so many file names is broadcast (about 100 bytes each).
MOST_BROADCAST_FILES = 100_000


def _small(table: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(table) if rows <= MOST_BROADCAST_FILES else table
