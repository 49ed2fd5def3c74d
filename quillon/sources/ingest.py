"""From the types of other tables to the logical types, and Arrow in and out."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import errors as E
from ..plans.schema import Field, Schema


def conform(df: DataFrame, schema: Schema) -> DataFrame:
    """Columns by name, in schema order, cast to their logical types."""
    for f in schema.fields:
        if f.name not in df.columns:
            raise E.UnknownColumn(f"unknown column '{f.name}'", name=f.name)
    kind = lambda f: T.ArrayType(T.FloatType()) if f.dimensions else f.spark().dataType
    return df.select(*[F.col(f"`{f.name}`").cast(kind(f)).alias(f.name) for f in schema.fields])


def logical(df: DataFrame) -> DataFrame:
    """`df` with integers widened to int64, timestamps as microseconds since 1970, and number lists as float vectors."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.ByteType | T.ShortType | T.IntegerType):
            c = c.cast("long")
        elif isinstance(f.dataType, T.TimestampType | T.TimestampNTZType):
            c = F.unix_micros(c.cast("timestamp"))
        elif isinstance(f.dataType, T.FloatType):
            c = c.cast("double")
        elif isinstance(f.dataType, T.ArrayType):
            c = c.cast(T.ArrayType(T.FloatType()))
        out.append(c.alias(f.name))
    return df.select(*out)


def schema_of(df: DataFrame, dimensions: dict[str, int] | None = None) -> Schema:
    """The logical schema of a frame that `logical` made; `dimensions` says how long its vectors are."""
    kinds = {"boolean": "bool", "bigint": "int64", "decimal(20,0)": "uint64", "double": "float64", "string": "utf8"}
    out = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        if isinstance(f.dataType, T.ArrayType):
            out.append(Field(f.name, f"vector[{(dimensions or {})[f.name]}]"))
        elif kind in kinds:
            out.append(Field(f.name, kinds[kind]))
        else:
            raise E.UnsupportedType(f"unsupported type {kind} of column '{f.name}'", name=f.name)
    return Schema(tuple(out))


def from_ipc(spark: SparkSession, data: bytes) -> DataFrame:
    """The one record batch of an Arrow IPC stream."""
    with pa.ipc.open_stream(data) as reader:
        batches = list(reader)
    if len(batches) != 1:
        raise E.BatchSchemaMismatch(f"an IPC stream of one batch is expected, this has {len(batches)}", batches=len(batches))
    return spark.createDataFrame(pa.Table.from_batches(batches))


def to_ipc(df: DataFrame) -> bytes:
    """A result, collected, as an Arrow IPC stream of one batch."""
    table = df.toArrow().combine_chunks()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        for batch in table.to_batches() or [pa.RecordBatch.from_pylist([], table.schema)]:
            writer.write_batch(batch)
    return sink.getvalue().to_pybytes()
