"""Row-level operators on DataFrames with row ids: tombstones, projection, grouping, exact nearest neighbours."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import errors as E
from ..functions.vectors import matrix, squared_l2
from ..plans.requests import Aggregate
from ..plans.schema import ROW_ID, Field, Schema
from ..sources import datafile, deletions

#: Ranges of deleted ids that are written into the filter itself; more are joined.
MOST_INLINE_RANGES = 64


def without_tombstones(df: DataFrame, ranges: tuple[tuple[int, int], ...]) -> DataFrame:
    """Rows whose id lies in none of the ranges: a plain condition for few ranges, else anti joins of their bits and blocks.

    A range of any width makes a row for each 64 ids at its ends and one for each block of ids between (`deletions.of_ranges`).
    """
    if not ranges:
        return df
    if len(ranges) <= MOST_INLINE_RANGES:
        dead = F.lit(False)
        for lo, hi in ranges:
            dead = dead | ((F.col(ROW_ID) == lo) if lo == hi else F.col(ROW_ID).between(lo, hi))
        return df.where(~dead)
    for vector in deletions.of_ranges(df.sparkSession, list(ranges)):
        df = df if vector is None else deletions.without(df, vector)
    return df


def project(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in columns])


def float_key(column: Column) -> Column:
    """Whether a float is -0.0: with the value, which takes both zeros and every NaN as one, it groups as the bits do."""
    return F.when(column == 0, column.cast("string") == "-0.0").otherwise(F.lit(False))


def aggregate_column(a: Aggregate, field: Field) -> Column:
    x = F.col(f"`{a.column}`")
    if a.function == "max" and field.type == "float64":
        out = F.coalesce(F.max(F.when(~F.isnan(x), x)), F.max(x))
    else:
        out = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max, "avg": F.avg}[a.function](x)
    return out.alias(a.alias)


def group(df: DataFrame, schema: Schema, keys: list[str], aggregates: list[Aggregate]) -> DataFrame:
    """One row for each distinct key tuple, null being a value; float keys group by bits. Without aggregates: the keys alone."""
    signs = {k: f"_sign{i}" for i, k in enumerate(keys) if schema.field(k).type == "float64"}
    by = [F.col(f"`{k}`") for k in keys] + [float_key(F.col(f"`{k}`")).alias(sign) for k, sign in signs.items()]
    outs = [aggregate_column(a, schema.field(a.column)) for a in aggregates]
    grouped = df.groupBy(*by).agg(*outs) if outs else df.select(*by).distinct()
    shown = [F.when(F.col(signs[k]), F.lit(-0.0)).otherwise(F.col(f"`{k}`")).alias(k) if k in signs else F.col(f"`{k}`") for k in keys]
    return grouped.select(*shown, *[F.col(f"`{a.alias}`") for a in aggregates])


def checked(df: DataFrame, aggregates: list[Aggregate], schema: Schema) -> list:
    """The collected rows of a grouping; an overflowing int64 sum becomes a typed error that names the alias."""
    try:
        return df.collect()
    except Exception as error:
        datafile.raise_if_corrupt(error)
        if "ARITHMETIC_OVERFLOW" not in str(error):
            raise
        sums = [a.alias for a in aggregates if a.function == "sum" and schema.field(a.column).type == "int64"]
        raise E.Int64SumOverflow(f"int64 sum overflow in '{sums[0]}'" if len(sums) == 1 else f"int64 sum overflow in one of {sums}", alias=sums[0], aliases=sums) from error


def collected(df: DataFrame) -> list:
    """The rows of `df`; a data file that cannot be read is a typed error."""
    try:
        return df.collect()
    except Exception as error:
        datafile.raise_if_corrupt(error)
        raise


def nearest(df: DataFrame, query: tuple[float, ...], k: int, columns: list[str] | None, distance=squared_l2, column: str = "vector") -> DataFrame:
    """The k rows nearest to `query`, ties by row id, null vectors left out: a top-k of each task, merged.

    A task measures whole Arrow batches and passes on its k nearest only, so little is sorted or shuffled. Hydrated
    columns are not carried through: the k hits, which are few, are joined back to the rows.
    """
    schema = pa.schema([("row_id", pa.int64()), ("distance", pa.float64())])

    def run(batches):
        ids, scores = np.empty(0, np.int64), np.empty(0)
        for batch in batches:
            ids = np.concatenate([ids, batch.column(0).to_numpy()])
            scores = np.concatenate([scores, distance(matrix(batch.column(1)), query)])
            if len(ids) > k:
                near = np.lexsort((ids, scores))[:k]
                ids, scores = ids[near], scores[near]
        if len(ids):
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(scores)], schema=schema)

    rows = df.where(F.col(f"`{column}`").isNotNull())
    hits = rows.select(ROW_ID, f"`{column}`").mapInArrow(run, "row_id long, distance double").orderBy("distance", "row_id").limit(k)
    return hits if columns is None else hydrated(df, hits, columns)


def hydrated(df: DataFrame, hits: DataFrame, columns: list[str]) -> DataFrame:
    """`hits` (row_id, distance), k rows at most, with `columns` of the rows of `df`."""
    named = [F.col(f"`{c}`") for c in columns]
    found = df.select(F.col(ROW_ID).alias("row_id"), *named).join(F.broadcast(hits), "row_id")
    return found.select("row_id", "distance", *named).orderBy("distance", "row_id")


def id_runs(ids: DataFrame) -> DataFrame:
    """Maximal runs [first, last] of consecutive ids: breaks are found by comparing each id with the one before it.

    The ids are range-partitioned and sorted; a window over buckets of 2^20 ids finds runs within a bucket, and a second,
    over the few runs that touch a bucket's edge, joins those that go on.
    """
    from pyspark.sql import Window as W

    bucket = F.shiftright("id", 20)
    numbered = ids.select(F.col(ids.columns[0]).alias("id")).withColumn("b", bucket).withColumn("n", F.row_number().over(W.partitionBy("b").orderBy("id")))
    within = numbered.groupBy("b", (F.col("id") - F.col("n")).alias("g")).agg(F.min("id").alias("first"), F.max("id").alias("last"))
    edge = (F.col("first") % (1 << 20) == 0) | (F.col("last") % (1 << 20) == (1 << 20) - 1)
    order = W.orderBy("first")
    edges = within.where(edge).withColumn("new", F.when(F.col("first") == F.lag("last").over(order) + 1, 0).otherwise(1)).withColumn("run", F.sum("new").over(order))
    joined = edges.groupBy("run").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("run")
    return within.where(~edge).select("first", "last").unionByName(joined)
