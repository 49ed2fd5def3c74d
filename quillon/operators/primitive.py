"""Primitive operators on plain frames, beside the typed ones of snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import errors as E


def filter_equal(df: DataFrame, column: str, text: str) -> DataFrame:
    """Rows whose string column is `text`."""
    return df.where(F.col(f"`{column}`") == F.lit(text))


def group_by(df: DataFrame, keys: list[str], aggregates: list[tuple[str, str]]) -> DataFrame:
    """Groups with columns named `{column}_{function}`: counts as int64, all else as float64; nulls are skipped."""
    if not keys:
        raise E.EmptyGroupBy("group-by requires at least one group column")
    outs = []
    for column, function in aggregates:
        c = F.col(f"`{column}`")
        if function != "count" and not isinstance(df.schema[column].dataType, T.NumericType):
            raise E.InvalidAggregateType(f"{function} cannot aggregate '{column}'", column=column, function=function)
        made = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max, "avg": F.avg}[function]
        outs.append((made(c) if function == "count" else made(c.cast("double"))).alias(f"{column}_{function}"))
    by = [F.col(f"`{k}`") for k in keys]
    return df.groupBy(*by).agg(*outs) if outs else df.select(*by).distinct()
