"""An opt-in container of row groups that can be read by number.

Rows are written with the number of their group, and the writer ends a row group of the file after so many rows, so a
group of the container is a row group of a Parquet file. A read filters by number, which the row groups' own bounds
answer: those outside are not decoded, whatever file they are in. An index beside the files says which groups they hold.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import errors as E
from .backend import backend_for

INDEX, GROUPS = "groups.json", "groups"
_GROUP = "_group"


@dataclass(frozen=True)
class RowGroup:
    """A group by its place: the file, the group's number there, and its rows."""

    key: str
    number: int
    rows: int


def write_row_groups(df: DataFrame, root: str, rows: int) -> int:
    """Write `df` in groups of `rows` rows (the last of a partition may have fewer), a file a partition; how many groups."""
    if rows <= 0:
        raise E.UnreasonableCapacity("a row group holds at least one row", rows=rows)
    spark, backend = df.sparkSession, backend_for(df.sparkSession, root)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # the row's number in its partition
    numbered = df.withColumn(_GROUP, F.floor(place / rows).cast("long"))
    # the writer looks at its limits only after so many rows
    numbered.write.option("parquet.block.row.count.limit", rows).option("parquet.page.size.row.check.min", 1).option("parquet.block.size.row.check.min", 1).parquet(backend.url(GROUPS))
    keys = [m.key for m in backend.list(GROUPS) if m.key.endswith(".parquet")]
    found = []
    if keys:
        counted = spark.read.parquet(*[backend.url(k) for k in keys]).groupBy(F.col("_metadata.file_name").alias("file"), _GROUP).agg(F.count("*").alias("n")).orderBy("file", _GROUP)
        by_name = {k.rpartition("/")[2]: k for k in keys}
        found = [(by_name[r.file], r[_GROUP], r.n) for r in counted.collect()]
    backend.put(INDEX, json.dumps(found).encode())
    return len(found)


def row_group_index(spark: SparkSession, root: str) -> list[RowGroup]:
    """All groups in order."""
    try:
        found = [RowGroup(*x) for x in json.loads(backend_for(spark, root).get(INDEX))]
    except E.ObjectNotFound:
        found = []
    except (ValueError, TypeError) as error:
        raise E.CorruptDataFile(f"the index of row groups at {root} cannot be read: {error}", root=root) from error
    if not found:
        raise E.EmptyDataFile(f"no row groups at {root}", root=root)
    return found


def read_row_groups(spark: SparkSession, root: str, first: int, count: int, columns: list[str] | None = None) -> DataFrame:
    """Rows of the groups [first, first + count), with only `columns` decoded."""
    groups = row_group_index(spark, root)
    if first < 0 or count <= 0 or first + count > len(groups):
        raise E.CorruptDataFile(f"groups {first} to {first + count} of {len(groups)}")
    backend, parts = backend_for(spark, root), []
    wanted: dict[str, list[int]] = {}
    for g in groups[first : first + count]:
        wanted.setdefault(g.key, []).append(g.number)
    inner = [k for k in list(wanted)[1:-1]]  # files in between are read whole
    if inner:
        parts.append(spark.read.parquet(*[backend.url(k) for k in inner]))
    for key in {next(iter(wanted)), next(reversed(wanted))}:
        parts.append(spark.read.parquet(backend.url(key)).where(F.col(_GROUP).between(min(wanted[key]), max(wanted[key]))))
    df = parts[0]
    for part in parts[1:]:
        df = df.unionByName(part)
    return df.drop(_GROUP) if columns is None else df.select(*columns)
