"""Command line: one dataset command a call, results as lines or JSON, an exit code for each kind of failure."""

from __future__ import annotations

import argparse
import json
import math
import sys
from collections.abc import Callable, Sequence
from dataclasses import asdict

from pyspark.sql import DataFrame, Row, SparkSession

from . import errors as E
from .operators.dataset import Dataset
from .plans.requests import Aggregate, Compare, GroupByRequest, RowLookupRequest, ScanRequest, VectorSearchRequest
from .plans.schema import Field, Schema
from .sources.ingest import conform

OK, OPERATIONAL, USAGE, CONFLICT, UNSUPPORTED, CORRUPTION = range(6)
DEFAULT_K = 3


def session() -> SparkSession:
    return SparkSession.builder.appName("quillon").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def parse_schema(text: str) -> Schema:
    """`name:type`, comma-separated; a trailing ! means not null."""
    fields = []
    for part in text.split(","):
        name, _, kind = part.partition(":")
        kind = {"boolean": "bool", "boolean!": "bool!"}.get(kind, kind)
        fields.append(Field(name, kind.rstrip("!"), not kind.endswith("!")))
    return Schema(tuple(fields))


def parse_filter(schema: Schema, parts: Sequence[str] | None) -> Compare | None:
    """Column, operator, value; the value is read as the column's type."""
    if not parts:
        return None
    column, op, text = parts
    kind = schema.field(column).type
    if kind == "bool":
        if text not in ("true", "false"):
            raise E.FilterTypeMismatch(f"'{text}' is not a boolean", column=column)
        return Compare(column, op, text == "true")
    try:
        return Compare(column, op, {"int64": int, "uint64": int, "float64": float}.get(kind, str)(text))
    except ValueError as error:
        raise E.FilterTypeMismatch(f"'{text}' is not {kind}", column=column) from error


def value_json(value):
    """JSON form of a value: non-finite numbers are typed nulls."""
    if isinstance(value, float) and not math.isfinite(value):
        return {"type": "float64", "value": None}
    if isinstance(value, list):
        return [value_json(x) for x in value]
    return int(value) if value.__class__.__name__ == "Decimal" else value


def lines(df: DataFrame) -> list[str]:
    """Rows as text, sorted, for stable output."""
    return sorted(" ".join(f"{k}={json.dumps(value_json(v), ensure_ascii=False)}" for k, v in r.asDict().items()) for r in df.collect())


def lookup_json(schema: Schema, found) -> str:
    row: Row | None = found.row
    fields = [] if row is None else [{"name": n, "type": schema.field(n).type, "value": value_json(row[i])} for i, n in enumerate(found.columns)]
    return json.dumps({"kind": "row_lookup", "row_id": found.row_id, "outcome": found.outcome, "fields": fields}, ensure_ascii=False)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quillon")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, writes: bool = False) -> argparse.ArgumentParser:
        p = commands.add_parser(name)
        p.add_argument("root")
        if writes:
            p.add_argument("--ack-single-writer", action="store_true")
        return p

    command("create", True).add_argument("--schema", required=True)
    command("insert", True).add_argument("--json-lines", required=True)
    command("scan").add_argument("--columns")
    p = command("filter")
    p.add_argument("--where", nargs=3, required=True)
    p = command("query-scan")
    p.add_argument("--columns", required=True)
    p.add_argument("--where", nargs=3)
    p = command("group-by")
    p.add_argument("--by", required=True)
    p.add_argument("--agg", required=True, help="count:column, sum:column or avg:column")
    p.add_argument("--where", nargs=3)
    p = command("search")
    p.add_argument("--vector", required=True)
    p.add_argument("-k", type=int, default=DEFAULT_K)
    p.add_argument("--exact", action="store_true")
    p.add_argument("--where", nargs=3)
    p.add_argument("--hydrate")
    p = command("lookup")
    p.add_argument("row_id", type=int)
    p.add_argument("--columns")
    p = command("explain")
    p.add_argument("--where", nargs=3)
    p = command("migration", True)
    p.add_argument("action", choices=["validate", "run", "status"])
    p.add_argument("--column")
    p = command("crash-loop", True)
    p.add_argument("--rounds", type=int, default=3)
    for name in ("inspect", "schema", "manifest-status", "recovery-status", "evidence"):
        command(name)
    return top


def run(args: Sequence[str], spark: SparkSession | None = None, out: Callable[[str], None] = print) -> int:
    """Carry out one command; the exit code."""
    try:
        a = parser().parse_args(args)
    except SystemExit as stop:
        return OK if stop.code == 0 else USAGE
    if getattr(a, "ack_single_writer", None) is False and not (a.command == "migration" and a.action != "run"):
        print("mutations need --ack-single-writer", file=sys.stderr)
        return USAGE
    try:
        for text in _execute(a, spark or session()):
            out(text)
        return OK
    except (E.QuillonError, OSError, ValueError) as error:
        print(f"{type(error).__name__}: {error}", file=sys.stderr)
        return exit_code(error)


def exit_code(error: Exception) -> int:
    families = (
        (CONFLICT, (E.Conflict, E.InsufficientHistory)),
        (UNSUPPORTED, (E.UnsupportedTransactionRead, E.UnsupportedType, E.MigrationUnsupported, E.MigrationLossyConversion, E.DurabilityUnsupported)),
        (CORRUPTION, (E.CorruptManifest, E.CorruptDataFile, E.CorruptSegment, E.UnsafeManifestPath, E.RowIdRangeMismatch)),
        (USAGE, (E.InvalidQueryError,)),
    )
    return next((code for code, kinds in families if isinstance(error, kinds)), OPERATIONAL)


def _split(text: str | None) -> tuple[str, ...] | None:
    return None if text is None else tuple(x for x in text.split(",") if x)


def _execute(a, spark: SparkSession) -> list[str]:
    if a.command == "create":
        ds = Dataset.create(spark, a.root, parse_schema(a.schema))
        return [f"created version={ds.version}"]
    ds = Dataset.open(spark, a.root)
    view = ds.snapshot()
    where = parse_filter(ds.schema, getattr(a, "where", None))
    if a.command == "insert":
        with ds.begin() as txn:
            txn.insert(conform(spark.read.schema(ds.schema.spark()).json(a.json_lines), ds.schema))
        return [f"inserted version={ds.version}"]
    if a.command in ("scan", "filter", "query-scan"):
        return lines(view.scan(ScanRequest(_split(getattr(a, "columns", None)), where)))
    if a.command == "group-by":
        function, _, column = a.agg.partition(":")
        if function not in ("count", "sum", "avg"):
            raise ValueError("--agg takes one count, sum or avg")
        return lines(view.group_by(GroupByRequest(_split(a.by), (Aggregate(column, function, f"{function}_{column}"),), where)))
    if a.command == "search":
        if a.exact:
            raise E.UnsupportedType("every search is exact; --exact is not an option")
        hydrate = False if a.hydrate is None else _split(a.hydrate)
        found = view.vector_search(VectorSearchRequest(tuple(map(float, a.vector.split(","))), a.k, filter=where, hydrate=hydrate))
        return [json.dumps({k: value_json(v) for k, v in r.asDict().items()}, ensure_ascii=False) for r in found.collect()]
    if a.command == "lookup":
        return [lookup_json(ds.schema, view.lookup(RowLookupRequest(a.row_id, _split(a.columns))))]
    if a.command == "explain":
        return [json.dumps(asdict(view.explain_scan(ScanRequest(None, where))))]
    if a.command == "schema":
        return [f"{f.name} {f.type}{'' if f.nullable else ' not null'}" for f in ds.schema.fields]
    if a.command == "inspect":
        return [json.dumps({"version": ds.version, "schema_version": ds.schema_version, "files": len(view.manifest.files), "rows": sum(f.row_count for f in view.manifest.files)})]
    if a.command == "recovery-status":
        return [json.dumps(asdict(ds.recovery))]
    if a.command in ("manifest-status", "evidence"):
        return [json.dumps(asdict(ds.inventory()))]
    if a.command == "migration":
        if a.action == "status":
            return [json.dumps(ds.migration_status())]
        name, _, kind = (a.column or "").partition(":")
        field = Field(name, kind)
        Schema((*ds.schema.fields, field))
        if a.action == "validate":
            return [json.dumps(ds.migration_status() | {"column": name, "type": kind})]
        return [f"migrated version={ds.migrate_add_nullable_column(field).version}"]
    for _ in range(a.rounds):
        ds = Dataset.open(spark, a.root, verify=True)
    return [f"reopened {a.rounds} times at version={ds.version}"]


def main() -> int:
    return run(sys.argv[1:])


if __name__ == "__main__":
    sys.exit(main())
