"""Queries on what operators do beside returning rows: files, states, refusals, lifecycles, plans, and approximate search.

Each returns a small table, one row a case, and its SQL says what the cases must come to, from the test tables where they
hold rows.
"""

from __future__ import annotations

import gc
import json
import math
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from . import cli
from . import errors as E
from .functions import filters
from .operators import rows, vector_index
from .operators.dataset import CommitLog, Dataset
from .plans import planner, results
from .plans.requests import Aggregate, Compare, GroupByRequest, RowLookupRequest, ScanRequest, VectorSearchRequest
from .plans.schema import ROW_ID, Schema
from .queries import CUSTOMER, DIMENSIONS, NATION, QUERY_VECTOR, _embeddings, _holed_parts, _knn_sql, _nation_rows, _rounded, dataset_of, in_order, load, ordered, query, sliced, source
from .sources import datafile, ingest
from .sources.backend import HadoopBackend, LocalBackend, check_key
from .sources.manifest import Manifest, manifest_key, publish, read_manifest
from .sources.shared import fresh_root

C = Compare
_HELD: list = []  # snapshots whose frames are still to be read


def outcome(work: Callable) -> str:
    """What `work` comes to: the name of its error, or its result as text."""
    try:
        return str(work())
    except E.QuillonError as error:
        return type(error).__name__


def table(spark: SparkSession, cases: dict[str, Callable]) -> DataFrame:
    return spark.createDataFrame([(name, outcome(work)) for name, work in cases.items()], "what string, outcome string")


def cases_sql(**cases: str) -> str:
    """SQL of a table of cases; an outcome in parentheses is an expression."""
    quoted = lambda v: "'" + v.replace("'", "''") + "'"
    return " UNION ALL ".join(f"SELECT '{k}' AS what, {v if v.startswith('(') else quoted(v)} AS outcome" for k, v in cases.items())


def nation(spark, d) -> Dataset:
    return ordered(spark, d, "nation", "n_nationkey")


def count(ds: Dataset) -> int:
    return ds.snapshot().scan(ScanRequest(())).count()


_NATIONS = "(SELECT CAST(count(*) AS VARCHAR) FROM nation)"

# -- files and stores --------------------------------------------------------------------------------------------------


@query("read_projected", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey < 5000")
def _(spark, d):
    _HELD.append(view := sliced(spark, d).snapshot())
    return view.read_file(next(f.name for f in view.manifest.files if f.row_count), ["o_orderkey", "o_totalprice"])


@query("read_corrupt", cases_sql(broken="CorruptDataFile", missing="CorruptDataFile", group="CorruptDataFile", reopened="CorruptDataFile", verified="CorruptDataFile", unknown="ObjectNotFound"))
def _(spark, d):
    ds = nation(spark, d)
    view, request = ds.snapshot(), GroupByRequest(("n_regionkey",))
    name = next(f.name for f in view.manifest.files if f.row_count)
    good = ds.backend.get(name)

    def with_bytes(data, work):
        ds.backend.put(name, data)
        return work()

    torn = good[:40] + bytes(len(good) - 48) + good[-8:]
    cases = {
        "broken": lambda: with_bytes(torn, lambda: view.collect_scan(ScanRequest())),
        "group": lambda: with_bytes(torn, lambda: view.collect_groups(request)),
        "verified": lambda: with_bytes(torn, lambda: Dataset.open(spark, ds.backend.root, verify=True)),
        "reopened": lambda: with_bytes(good[:-1], lambda: Dataset.open(spark, ds.backend.root)),
        "unknown": lambda: view.read_file("data/none.parquet"),
        "missing": lambda: (ds.backend.delete(name), view.collect_scan(ScanRequest())),
    }
    return table(spark, cases)


@query("write_sink", "SELECT CAST(count(*) AS BIGINT) AS row_count, min(l_orderkey) AS low, max(l_orderkey) AS high, true AS sizes_known FROM lineitem")
def _(spark, d):
    df = source(spark, d, "lineitem")
    backend, schema = LocalBackend(fresh_root(spark)), ingest.schema_of(df)
    files = datafile.describe(spark, backend, datafile.write_parts(backend, df, 0, 0), schema)
    bounds = [f.stats["l_orderkey"] for f in files if f.row_count]
    made = (sum(f.row_count for f in files), min(lo for lo, _ in bounds), max(hi for _, hi in bounds), all(f.byte_len > 0 for f in files))
    return spark.createDataFrame([made], "row_count long, low long, high long, sizes_known boolean")


def _store_sql() -> str:
    want = {"put": "b'one'", "range": "b'ne'", "replaced": "b'two'", "absent": "None", "present": "ObjectAlreadyExists", "kept": "b'three'", "listed": "[('a/x', 3), ('a/y', 5)]", "deleted": "[('a/y', 5)]", "missing": "ObjectNotFound", "unsafe": "UnsafeManifestPath"}
    rows_ = [f"SELECT '{kind}.{k}' AS what, '{v.replace(chr(39), chr(39) * 2)}' AS outcome" for kind in ("local", "hadoop") for k, v in want.items()]
    return " UNION ALL ".join([*rows_, "SELECT 'objects.put', 'DurabilityUnsupported'"])


@query("store_contract", _store_sql())
def _(spark, d):
    cases = {}
    for kind, store in (("local", LocalBackend(fresh_root(spark))), ("hadoop", HadoopBackend(spark, f"file://{fresh_root(spark).removeprefix('file://')}"))):
        store.create()
        steps = {
            "put": lambda s=store: (s.put("a/x", b"one"), s.get("a/x"))[1],
            "range": lambda s=store: s.get_range("a/x", 1, 2),
            "replaced": lambda s=store: (s.put("a/x", b"two"), s.get("a/x"))[1],
            "absent": lambda s=store: s.put_if_absent("a/y", b"three"),
            "present": lambda s=store: s.put_if_absent("a/y", b"four"),
            "kept": lambda s=store: s.get("a/y"),
            "listed": lambda s=store: [(m.key, m.bytes) for m in s.list("a")],
            "deleted": lambda s=store: (s.delete("a/x"), [(m.key, m.bytes) for m in s.list("a")])[1],
            "missing": lambda s=store: s.get("a/x"),
            "unsafe": lambda s=store: s.get("../a"),
        }
        cases |= {f"{kind}.{k}": outcome(work) for k, work in steps.items()}

    class Renamed:
        """A file system that says it is an object store."""

        getUri = lambda self: self
        getScheme = lambda self: "s3a"

    store._fs = Renamed()
    cases["objects.put"] = outcome(lambda: store.put_if_absent("a/z", b""))
    return spark.createDataFrame(list(cases.items()), "what string, outcome string")


@query("safe_keys", cases_sql(plain="a/b", rooted="UnsafeManifestPath", parent="UnsafeManifestPath", dot="UnsafeManifestPath", empty="UnsafeManifestPath", backslash="UnsafeManifestPath", zero="UnsafeManifestPath", double="UnsafeManifestPath", joined="(SELECT 'file:///root/data/x')", manifest="UnsafeManifestPath"))
def _(spark, d):
    keys = {"plain": "a/b", "rooted": "/a", "parent": "a/../b", "dot": "./a", "empty": "", "backslash": "a\\b", "zero": "a\0b", "double": "a//b"}
    cases = {k: lambda v=v: check_key(v) for k, v in keys.items()} | {"joined": lambda: LocalBackend("/root/").url("data/x")}

    def listed():
        ds = nation(spark, d)
        key = manifest_key(ds.version)
        data = json.loads(ds.backend.get(key))
        text = data["manifest"].replace('"name":"data/', '"name":"../')
        ds.backend.put(key, json.dumps({"crc32": zlib.crc32(text.encode()), "manifest": text}).encode())
        return Dataset.open(spark, ds.backend.root)

    return table(spark, cases | {"manifest": listed})


@query("arrow_ipc", NATION)
def _(spark, d):
    view = load(spark, d, "nation").snapshot()
    return ingest.from_ipc(spark, ingest.to_ipc(view.scan(ScanRequest())))


@query("physical_cast", "SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size, CAST(p_retailprice AS DOUBLE) AS p_retailprice, p_partkey % 2 = 0 AS even, CAST(p_size AS BIGINT) AS wide FROM part")
def _(spark, d):
    raw = spark.read.parquet(f"{d}/part.parquet").selectExpr("p_partkey", "p_size", "p_retailprice", "p_partkey % 2 = 0 AS even", "cast(p_size AS smallint) AS wide")
    df = ingest.logical(raw)
    return ingest.conform(df, ingest.schema_of(df))


@query("row_values", "SELECT 'n_name=\"' || n_name || '\" n_nationkey=' || n_nationkey AS line FROM nation")
def _(spark, d):
    found = cli.lines(load(spark, d, "nation").snapshot().scan(ScanRequest(("n_name", "n_nationkey"))))
    return spark.createDataFrame([(x,) for x in found], "line string")


# -- planning ----------------------------------------------------------------------------------------------------------


@query("column_plan", cases_sql(read="struct<o_custkey:bigint,o_totalprice:double>", shown="o_totalprice", pushed="True", tree="['o_custkey', 'o_totalprice', 'o_custkey']"))
def _(spark, d):
    f = (C("o_custkey", ">", 10) & C("o_totalprice", "<", 9e9)) & ~C("o_custkey", "=", 11)
    df = sliced(spark, d).snapshot().scan(ScanRequest(("o_totalprice",), f))
    plan = df._jdf.queryExecution().executedPlan().toString()
    read = plan[plan.index("ReadSchema: ") + 12 :].split("\n")[0].strip()
    return table(spark, {"read": lambda: read, "shown": lambda: ",".join(df.columns), "pushed": lambda: "GreaterThan(o_custkey,10)" in plan, "tree": f.columns})


@query("filter_keys", cases_sql(alike="True", typed="7", zeros="2", nan="True", nested="True", refused="FilterTypeMismatch"))
def _(spark, d):
    view = load(spark, d, "nation").snapshot()
    cases = {
        "alike": lambda: C("a", "==", 1) == C("a", "=", 1),
        "typed": lambda: len({C("a", "=", v) for v in (1, 1.0, True, "1", 0, 0.0, False)}),
        "zeros": lambda: len({C("a", "=", v) for v in (0.0, -0.0)}),
        "nan": lambda: C("a", "=", math.nan) == C("a", "=", math.nan),
        "nested": lambda: (C("a", "=", 1) & ~C("b", "<", "x")) in {C("a", "=", 1) & ~C("b", "<", "x")},
        "refused": lambda: (view.live_set(C("n_regionkey", "=", 1)), view.live_set(C("n_regionkey", "=", True))),
    }
    return table(spark, cases)


@query("prunable_filters", cases_sql(eq="True", ne="False", not_="False", and_one="True", or_one="False", or_both="True", bool_="False"))
def _(spark, d):
    schema = Schema.of(("n", "int64"), ("b", "bool"), ("s", "utf8"))
    n, s = C("n", "=", 1), C("s", ">", "x")
    cases = {"eq": n, "ne": C("n", "!=", 1), "not_": ~n, "and_one": n & ~s, "or_one": n | ~s, "or_both": n | s, "bool_": C("b", "=", True)}
    return table(spark, {k: lambda f=f: filters.prunable(schema, f) for k, f in cases.items()})


@query("zone_map_merge", "SELECT min(o_orderkey) AS low, max(o_orderkey) AS high, min(o_totalprice) AS cheap, max(o_totalprice) AS dear, min(o_orderpriority) AS first, max(o_orderpriority) AS last FROM orders")
def _(spark, d):
    stats = [f.stats for f in sliced(spark, d).snapshot().manifest.files if f.row_count]
    ends = [pick(x[c][i] for x in stats) for c in ("o_orderkey", "o_totalprice", "o_orderpriority") for i, pick in ((0, min), (1, max))]
    return spark.createDataFrame([tuple(ends)], "low long, high long, cheap double, dear double, first string, last string")


@query("time_pruned_scan", "SELECT o_orderkey FROM orders WHERE o_orderkey < 5000")
def _(spark, d):
    _HELD.append(view := sliced(spark, d).snapshot())
    early = C("_timestamp", "<=", min(f.timestamp for f in view.manifest.files))
    found = view.scan_predicate(early, ["o_orderkey", "_timestamp"])
    return found.select("o_orderkey") if len(view.surviving(early, primitive=True)) == 1 else found


@query("time_bounds", cases_sql(bounds="True", kept="1", ids="1"))
def _(spark, d):
    view = sliced(spark, d).snapshot()
    files = [f for f in view.manifest.files if f.row_count]
    times = sorted(f.timestamp for f in files)
    maps = view.zone_maps().where("column = '_timestamp'").collect()
    cases = {
        "bounds": lambda: sorted(int(r.minimum) for r in maps) == times and all(r.minimum == r.maximum for r in maps),
        "kept": lambda: len(view.surviving(C("_timestamp", "=", times[0]), primitive=True)),
        "ids": lambda: len(view.surviving(C("_row_id", ">=", max(f.first for f in files)), primitive=True)),
    }
    return table(spark, cases)


@query("plan_shapes", cases_sql(scan="ok", filtered="ok", no_end="InvalidLogicalShape", no_source="InvalidLogicalShape", late_filter="InvalidLogicalShape", two_ends="ConflictingTerminalOperators", none="InvalidLogicalShape"))
def _(spark, d):
    shapes = {
        "scan": "source projection materialize", "filtered": "source predicate grouping materialize", "no_end": "source projection", "no_source": "projection materialize",
        "late_filter": "source projection predicate materialize", "two_ends": "source projection grouping materialize", "none": "source materialize",
    }
    return table(spark, {k: lambda v=v: planner.check_shape(tuple(map(planner.Logical, v.split()))) or "ok" for k, v in shapes.items()})


@query("explain_steps", cases_sql(group="manifest_snapshot_source,zone_map_pruning,tombstone_filter,row_filter,hash_group_by,materialize", vector="zone_map_pruning,filter_live_set,tombstone_filter,immutable_segment_vector_search,hydration_lookup,materialize", files="3/1/2"))
def _(spark, d):
    view, f = sliced(spark, d).snapshot(), C("o_orderkey", "<", 5000)
    group = view.explain_group_by(GroupByRequest(("o_orderstatus",), (), f))
    near = _embeddings(spark, d).snapshot().explain_vector_search(VectorSearchRequest(QUERY_VECTOR, 3, filter=C("label", "=", 1), hydrate=("label",)))
    o = group.observations
    return table(spark, {"group": lambda: ",".join(group.physical), "vector": lambda: ",".join(near.physical), "files": lambda: f"{o.data_files_total}/{o.data_files_scanned}/{o.data_files_pruned}"})


# -- groups and hits ---------------------------------------------------------------------------------------------------


@query("group_empty", "SELECT 0::BIGINT AS kept, count(DISTINCT o_orderstatus) AS all_groups FROM orders")
def _(spark, d):
    view, aggregates = load(spark, d, "orders").snapshot(), (Aggregate("o_orderkey", "count", "n"),)
    made = [view.collect_groups(GroupByRequest(("o_orderstatus",), aggregates, f)) for f in (C("o_orderkey", "<", 0), None)]
    return spark.createDataFrame([tuple(map(len, made))], "kept long, all_groups long")


_GROUPS = {"fits": "ok", "short": "GroupResultShape", "vector_key": "NonScalarGroupResult", "null_count": "NullCountAggregate", "wrong_type": "AggregateResultTypeMismatch", "text_output": "InvalidAggregateOutputType", "two_keys": "DuplicateGroupColumn", "two_names": "DuplicateAggregateAlias"}


@query("group_result_shapes", cases_sql(**_GROUPS))
def _(spark, d):
    n = (("n", "uint64"),)
    cases = {
        "fits": (("k",), n, ((1, 2),)), "short": (("k",), n, ((1,),)), "vector_key": (("k",), n, (([1.0], 2),)), "null_count": (("k",), n, ((1, None),)),
        "wrong_type": (("k",), (("s", "float64"),), ((1, 2),)), "text_output": (("k",), (("s", "utf8"),), ()), "two_keys": (("k", "k"), n, ()), "two_names": (("n",), n, ()),
    }
    return table(spark, {k: lambda v=v: results.Groups(*v) and "ok" for k, v in cases.items()})


_HITS = {"fits": "ok", "too_many": "TooManyVectorHits", "infinite": "NonFiniteVectorDistance", "negative": "NegativeVectorDistance", "disordered": "NonMonotonicVectorDistances", "unasked": "UnexpectedHydration", "bare": "MissingHydration", "other_columns": "HydrationProjectionMismatch"}


@query("hit_result_shapes", cases_sql(**_HITS))
def _(spark, d):
    hit = results.Hit
    shown = hit(1, 0.0, results.HYDRATED, Row(a=1))
    cases = {
        "fits": (2, ("a",), (shown, hit(2, 1.0, results.UNRESOLVED, reason="not_found"))), "too_many": (1, None, (hit(1, 0.0), hit(2, 0.0))), "infinite": (1, None, (hit(1, math.inf),)),
        "negative": (1, None, (hit(1, -1.0),)), "disordered": (2, None, (hit(2, 1.0), hit(1, 1.0))), "unasked": (1, None, (shown,)), "bare": (1, ("a",), (hit(1, 0.0),)), "other_columns": (1, ("b",), (shown,)),
    }
    return table(spark, {k: lambda v=v: results.Hits(*v) and "ok" for k, v in cases.items()})


@query("knn_hit_states", _knn_sql("label < 5", 4, ", 'hydrated' AS state, CAST(label AS BIGINT) AS label"))
def _(spark, d):
    found = _embeddings(spark, d).snapshot().collect_hits(VectorSearchRequest(QUERY_VECTOR, 4, filter=C("label", "<", 5), hydrate=("label",)))
    return _rounded(spark.createDataFrame([(h.row_id, h.distance, h.state, h.row.label) for h in found.hits], "row_id long, distance double, state string, label long"), distance=9)


@query("unresolved_hits", cases_sql(deleted="unresolved tombstoned", swept="unresolved tombstoned", gone="unresolved not_found", live="hydrated None"))
def _(spark, d):
    ds = nation(spark, d)
    with ds.begin() as txn:
        txn.delete(3)
        txn.delete_where(C("n_nationkey", "=", 4))
    found = ds.snapshot().hydrate([(3, 0.0), (4, 0.5), (999, 1.0), (5, 2.0)], ["n_name"])
    return table(spark, {k: lambda h=h: f"{h.state} {h.reason}" for k, h in zip(("deleted", "swept", "gone", "live"), found, strict=True)})


@query("vector_checks", cases_sql(nan="NonFiniteStoredComponent", short="BatchSchemaMismatch", null="ok", query_nan="NonFiniteVectorComponent", query_short="VectorDimensionMismatch", zero_k="InvalidVectorK", other_column="UnsupportedVectorColumn", no_dimensions="ZeroVectorDimensions"))
def _(spark, d):
    ds = Dataset.create(spark, fresh_root(spark), Schema.of(("vector", "vector[2]")))

    def insert(v):
        with ds.begin() as txn:
            txn.insert(spark.createDataFrame([(v,)], "vector array<float>"))
        return "ok"

    ask = lambda q, k=1, c="vector": ds.snapshot().vector_search(VectorSearchRequest(q, k, c))
    cases = {
        "nan": lambda: insert([1.0, math.nan]), "short": lambda: insert([1.0]), "null": lambda: insert(None), "query_nan": lambda: ask((math.nan, 0.0)), "query_short": lambda: ask((0.0,)),
        "zero_k": lambda: ask((0.0, 0.0), 0), "other_column": lambda: ask((0.0, 0.0), 1, "v"), "no_dimensions": lambda: Schema.of(("vector", "vector[0]")),
    }
    return table(spark, cases)


@query("live_set_budget", "SELECT count(*) FILTER (WHERE o_totalprice > 200000.0) * 8 AS bytes, true AS same, true AS within FROM orders")
def _(spark, d):
    from .operators.snapshot import LIVE_SET_BYTES

    view, f = load(spark, d, "orders").snapshot(), C("o_totalprice", ">", 200000.0)
    first, again = view.live_set(f), view.live_set(f)
    return spark.createDataFrame([(view._live_bytes, first is again, view._live_bytes <= LIVE_SET_BYTES)], "bytes long, same boolean, within boolean")


# -- vector index ------------------------------------------------------------------------------------------------------


def _indexed(spark, d) -> Dataset:
    """Embeddings in two commits; the second is not indexed, and some rows of the first are deleted."""
    df = source(spark, d, "embeddings")
    first, second = df.where("vec_id % 5 <> 0"), df.where("vec_id % 5 = 0")
    ds = dataset_of(spark, df, [in_order(first, "vec_id")])
    ds.build_index(16)
    with ds.begin() as txn:
        txn.insert(ingest.conform(in_order(second, "vec_id"), ds.schema))
        txn.delete_where(C("label", "=", 1))
    return ds


def _index_sql(where: str, k: int) -> str:
    return _knn_sql(where, k, ", vec_id").replace("SELECT row_id,", "SELECT").replace("ORDER BY distance, row_id", "ORDER BY distance, vec_id")


@query("index_search_all_cells", _index_sql("(label <> 1 OR vec_id % 5 = 0)", 10))
def _(spark, d):
    _HELD.append(view := _indexed(spark, d).snapshot())
    return _rounded(view.vector_search(VectorSearchRequest(QUERY_VECTOR, 10, hydrate=("vec_id",)), probes=16).select("distance", "vec_id"), distance=9)


@query("index_search_filtered", _index_sql("label = 3", 8))
def _(spark, d):
    _HELD.append(view := _indexed(spark, d).snapshot())
    return _rounded(view.vector_search(VectorSearchRequest(QUERY_VECTOR, 8, filter=C("label", "=", 3), hydrate=("vec_id",)), probes=16).select("distance", "vec_id"), distance=9)


@query("index_search_live", _index_sql("label <> 1 AND vec_id < 100", 8))
def _(spark, d):
    _HELD.append(view := _indexed(spark, d).snapshot())
    live = view.matching_row_ids(C("vec_id", "<", 100) & C("label", "!=", 1))
    return _rounded(view.vector_search(VectorSearchRequest(QUERY_VECTOR, 8, hydrate=("vec_id",)), probes=16, live=live).select("distance", "vec_id"), distance=9)


@query("index_recall", "SELECT true AS recalled, true AS covers_all, 1 AS segments")
def _(spark, d):
    """Recall@10 of 0.9 or more, over queries that are rows. The test vectors have no structure, so most cells are probed."""
    df = source(spark, d, "embeddings")
    ds = dataset_of(spark, df, [in_order(df, "vec_id")])
    ds.build_index(16)
    view = ds.snapshot()
    queries = [tuple(r.vector) for r in df.where("vec_id % 100 = 0").orderBy("vec_id").limit(5).collect()]
    segments = view.manifest.segments
    covered = {n for s in segments for n in s.files} == {f.name for f in view.manifest.files if f.vectors}
    return spark.createDataFrame([(vector_index.recall(view, queries, 10, 13) >= 0.9, covered, len(segments))], "recalled boolean, covers_all boolean, segments int")


@query("index_segments", cases_sql(decoded="True", torn="CorruptSegment", missing="CorruptSegment", unchanged="True", added="2", compacted="0"))
def _(spark, d):
    ds = _indexed(spark, d)
    segment = ds.snapshot().manifest.segments[0]
    data = ds.backend.get(segment.name)
    decode = lambda x: vector_index.Description.decode(x, segment.name)
    cases = {"decoded": lambda: decode(data).encode() == data, "torn": lambda: decode(data[:-20]), "unchanged": lambda: decode(data).centres.shape == (16, DIMENSIONS)}

    def missing():
        ds.backend.delete(segment.name)
        try:
            return ds.snapshot().vector_search(VectorSearchRequest(QUERY_VECTOR, 1), probes=1)
        finally:
            ds.backend.put(segment.name, data)

    cases |= {"missing": missing, "added": lambda: len(ds.build_index(4).manifest.segments), "compacted": lambda: (ds.compact(), len(ds.snapshot().manifest.segments))[1]}
    return table(spark, cases)


@query("knn_primitive", _knn_sql("label >= 2 AND vec_id < 300", 12))
def _(spark, d):
    _HELD.append(view := _embeddings(spark, d).snapshot())
    return _rounded(view.vector_search_legacy(QUERY_VECTOR, 12, C("label", ">=", 2) & C("vec_id", "<", 300)), distance=9)


# -- transactions ------------------------------------------------------------------------------------------------------


@query("dataset_open", cases_sql(created="0", again="DatasetAlreadyExists", no_parent="DatasetNotFound", nothing="DatasetNotFound", reopened=_NATIONS, verified="(SELECT 'True')", two_columns="DuplicateSchemaColumn", reserved="ReservedColumn", no_type="UnsupportedType"))
def _(spark, d):
    root, schema = fresh_root(spark), Schema.of(("id", "int64"))
    ds = nation(spark, d)
    cases = {
        "created": lambda: Dataset.create(spark, root, schema).version,
        "again": lambda: Dataset.create(spark, root, schema),
        "no_parent": lambda: Dataset.create(spark, f"{root}/a/b", schema),
        "nothing": lambda: Dataset.open(spark, fresh_root(spark)),
        "reopened": lambda: count(Dataset.open(spark, ds.backend.root)),
        "verified": lambda: Dataset.open(spark, ds.backend.root, verify=True).recovery.data_files == len(ds.snapshot().manifest.files),
        "two_columns": lambda: Schema.of(("a", "int64"), ("a", "utf8")),
        "reserved": lambda: Schema.of(("_row_id", "int64")),
        "no_type": lambda: Schema.of(("a", "int32")),
    }
    return table(spark, cases)


@query("txn_states", cases_sql(begun="active", aborted="aborted", after_abort="TransactionFinished", rows_after_abort=_NATIONS, committed="committed", after_commit="TransactionFinished", failed="aborted", rows="(SELECT CAST(count(*) - 1 AS VARCHAR) FROM nation)", empty_commit="True"))
def _(spark, d):
    ds = nation(spark, d)
    one, two = ds.begin(), ds.begin()
    one.insert(_nation_rows(ds, (100, "ATLANTIS", 0)))

    def failing():
        try:
            with ds.begin() as txn:
                txn.delete(1)
                raise ZeroDivisionError
        except ZeroDivisionError:
            return txn.state

    def empty():
        before = ds.version
        with ds.begin():
            pass
        return ds.version == before + 1

    cases = {
        "begun": lambda: one.state, "aborted": lambda: (one.abort(), one.state)[1], "after_abort": lambda: one.commit(), "rows_after_abort": lambda: count(ds),
        "committed": lambda: (two.delete(0), two.commit(), two.state)[2], "after_commit": lambda: two.delete(1), "failed": failing, "rows": lambda: count(ds), "empty_commit": empty,
    }
    return table(spark, cases)


@query("txn_refusals", cases_sql(twice="DuplicateTarget", unknown="RowNotFound", dead="RowNotLive", swept="RowNotLive", two_rows="InvalidUpdateShape", other_names="BatchSchemaMismatch", nulls="ok", staged_vectors="UnsupportedTransactionRead"))
def _(spark, d):
    ds = nation(spark, d)
    with ds.begin() as txn:
        txn.delete(0)
        txn.delete_where(C("n_nationkey", "=", 2))
    txn = ds.begin()
    vectors = dataset_of(spark, df := source(spark, d, "embeddings"), [df.limit(3)]).begin()
    cases = {
        "twice": lambda: (txn.delete(1), txn.delete(1)), "unknown": lambda: txn.delete(999), "dead": lambda: txn.delete(0), "swept": lambda: txn.delete(2),
        "two_rows": lambda: txn.update(3, _nation_rows(ds, (3, "A", 1), (3, "B", 1))), "other_names": lambda: txn.insert(spark.createDataFrame([(1,)], "x long")),
        "nulls": lambda: txn.insert(_nation_rows(ds, (None, None, None))) or "ok", "staged_vectors": lambda: (vectors.delete(0), vectors.vector_search(VectorSearchRequest(QUERY_VECTOR, 1))),
    }
    return table(spark, cases)


@query("overlay_vector", _knn_sql("true", 5))
def _(spark, d):
    _HELD.append(txn := _embeddings(spark, d).begin())
    return _rounded(txn.vector_search(VectorSearchRequest(QUERY_VECTOR, 5)), distance=9)


@query("publication", cases_sql(visible="IndeterminateManifestPublication", installed="2", rows="(SELECT CAST(count(*) - 1 AS VARCHAR) FROM nation)", taken="PublicationIndeterminate", after="True"))
def _(spark, d):
    ds = nation(spark, d)
    sync = ds.backend._sync

    def torn(folder):
        if folder.name == "_versions":
            raise OSError("not synced")
        sync(folder)

    def commit(row):
        with ds.begin() as txn:
            txn.delete(row)

    def visible():
        ds.backend._sync = torn
        try:
            commit(0)
        finally:
            ds.backend._sync = sync

    def taken():
        publish(ds.backend, Manifest(ds.version + 1, 1, ds.schema))
        commit(1)

    cases = {"visible": visible, "installed": lambda: ds.version, "rows": lambda: count(Dataset.open(spark, ds.backend.root)), "taken": taken, "after": lambda: ds.version == 2}
    return table(spark, cases)


@query("schema_changes", cases_sql(retyped="MigrationLossyConversion", not_null="MigrationUnsupported", there="MigrationIncompatibleType", reserved="ReservedColumnName", added="2", again="MigrationSourceVersion", stale="SchemaVersionChanged", rows=_NATIONS))
def _(spark, d):
    ds = nation(spark, d)
    stale = ds.begin()
    stale.delete(0)
    cases = {
        "retyped": lambda: ds.migrate_change_type("n_name", "int64"), "not_null": lambda: ds.migrate_add_nullable_column(("tag", "utf8", False)), "there": lambda: ds.migrate_add_nullable_column(("n_name", "utf8")),
        "reserved": lambda: ds.migrate_add_nullable_column(("_row_id", "int64")), "added": lambda: ds.migrate_add_nullable_column(("tag", "utf8")).schema_version,
        "again": lambda: ds.migrate_add_nullable_column(("more", "utf8")), "stale": lambda: stale.commit(), "rows": lambda: count(ds),
    }
    return table(spark, cases)


@query("delete_vectors", "SELECT count(*) AS left_, count(*) FILTER (WHERE o_totalprice > 250000.0) AS wrong, (SELECT count(*) FROM orders WHERE o_totalprice > 250000.0 OR o_orderkey = (SELECT min(o_orderkey) FROM orders WHERE NOT o_totalprice > 250000.0)) AS deleted FROM orders WHERE NOT o_totalprice > 250000.0 AND o_orderkey <> (SELECT min(o_orderkey) FROM orders WHERE NOT o_totalprice > 250000.0)")
def _(spark, d):
    ds = ordered(spark, d, "orders", "o_orderkey")
    with ds.begin() as txn:
        txn.delete_where(C("o_totalprice", ">", 250000.0))
    first = ds.snapshot().scan_all([ROW_ID]).agg(F.min(ROW_ID)).first()[0]
    with ds.begin() as txn:
        txn.delete(first)
    _HELD.append(view := ds.snapshot())
    return view.scan(ScanRequest()).agg(F.count("*").alias("left_"), F.count_if(F.col("o_totalprice") > 250000.0).alias("wrong"), F.lit(view.manifest.deleted).alias("deleted"))


@query("delete_vector_conflicts", cases_sql(both_swept="Conflict", one_swept="Conflict", apart="ok"))
def _(spark, d):
    def race(first, second):
        ds = nation(spark, d)
        a, b = ds.begin(), ds.begin()
        first(a)
        second(b)
        a.commit()
        b.commit()
        return "ok"

    sweep = lambda n: lambda txn: txn.delete_where(C("n_nationkey", "<", n))
    cases = {"both_swept": lambda: race(sweep(5), sweep(3)), "one_swept": lambda: race(sweep(5), lambda t: t.delete(2)), "apart": lambda: race(sweep(5), lambda t: t.delete(20))}
    return table(spark, cases)


@query("wide_tombstones", "SELECT count(*) AS n, min(n_nationkey) AS first FROM nation WHERE n_nationkey NOT IN (1, 3, 5) AND n_nationkey < 10")
def _(spark, d):
    """A range of 10^9 deleted ids beside 70 short ones, cut into bits and blocks."""
    ids = source(spark, d, "nation").select(F.col("n_nationkey").alias(ROW_ID))
    ranges = ((1, 1), (3, 3), (5, 5), (10, 10 + 10**9), *((2 * 10**9 + 3 * i, 2 * 10**9 + 3 * i) for i in range(70)))
    return rows.without_tombstones(ids, ranges).agg(F.count("*").alias("n"), F.min(ROW_ID).cast("int").alias("first"))


# -- lifecycle ---------------------------------------------------------------------------------------------------------


@query("vacuum_keeps_staged", NATION + " WHERE n_nationkey > 2 UNION ALL SELECT 100, 'ATLANTIS', 0")
def _(spark, d):
    ds = nation(spark, d)
    txn, ended = ds.begin(), ds.begin()
    txn.insert(_nation_rows(ds, (100, "ATLANTIS", 0)))
    txn.delete_where(C("n_nationkey", "<=", 2))
    ended.insert(_nation_rows(ds, (200, "LOST", 0)))
    ended.abort()
    if not ds.vacuum():
        raise AssertionError("the aborted transaction's file is still there")
    txn.commit()
    ds.vacuum()
    _HELD.append(view := Dataset.open(spark, ds.backend.root).snapshot())
    return view.scan(ScanRequest())


@query("pruned_manifests", cases_sql(young="[]", pruned="[0, 1]", held="[2, 3, 4]", listed="[2, 3, 4]", rows="(SELECT CAST(count(*) - 3 AS VARCHAR) FROM nation)", none="InvalidRetentionPolicy", gone="CorruptManifest"))
def _(spark, d):
    ds = nation(spark, d)
    held = None
    for i in range(3):
        with ds.begin() as txn:
            txn.delete(i)
        held = held or ds.snapshot()
        del txn
    gc.collect()
    cases = {
        "young": lambda: ds.prune_manifests_by_age(1, 10**12), "pruned": lambda: ds.prune_manifests(2), "held": lambda: sorted({*ds.live_versions(), *ds.retention_plan(2).retained_versions}),
        "listed": lambda: list(ds.retention_plan(2).retained_versions), "rows": lambda: count(ds), "none": lambda: ds.prune_manifests(0), "gone": lambda: read_manifest(ds.backend, 0),
    }
    found = table(spark, cases)
    del held
    return found


@query("snapshot_leases", cases_sql(held="[1, 2]", kept="0", readable=_NATIONS, released="[3]", swept="True"))
def _(spark, d):
    ds = nation(spark, d)
    lease = [ds.snapshot()]
    with ds.begin() as txn:
        txn.delete(0)
    del txn
    gc.collect()

    def released():
        lease.clear()
        gc.collect()
        return ds.live_versions()

    cases = {
        "held": ds.live_versions, "kept": lambda: len(ds.compact().deleted), "readable": lambda: lease[0].scan(ScanRequest(())).count(),
        "released": released, "swept": lambda: (ds.prune_manifests(1), len(ds.vacuum()) > 0)[1],
    }
    return table(spark, cases)


@query("lifecycle_exclusion", cases_sql(shared="True", waits="False", then="True", nested="True"))
def _(spark, d):
    import threading

    from .operators.lifecycle import Exclusion

    exclusion, ran = Exclusion(), threading.Event()

    def alone():
        with exclusion.exclusive():
            ran.set()

    def nested():
        with exclusion.exclusive(), exclusion.exclusive(), exclusion.shared():
            return True

    found = {}
    with exclusion.shared(), exclusion.shared():
        found["shared"] = True
        thread = threading.Thread(target=alone)
        thread.start()
        found["waits"] = ran.wait(0.2)
    thread.join(5)
    found |= {"then": ran.is_set(), "nested": nested()}
    return spark.createDataFrame([(k, str(v)) for k, v in found.items()], "what string, outcome string")


@query("recovery_counts", cases_sql(files="True", bytes="True", manifest="True", history="InsufficientHistory", counted="1"))
def _(spark, d):
    ds = nation(spark, d)
    with ds.begin() as txn:
        txn.delete(0)
    again = Dataset.open(spark, ds.backend.root)
    files = again.snapshot().manifest.files

    def history():
        old = ds.begin()
        old.delete(1)
        ds._log = CommitLog(ds.version + 1)
        return old.commit()

    cases = {
        "files": lambda: again.recovery.data_files == len(files), "bytes": lambda: again.recovery.data_bytes == sum(f.byte_len for f in files),
        "manifest": lambda: again.recovery.manifest_bytes == len(ds.backend.get(manifest_key(ds.version))), "history": history, "counted": lambda: ds.insufficient_history_count,
    }
    return table(spark, cases)


@query("compact_deletion_vectors", "SELECT count(*) AS n, 0::BIGINT AS tombstones, 0::BIGINT AS vectors FROM part WHERE p_size > 5")
def _(spark, d):
    ds = _holed_parts(spark, d)
    gc.collect()
    ds.compact()
    _HELD.append(view := ds.snapshot())
    return view.scan(ScanRequest(())).agg(F.count("*").alias("n"), F.lit(len(view.manifest.tombstones)).cast("long").alias("tombstones"), F.lit(len(view.manifest.deletions)).cast("long").alias("vectors"))


@query("stream_replay", "SELECT count(*) AS n, count(DISTINCT event_id) AS ids, 1::BIGINT AS versions FROM events")
def _(spark, d):
    """The same stream twice, the second time without its checkpoint."""
    from .streaming import committing

    df = source(spark, d, "events")
    ds = Dataset.create(spark, fresh_root(spark), ingest.schema_of(df))
    raw = spark.readStream.schema(spark.read.parquet(f"{d}/events.parquet").schema).parquet(f"{d}/events.parque[t]")
    for _ in range(2):
        committing(ds, ingest.logical(raw), "events").trigger(availableNow=True).option("checkpointLocation", fresh_root(spark)).start().awaitTermination()
    _HELD.append(view := ds.snapshot())
    return view.scan(ScanRequest(("event_id",))).agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"), F.lit(ds.version).cast("long").alias("versions"))


# -- command line ------------------------------------------------------------------------------------------------------


@query("command_line", "SELECT 'scan' AS command, 0 AS code, 'c_custkey=' || c_custkey || ' c_mktsegment=\"' || c_mktsegment || '\"' AS line FROM (" + CUSTOMER + ") WHERE c_custkey <= 20 UNION ALL SELECT 'unknown', 2, '' UNION ALL SELECT 'unacknowledged', 2, '' UNION ALL SELECT 'missing', 1, '' UNION ALL SELECT 'group', 0, 'c_mktsegment=\"' || c_mktsegment || '\" count_c_custkey=' || count(*) FROM customer GROUP BY c_mktsegment")
def _(spark, d):
    root, found = load(spark, d, "customer").backend.root, []

    def run(name, *args):
        out: list[str] = []
        code = cli.run([args[0], root, *args[1:]], spark, out.append)
        found.extend((name, code, line) for line in out or [""])

    run("scan", "query-scan", "--columns", "c_custkey,c_mktsegment", "--where", "c_custkey", "<=", "20")
    run("unknown", "query-scan", "--columns", "nope")
    run("unacknowledged", "create", "--schema", "a:int64")
    run("group", "group-by", "--by", "c_mktsegment", "--agg", "count:c_custkey")
    found.append(("missing", cli.run(["scan", fresh_root(spark)], spark, lambda _: None), ""))
    return spark.createDataFrame(found, "command string, code int, line string")


@query("lookup_json", "SELECT '{\"kind\": \"row_lookup\", \"row_id\": 7, \"outcome\": \"live\", \"fields\": [{\"name\": \"n_name\", \"type\": \"utf8\", \"value\": \"' || n_name || '\"}, {\"name\": \"n_regionkey\", \"type\": \"int64\", \"value\": ' || n_regionkey || '}]}' AS line FROM nation WHERE n_nationkey = 7")
def _(spark, d):
    ds = nation(spark, d)
    return spark.createDataFrame([(cli.lookup_json(ds.schema, ds.snapshot().lookup(RowLookupRequest(7, ("n_name", "n_regionkey")))),)], "line string")
