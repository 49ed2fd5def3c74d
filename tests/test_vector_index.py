import numpy as np
import pytest
from engine import commit, make, values
from pyspark.sql import Row

from quillon import errors as E
from quillon.operators import vector_index
from quillon.operators.dataset import Dataset
from quillon.plans import results
from quillon.plans.requests import Aggregate, Compare, GroupByRequest, ScanRequest, VectorSearchRequest

DIM = 8


@pytest.fixture
def cloud(spark, tmp_path):
    """2,000 vectors in clusters, in two commits; one row in ten has none."""
    r = np.random.default_rng(2)
    centres = r.normal(size=(20, DIM)) * 4
    x = (centres[r.integers(0, 20, 2000)] + r.normal(size=(2000, DIM))).astype(np.float32)
    ds = make(spark, tmp_path, ("id", "int64"), ("label", "int64"), ("vector", f"vector[{DIM}]"))
    rows = [(i, i % 4, None if i % 10 == 9 else [float(c) for c in v]) for i, v in enumerate(x)]
    commit(ds, *rows[:1500])
    commit(ds, *rows[1500:])
    return ds, x


def brute(x, query, k, keep):
    apart = sorted((float(((x[i].astype(float) - query) ** 2).sum()), i) for i in range(len(x)) if i % 10 != 9 and keep(i))
    return [i for _, i in apart[:k]]


def ids(df):
    return [r.row_id for r in df.collect()]


def test_recall_filters_deletes_and_new_rows(cloud):
    ds, x = cloud
    queries = [tuple(float(c) for c in x[i]) for i in range(0, 200, 20)]
    exact = [ids(ds.snapshot().vector_search(VectorSearchRequest(q, 10))) for q in queries]
    assert exact == [brute(x, np.array(q), 10, lambda i: True) for q in queries]
    ds.build_index(40)
    view = ds.snapshot()
    assert view.manifest.segments and vector_index.recall(view, queries, 10, 8) >= 0.9
    assert [ids(view.vector_search(VectorSearchRequest(q, 10), probes=40)) for q in queries] == exact
    some = VectorSearchRequest(queries[0], 5, filter=Compare("label", "=", 2), hydrate=("id", "label"))
    got = view.vector_search(some, probes=40).collect()
    assert [r.id for r in got] == brute(x, np.array(queries[0]), 5, lambda i: i % 4 == 2) and {r.label for r in got} == {2}
    live = view.matching_row_ids(Compare("id", "<", 30))
    assert ids(view.vector_search(VectorSearchRequest(queries[0], 3), probes=1, live=live)) == brute(x, np.array(queries[0]), 3, lambda i: i < 30)
    with ds.begin() as txn:
        txn.delete(exact[0][0])
        txn.delete_where(Compare("id", "=", exact[0][1]))
    gone = set(exact[0][:2])
    assert ids(ds.snapshot().vector_search(VectorSearchRequest(queries[0], 5), probes=40)) == brute(x, np.array(queries[0]), 5, lambda i: i not in gone)
    commit(ds, (9000, 0, list(queries[0])))
    assert ids(ds.snapshot().vector_search(VectorSearchRequest(queries[0], 1), probes=1)) == [2000]
    ds.build_index()
    assert len(ds.snapshot().manifest.segments) == 2
    assert ids(ds.snapshot().vector_search(VectorSearchRequest(queries[0], 1), probes=1)) == [2000]
    assert ids(Dataset.open(ds.spark, ds.backend.root).snapshot().vector_search(VectorSearchRequest(queries[0], 1), probes=1)) == [2000]
    assert ds.build_index().version == ds.version
    ds.compact()
    assert ds.snapshot().manifest.segments == ()


def test_scans_read_only_probed_cells(cloud):
    ds, x = cloud
    ds.build_index(16)
    stored = ds.spark.read.parquet(*[ds.backend.url(p) for s in ds.snapshot().manifest.segments for p in vector_index.describe(ds.backend, s).parts])
    assert "PushedFilters: [In(cell, [2,5])]" in stored.where(stored.cell.isin([2, 5]))._jdf.queryExecution().executedPlan().toString()
    near = vector_index.describe(ds.backend, ds.snapshot().manifest.segments[0]).near(tuple(map(float, x[0])), 2)
    found = set(ids(ds.snapshot().vector_search(VectorSearchRequest(tuple(map(float, x[0])), 3), probes=2)))
    assert found <= {r._row_id for r in stored.where(stored.cell.isin(near)).collect()}


def test_broken_segments_are_found_and_orphans_go(cloud):
    ds, x = cloud
    ds.build_index(4)
    segment = ds.snapshot().manifest.segments[0]
    assert ds.vacuum() == []
    good = ds.backend.get(segment.name)
    request = VectorSearchRequest(tuple(map(float, x[0])), 3)
    for bad in (good.replace(b"cells", b"cellz"), good[:50], b"{}"):
        ds.backend.put(segment.name, bad)
        with pytest.raises(E.CorruptSegment):
            ds.snapshot().vector_search(request, probes=1)
    ds.backend.delete(segment.name)
    with pytest.raises(E.CorruptSegment):
        ds.snapshot().vector_search(request, probes=1)
    ds.backend.put(segment.name, good)
    decoded = vector_index.Description.decode(good, "x")
    assert vector_index.Description.decode(decoded.encode(), "x").parts == decoded.parts
    ds.backend.put("index/stray/part.parquet", b"x")
    assert ds.vacuum() == ["index/stray/part.parquet"]


def test_index_without_vectors_and_few_rows(spark, tmp_path):
    ds = make(spark, tmp_path, ("id", "int64"), ("vector", "vector[2]"))
    assert ds.build_index().version == 0
    commit(ds, (1, None))
    assert ds.build_index().version == 1
    commit(ds, (2, [1.0, 1.0]), (3, [1.0, 1.0]))
    ds.build_index(50)
    assert ids(ds.snapshot().vector_search(VectorSearchRequest((0.0, 0.0), 5), probes=1)) == [1, 2]


def test_collected_hits_and_their_rows(cloud):
    ds, x = cloud
    view = ds.snapshot()
    q = tuple(map(float, x[0]))
    hits = view.collect_hits(VectorSearchRequest(q, 3, hydrate=("label", "id")))
    assert hits.columns == ("label", "id") and [h.row.id for h in hits.hits] == [h.row_id for h in hits.hits] and hits.hits[0].state == "hydrated"
    assert [h.state for h in view.collect_hits(VectorSearchRequest(q, 2)).hits] == ["not_requested"] * 2
    with ds.begin() as txn:
        txn.delete(0)
    found = ds.snapshot().hydrate([(0, 0.0), (1, 1.0), (5000, 2.0)], ["id"])
    assert [(h.state, h.reason) for h in found] == [("unresolved", "tombstoned"), ("hydrated", None), ("unresolved", "not_found")]


def test_primitive_search(cloud):
    ds, x = cloud
    q = tuple(map(float, x[0]))
    got = ids(ds.snapshot().vector_search_legacy(q, 4, Compare("label", ">=", 1) & Compare("_row_id", "<", 700)))
    assert got == brute(x, np.array(q), 4, lambda i: i % 4 >= 1 and i < 700)


H = results.Hit


@pytest.mark.parametrize(
    "error, columns, hits",
    [
        (E.TooManyVectorHits, None, [H(1, 0.0), H(2, 0.0), H(3, 0.0)]),
        (E.NonFiniteVectorDistance, None, [H(1, float("nan"))]),
        (E.NegativeVectorDistance, None, [H(1, -0.5)]),
        (E.NonMonotonicVectorDistances, None, [H(1, 2.0), H(2, 1.0)]),
        (E.NonMonotonicVectorDistances, None, [H(2, 1.0), H(2, 1.0)]),
        (E.UnexpectedHydration, None, [H(1, 0.0, "hydrated", Row(a=1))]),
        (E.MissingHydration, ("a",), [H(1, 0.0)]),
        (E.HydrationProjectionMismatch, ("a", "b"), [H(1, 0.0, "hydrated", Row(b=1, a=2))]),
    ],
)
def test_hits_that_do_not_fit(error, columns, hits):
    with pytest.raises(error):
        results.Hits(2, columns, tuple(hits))


@pytest.mark.parametrize(
    "error, keys, aggregates, rows",
    [
        (E.GroupResultShape, ("k",), (("n", "uint64"),), [(1,)]),
        (E.NonScalarGroupResult, ("k",), (), [([1.0],)]),
        (E.NullCountAggregate, ("k",), (("n", "uint64"),), [(1, None)]),
        (E.AggregateResultTypeMismatch, ("k",), (("s", "float64"),), [(1, 2)]),
        (E.AggregateResultTypeMismatch, ("k",), (("s", "int64"),), [(1, True)]),
        (E.InvalidAggregateOutputType, ("k",), (("s", "utf8"),), []),
        (E.DuplicateGroupColumn, ("k", "k"), (), []),
        (E.DuplicateAggregateAlias, ("k",), (("k", "int64"),), []),
        (E.ReservedColumn, ("_row_id",), (), []),
    ],
)
def test_groups_that_do_not_fit(error, keys, aggregates, rows):
    with pytest.raises(error):
        results.Groups(keys, aggregates, tuple(rows))


def test_collected_groups(cloud):
    ds, _ = cloud
    request = GroupByRequest(("label",), (Aggregate("id", "count", "n"), Aggregate("id", "avg", "mean")))
    assert sorted(tuple(r) for r in ds.snapshot().collect_groups(request)) == sorted(tuple(r) for r in ds.snapshot().group_by(request).collect())


def test_filters_are_keys_by_type_and_bits(cloud):
    ds, _ = cloud
    one = [Compare("a", "=", v) for v in (1, 1.0, True, "1", 0.0, -0.0, float("nan"))]
    assert len(set(one)) == 7 and Compare("a", "==", 1) == Compare("a", "=", 1) and Compare("a", "=", float("nan")) in set(one)
    view = ds.snapshot()
    view.live_set(Compare("label", "=", 1))
    with pytest.raises(E.FilterTypeMismatch):
        view.live_set(Compare("label", "=", True))


def test_live_sets_stay_within_their_budget(cloud, monkeypatch):
    from quillon.operators import snapshot

    monkeypatch.setattr(snapshot, "LIVE_SET_BYTES", 8 * 600)
    view = cloud[0].snapshot()
    small, large = Compare("label", "=", 1), Compare("label", ">=", 0)
    assert view.live_set(small) is view.live_set(small) and view.live_set(large) is not view.live_set(large)
    assert view.live_set(large).count() == 2000 and view._live_bytes == 8 * 500


def test_time_and_id_filters_prune(cloud):
    ds, _ = cloud
    view = ds.snapshot()
    first, second = sorted({f.timestamp for f in view.manifest.files if f.row_count})
    assert [f.timestamp for f in view.surviving(Compare("_timestamp", ">", first), primitive=True)] == [second]
    got = view.scan_predicate(Compare("_timestamp", "<=", first) & Compare("_row_id", ">=", 1498), ["id", "_timestamp", "_row_id"])
    assert values(got.select("id")) == [(1498,), (1499,)]
    with pytest.raises(E.ReservedColumn):
        view.scan(ScanRequest(None, Compare("_timestamp", ">", 0)))


def test_primitive_scans_prune_floats_by_total_order(spark, tmp_path):
    ds = make(spark, tmp_path, ("id", "int64"), ("x", "float64"))
    commit(ds, (1, 1.0), (2, 2.0))
    commit(ds, (3, 10.0), (4, float("nan")))
    commit(ds, (5, 0.0), (6, -0.0))
    view = ds.snapshot()
    left = lambda op, v: [f.first // 2 for f in view.surviving(Compare("x", op, v), primitive=True)]
    assert left("<", 5.0) == [0, 2] and left("=", 10.0) == [1] and left("<", 0.0) == [2]
    got = lambda op, v: sorted(r.id for r in view.scan_predicate(Compare("x", op, v), ["id", "x"]).collect())
    assert got(">", 5.0) == [3, 4] and got("=", float("nan")) == [4] and got("<", 0.0) == [6] and got("=", 0.0) == [5] and got("<=", 0.0) == [5, 6]
