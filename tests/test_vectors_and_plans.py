import random

import numpy as np
import pytest
from engine import commit, make, values

from quillon import errors as E
from quillon.functions import vectors
from quillon.operators import rows
from quillon.plans import planner as P
from quillon.plans.requests import Aggregate, Compare, GroupByRequest, ScanRequest, VectorSearchRequest

PLAN = (("category", "utf8"), ("amount", "int64"), ("vector", "vector[2]"))
BIG = Compare("amount", ">", 5)


@pytest.fixture
def planned(spark, tmp_path):
    ds = make(spark, tmp_path, *PLAN)
    commit(ds, ("discard", 1, [0.0, 0.0]), (None, None, [1.0, 1.0]))
    commit(ds, ("keep", 10, [2.0, 2.0]), ("keep", 20, [3.0, 3.0]))
    return ds.snapshot()


def test_ties_go_to_the_smaller_id(spark, tmp_path):
    ds = make(spark, tmp_path, ("name", "utf8"), ("vector", "vector[2]"))
    commit(ds, ("exact", [0.0, 0.0]), ("left", [-1.0, 0.0]), ("right", [1.0, 0.0]), ("none", None))
    hits = ds.snapshot().vector_search(VectorSearchRequest((0.0, 0.0), 3)).collect()
    assert [tuple(h) for h in hits] == [(0, 0.0), (1, 1.0), (2, 1.0)]
    assert len(ds.snapshot().vector_search(VectorSearchRequest((0.0, 0.0), 9)).collect()) == 3


def test_filter_comes_before_the_top(spark, tmp_path):
    ds = make(spark, tmp_path, ("name", "utf8"), ("selected", "bool"), ("vector", "vector[2]"))
    commit(ds, ("near", False, [0.0, 0.0]), ("far", True, [10.0, 10.0]), ("null", True, None))
    found = ds.snapshot().vector_search(VectorSearchRequest((0.0, 0.0), 4, filter=Compare("selected", "=", True), hydrate=("name",))).collect()
    assert [tuple(h) for h in found] == [(1, 200.0, "far")]
    with ds.begin() as txn:
        txn.delete(1)
    assert ds.snapshot().vector_search(VectorSearchRequest((0.0, 0.0), 4, filter=Compare("selected", "=", True))).count() == 0


def test_search_equals_brute_force_and_plans_a_top_k(spark, tmp_path):
    r = random.Random(1)
    data = [(i, [float(np.float32(r.random())) for _ in range(8)]) for i in range(300)]
    ds = make(spark, tmp_path, ("id", "int64"), ("vector", "vector[8]"))
    commit(ds, *data[:150])
    commit(ds, *data[150:])
    q = tuple(r.random() for _ in range(8))
    df = ds.snapshot().vector_search(VectorSearchRequest(q, 20, hydrate=("id",)))
    want = sorted((sum((a - b) ** 2 for a, b in zip(v, q, strict=True)), i) for i, v in data)[:20]
    got = [(h.distance, h.id) for h in df.collect()]
    assert [i for _, i in got] == [i for _, i in want] and np.allclose([d for d, _ in got], [d for d, _ in want])
    assert "TakeOrderedAndProject" in df._jdf.queryExecution().executedPlan().toString()


def test_other_distances(spark):
    df = spark.createDataFrame([(0, [3.0, 4.0]), (1, [0.0, 0.0]), (2, [-4.0, 3.0])], "_row_id long, vector array<float>")
    by = lambda f: {r.row_id: round(r.distance, 9) for r in rows.nearest(df, (3.0, 4.0), 3, None, f).collect()}
    assert by(vectors.cosine_distance) == {0: 0.0, 1: 0.0, 2: 1.0}
    assert by(vectors.dot_distance) == {0: -25.0, 1: 0.0, 2: 0.0}


def test_planned_equals_direct_with_evidence(planned):
    scan, group, search = ScanRequest(("category",), BIG), GroupByRequest(("category",), (Aggregate("amount", "sum", "s"),), BIG), VectorSearchRequest((2.0, 2.0), 2, filter=BIG, hydrate=("category",))
    plan, df = planned.planned_scan(scan)
    assert plan.physical == ("manifest_snapshot_source", "zone_map_pruning", "tombstone_filter", "row_filter", "column_projection", "materialize")
    assert (plan.observations.data_files_total, plan.observations.data_files_scanned, plan.observations.data_files_pruned) == (2, 1, 1)
    assert values(df) == values(planned.scan(scan)) == [("keep",), ("keep",)]
    plan, df = planned.planned_group_by(group)
    assert plan.physical == ("manifest_snapshot_source", "zone_map_pruning", "tombstone_filter", "row_filter", "hash_group_by", "materialize")
    assert values(df) == values(planned.group_by(group)) == [("keep", 30)]
    plan, df = planned.planned_vector_search(search)
    assert plan.physical == ("zone_map_pruning", "filter_live_set", "tombstone_filter", "immutable_segment_vector_search", "hydration_lookup", "materialize")
    assert (plan.observations.index_segments_total, plan.observations.index_segments_pruned) == (2, 1)
    assert values(df) == values(planned.vector_search(search))
    assert planned.explain_scan(ScanRequest()).physical == ("manifest_snapshot_source", "tombstone_filter", "column_projection", "materialize")
    assert values(planned.explain(BIG).select("scanned", "segment")) == [(False, True), (True, True)]


def test_filters_and_columns_reach_the_scan(planned):
    plan = planned.scan(ScanRequest(("category",), Compare("amount", ">", 5)))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(amount), GreaterThan(amount,5)]" in plan and "ReadSchema: struct<category:string,amount:bigint>" in plan


def test_live_sets_are_kept_by_filter(planned):
    assert planned.live_set(BIG) is planned.live_set(Compare("amount", ">", 5))
    assert values(planned.live_set(BIG)) == [(2,), (3,)]


def test_plan_shapes():
    source, end = P.Logical("source"), P.Logical("materialize")
    for bad in ((source, end), (P.Logical("projection"), end), (source, P.Logical("projection")), (source, P.Logical("projection"), P.Logical("predicate"), end)):
        with pytest.raises(E.InvalidLogicalShape):
            P.check_shape(bad)
    with pytest.raises(E.ConflictingTerminalOperators):
        P.check_shape((source, P.Logical("projection"), P.Logical("grouping"), end))
