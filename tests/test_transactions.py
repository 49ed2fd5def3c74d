import threading

import pytest
from engine import commit, frame, make, values

from quillon import errors as E
from quillon.operators.dataset import CommitLog, Dataset
from quillon.plans.requests import Aggregate, Compare, GroupByRequest, RowLookupRequest, ScanRequest, VectorSearchRequest
from quillon.plans.schema import Schema
from quillon.sources.manifest import holds, normalized

DEMO = (("id", "int64", False), ("name", "utf8", False), ("vector", "vector[3]"))
ALL = ScanRequest(("id", "name"))


@pytest.fixture
def demo(spark, tmp_path):
    ds = make(spark, tmp_path, *DEMO)
    commit(ds, (1, "base", [1.0, 0.0, 0.0]), (2, "deleted", [2.0, 0.0, 0.0]), (3, "old", [3.0, 0.0, 0.0]))
    return ds


def test_overlay_reads(demo):
    txn = demo.begin()
    txn.insert(frame(demo, (4, "new", None)))
    txn.delete(1)
    txn.update(2, frame(demo, (3, "changed", [9.0, 0.0, 0.0])))
    assert values(txn.scan(ALL)) == [(1, "base"), (3, "changed"), (4, "new")]
    assert values(txn.scan(ScanRequest(("name",), Compare("id", ">=", 3)))) == [("changed",), ("new",)]
    assert values(txn.group_by(GroupByRequest(("name",), (Aggregate("id", "sum", "s"),)))) == [("base", 1), ("changed", 3), ("new", 4)]
    look = lambda i: txn.lookup(RowLookupRequest(i, ("name",)))
    assert [(x.outcome, x.row and x.row[0]) for x in map(look, (0, 1, 2, 3))] == [("live", "base"), ("tombstoned", None), ("live", "changed"), ("not_found", None)]
    assert values(demo.snapshot().scan(ALL)) == [(1, "base"), (2, "deleted"), (3, "old")]
    with pytest.raises(E.UnsupportedTransactionRead):
        txn.vector_search(VectorSearchRequest((0.0, 0.0, 0.0), 1))
    plan = txn.explain_scan(ScanRequest(None, Compare("id", ">", 100)))
    assert plan.physical == ("manifest_snapshot_source", "tombstone_filter", "transaction_overlay", "row_filter", "materialize")
    assert (plan.observations.data_files_scanned, plan.observations.data_files_pruned) == (plan.observations.data_files_total, 0)
    txn.commit()
    assert values(demo.snapshot().scan(ALL)) == [(1, "base"), (3, "changed"), (4, "new")]
    assert demo.snapshot().lookup(1).outcome == "tombstoned" and demo.snapshot().lookup(4).outcome == "live"


def test_target_errors_and_states(demo):
    txn = demo.begin()
    txn.delete(0)
    with pytest.raises(E.DuplicateTarget):
        txn.update(0, frame(demo, (1, "x", None)))
    with pytest.raises(E.RowNotFound):
        txn.delete(77)
    with pytest.raises(E.InvalidUpdateShape):
        txn.update(1, frame(demo, (1, "x", None), (2, "y", None)))
    txn.commit()
    assert txn.state == "committed"
    again = demo.begin()
    with pytest.raises(E.RowNotLive):
        again.delete(0)
    again.abort()
    with pytest.raises(E.TransactionFinished):
        again.commit()
    with pytest.raises(ZeroDivisionError), demo.begin() as failed:
        failed.delete(1)
        1 / 0
    assert failed.state == "aborted" and demo.snapshot().lookup(1).outcome == "live"


def test_batches_must_fit(spark, demo):
    txn = demo.begin()
    for batch in (
        spark.createDataFrame([(1, "x")], "id long, name string"),
        spark.createDataFrame([("x", 1, [1.0])], "name string, id long, vector array<float>"),
        spark.createDataFrame([(1, "x", [1.0])], "id int, name string, vector array<float>"),
        spark.createDataFrame([(None, "x", [1.0, 2.0, 3.0])], "id long, name string, vector array<float>"),
        spark.createDataFrame([(1, "x", [1.0, 2.0])], "id long, name string, vector array<float>"),
    ):
        with pytest.raises(E.BatchSchemaMismatch):
            txn.insert(batch)
    for odd in (float("nan"), float("inf"), None):
        with pytest.raises(E.NonFiniteStoredComponent):
            txn.insert(spark.createDataFrame([(1, "x", [1.0, odd, 3.0])], "id long, name string, vector array<float>"))
    txn.abort()
    assert demo.version == 1


def test_conflicts(demo):
    one, two, three = demo.begin(), demo.begin(), demo.begin()
    one.delete(0)
    one.delete(1)
    two.delete(1)
    two.delete(0)
    three.insert(frame(demo, (9, "free", None)))
    one.commit()
    with pytest.raises(E.Conflict) as found:
        two.commit()
    assert found.value.contested_row_ids == [1, 0]
    three.commit()
    demo.begin().commit()
    assert demo.version == 4


def test_commit_log():
    log = CommitLog(0)
    for v in range(1, 2051):
        log.push(v, frozenset({v}))
    assert log.check(2000, [1990, 2010, 2005]) == [2005, 2010] or log.check(2000, [1990, 2010, 2005]) == [2010, 2005]
    assert log.check(0, []) == []
    with pytest.raises(E.InsufficientHistory):
        log.check(0, [5])


def test_tombstone_ranges():
    ranges = normalized([5, 3, 4, 9], ((0, 1),))
    assert ranges == ((0, 1), (3, 5), (9, 9))
    assert [i for i in range(11) if holds(ranges, i)] == [0, 1, 3, 4, 5, 9]


def test_many_tombstones_by_join_and_by_condition(spark, tmp_path):
    ds = make(spark, tmp_path, ("id", "int64"), ("odd", "bool"))
    commit(ds, *[(i, i % 2 == 1) for i in range(400)])
    with ds.begin() as txn:
        assert txn.delete_where(Compare("odd", "=", True)) == 200
    assert ds.snapshot().manifest.deleted == 200 and ds.snapshot().manifest.tombstones == ()
    assert [r[0] for r in values(ds.snapshot().scan(ScanRequest(("id",))))] == sorted(range(0, 400, 2), key=lambda i: repr((i,)))


def test_snapshots_do_not_move(demo):
    before = demo.snapshot()
    with demo.begin() as txn:
        txn.delete(0)
        txn.insert(frame(demo, (7, "later", None)))
    demo.compact()
    assert values(before.scan(ALL)) == [(1, "base"), (2, "deleted"), (3, "old")]
    assert values(demo.snapshot().scan(ALL)) == [(2, "deleted"), (3, "old"), (7, "later")]


def test_threads_race_for_one_row(demo):
    outcomes, gate = [], threading.Barrier(4)

    def work(n):
        txn = demo.begin()
        txn.update(0, frame(demo, (1, f"by {n}", None)))
        gate.wait()
        try:
            txn.commit()
            outcomes.append(n)
        except E.Conflict as error:
            assert error.contested_row_ids == [0]

    threads = [threading.Thread(target=work, args=(n,)) for n in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(outcomes) == 1
    names = [r[1] for r in values(demo.snapshot().scan(ALL))]
    assert sorted(names) == sorted([f"by {outcomes[0]}", "deleted", "old"])


def test_reopen_sees_commits_only_and_never_reuses_ids(spark, demo):
    root = demo.backend.root
    txn = demo.begin()
    txn.insert(frame(demo, (8, "uncommitted", None)))
    again = Dataset.open(spark, root, verify=True)
    assert values(again.snapshot().scan(ALL)) == [(1, "base"), (2, "deleted"), (3, "old")]
    commit(again, (9, "next", None))
    ids = [r[0] for r in values(again.snapshot().scan_all(["_row_id"]))]
    assert ids == [0, 1, 2, 4]
    assert again.recovery.data_files == 1 and Dataset.open(spark, root).version == 2


def test_zero_row_batches_and_empty_dataset(spark, tmp_path):
    ds = make(spark, tmp_path, *DEMO)
    assert ds.snapshot().scan(ScanRequest()).count() == 0 and ds.snapshot().scan_all(["_row_id", "_timestamp"]).count() == 0
    commit(ds)
    assert ds.version == 1 and ds.snapshot().scan(ScanRequest()).count() == 0
    assert ds.snapshot().group_by(GroupByRequest(("id",), (Aggregate("id", "sum", "s"),))).count() == 0
    assert ds.snapshot().vector_search(VectorSearchRequest((0.0, 0.0, 0.0), 3)).count() == 0
    assert ds.compact().files_after == 0


def test_create_errors(spark, tmp_path):
    make(spark, tmp_path, ("id", "int64"))
    with pytest.raises(E.DatasetAlreadyExists):
        make(spark, tmp_path, ("id", "int64"))
    with pytest.raises(E.DatasetNotFound):
        Dataset.create(spark, str(tmp_path / "no" / "where"), Schema.of(("id", "int64")))
    with pytest.raises(E.DatasetNotFound):
        Dataset.open(spark, str(tmp_path / "none"))
