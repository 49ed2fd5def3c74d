import gc
import time

import pytest
from engine import commit, frame, make, values

from quillon import errors as E
from quillon.operators import rows
from quillon.operators.dataset import Dataset
from quillon.plans.requests import Aggregate, Compare, GroupByRequest, ScanRequest, VectorSearchRequest
from quillon.plans.schema import ROW_ID
from quillon.sources import deletions

IDS = (("id", "int64"), ("odd", "bool"))


@pytest.fixture
def numbers(spark, tmp_path):
    ds = make(spark, tmp_path, *IDS)
    commit(ds, *[(i, i % 2 == 1) for i in range(300)])
    return ds


def kept(ds):
    return sorted(r[0] for r in ds.snapshot().scan(ScanRequest(("id",))).collect())


def test_bits_of_ids(spark):
    ids = [0, 1, 63, 64, 127, 200, (1 << 40) + 5]
    words = deletions.of_ids(spark.createDataFrame([(i,) for i in [*ids, 63]], "row_id long"))
    vector = deletions.Vector(words, 5)
    assert sorted(r[0] for r in deletions.ids(vector).collect()) == ids
    table = spark.createDataFrame([(i,) for i in range(260)], f"{ROW_ID} long")
    for count in (5, deletions.MOST_BROADCAST_WORDS + 1):
        named = deletions.Vector(words, count)
        assert sorted(r[0] for r in deletions.within(table, named).collect()) == ids[:-1]
        assert sorted(r[0] for r in deletions.without(table, named).collect()) == [i for i in range(260) if i not in ids]


def test_wide_ranges_make_few_rows(spark):
    wide = (1000, 1000 + 10**9)
    ranges = tuple((i * 7 + 2 * 10**9, i * 7 + 2 * 10**9 + i % 5) for i in range(100)) + (wide, (3, 3), (62, 66))
    words, blocks = deletions.of_ranges(spark, list(ranges))
    assert words.count < 40_000 and blocks.count < 1000
    probe = [0, 3, 4, 61, 62, 66, 67, 999, 1000, 1001, 1 << 20, 5 << 20, 10**9, wide[1], wide[1] + 1, *range(2 * 10**9 - 3, 2 * 10**9 + 800)]
    table = spark.createDataFrame([(i,) for i in probe], f"{ROW_ID} long")
    got = sorted(r[0] for r in rows.without_tombstones(table, ranges).collect())
    assert got == sorted(i for i in probe if not any(lo <= i <= hi for lo, hi in ranges))


def test_delete_where_is_seen_by_every_read(numbers):
    txn = numbers.begin()
    assert txn.delete_where(Compare("odd", "=", True)) == 150 and txn.delete_where(Compare("id", "<", 0)) == 0
    assert sorted(r[0] for r in txn.scan(ScanRequest(("id",))).collect()) == list(range(0, 300, 2))
    assert txn.lookup(7).outcome == "tombstoned" and txn.lookup(8).outcome == "live"
    with pytest.raises(E.DuplicateTarget):
        txn.delete(7)
    with pytest.raises(E.DuplicateTarget):
        txn.delete_where(Compare("id", "=", 9))
    txn.delete(8)
    with pytest.raises(E.DuplicateTarget):
        txn.delete_where(Compare("id", "<", 20) & Compare("odd", "=", False))
    txn.commit()
    want = [i for i in range(0, 300, 2) if i != 8]
    assert kept(numbers) == want and numbers.snapshot().manifest.deleted == 151 and numbers.inventory().tombstone_count == 151
    again = Dataset.open(numbers.spark, numbers.backend.root)
    assert kept(again) == want
    view = again.snapshot()
    assert view.lookup(7).outcome == "tombstoned" and view.lookup(300).outcome == "not_found"
    assert values(view.group_by(GroupByRequest(("odd",), (Aggregate("id", "count", "n"),)))) == [(False, 149)]
    with pytest.raises(E.RowNotLive):
        again.begin().delete(7)
    del view
    gc.collect()
    again.compact()
    assert kept(again) == want and again.snapshot().manifest.deletions == () and again.snapshot().lookup(7).outcome == "not_found"
    with again.begin() as txn:
        txn.delete(10)
        with pytest.raises(E.RowNotFound):
            txn.delete(11)
    assert kept(again) == [i for i in want if i != 10]


@pytest.mark.parametrize("first, second", [("one", "where"), ("where", "one"), ("where", "where")])
def test_conflicts_of_deletion_vectors(numbers, first, second):
    def target(txn, how):
        txn.delete(5) if how == "one" else txn.delete_where(Compare("odd", "=", True) & Compare("id", "<", 50))

    a, b, clear = numbers.begin(), numbers.begin(), numbers.begin()
    target(a, first)
    target(b, second)
    clear.delete_where(Compare("odd", "=", False))
    a.commit()
    clear.commit()
    with pytest.raises(E.Conflict) as found:
        b.commit()
    assert 5 in found.value.contested_row_ids


def test_vacuum_keeps_what_open_transactions_staged(numbers):
    txn, ended = numbers.begin(), numbers.begin()
    txn.insert(frame(numbers, (1000, False)))
    txn.delete_where(Compare("id", "<", 10))
    ended.insert(frame(numbers, (2000, False)))
    ended.abort()
    gone = numbers.vacuum()
    assert len(gone) == 1 and not set(gone) & set(txn.objects)
    txn.commit()
    assert numbers.vacuum() == []
    assert kept(numbers) == [*range(10, 300), 1000] == kept(Dataset.open(numbers.spark, numbers.backend.root))


def test_commit_refuses_when_a_staged_file_is_gone(numbers):
    txn = numbers.begin()
    txn.insert(frame(numbers, (1000, False)))
    numbers.backend.delete(txn.files[0].name)
    with pytest.raises(E.CorruptDataFile):
        txn.commit()
    assert numbers.version == 1 and len(kept(numbers)) == 300


def test_a_replayed_micro_batch_commits_once(spark, tmp_path):
    from quillon.streaming import committing

    ds = make(spark, tmp_path, ("id", "int64"))
    for i in range(3):
        spark.range(i * 10, i * 10 + 10).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        time.sleep(0.01)

    def run(checkpoint):
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        committing(ds, stream, "numbers").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/{checkpoint}").start().awaitTermination()

    run("one")
    assert (ds.version, ds.last_batch("numbers")) == (3, 2)
    run("two")  # the checkpoint is lost: every batch comes again
    assert ds.version == 3 and kept(ds) == list(range(30))
    assert Dataset.open(spark, ds.backend.root).last_batch("numbers") == 2 and ds.last_batch("other") == -1
    late, again = ds.begin(), ds.begin()
    for txn in (late, again):
        txn.stream = ("numbers", 3)
        txn.insert(frame(ds, (100,)))
    late.commit()
    again.commit()
    assert kept(ds) == [*range(30), 100]


def test_publication_that_is_visible_before_it_fails(numbers, monkeypatch):
    sync = numbers.backend._sync

    def broken(folder):
        if folder.name == "_versions":
            raise OSError("the folder cannot be synced")
        sync(folder)

    txn = numbers.begin()
    txn.delete(0)
    monkeypatch.setattr(numbers.backend, "_sync", broken)
    with pytest.raises(E.IndeterminateManifestPublication):
        txn.commit()
    monkeypatch.undo()
    assert numbers.version == 2 and kept(numbers) == list(range(1, 300))
    with numbers.begin() as txn:
        txn.delete(1)
    assert kept(Dataset.open(numbers.spark, numbers.backend.root)) == list(range(2, 300))


def test_publication_that_nobody_can_see(numbers, monkeypatch):
    txn = numbers.begin()
    txn.delete(0)
    monkeypatch.setattr(numbers.backend, "put_if_absent", lambda *a: (_ for _ in ()).throw(OSError("full")))
    with pytest.raises(OSError, match="full"):
        txn.commit()
    assert numbers.version == 1


def test_vector_search_refuses_staged_vectors(spark, tmp_path):
    ds = make(spark, tmp_path, ("id", "int64"), ("vector", "vector[2]"))
    commit(ds, (1, [0.0, 1.0]), (2, [5.0, 5.0]))
    txn = ds.begin()
    txn.delete_where(Compare("id", "=", 1))
    with pytest.raises(E.UnsupportedTransactionRead):
        txn.vector_search(VectorSearchRequest((0.0, 0.0), 1))
    txn.commit()
    assert [r.row_id for r in ds.snapshot().vector_search(VectorSearchRequest((0.0, 0.0), 2)).collect()] == [1]
