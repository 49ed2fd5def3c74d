import gc
import json
import os
import subprocess
import sys
import time
from pathlib import Path

import pyarrow as pa
import pytest
from engine import commit, frame, make, values

from quillon import cli
from quillon import errors as E
from quillon.operators import rows
from quillon.operators.dataset import Dataset
from quillon.plans.requests import Compare, ScanRequest
from quillon.plans.schema import Schema
from quillon.sources import ingest, rowgroups
from quillon.sources.backend import HadoopBackend, LocalBackend, check_key
from quillon.sources.manifest import Manifest, manifest_key, read_manifest
from quillon.streaming import committing

ID = (("id", "int64", False),)


def test_compaction_keeps_rows_ids_and_times(spark, tmp_path):
    ds = make(spark, tmp_path, *ID, ("vector", "vector[2]"))
    for i in range(0, 12, 3):
        commit(ds, *[(k, [float(k), 0.0]) for k in range(i, i + 3)])
    with ds.begin() as txn:
        for i in (1, 2, 7):
            txn.delete(i)
    del txn
    hidden = ["_row_id", "_timestamp", "id"]
    before = values(ds.snapshot().scan_all(hidden))
    gc.collect()
    report = ds.compact(2)
    assert (report.rows, len(report.deleted)) == (9, 4)
    assert values(ds.snapshot().scan_all(hidden)) == before
    assert ds.snapshot().manifest.tombstones == () and ds.snapshot().lookup(7).outcome == "not_found" and ds.snapshot().lookup(8, ("id",)).row.id == 8
    assert values(Dataset.open(spark, ds.backend.root, verify=True).snapshot().scan_all(hidden)) == before
    with ds.begin() as txn:
        txn.delete(8)
    assert ds.snapshot().scan(ScanRequest()).count() == 8
    with pytest.raises(E.InvalidCompactionPolicy):
        ds.compact(0)


def test_runs_of_ids(spark):
    ids = [0, 1, 2, 5, 6, 9, (1 << 20) - 1, 1 << 20, (1 << 20) + 1, (1 << 21) - 1, 1 << 21]
    got = sorted(tuple(r) for r in rows.id_runs(spark.createDataFrame([(i,) for i in ids], "id long")).collect())
    assert got == [(0, 2), (5, 6), (9, 9), ((1 << 20) - 1, (1 << 20) + 1), ((1 << 21) - 1, 1 << 21)]


def test_migration(spark, tmp_path):
    ds = make(spark, tmp_path, *ID)
    commit(ds, (7,), (8,))
    old, stale = ds.snapshot(), ds.begin()
    with pytest.raises(E.MigrationUnsupported):
        ds.migrate_add_nullable_column(("tag", "utf8", False))
    with pytest.raises(E.MigrationIncompatibleType):
        ds.migrate_add_nullable_column(("id", "utf8"))
    with pytest.raises(E.MigrationLossyConversion):
        ds.migrate_change_type("id", "utf8")
    ds.migrate_add_nullable_column(("tag", "utf8"))
    commit(ds, (9, "new"))
    assert values(ds.snapshot().scan(ScanRequest())) == [(7, None), (8, None), (9, "new")]
    assert values(ds.snapshot().scan(ScanRequest(("id",), Compare("tag", "=", "new")))) == [(9,)]
    assert values(old.scan(ScanRequest())) == [(7,), (8,)] and (ds.schema_version, old.schema_version) == (2, 1)
    with pytest.raises(E.SchemaVersionChanged):
        stale.commit()
    with pytest.raises(E.MigrationSourceVersion):
        ds.migrate_add_nullable_column(("more", "utf8"))
    del old, stale
    gc.collect()
    ds.compact()
    assert values(Dataset.open(spark, ds.backend.root, verify=True).snapshot().scan(ScanRequest())) == [(7, None), (8, None), (9, "new")]


def test_retention_vacuum_and_maintenance(spark, tmp_path):
    ds = make(spark, tmp_path, *ID)
    for i in range(4):
        commit(ds, (i,))
    gc.collect()
    held = ds.snapshot()
    commit(ds, (4,))
    plan = ds.retention_plan(1)
    assert plan.retained_versions == (4, 5) and plan.eligible_versions == (0, 1, 2, 3) and plan.eligible_data_objects == ()
    with pytest.raises(E.InvalidRetentionPolicy):
        ds.retention_plan(0)
    assert ds.prune_manifests_by_age(1, 10**12) == []
    assert ds.prune_manifests(2) == [0, 1, 2, 3]
    aborted = ds.begin()
    aborted.insert(frame(ds, (99,)))
    aborted.abort()
    assert ds.inventory().orphan_candidate_count == 1
    assert len(ds.vacuum()) == 1 and ds.vacuum() == []
    assert values(held.scan(ScanRequest())) == [(0,), (1,), (2,), (3,)]
    del held, aborted
    gc.collect()
    report = ds.maintain(1, 0, 10, 10)
    assert report.storage_bound_met and report.inventory.data_object_count == report.inventory.reachable_data_file_count
    assert not ds.maintain(1, 0, 1, 1).storage_bound_met
    with pytest.raises(E.InvalidRetentionPolicy):
        ds.maintain(1, 0, 0, 1)
    assert values(Dataset.open(spark, ds.backend.root).snapshot().scan(ScanRequest())) == [(i,) for i in range(5)]


def test_broken_objects_are_found(spark, tmp_path):
    ds = make(spark, tmp_path, *ID)
    commit(ds, (1,), (2,))
    root = Path(ds.backend.root)
    data = next(root.glob("data/*/*.parquet"))
    manifest = root / manifest_key(1)
    good = manifest.read_bytes()
    for bad in (good.replace(b'next_row_id', b'next_row_ix'), good[:-9], b"{}", b""):
        manifest.write_bytes(bad)
        with pytest.raises(E.CorruptManifest):
            Dataset.open(spark, str(root))
    manifest.write_bytes(good)
    kept = data.read_bytes()
    data.write_bytes(kept + b"x")
    with pytest.raises(E.CorruptDataFile):
        Dataset.open(spark, str(root))
    data.unlink()
    with pytest.raises(E.CorruptDataFile):
        Dataset.open(spark, str(root))
    assert Manifest.decode(good, 1).encode() == good
    with pytest.raises(E.CorruptManifest):
        Manifest.decode(good, 2)


@pytest.mark.parametrize("kind", ["local", "hadoop"])
def test_backends(spark, tmp_path, kind):
    b = LocalBackend(str(tmp_path / "b")) if kind == "local" else HadoopBackend(spark, f"file://{tmp_path}/b")
    assert not b.exists() and b.parent_exists()
    b.create()
    b.put("a/x", b"hello")
    b.put("a/x", b"hello world")
    b.put_if_absent("a/y/z", b"1")
    with pytest.raises(E.ObjectAlreadyExists):
        b.put_if_absent("a/y/z", b"2")
    assert b.get("a/x") == b"hello world" and b.get_range("a/x", 6, 3) == b"wor" and b.get("a/y/z") == b"1"
    assert [(m.key, m.bytes) for m in b.list("a")] == [("a/x", 11), ("a/y/z", 1)] and b.list("none") == []
    b.delete("a/x")
    with pytest.raises(E.ObjectNotFound):
        b.get("a/x")


@pytest.mark.parametrize("key", ["", "/a", "../a", "a/../b", "a//b", "./a", "a\\b", "a/"])
def test_unsafe_keys(key):
    with pytest.raises(E.UnsafeManifestPath):
        check_key(key)


def test_a_dataset_through_the_hadoop_backend(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("quillon.operators.dataset.backend_for", HadoopBackend)
    ds = Dataset.create(spark, f"file://{tmp_path}/h", Schema.of(*ID))
    commit(ds, (1,), (2,))
    with ds.begin() as txn:
        txn.delete(0)
    assert values(Dataset.open(spark, f"file://{tmp_path}/h", verify=True).snapshot().scan(ScanRequest())) == [(2,)]


CHILD = """
import os, sys
sys.path.insert(0, sys.argv[2])
from pyspark.sql import SparkSession
from quillon.operators.dataset import Dataset
from quillon.sources import manifest
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
ds = Dataset.open(spark, sys.argv[1])
txn = ds.begin()
txn.insert(spark.createDataFrame([(50,)], ds.schema.spark()))
manifest.publish = lambda *_: os._exit(9)
txn.commit()
"""


def test_a_crash_before_publication_leaves_no_trace(spark, tmp_path):
    ds = make(spark, tmp_path, *ID)
    commit(ds, (1,))
    done = subprocess.run([sys.executable, "-c", CHILD, ds.backend.root, str(Path(__file__).parents[1])], capture_output=True, timeout=300)
    assert done.returncode == 9, done.stderr[-800:]
    again = Dataset.open(spark, ds.backend.root, verify=True)
    assert values(again.snapshot().scan(ScanRequest())) == [(1,)] and again.inventory().orphan_candidate_count == 1
    commit(again, (2,))
    assert [r[0] for r in values(again.snapshot().scan_all(["_row_id"]))] == [0, 2]
    assert len(again.vacuum()) == 1


def test_row_groups_and_arrow(spark, tmp_path):
    df = spark.range(25).selectExpr("id", "id * 3 AS extra").coalesce(1)
    assert rowgroups.write_row_groups(df, str(tmp_path / "g"), 10) == 3
    assert values(rowgroups.read_row_groups(spark, str(tmp_path / "g"), 1, 2, ["extra"])) == sorted([(3 * i,) for i in range(10, 25)], key=repr)
    with pytest.raises(E.CorruptDataFile):
        rowgroups.read_row_groups(spark, str(tmp_path / "g"), 2, 2)
    with pytest.raises(E.UnreasonableCapacity):
        rowgroups.write_row_groups(df, str(tmp_path / "h"), 0)
    data = ingest.to_ipc(df)
    assert values(ingest.from_ipc(spark, data)) == values(df)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("id", pa.int64())])) as w:
        w.write_batch(pa.RecordBatch.from_pydict({"id": [1]}))
        w.write_batch(pa.RecordBatch.from_pydict({"id": [2]}))
    with pytest.raises(E.BatchSchemaMismatch):
        ingest.from_ipc(spark, sink.getvalue().to_pybytes())


def test_row_groups_are_those_of_the_files(spark, tmp_path):
    import pyarrow.parquet as pq

    df = spark.range(95).selectExpr("id", "id * 3 AS extra").repartitionByRange(3, "id").sortWithinPartitions("id")
    n = rowgroups.write_row_groups(df, str(tmp_path / "g"), 10)
    index = rowgroups.row_group_index(spark, str(tmp_path / "g"))
    assert n == len(index) and sum(g.rows for g in index) == 95 and max(g.rows for g in index) == 10
    for key in {g.key for g in index}:
        meta = pq.ParquetFile(tmp_path / "g" / key).metadata
        assert [meta.row_group(i).num_rows for i in range(meta.num_row_groups)] == [g.rows for g in index if g.key == key]
    for first, count in ((0, n), (1, 1), (2, n - 3), (n - 1, 1)):
        before = sum(g.rows for g in index[:first])
        got = sorted(r.id for r in rowgroups.read_row_groups(spark, str(tmp_path / "g"), first, count).collect())
        assert got == list(range(before, before + sum(g.rows for g in index[first : first + count])))
    plan = rowgroups.read_row_groups(spark, str(tmp_path / "g"), 1, 1)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(_group,1)" in plan


def test_full_runs_of_files_are_shared_by_versions(spark, tmp_path, monkeypatch):
    from quillon.sources import manifest as M

    monkeypatch.setattr(M, "CHUNK_FILES", 3)
    ds = make(spark, tmp_path, *ID)
    sizes = []
    for i in range(10):
        commit(ds, (i,))
        sizes.append(len(ds.backend.get(manifest_key(ds.version))))
    assert len(ds.snapshot().manifest.chunks) == 3 and len(ds.backend.list(M.CHUNKS)) == 3
    assert sizes[9] < sizes[1] + 400  # a manifest holds the files since the last full run, and keys
    again = Dataset.open(spark, ds.backend.root)
    assert again.snapshot().manifest == ds.snapshot().manifest and values(again.snapshot().scan(ScanRequest())) == [(i,) for i in range(10)]
    del again
    gc.collect()
    assert ds.vacuum() == []
    ds.compact()
    ds.prune_manifests(1)
    gc.collect()
    before = set(ds.snapshot().manifest.chunks)
    assert sum(k.startswith("_files/") for k in ds.vacuum()) == 3 and {m.key for m in ds.backend.list(M.CHUNKS)} == before
    assert values(Dataset.open(spark, ds.backend.root).snapshot().scan(ScanRequest())) == [(i,) for i in range(10)]
    for i in range(10, 14):
        commit(ds, (i,))
    chunk = ds.backend.list(M.CHUNKS)[0].key
    ds.backend.put(chunk, b"[]")
    with pytest.raises(E.CorruptManifest):
        Dataset.open(spark, ds.backend.root)
    with pytest.raises(E.MigrationUnsupportedDirection):
        ds.check_migration(0)


def test_streams_commit_by_batch(spark, tmp_path):
    ds = make(spark, tmp_path, *ID)
    for i in range(3):
        spark.range(i * 10, i * 10 + 10).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        time.sleep(0.01)
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    committing(ds, stream).trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start().awaitTermination()
    assert ds.version == 3 and ds.snapshot().scan(ScanRequest()).count() == 30


def test_command_line(spark, tmp_path, capsys):
    root, out = str(tmp_path / "cli"), []
    run = lambda *args: (out.clear(), cli.run([args[0], root, *args[1:]], spark, out.append))[1]
    assert run("create", "--schema", "id:int64!,name:utf8,score:float64,vector:vector[2]") == cli.USAGE
    assert run("create", "--schema", "id:int64!,name:utf8,score:float64,vector:vector[2]", "--ack-single-writer") == cli.OK
    Path(tmp_path / "rows.json").write_text("\n".join(json.dumps(r) for r in ({"id": 1, "name": 'al"é', "score": 1.5, "vector": [1, 2]}, {"id": 2, "name": "bob", "vector": [4, 5]})))
    assert run("insert", "--json-lines", str(tmp_path / "rows.json"), "--ack-single-writer") == cli.OK and out == ["inserted version=1"]
    assert run("query-scan", "--columns", "name,id", "--where", "score", ">", "1.0") == cli.OK and out == ['name="al\\"é" id=1']
    assert run("query-scan") == cli.USAGE and run("query-scan", "--columns", "nope") == cli.USAGE and run("filter", "--where", "id", "=", "x") == cli.USAGE
    assert run("group-by", "--by", "name", "--agg", "sum:score") == cli.OK and out == ['name="al\\"é" sum_score=1.5', 'name="bob" sum_score=null']
    assert run("search", "--vector", "4,5", "-k", "1", "--hydrate", "id") == cli.OK and json.loads(out[0]) == {"row_id": 1, "distance": 0.0, "id": 2}
    assert run("search", "--vector", "4,5", "--exact") == cli.UNSUPPORTED
    assert run("lookup", "0", "--columns", "name") == cli.OK and json.loads(out[0]) == {"kind": "row_lookup", "row_id": 0, "outcome": "live", "fields": [{"name": "name", "type": "utf8", "value": 'al"é'}]}
    for command in ("scan", "inspect", "schema", "manifest-status", "recovery-status", "evidence", "explain"):
        assert run(command) == cli.OK and out
    assert run("migration", "validate", "--column", "tag:utf8") == cli.OK and run("migration", "run", "--column", "tag:utf8", "--ack-single-writer") == cli.OK
    assert run("migration", "status") == cli.OK and json.loads(out[0])["schema_version"] == 2
    assert run("crash-loop", "--rounds", "1", "--ack-single-writer") == cli.OK
    os.remove(next(Path(root).glob("data/*/*.parquet")))
    assert run("scan") == cli.CORRUPTION
    assert cli.exit_code(E.Conflict("x")) == cli.CONFLICT and cli.exit_code(E.RowNotFound("x")) == cli.OPERATIONAL


def test_manifest_versions_reject_strangers(spark, tmp_path):
    ds = make(spark, tmp_path, *ID)
    Path(ds.backend.root, "_versions", "oops.txt").write_text("x")
    with pytest.raises(E.CorruptManifest):
        Dataset.open(spark, ds.backend.root)
    with pytest.raises(E.CorruptManifest):
        read_manifest(ds.backend, 7)
