import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quillon.llm import mixing as M

SCHEMA = "doc_id long, text string, source string, size long"


def brute(rows):
    sizes = [(i, s, len((t or "").split(" ")) if t else 0) for i, t, s, _ in rows]
    by = defaultdict(int)
    for _, s, n in sizes:
        by[s] += n
    order = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, whole, free = {}, 1.5 * sum(by.values()), set(order)
    while free:
        level = (whole - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * by[s]}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: 2.0 * by[s] for s in over}
        free -= over
    out, left = [], {s: int(target[s] + 1e-9) for s in order}
    key = lambda i: hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()
    ordered = sorted(sizes, key=lambda x: (key(x[0]), -1 if x[0] is None else x[0], x[2]))
    taken = [0] * len(ordered)
    for _ in range(3):
        for k, (_, s, n) in enumerate(ordered):
            take = min(n, left[s])
            taken[k] += take
            left[s] -= take
    for k, (i, s, n) in enumerate(ordered):
        out.append((i, n, by[s], round(target[s], 6), taken[k]))
    return out


@pytest.mark.parametrize("per_range", [4096, 3])
def test_mix_equals_brute_force(spark, monkeypatch, per_range):
    monkeypatch.setattr(M, "RANGE_ROWS", per_range)
    monkeypatch.setattr(M, "PART_ROWS", per_range)
    rows = [(i, " ".join(["w"] * (i * 7 % 23)), ("big", "é", "a", "Z", None)[min(4, i % 9)], i) for i in range(200)]
    rows += [(None, "x y z", "a", 0), (None, "x y z", "a", 1), (5, "x y", "big", 0), (5, "x y", "big", 0), (900, None, "empty", 0), (901, "", "empty", 0)]
    got = [(r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in M.mix(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()]
    order = lambda x: (-1 if x[0] is None else x[0], *x[1:])
    assert sorted(got, key=order) == sorted(brute(rows), key=order)


def test_documents_follow_the_mix(spark):
    rows = [(i, " ".join(f"w{i}_{k}" for k in range(i % 11)), "abc"[i % 3] if i % 7 else None, i) for i in range(90)] + [(3, "q r s", "a", 5), (3, "q r s", "a", 6), (None, "n o", "b", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = M.mixed_documents(docs)
    assert out.columns == docs.columns
    words = defaultdict(int)
    for r in out.collect():
        words[r.doc_id] += len(r.text.split())
        assert any(r.doc_id == i and (t or "").startswith(r.text.rsplit(" ", 1)[0]) for i, t, _, _ in rows)
    want = defaultdict(int)
    for r in M.mix(docs).collect():
        want[r.doc_id] += r.taken
    assert words == {k: v for k, v in want.items() if v}


@pytest.mark.parametrize("part", [M.PART_ROWS, 3])
def test_takes_stay_with_their_source(spark, monkeypatch, part):
    monkeypatch.setattr(M, "PART_ROWS", part)
    rows = [(None, f"{s}{k} x y", s, k) for s in ("a", "b", "c", None) for k in range(6)] + [(1, "w " * 40, "b", 0)]
    sizes = spark.createDataFrame([(s, len(t.split())) for _, t, s, _ in rows], "source string, size long")
    got = defaultdict(int)
    for r in M.mixed_documents(spark.createDataFrame(rows, SCHEMA)).collect():
        got[r.source] += len(r.text.split())
    assert got == {r.source: int(r.target) for r in M.source_targets(sizes).collect()}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert M.mix(empty).count() == 0 and M.mixed_documents(empty).count() == 0
    assert M.mix(spark.createDataFrame([(1, None, None, 0)], SCHEMA)).collect()[0].taken == 0


def test_clashing_names_and_a_very_long_text(spark):
    names = "_id _size _at _taken _now _part _atn _atk".split()
    rows = [(i, "w " * (400_000 if i == 0 else 5), "a", *[77] * len(names)) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} int" for n in names))
    out = M.mixed_documents(docs)
    assert out.columns == docs.columns
    for r in out.select("doc_id", F.size(F.split(F.trim("text"), " ")).alias("n"), *names).collect():
        assert all(r[n] == 77 for n in names) and r.n <= (400_000 if r.doc_id == 0 else 5)


def test_many_rows_without_an_id(spark, monkeypatch):
    """A third of all rows alike in id, source and size: numbered in parts, each text as often as one of its takes."""
    monkeypatch.setattr(M, "PART_ROWS", 16)
    rows = [(None, f"t{i % 150} b c", "a", i) for i in range(300)] + [(i, "w " * (i % 9), "ab"[i % 2], i) for i in range(600)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = sum(len(r.text.split()) for r in M.mixed_documents(docs).collect())
    want = sum(r.taken for r in M.mix(docs).collect())
    assert got == want and [r.text for r in M.mixed_documents(docs).orderBy("text").collect()] == [r.text for r in M.mixed_documents(docs.repartition(2)).orderBy("text").collect()]
