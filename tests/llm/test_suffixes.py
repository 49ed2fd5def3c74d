import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from quillon.llm import suffixes as S
from quillon.llm import repeats

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(texts, length=400):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        spans = sum(1 for i in range(len(r)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(r), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def some_texts():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, line, long = text(120), text(12), text(900)
    texts = [text(r.randint(5, 400)) for _ in range(25)]
    texts += [text(30) + passage + text(r.randint(0, 200)) for _ in range(6)]
    texts += [long, long, long[:2500] + "X" + long[2501:], long[100:] + text(9), text(3) + long[777:1177], text(3) + long[778:1176] + "é"]
    texts += [passage[:400], passage[:399], passage[1:400], line * 9, (line + "\n") * 60, "ab" * 700, "é" * 650, "x" * 400, "x" * 401, None, "", " ", passage + passage]
    return texts


@pytest.mark.parametrize("piece", [S.PIECE, 700])
def test_summarize_equals_brute_force(spark, monkeypatch, piece):
    monkeypatch.setattr(S, "PIECE", piece)
    texts = some_texts()
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.summarize(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_null_ids_repeated_rows_and_extra_columns(spark):
    long = " ".join(f"word{i}" for i in range(100))
    rows = [(None, long, 1), (None, long, 2), (7, long, 3), (7, "short", 4), (8, None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    got = sorted((r.doc_id or -1, r.n_removed) for r in S.summarize(docs).collect())
    assert got == [(-1, len(long)), (-1, len(long)), (7, 0), (7, len(long)), (8, 0)]
    kept = S.remove_repeats(docs)
    assert kept.columns == docs.columns and kept.count() == 5
    assert {(r.spans, r.text) for r in kept.collect()} == {(1, ""), (2, ""), (3, ""), (4, "short"), (5, None)}


def test_empty_table(spark):
    assert S.summarize(spark.createDataFrame([], SCHEMA)).count() == 0


def test_multikey_sort_sorts_tuples():
    r = np.random.default_rng(3)
    keys = [r.integers(0, 4, 500), np.zeros(500, np.int64), r.integers(0, 3, 500), r.integers(0, 9, 500)]
    order, new = repeats.multikey_sort(500, 4, lambda depth, at: keys[depth][at])
    rows = list(zip(*(k[order] for k in keys), strict=True))
    assert rows == sorted(zip(*keys, strict=True))
    assert new.tolist() == [i == 0 or rows[i] != rows[i - 1] for i in range(500)]


def test_multikey_sort_is_done_with_equal_rows_early(monkeypatch):
    monkeypatch.setattr(repeats, "CHECKED", 2)
    r = np.random.default_rng(7)
    table = np.repeat(r.integers(0, 3, (60, 9)), 4, axis=0)
    table[r.integers(0, 240, 20), r.integers(0, 9, 20)] += 1
    asked = []

    def equal(rows):
        return np.r_[False, (table[rows[1:]] == table[rows[:-1]]).all(1)]

    order, new = repeats.multikey_sort(240, 9, lambda depth, at: asked.append(len(at)) or table[at, depth], equal)
    rows = [tuple(x) for x in table[order].tolist()]
    groups = np.split(np.arange(240), np.flatnonzero(new)[1:])
    assert all(len({rows[i] for i in g}) == 1 for g in groups)  # rows of a group are equal, and no two groups are
    assert len(groups) == len(set(rows)) and sum(asked) < 240 * 9


def some_suffixes(r):
    parts = ["", "\0", "\0\0", "a", "b", "é", "x" * 7, "x" * 8, "x" * 9, "x" * 40]
    return [("".join(r.choice(parts) for _ in range(r.randint(0, 3))).encode(), r.randint(1, 2), i) for i in range(700)] + [(b"x" * 40, 1, 1000 + i) for i in range(300)]


@pytest.mark.parametrize("buckets", [1, 40])
def test_equal_suffixes_across_boundaries(spark, buckets):
    rows = some_suffixes(random.Random(4))
    spark.conf.set("spark.sql.shuffle.partitions", str(buckets))
    try:
        got = sorted(x.lo for x in repeats.equal_suffixes(spark.createDataFrame(rows, "suffix binary, level int, lo long").repartition(5), ["lo"], 0).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    count = Counter(x[:2] for x in rows)
    assert got == sorted(x[2] for x in rows if count[x[:2]] > 1)


@pytest.mark.parametrize("buckets", [1, 50])
def test_met_before_across_boundaries(spark, buckets):
    r = random.Random(2)
    rows = list({(r.choice([1, 1, 1, 2, r.randint(3, 300)]), r.choice([5, 5, r.randint(1, 30)]), r.randint(0, 30), 0, i) for i in range(900)})
    spark.conf.set("spark.sql.shuffle.partitions", str(buckets))
    try:
        met, open_ = repeats.met_before(spark.createDataFrame(rows, "key long, context long, doc_id long, tid long, pos long").repartition(5), 0)
        met, open_ = (sorted(x.pos for x in df.collect()) for df in (met, open_))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    least, contexts = {}, {}
    for k, c, d, _, _ in rows:
        least[k, c] = min(d, least.get((k, c), d))
        contexts.setdefault(k, set()).add(c)
    assert met == sorted(p for k, c, d, _, p in rows if d > least[k, c])
    assert open_ == sorted(p for k, c, d, _, p in rows if d == least[k, c] and len(contexts[k]) > 1)


@pytest.mark.parametrize("length", [48, 200, 201])
def test_other_lengths_equal_brute_force(spark, length):
    texts = some_texts()
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.summarize(spark.createDataFrame(rows, SCHEMA).repartition(3), length=length).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, length)


def test_short_windows_are_refused(spark):
    with pytest.raises(ValueError, match="48"):
        S.summarize(spark.createDataFrame([(1, "x")], "doc_id long, text string"), length=47)


def test_many_rows_and_a_long_text(spark):
    """More rows than one part of a batch holds, and a text of more than one piece."""
    r = random.Random(6)
    text = lambda n: " ".join(str(r.randint(0, 999_999)) for _ in range(n))
    passage, long = text(100), text(60_000)
    texts = [text(20) for _ in range(600)] + [text(9) + passage + text(9) for _ in range(3)] + [long + " " + passage, passage[5:500] + long[300_000:302_000]]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.summarize(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)
