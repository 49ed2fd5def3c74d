import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from quillon.llm import language_model as L

SCHEMA = "doc_id long, text string, score int"


def tokens(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*lower.encode().split(), b"\n"]


@pytest.mark.parametrize("head", [L.HEAD, 5])
def test_base_equals_brute_force_and_rows_survive(spark, head):
    r = random.Random(3)
    words = ["The", "the", "of", "É", "é", "a\x0b", "x" * 300, *[f"w{i}" for i in range(40)]]
    rows = [(i, " ".join(r.choices(words, k=r.randint(0, 30))), i) for i in range(60)] + [(None, "the x", 0), (61, None, 0), (7, "only here", 0), (7, "only here", 0)]
    got = L.score(spark.createDataFrame(rows, SCHEMA).repartition(3), head_size=head, words=min(L.WORDS, head - 2)).collect()
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 5 == 1
    c = Counter(t for i, x, _ in rows if not held(i) for t in tokens(x))
    n, v = sum(c.values()), len(c)
    want = sorted((-1 if i is None else i, held(i), len(tokens(x)), sum(c[t] > 0 for t in tokens(x)), n, round(sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens(x)), 6)) for i, x, _ in rows)
    assert sorted((-1 if g.doc_id is None else g.doc_id, g.held_out, g.n_tokens, g.n_known, g.train_tokens, round(g.base_score, 6)) for g in got) == want
    assert all(g.score < 0 and math.isfinite(g.score) for g in got)


def test_model_beats_unigrams_on_held_out_text(spark):
    r = random.Random(1)
    langs = [[f"{p}{i}" for i in range(150)] for p in ("a", "b", "c")]
    rows = [(i, " ".join(r.choices(langs[i % 3], k=60)), 0) for i in range(600)]
    got = [g for g in L.score(spark.createDataFrame(rows, SCHEMA)).collect() if g.held_out]
    assert sum(g.score for g in got) > sum(g.base_score for g in got) + 0.2 * sum(g.n_tokens for g in got)


def test_probabilities_sum_to_one():
    pairs = np.random.default_rng(0).integers(0, 50, (30, 30))
    p = L.train(pairs, 400)
    assert np.allclose((10**p).sum(1), 1)
    want = pairs / pairs.sum(1, keepdims=True)
    assert np.abs(10**p - want).mean() < 0.01


def test_the_vocabulary_grows_with_the_corpus():
    sizes = [L.words_for(10**k) for k in range(9)]
    assert sizes == sorted(sizes) and sizes[0] == L.WORDS and sizes[-1] == L.MOST_WORDS and L.words_for(100_000) > L.words_for(10_000)


def test_empty_table(spark):
    assert L.score(spark.createDataFrame([], SCHEMA)).count() == 0


def test_score_equals_a_plain_version_of_the_model(spark, monkeypatch):
    """The same table of log-probabilities, read token by token."""
    tables = []
    train = L.train
    monkeypatch.setattr(L, "train", lambda pairs, **kw: tables.append((pairs.copy(), train(pairs, **kw))) or tables[-1][1])
    r = random.Random(8)
    words = ["the", "of", "and", "É", *[f"w{i}" for i in range(30)]]
    rows = [(i, " ".join(r.choices(words, k=r.randint(0, 40))), i) for i in range(80)] + [(500, "unseen the xyz " * 5000, 0)]
    got = L.score(spark.createDataFrame(rows, SCHEMA).repartition(3), head_size=12, words=6).collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    train_texts = [tokens(x) for i, x, _ in rows if not held(i)]
    c = Counter(t for x in train_texts for t in x)
    top = sorted((t for t in c if t != b"\n"), key=lambda t: (-c[t], t))[:6]
    symbol = {b"\n": 0} | {t: k + 1 for k, t in enumerate(top)}
    of = lambda t: symbol.get(t, L.class_of(t, 6))
    size = 1 + 6 + L.CLASSES
    pairs = np.zeros((size, size))
    for x in train_texts:
        for a, b in zip([b"\n", *x], x, strict=False):
            pairs[of(a), of(b)] += 1
    assert (tables[0][0] == pairs).all()
    table = tables[0][1]
    total = Counter()
    distinct = Counter()
    for t in c:
        if of(t) > 6:
            total[of(t)] += c[t]
            distinct[of(t)] += 1
    for g in got:
        x = tokens(next(text for i, text, _ in rows if i == g.doc_id))
        want = 0.0
        for a, b in zip([b"\n", *x], x, strict=False):
            want += table[of(a), of(b)]
            if of(b) > 6:
                want += math.log10((c[b] + 0.5) / (total[of(b)] + 0.5 * (distinct[of(b)] + 1)))
        assert math.isclose(g.score, want, rel_tol=1e-4, abs_tol=1e-3)
