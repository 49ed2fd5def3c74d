import random

import numpy as np
import pytest
import xxhash

from quillon.llm import simhash as S
from quillon.llm.components import connected_components

SCHEMA = "doc_id long, text string, fp string"


def plain(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def classes(rows):
    prints = [plain(t) for _, t, _ in rows]
    group = list(range(len(rows)))
    find = lambda i: i if group[i] == i else find(group[i])
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                group[find(i)] = find(j)
    least = {}
    for i, (d, _, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, p - (1 << 64) if p >> 63 else p, least.get(find(i))) for i, ((d, _, _), p) in enumerate(zip(rows, prints, strict=True))]


def test_classes_equal_brute_force(spark):
    r = random.Random(4)
    words = ["The", "the", "É", "x", *[f"w{i}" for i in range(60)]]
    base = [" ".join(r.choices(words, k=300)) for _ in range(6)]
    texts = [" ".join(r.choices(words, k=r.randint(0, 40))) for _ in range(40)]
    for b in base:
        for _ in range(12):
            parts = b.split()
            for _ in range(r.randint(0, 2)):
                parts[r.randrange(300)] = r.choice(words)
            texts.append("\n ".join(parts))
    texts += [None, "", " \t", "a", "A", "a b", "a b c", "y " * 5000]
    r.shuffle(texts)
    rows = [(i, t, "z") for i, t in enumerate(texts)] + [(None, base[0], None), (3, texts[5], None), (3, texts[5], None)]
    got = [tuple(x) for x in S.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()]
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(got, key=key) == sorted(classes(rows), key=key)


@pytest.mark.parametrize("joined", [S.JOINED, 3, 0])
def test_links_are_exactly_those_within_two_bits(spark, monkeypatch, joined):
    """Whether blocks are joined or, having too many members, refined."""
    monkeypatch.setattr(S, "JOINED", joined)
    r = random.Random(9)
    prints = set()
    for _ in range(12):
        x = r.getrandbits(64)
        prints |= {x ^ sum(1 << b for b in set(r.choices(range(64), k=r.randint(0, 5)))) for _ in range(25)}
    prints = [p - (1 << 64) if p >> 63 else p for p in prints]
    edges = S.linked_fingerprints(spark.createDataFrame([(p,) for p in prints], "fp long"))
    got = {(r.node): r.root for r in connected_components(edges).collect()}
    group = {p: p for p in prints}
    for _ in prints:
        for a in prints:
            for b in prints:
                if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2:
                    group[a] = group[b] = min(group[a], group[b])
        if all(group[p] == got.get(p, p) for p in prints):
            break
    assert group == {p: got.get(p, p) for p in prints}


def similar(rows):
    """Smallest id of each group linked by a five-word Jaccard similarity of 0.8, by brute force; pairs near 0.8 are left out of the fixture."""
    grams = []
    for _, t, _ in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()
        grams.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)})
    group = list(range(len(rows)))
    find = lambda i: i if group[i] == i else find(group[i])
    for i in range(len(rows)):
        for j in range(i):
            s = len(grams[i] & grams[j]) / len(grams[i] | grams[j])
            assert not 0.68 < s < 0.82
            if s >= 0.8:
                group[find(i)] = find(j)
    out = {}
    for i, (d, _, _) in enumerate(rows):
        out[find(i)] = min(d, out.get(find(i), d))
    return {d: out[find(i)] for i, (d, _, _) in enumerate(rows)}


@pytest.mark.parametrize("cell", [S.CELL_MEMBERS, 3])
def test_similar_groups_equal_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(S, "CELL_MEMBERS", cell)
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    vocabulary = [word() for _ in range(3000)]
    texts = [" ".join(r.choices(vocabulary, k=r.randint(150, 400))) for _ in range(40)]
    for t in texts[:6]:
        for _ in range(8):
            w = t.split()
            for at in r.sample(range(len(w)), k=max(1, len(w) // 150)):
                w[at] = r.choice(vocabulary)
            texts.append(" ".join(w))
        texts.append(t.upper())
        half = t.split()
        texts.append(" ".join(half[: len(half) // 2] + r.choices(vocabulary, k=len(half) // 2)))
    texts += [None, "", " \n", "one two", "ONE two", "three"]
    r.shuffle(texts)
    rows = [(i, t, "z") for i, t in enumerate(texts)]
    want = similar(rows)
    got = {d: d for d in want} | {x.doc_id: x.component_id for x in S.similar_groups(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert got == want


def test_deduplicate_keeps_one_of_each_class(spark):
    text = " ".join(f"w{i}" for i in range(80))
    near = text + " more"
    rows = [(4, text, "a"), (2, near, "b"), (2, near, "c"), (9, "other words here now", "d"), (None, text, "e"), (7, None, "f"), (8, "", "g")]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = S.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 2, 7, 9]


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)], [(1, 1)], []])
def test_components(spark, edges):
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {n: min(nodes) for n in nodes}


def test_empty_table(spark):
    assert S.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    assert S.deduplicate(spark.createDataFrame([], SCHEMA)).count() == 0


def linked_pairs(spark, pairs):
    """For each pair of texts, whether both come out in one group."""
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(t for p in pairs for t in p)], SCHEMA)
    got = {x.doc_id: x.component_id for x in S.similar_groups(docs).collect()}
    return [got.get(2 * k + 1) == 2 * k for k in range(len(pairs))]


def test_links_start_at_exactly_four_fifths(spark):
    r = random.Random(5)
    pairs = []
    # of 270 shingles each: 240 of 300 are 0.8, 239 of 301 0.794, 233 of 307 0.759
    for common in [240, 239, 238, 233] * 8:
        a = [f"v{r.randrange(5000)}" for _ in range(274)]
        pairs.append((" ".join(a), " ".join([*a[: common + 4], *r.choices(a, k=270 - common)])))
    assert linked_pairs(spark, pairs) == [True, False, False, False] * 8


def test_long_texts_of_few_words_link_with_fresh_words(spark):
    r = random.Random(8)
    pairs = []
    for k in range(40):
        a = [f"w{k}_{r.randrange(400)}" for _ in range(4000)]
        b = list(a)
        for at in r.sample(range(4000), k=80):
            b[at] = f"id{r.random()}"
        grams = [{tuple(w[i : i + 5]) for i in range(3996)} for w in (a, b)]
        assert len(grams[0] & grams[1]) >= 0.8 * len(grams[0] | grams[1])
        pairs.append((" ".join(a), " ".join(b)))
    assert linked_pairs(spark, pairs) == [True] * 40


@pytest.mark.parametrize("common", [[], list(range(0, 400, 3))])
def test_prefixes_of_similar_sets_meet(common):
    r = np.random.default_rng(3)
    order, rank = np.array(sorted(common), np.int64), r.permutation(len(common))
    for n in [1, 4, 5, 6, 9, 10, 11, 49, 100]:
        for _ in range(200):
            a = r.choice(400, n, replace=False)
            b = np.r_[a[r.permutation(n)[: n - r.integers(0, n // 5 + 1)]], 400 + np.arange(r.integers(0, n // 5 + 1))]
            shared = len(np.intersect1d(a, b))
            if shared >= 0.8 * (n + len(b) - shared):
                assert len(np.intersect1d(S.prefix(np.sort(a), order, rank), S.prefix(np.sort(b), order, rank)))


def test_other_texts_of_a_repeated_id_stay(spark):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(1, text, "a"), (2, text + " more", "b"), (2, "another text of the same id", "c"), (3, "x", "e"), (3, "x", "d"), (3, "y", "f")]
    kept = S.deduplicate(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted(map(tuple, kept)) == [(1, text, "a"), (2, "another text of the same id", "c"), (3, "x", "d"), (3, "y", "f")]
