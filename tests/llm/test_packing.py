import random
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import packing as P




@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_packs_hold_and_use_the_tightest_bin(sizes):
    capacities = (8, 16, 32, 64)
    sizes = sorted(sizes, reverse=True)
    spots, bins = P.best_fit(sizes, capacities)
    used = defaultdict(list)
    for s, (b, o) in zip(sizes, spots, strict=True):
        used[b].append((o, s))
    assert len(used) == len(bins)
    for b, (length, tokens) in enumerate(bins):
        at = 0
        for o, s in sorted(used[b]):
            assert o == at
            at += s
        assert at == tokens <= length and not any(tokens <= c < length for c in capacities)
    slots = sum(length for length, _ in bins)
    assert slots <= 64 * max(1, -(-sum(sizes) * 3 // 128)) + 64


def test_every_token_lands_once(spark):
    r = random.Random(1)
    rows = [(i, " ".join("w" * r.randint(1, 3) for _ in range(r.choice([0, 3, 40, 700, 9000])))) for i in range(60)] + [(None, None), (None, ""), (5, "a b"), (5, "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = P.pack(docs).collect()
    assert sum(x.n_tokens for x in got) == sum(len((t or "").split()) + 1 for _, t in rows)
    bins = defaultdict(list)
    for x in got:
        bins[x.bin_id].append(x)
    for members in bins.values():
        members.sort(key=lambda x: x.bin_offset)
        at = 0
        for x in members:
            assert x.bin_offset == at and x.capacity in P.CAPACITIES
            at += x.n_tokens
        assert at == members[0].bin_tokens <= members[0].capacity
    starts = defaultdict(list)
    for x in got:
        starts[x.doc_id].append((x.piece, x.start, x.n_tokens))
    for i, t in rows[:60]:
        if i != 5:
            assert [s for _, s, _ in sorted(starts[i])] == list(range(0, len(t.split()) + 1, P.CAPACITIES[-1]))


def test_several_lengths_waste_less_than_one():
    r = random.Random(4)
    sizes = sorted((min(8192, max(1, int(r.lognormvariate(6, 1)))) for _ in range(3000)), reverse=True)
    waste = lambda caps: sum(length + P.BIN_COST for length, _ in P.best_fit(sizes, caps)[1]) / sum(sizes)
    assert waste(P.CAPACITIES) <= waste((8192,)) * 1.001 and waste(P.CAPACITIES) < 1.02


def test_empty_table(spark):
    assert P.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def plain_best_fit(sizes, capacities, cost):
    """Bins as lists, searched one after the other."""
    bins, spots = [], []
    for k, s in enumerate(sizes):
        fits = [b for b, (room, _, _) in enumerate(bins) if room >= s]
        if fits:
            tightest = min(bins[b][0] for b in fits)
            b = max((b for b in fits if bins[b][0] == tightest), key=lambda b: bins[b][2])
        else:
            need = max(s, 1)
            to_come = sizes[k + 1 :]
            price = {c: (c + cost) / (need + min(c - need, sum(x for x in to_come if x <= c - need))) for c in capacities if c >= need}
            bins.append([min(price, key=price.get), 0, 0])
            b = len(bins) - 1
        spots.append((b, bins[b][1]))
        bins[b][0] -= s
        bins[b][1] += s
        bins[b][2] = k
    return spots, [(min(c for c in capacities if c >= used), used) for _, used, _ in bins]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60), st.sampled_from([(64,), (16, 64), (8, 16, 32, 64)]), st.integers(0, 20))
def test_best_fit_equals_a_plain_version(sizes, capacities, cost):
    sizes = sorted(sizes, reverse=True)
    got = P.best_fit(sizes, capacities, cost)
    assert got == plain_best_fit(sizes, capacities, cost)
    assert sum(length for length, _ in got[1]) >= sum(sizes)


def test_equal_rows_spread_over_packs_and_names_may_clash(spark, monkeypatch):
    monkeypatch.setattr(P, "PACK_PIECES", 50)
    rows = [(7, "a b c", i, "x", 1) for i in range(400)]
    got = P.pack(spark.createDataFrame(rows, "doc_id long, text string, row long, h string, tokens int")).collect()
    assert sum(g.n_tokens for g in got) == 1600 and len({g.bin_id >> 40 for g in got}) > 3
