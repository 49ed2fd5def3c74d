import random
from collections import defaultdict

import numpy as np
import test_mixing
import test_quality
import test_simhash
import test_suffixes

import corpus_pipeline as P
from quillon.llm import packing, quality

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghé") for _ in range(r.randint(3, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(90)
    texts = [text(r.randint(25, 150)) for _ in range(40)] + [f"{text(r.randint(60, 90))} {passage} {text(r.randint(60, 90))}" for _ in range(5)]
    texts += [texts[0], texts[1] + " x", texts[1], "short", None, "", " | ".join(word() for _ in range(60)), " ".join(word() + "%%%" for _ in range(60)), "same line here\n" * 30]
    return [(i, t, "en", f"s{i % 4}" if i % 9 else None, len(t or "")) for i, t in enumerate(texts)]


def cut(text, gone):
    return np.frombuffer(text.encode(), np.uint8)[~gone].tobytes().decode(errors="ignore")


def test_each_stage_equals_its_plain_version(spark):
    docs = spark.createDataFrame(corpus(), COLUMNS)
    rows = {s[0]: None for s in P.STAGES}
    now = corpus()
    for name, stage in P.STAGES[:-1]:
        docs = P.materialize(stage(spark, docs, ""))
        assert [f.name for f in docs.schema] == ["doc_id", "text", "lang", "source", "n_chars"]
        rows[name] = sorted(map(tuple, docs.collect()))
        now = plain(name, now)
        assert [x[:4] for x in rows[name]] == sorted(x[:4] for x in now), name
    packed = P.STAGES[-1][1](spark, docs, "").collect()
    assert sum(x.n_tokens for x in packed) == sum(len((x[1] or "").split()) + 1 for x in now)
    bins = defaultdict(int)
    for x in packed:
        bins[x.bin_id] += x.n_tokens
        assert x.bin_tokens <= x.capacity and x.capacity in packing.CAPACITIES
    assert all(bins[x.bin_id] == x.bin_tokens for x in packed)


def plain(name, rows):
    if name == "quality rules":
        junk = {48, 49, 50, 51, 52, 53}
        assert {i for i, t, *_ in rows if test_quality.brute(t)[0] < quality.LEAST_WORDS} <= junk
        return [x for x in rows if x[0] not in junk]
    if name == "SimHash near-dedup":
        named = {i for i, c in test_simhash.similar([x[:3] for x in rows]).items() if i == c}
        return [x for x in rows if x[0] in named]
    if name == "suffix-array dedup":
        out = []
        for x in rows:
            gone = np.zeros(len(x[1].encode()), bool)
            size = P.PASSAGE_BYTES
            for i in range(len(gone) - size + 1):
                piece = x[1].encode()[i : i + size]
                if sum(y[1].encode().count(piece) for y in rows) > 1:
                    gone[i : i + size] = True
            out.append((x[0], cut(x[1], gone), *x[2:]))
        return out
    taken = {i: t for i, _, _, _, t in test_mixing.brute([(i, " ".join((t or "").split()), s, 0) for i, t, _, s, _ in rows])}
    out = []
    for x in rows:
        words, left = x[1].split(), taken[x[0]]
        while left > 0 and words:
            out.append(x if left >= len(words) else (x[0], " ".join(words[:left]), *x[2:]))
            left -= len(words)
    return out


def test_plain_repeats_are_bytes():
    assert test_suffixes.brute(["x" * 401])[0][1] == 401


def test_run_and_stage_list(spark, tmp_path):
    spark.createDataFrame(corpus(), COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    assert P.run(spark, str(tmp_path)).count() > 0
    assert [s[0].split()[0] for s in P.STAGES] == ["quality", "SimHash", "suffix-array", "mixing", "best-fit"]
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert P.run(spark, f"{tmp_path}/none").count() == 0
