import hashlib
import random

import numpy as np

from quillon.llm import substring as S

SCHEMA = "doc_id long, text string"


def brute(rows):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in words:
        if i is not None:
            for k in range(len(w) - 49):
                key = tuple(w[k : k + 50])
                first[key] = min(i, first.get(key, i))
    out = []
    for i, w in words:
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - 49):
            if i is not None and first[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = True
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((i, len(w), int(gone.sum()), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def test_cover_lets_any_two_positions_meet():
    for gap in range(S.PERIOD):
        assert any((c + gap) % S.PERIOD in S.COVER for c in S.COVER)


def test_summarize_equals_brute_force(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abé漢") for _ in range(r.randint(1, 5)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, fifty = text(90), text(50)
    texts = [text(r.randint(0, 200)) for _ in range(15)] + [f"{text(r.randint(0, 99))}\t{passage}\n{text(r.randint(0, 40))}" for _ in range(8)]
    texts += [fifty, fifty.replace(" ", " \x0b\n "), fifty + " x", "y " + fifty, " ".join(fifty.split()[:49]), passage + " " + passage, "a " * 300, "a " * 120, "a " * 90, None, "", " \t "]
    texts += [texts[16], texts[0]]
    rows = list(enumerate(texts))
    r.shuffle(rows)
    rows = [(None, passage), (None, passage), (3, passage), *rows, (16, texts[16])]
    got = S.summarize(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    order = lambda x: (-1 if x[0] is None else x[0], *x[1:])
    assert sorted(map(tuple, got), key=order) == sorted(brute(rows), key=order)


def test_words_that_weak_digests_mix_up(spark):
    """Thue-Morse words and their complements: equal under polynomial digests modulo 2^64."""
    bits = "".join(str(bin(i).count("1") % 2) for i in range(1024))
    a, b = (bits.translate(str.maketrans("01", x)) for x in ("ab", "ba"))
    shared = " ".join(f"w{i}" for i in range(49))
    runs = [" ".join(x if c == "0" else y for c in bits) for x, y in (("p", "q"), ("q", "p"))]
    rows = [(1, f"{a} {shared}"), (2, f"{b} {shared}"), (3, f"{shared} {a}"), (4, f"{shared} {b}"), (5, runs[0]), (6, runs[1]), (7, runs[0])]
    got = S.summarize(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows))


def test_many_rows_long_texts_and_shared_edges(spark, monkeypatch):
    """More than 256 rows and 256 KB, texts of several stretches, and passages met at every alignment with edits inside."""
    r = random.Random(9)
    text = lambda n: " ".join(str(r.randint(0, 999_999)) for _ in range(n))
    passage = text(160).split()
    texts = [text(r.randint(0, 60)) for _ in range(400)] + [text(70_000)]
    for i in range(40):
        words = passage[r.randint(0, 60) : 160 - r.randint(0, 60)]
        if i % 3 == 0:
            words[r.randint(0, len(words) - 1)] = "edit"
        texts.append(f"{text(i)} {' '.join(words)} {text(r.randint(0, 40))}")
    texts.append(" ".join(texts[400].split()[65_500:65_600]) + " " + text(5))
    rows = list(enumerate(texts))
    got = S.summarize(spark.createDataFrame(rows, SCHEMA).coalesce(2)).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows))


def test_texts_split_in_parts(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_BYTES", 100)
    text = " ".join(f"w{i}" for i in range(500))
    assert len(S.word_digests(f" {text}\n".encode())) == 500
    assert (S.word_digests(text.encode()) == S.word_digests(text.replace(" ", " \t ").encode())).all()


def test_remove_repeats_keeps_columns(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(1, passage, "a"), (2, "x  " + passage + " y", "b"), (3, None, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _starts string")
    got = {r.doc_id: (r.text, r._starts) for r in S.remove_repeats(docs).select("doc_id", "text", "_starts").collect()}
    assert got == {1: (passage, "a"), 2: ("x y", "b"), 3: (None, "c")}


def test_empty_table(spark):
    assert S.summarize(spark.createDataFrame([], SCHEMA)).count() == 0
