import random
import re
from collections import Counter

from quillon.llm import quality as Q

SCHEMA = "doc_id long, text string, kept string"
FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def brute(text):
    text = text or ""
    words = [w for w in re.split(r"[ \t-\r]+", text) if w]
    lines = [x for x in text.split("\n") if re.search(r"[^ \t-\r]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered |= set(range(i, i + 8))
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def texts():
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdeéü") for _ in range(r.randint(3, 7)))
    good = [" ".join(word() for _ in range(r.randint(25, 200))) for _ in range(60)]
    bad = [" ".join(word() + "%%%" for _ in range(60)) for _ in range(4)] + [" | ".join(word() for _ in range(60)) for _ in range(4)] + [" ".join(word().upper() + "!!" for _ in range(60)) for _ in range(4)]
    line = " ".join(word() for _ in range(9))
    odd = [None, "", " \n\t ", "a b c d e f g h", "a b c d e f g h " * 2, "a " * 17, "a " * 9, "a " * 8, (line + "\n") * 30, f"{line}\n \n \n{line}\n\n{line}x", "x\x0by\x0cz\rw\x1cv u t", "é" * 500, "w " * 20_000]
    return good, bad, odd


def test_counts_equal_brute_force(spark):
    good, bad, odd = texts()
    rows = [(i, t, "x") for i, t in enumerate([*good, *bad, *odd])] + [(None, "a b", None), (0, "other text", None)]
    got = Q.judge(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    key = lambda x: (-1 if x[0] is None else x[0], *x[1:])
    assert sorted(((r.doc_id, *(r[f] for f in FIELDS)) for r in got), key=key) == sorted(((i, *brute(t)) for i, t, _ in rows), key=key)
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.kept and r.base_failed)
        assert r.kept == (not r.base_failed and r.posterior >= 0.5)


def test_good_text_stays_and_junk_goes(spark):
    good, bad, _ = texts()
    rows = [(i, t, "x") for i, t in enumerate([*good, *bad])]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = Q.keep_good(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(range(len(good)))


def test_no_python_on_the_main_path(spark):
    docs = spark.createDataFrame([(1, "a b", "x")], SCHEMA)
    plan = Q.metrics(docs).withColumns(Q.votes())._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_estimation_is_plain_em_and_empty_is_fine(spark):
    prior, rates = Q.estimate([((1, 1, 0), 900), ((-1, 1, 1), 50), ((-1, -1, 0), 50)], 3)
    assert 0.5 < prior < 1 and all(0 < x < 1 for r in rates for x in r)
    assert Q.posterior(prior, rates, (1, 1, 0)) > 0.9 > 0.1 > Q.posterior(prior, rates, (-1, -1, 0))
    assert Q.judge(spark.createDataFrame([], SCHEMA)).count() == 0
    assert Q.keep_good(spark.createDataFrame([], SCHEMA)).count() == 0
