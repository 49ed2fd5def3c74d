"""Quality rules as weak supervision, in DataFrame functions alone: votes, expectation-maximisation, posterior."""

from __future__ import annotations

from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, let, materialize, words_of

WINDOW = 8
LEAST_WORDS, MOST_REPEATED_PERCENT = 20, 30
LEAST_POSTERIOR = 0.5
STEPS = 60
#: A rule is expected to be right on this share of good rows and of bad rows (junk has kinds; a rule sees a few).
EXPECTED = (0.995, 0.25)
#: Rows, as a share of the input, that this expectation counts for beside the data.
PRIOR_ROWS = (0.5, 0.1)


def _covered_words(hashes: Column) -> Column:
    """Words that lie in a window whose hash occurs twice or more in `hashes` (one per window start)."""

    def starts(s: Column) -> Column:
        same = lambda k, x: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
        return F.filter(F.transform(s, lambda x, k: F.when(same(k - 1, x) | same(k + 1, x), x["i"]).otherwise(-1)), lambda i: i >= 0)

    def total(p: Column) -> Column:
        nothing = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        step = lambda a, i: F.struct((a["n"] + WINDOW - F.greatest(F.lit(0), a["end"] - i)).alias("n"), (i + WINDOW).alias("end"))
        return F.aggregate(p, nothing, step, lambda a: a["n"])

    ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return let(ordered, lambda s: let(F.array_sort(starts(s)), total))


def _repeats(word_hashes: Column) -> Column:
    windows = F.transform(F.sequence(F.lit(1), F.size(word_hashes) - WINDOW + 1), lambda i: F.xxhash64(F.slice(word_hashes, i, WINDOW)))
    found = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), _covered_words(h)).otherwise(0))
    return F.when(F.size(word_hashes) > WINDOW, found).otherwise(0)


def metrics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of counts for each row of `docs`; null text counts as empty."""
    text, words, lines = F.coalesce(F.col(text_col), F.lit("")), F.col("_w"), F.col("_l")
    less = lambda pattern: (F.length("_t") - F.length(F.regexp_replace("_t", pattern, ""))).cast("long")
    split = docs.select(F.col(id_col).alias("doc_id"), text.alias("_t"), words_of(F.col(text_col)).alias("_w"), F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE_CLASS[1:]}")).alias("_l"))
    by_hash = let(
        F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.struct(F.size(F.array_distinct(h)).cast("long").alias("distinct"), _repeats(h).cast("long").alias("repeated"))
    )
    out = split.select(
        "doc_id",
        F.size(words).cast("long").alias("n_words"),
        F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
        less("[#*$%&|<>]").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        by_hash.alias("_h"),
        F.size(lines).cast("long").alias("n_lines"),
        less("[A-Z]").alias("n_upper"),
        less("!").alias("n_bangs"),
        less(r"[\p{L}\p{N}]+").alias("n_alnum"),
    )
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.col("_h.repeated").alias("n_repeat_words"), F.col("_h.distinct").alias("n_distinct"), "n_lines", "n_upper", "n_bangs", "n_alnum")


def _vote(value: Column, good: Column, bad: Column) -> Column:
    return F.when(value.isNull(), 0).when(bad, -1).when(good, 1).otherwise(0)


def _ratio(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b))


def votes() -> dict[str, Column]:
    """Each rule says good (1), bad (-1) or nothing (0) about a row of `metrics`."""
    symbols, bangs, upper = _ratio("n_symbols", "n_words"), _ratio("n_bangs", "n_words"), _ratio("n_upper", "n_alnum")
    letters, mean, lines = _ratio("n_alnum", "word_chars"), _ratio("word_chars", "n_words"), _ratio("n_dup_lines", "n_lines")
    repeated, distinct = _ratio("n_repeat_words", "n_words"), _ratio("n_distinct", "n_words")
    varied = F.when(F.col("n_words") >= 50, distinct)
    return {
        "length": _vote(F.col("n_words"), F.col("n_words") >= 40, F.col("n_words") < LEAST_WORDS),
        "symbols": _vote(symbols, symbols <= 0.02, symbols > 0.2),
        "bangs": _vote(bangs, bangs <= 0.05, bangs > 0.3),
        "upper": _vote(upper, upper <= 0.2, upper > 0.5),
        "letters": _vote(letters, letters >= 0.95, letters < 0.92),
        "word_length": _vote(mean, mean.between(3.5, 7.0), (mean < 2.5) | (mean > 12)),
        "lines": _vote(lines, lines == 0, lines > 0.3),
        "repeats": _vote(repeated, repeated <= 0.1, repeated > MOST_REPEATED_PERCENT / 100),
        "variety": _vote(varied, varied >= 0.5, varied < 0.25),
    }


def estimate(patterns: list[tuple[tuple[int, ...], int]], n_rules: int, steps: int = STEPS) -> tuple[float, list[tuple[float, float]]]:
    """Share of good rows and each rule's accuracy on good and on bad rows, from counts of vote patterns.

    Two-class Dawid-Skene model with Beta priors (EXPECTED, PRIOR_ROWS); an abstention says nothing. Without the
    priors, rules that see one kind of junk agree so well with each other that the bad class shrinks to that kind. `patterns` has at most 3 ** n_rules entries however
    many rows there are, so this part of the work is bounded.
    """
    rows = sum(n for _, n in patterns) or 1
    prior, rates = 0.9, [EXPECTED] * n_rules
    strength = tuple(w * rows for w in PRIOR_ROWS)
    for _ in range(steps):
        good, seen = strength[0] * 0.9, [list(strength) for _ in rates]
        right = [[w * x for w, x in zip(strength, EXPECTED, strict=True)] for _ in rates]
        for pattern, n in patterns:
            p = posterior(prior, rates, pattern)
            good += n * p
            for j, v in enumerate(pattern):
                if v:
                    for k, share in enumerate((n * p, n * (1 - p))):
                        seen[j][k] += share
                        right[j][k] += share * ((v > 0) == (k == 0))
        prior = good / (rows + strength[0])
        rates = [(r[0] / x[0], r[1] / x[1]) for r, x in zip(right, seen, strict=True)]
    return prior, rates


def posterior(prior: float, rates: list[tuple[float, float]], pattern: tuple[int, ...]) -> float:
    odds = log(prior / (1 - prior)) + sum(_evidence(r, v) for r, v in zip(rates, pattern, strict=True))
    return 1 / (1 + exp(-max(-700.0, min(700.0, odds))))


def _evidence(rate: tuple[float, float], vote: int) -> float:
    good, bad = (min(1 - 1e-6, max(1e-6, x)) for x in rate)
    return log(good / (1 - bad)) if vote > 0 else log((1 - good) / bad) if vote < 0 else 0.0


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `metrics` with base_failed, the posterior probability of good quality, and kept.

    base_failed: under 20 words, or over 30 % of the words in repeated 8-word windows. kept: not base_failed and a
    posterior of 0.5 or more. Null or empty text has no words and fails the base. Rows with equal ids are judged
    each on its own text. An empty table gives an empty table.
    """
    rules = votes()
    counted = materialize(metrics(docs, id_col, text_col).withColumns({f"vote_{k}": v for k, v in rules.items()}))
    names = [f"vote_{k}" for k in rules]
    patterns = [(tuple(r[n] for n in names), r["n"]) for r in counted.groupBy(*names).agg(F.count("*").alias("n")).collect()]
    prior, rates = estimate(sorted(patterns), len(names))
    odds = F.lit(log(prior / (1 - prior)))
    for name, rate in zip(names, rates, strict=True):
        odds = odds + F.when(F.col(name) > 0, _evidence(rate, 1)).when(F.col(name) < 0, _evidence(rate, -1)).otherwise(0.0)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    scored = counted.withColumn("base_failed", failed).withColumn("posterior", 1 / (1 + F.exp(-odds)))
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= LEAST_POSTERIOR))


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without the rows that `judge` rejects. Rows are written once beside their counts, so nothing is shuffled or joined back."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).alias("text"))
    return judge(whole, "row", "text").where("kept").select(*[F.col("doc_id").getField(c).alias(c) for c in docs.columns])


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    found = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")
