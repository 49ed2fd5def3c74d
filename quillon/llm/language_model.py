"""Language-model scores: a log-bilinear model fitted with noise-contrastive estimation, beside unigram scores."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, materialize, record_batch, slices, texts_of

#: The end of a text as a token; no word holds a line feed.
END = "\n"
#: Tokens that every task holds counts of (broadcast): the most frequent ones. All others meet their counts in a join.
HEAD = 1 << 17
#: Symbols of the neural model: the end, the most frequent words (WORDS to MOST_WORDS, as many as the corpus calls for), and CLASSES
#: for all other words by their last bytes. The table of all pairs is broadcast, so the number has a bound.
WORDS, MOST_WORDS, CLASSES, LAST_BYTES = 767, 1791, 256, 3
DIMENSIONS, NOISE, STEPS, RATE = 24, 10.0, 120, 0.05
#: Weight of a Gaussian prior on the vectors' components, in pairs.
PRIOR = 10.0
#: Distinct tokens that a task counts before it passes them on.
MOST_COUNTED = 200_000


def tokens_of(text: bytes) -> list[bytes]:
    """Words of a text with A-Z in lower case."""
    return text.translate(ASCII_LOWER).split()


def class_of(token: bytes, words: int = WORDS) -> int:
    return 1 + words + zlib.crc32(token[-LAST_BYTES:]) % CLASSES


def words_for(distinct: int) -> int:
    """Words that the neural model tells apart, for a corpus of so many distinct tokens: four times their square root, as a power of two with the other symbols."""
    symbols = 1 << max(0, math.ceil(math.log2(4 * math.sqrt(max(1, distinct)))))
    return min(MOST_WORDS, max(WORDS, symbols - 1 - CLASSES))


def train(pairs: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Log10 probability of each symbol after each symbol, from counts of pairs (previous, next).

    Log-bilinear: the score of symbol j after i is c_i . r_j + b_j. Noise-contrastive estimation tells observed pairs
    from NOISE times as many whose second symbol comes from the unigram distribution; as the pairs are counted, the
    expectation over the noise is taken in full rather than sampled. Normalising takes one product of the two matrices
    and a sum for each row.
    """
    n = pairs.astype(np.float32)
    size = len(n)
    total = max(1.0, float(n.sum()))
    noise = (n.sum(0) + 0.5) / (n.sum() + 0.5 * size)
    draw = np.random.default_rng(7)
    weights = [draw.normal(0, 0.1, (size, DIMENSIONS)).astype(np.float32), draw.normal(0, 0.1, (size, DIMENSIONS)).astype(np.float32), np.log(noise).astype(np.float32)]
    n /= total
    expected = NOISE * n.sum(1, keepdims=True) * noise[None, :].astype(np.float32)
    shift = np.log(NOISE * noise).astype(np.float32)
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for t in range(1, steps + 1):
        c, r, b = weights
        g = 1 / (1 + np.exp(-np.clip(c @ r.T + (b - shift), -30, 30)))
        g = g * (n + expected) - n
        for k, grad in enumerate((g @ r, g.T @ c, g.sum(0))):
            grad = size * (grad + (PRIOR / total * weights[k] if k < 2 else 0))
            first[k] = 0.9 * first[k] + 0.1 * grad
            second[k] = 0.99 * second[k] + 0.01 * grad**2
            weights[k] -= RATE * (1 - t / (steps + 1)) * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-6)
    c, r, b = (w.astype(np.float64) for w in weights)
    out = np.empty((size, size))
    for i in range(0, size, 256):
        s = c[i : i + 256] @ r.T + b
        s -= s.max(1, keepdims=True)
        out[i : i + 256] = (s - np.log(np.exp(s).sum(1, keepdims=True))) / np.log(10)
    return out


class Vocabulary:
    """What tasks know of the tokens: HEAD counts, symbols, and totals of the classes (all of bounded size)."""

    def __init__(self, head: list[tuple[str, int]], classes: dict[int, tuple[int, int]], end: int, words: int = WORDS):
        self.words, self.symbols = words, 1 + words + CLASSES
        known = [(w.encode(), c) for w, c in head]
        self.index = {w: i + 1 for i, (w, _) in enumerate(known)}
        self.log_count = np.log10(np.array([end, *[c for _, c in known]], float) + 0.5)
        self.symbol = np.array([0, *[i + 1 if i < words else class_of(w, words) for i, (w, _) in enumerate(known)]], np.int64)
        total = np.zeros((self.symbols, 2))
        for k, pair in classes.items():
            total[k] = pair
        self.class_total = np.log10(total[:, 0] + 0.5 * (total[:, 1] + 1))
        self.end_known = end > 0

    def look_up(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Index in the head of each word and of the end (-1: not there), and their symbols."""
        at = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        at = np.append(at, 0)
        symbols = self.symbol[at]
        for i in np.flatnonzero(at < 0):
            symbols[i] = class_of(words[i], self.words)
        return at, symbols


def token_counts(training: DataFrame) -> DataFrame:
    """Rows (token, c) over all texts of `training`, the end token included; tasks count before the shuffle."""

    def run(batches):
        counted: Counter = Counter()
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(list(counted), pa.binary()).cast(pa.string()), pa.array(list(counted.values()), pa.int64())], ["token", "c"])
        for batch in batches:
            for text in texts_of(batch.column(0)):
                counted.update(tokens_of(text))
                counted[END.encode()] += 1
                if len(counted) > MOST_COUNTED:
                    yield flush()
                    counted.clear()
        if counted:
            yield flush()

    return training.select("text").mapInArrow(run, "token string, c long").groupBy("token").agg(F.sum("c").alias("c"))


def pair_counts(training: DataFrame, shared) -> np.ndarray:
    """How often each symbol follows each, over all texts of `training`; an end comes before every text."""
    schema = pa.schema([("pair", pa.int64()), ("n", pa.int64())])

    def run(batches):
        vocabulary = shared.value
        found = np.zeros(vocabulary.symbols**2, np.int64)
        for batch in slices(batches):
            codes = []
            for text in texts_of(batch.column(0)):
                _, symbols = vocabulary.look_up(tokens_of(text))
                codes.append(np.r_[0, symbols[:-1]] * vocabulary.symbols + symbols)
            if codes:
                pairs, n = np.unique(np.concatenate(codes), return_counts=True)
                found[pairs] += n
        at = np.flatnonzero(found)
        yield record_batch(schema, at, found[at])

    summed = training.select("text").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    size = shared.value.symbols
    out = np.zeros(size * size)
    out[summed.column("pair").to_numpy()] = summed.column("n").to_numpy()
    return out.reshape(size, size)


def _most_frequent(counts: DataFrame, size: int) -> list[tuple[str, int]]:
    """The `size` tokens of the highest counts, equal ones by text; only they come to the driver.

    A histogram over powers of two shows from which count on there are enough; the top is picked among those.
    """
    power = F.floor(F.log2("c")).cast("int")
    held, least = 0, 0
    for r in sorted(counts.groupBy(power.alias("p")).agg(F.count("*").alias("n")).collect(), reverse=True):
        held, least = held + r.n, r.p
        if held >= size:
            break
    top = materialize(counts.where(power >= least).orderBy(F.desc("c"), "token").limit(size))
    return sorted((tuple(r) for r in top.collect()), key=lambda r: (-r[1], r[0].encode()))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", head_size: int = HEAD, words: int | None = None) -> DataFrame:
    """Rows (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one for each row of `docs`.

    Counts and the model come from rows whose crc32(id as text) mod 5 is not 1 (null id: of an empty text), all of
    them. base_score sums log10((c + 0.5) / (N + 0.5 (V + 1))). score sums the model's log10 probability of each
    token's symbol after the one before; the symbols are the most frequent words, more of them the more distinct tokens
    there are (`words_for`). A word outside the model's vocabulary is its class and then the word within
    it, by smoothed counts, so the probabilities of all words sum to one. Words beyond the HEAD tokens are joined with
    their counts; only these travel. Null and empty texts are an end alone. Repeated rows are scored each; they count
    each in training. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    held = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 1
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), held.alias("held_out"))
    training = rows.where("not held_out")
    counts = materialize(token_counts(training))
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("token") == END, F.col("c"))), F.lit(0))).first()
    n, v, ends = (int(x) for x in totals)
    words = words_for(v) if words is None else words
    head = _most_frequent(counts.where(F.col("token") != END), head_size)
    top = counts.where(F.col("token") != END)
    if len(head) > words:
        w, c = head[words - 1]
        top = top.where((F.col("c") < c) | ((F.col("c") == c) & (F.col("token") > w)))
    else:
        top = top.where("false")
    ending = F.expr(f"substring(cast(token as binary), -{LAST_BYTES})")
    ending = F.when(F.octet_length("token") < LAST_BYTES, F.col("token").cast("binary")).otherwise(ending)
    by_class = {int(r.k): (int(r.c), int(r.v)) for r in top.groupBy((F.crc32(ending) % CLASSES + 1 + words).alias("k")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()}
    shared = spark.sparkContext.broadcast(Vocabulary(head, by_class, ends, words))
    table = spark.sparkContext.broadcast(train(pair_counts(training, shared)).astype(np.float32))
    schema = pa.schema([("row", pa.int64()), ("doc_id", docs_type(rows)), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_head", pa.int64()), ("base", pa.float64()), ("model", pa.float64()), ("tail", pa.list_(pa.struct([("token", pa.string()), ("tf", pa.int32())])))])

    def run(batches):
        from pyspark import TaskContext

        vocabulary, log_table, number = shared.value, table.value, TaskContext.get().partitionId() << 40
        for part in slices(batches):
            out = []
            for text in texts_of(part.column(1)):
                said = tokens_of(text)
                at, symbols = vocabulary.look_up(said)
                inside = at[at >= 0]
                logs = vocabulary.log_count[inside]
                model = float(log_table[np.r_[0, symbols[:-1]], symbols].sum(dtype=np.float64))
                rare = symbols > vocabulary.words
                model += float(logs[rare[at >= 0]].sum() - vocabulary.class_total[symbols[rare]].sum())
                tail = Counter(said[i] for i in np.flatnonzero(at < 0))
                out.append((number, len(at), len(inside) - (not vocabulary.end_known), float(logs.sum()), model, [{"token": w.decode(), "tf": k} for w, k in tail.items()]))
                number += 1
            row, n_tokens, n_head, base, model, tail = zip(*out, strict=True)
            yield record_batch(schema, row, part.column(0), part.column(2), n_tokens, n_head, base, model, tail)

    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = materialize(rows.mapInArrow(run, f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_head long, base double, model double, tail array<struct<token: string, tf: int>>"))
    tails = scored.select("row", F.explode("tail").alias("x")).select("row", F.col("x.token").alias("token"), F.col("x.tf").alias("tf"))
    met = tails.join(counts, "token", "left")
    summed = met.groupBy("row").agg(F.sum(F.col("tf") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("logs"), F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("known"))
    all_ = scored.drop("tail").join(summed, "row", "left")
    logs = F.coalesce("logs", F.lit(0.0))
    smoothed = float(np.log10(n + 0.5 * (v + 1)))
    return all_.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_head") + F.coalesce("known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + logs - F.col("n_tokens") * F.lit(smoothed)).alias("base_score"),
        (F.col("model") + logs).alias("score"),
    )


def docs_type(rows: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(rows.schema["doc_id"].dataType)


def op5_language_model(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
