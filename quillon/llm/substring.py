"""Substring dedup on words: difference-cover anchors that long matches share, then extended to whole windows.

Positions p with p mod 31 in the perfect difference set {1, 5, 11, 24, 25, 27} are a cover: any two positions are both
covered after a common step below 31. So two equal windows of 50 words, wherever they start, share an anchor: a covered
position whose 20 words lie in both windows at the same place. An anchor's context is the 80 words that all windows over
it lie in (past an end of the text: a mark that is no word). Two steps extend what meets at an anchor:

1. If a document with a smaller id has the same anchor in the same context, all windows over it are repeated.
2. Of each context of an anchor that has several, the documents with the least id extend to the windows over it, and
   these are compared each. Of equal windows, the least document's never falls under step 1, and any other's either
   does or shares with it an anchor in another context, so both are compared here.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, record_batch, slices, texts_of
from .repeats import PLACE, met_before
from .rolling import FIRST, SECOND

WINDOW = 50
PERIOD = 31
COVER = (1, 5, 11, 24, 25, 27)
ANCHOR = WINDOW - PERIOD + 1
#: Words before an anchor, and behind it, that a window over it can reach.
REACH = WINDOW - ANCHOR
CONTEXT = REACH + ANCHOR + REACH
#: Words that are hashed together, about, and bytes of text that are split into words together.
BLOCK_WORDS, BLOCK_BYTES = 1 << 16, 1 << 22
#: Bytes of text for one anchor, about: tells how many ranges to deal anchors into.
ANCHOR_BYTES = 30
_COVERED = np.zeros(PERIOD, bool)
_COVERED[list(COVER)] = True
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_BEFORE, _BEHIND = np.zeros((REACH, 2), np.uint64), np.zeros((CONTEXT, 2), np.uint64)


def word_digests(text: bytes) -> np.ndarray:
    """Two 64-bit digests of each word, the halves of its XXH3-128; long texts are split in parts."""
    parts, at = [], 0
    while at < len(text):
        end = len(text)
        if end - at > BLOCK_BYTES and (cut := _SPACE.search(text, at + BLOCK_BYTES)):
            end = cut.end()
        parts.append(b"".join(map(xxhash.xxh3_128_digest, text[at:end].split())))
        at = end
    return np.frombuffer(b"".join(parts), np.uint64).reshape(-1, 2)


def stretches(texts: Iterable[tuple[int, bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Places in texts that hold a window, many together: text, position, words of the text, index into the digests, digests.

    At a place's index the digests hold the CONTEXT of an anchor there, and REACH later the words from the place on. Long
    texts come in several stretches, whose digests overlap.
    """
    held: list[tuple[int, int, int, int, np.ndarray]] = []
    size = 0

    def close():
        lengths = np.array([hi - lo for _, lo, hi, _, _ in held])
        heads = np.cumsum(lengths) - lengths
        step = np.arange(lengths.sum()) - np.repeat(heads, lengths)
        sections = np.array([len(x) for *_, x in held])
        begin = np.cumsum(sections) - sections
        column = lambda i: np.repeat(np.array([x[i] for x in held], np.int64), lengths)
        return column(0), column(1) + step, column(3), np.repeat(begin, lengths) + step, np.concatenate([x for *_, x in held])

    for i, text in texts:
        words = word_digests(text)
        n = len(words)
        if n < WINDOW:
            continue
        padded = np.concatenate([_BEFORE, words, _BEHIND])
        for lo in range(0, n, BLOCK_WORDS):
            hi = min(n, lo + BLOCK_WORDS)
            held.append((i, lo, hi, n, padded[lo : hi + CONTEXT]))
            size += hi - lo
            if size >= BLOCK_WORDS:
                yield close()
                held, size = [], 0
    if held:
        yield close()


def anchors(keyed: DataFrame) -> DataFrame:
    """Rows (key, context, doc_id, tid, pos): digests of the ANCHOR words from each covered position on, and of those around them."""
    schema = pa.schema([(n, pa.int64()) for n in ("key", "context", *PLACE)])

    def run(batches):
        for batch in batches:
            ids, tids = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for text, pos, n, at, digests in stretches(enumerate(texts_of(batch.column(2)))):
                use = np.flatnonzero(_COVERED[pos % PERIOD] & (pos + ANCHOR <= n))
                key = FIRST.runs(digests[:, 0], (ANCHOR,))[ANCHOR][at[use] + REACH]
                context = SECOND.runs(digests[:, 1], (CONTEXT,))[CONTEXT][at[use]]
                yield record_batch(schema, key.view(np.int64), context.view(np.int64), ids[text[use]], tids[text[use]], pos[use])

    return keyed.select("doc_id", "tid", "text").mapInArrow(run, ", ".join(f"`{f.name}` long" for f in schema))


def _over(marks: np.ndarray, n: int) -> np.ndarray:
    """Which windows of a text of `n` words hold one of the anchors at `marks`."""
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, np.maximum(0, marks - REACH), 1)
    np.add.at(change, marks + 1, -1)
    return np.cumsum(change)[: n - WINDOW + 1] > 0


def _windows(marked: DataFrame) -> DataFrame:
    """Both digests and the place of each window over an open anchor of its text (`marks`: 2 p, or 2 p + 1 if met before) and over none met before."""
    schema = pa.schema([(n, pa.int64()) for n in ("key", "context", *PLACE)])

    def run(batches):
        for batch in slices(batches):
            ids, tids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            found = [m.values.to_numpy(zero_copy_only=False) for m in batch.column(3)]
            use: dict[int, np.ndarray] = {}
            for text, pos, n, at, digests in stretches(enumerate(texts_of(batch.column(2)))):
                rows = []
                edges = np.flatnonzero(np.r_[True, text[1:] != text[:-1], True]).tolist()
                for lo, hi in zip(edges, edges[1:], strict=False):
                    i, size = int(text[lo]), int(n[lo])
                    if i not in use:
                        use = {i: _over(found[i][found[i] % 2 == 0] // 2, size) & ~_over(found[i][found[i] % 2 == 1] // 2, size)}
                    rows.append(lo + np.flatnonzero(use[i][pos[lo] : pos[lo] + hi - lo]))
                rows = np.concatenate(rows)
                if len(rows):
                    first, second = (h.runs(digests[:, k], (WINDOW,))[WINDOW][at[rows] + REACH].view(np.int64) for k, h in enumerate((FIRST, SECOND)))
                    yield record_batch(schema, first, second, *[np.array([x[i] for i in text[rows].tolist()], np.int64) for x in (ids, tids)], pos[rows])

    return marked.mapInArrow(run, ", ".join(f"`{f.name}` long" for f in schema))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, tid, marks): of each text, what windows that also start in a document with a smaller id cover.

    A mark 2 p is the window of the words from p on, 2 p + 1 all windows over the anchor at p. tid is xxhash64 of the text.
    Rows without an id take no part.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("tid"), text.alias("text"))
    n_bytes = int(keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    met, open_ = met_before(anchors(keyed), n_bytes // ANCHOR_BYTES)
    mark = lambda df, odd: df.select("doc_id", "tid", (2 * F.col("pos") + odd).alias("mark"))
    whole = mark(met, 1)
    by_text = whole.unionByName(mark(open_, 0)).groupBy("doc_id", "tid").agg(F.collect_set("mark").alias("marks"), F.min(F.col("mark") % 2).alias("least"))
    texts = keyed.join(by_text.where("least = 0"), ["doc_id", "tid"])
    starts, _ = met_before(_windows(texts.select("doc_id", "tid", "text", "marks")), n_bytes // ANCHOR_BYTES)
    return whole.unionByName(mark(starts, 0)).groupBy("doc_id", "tid").agg(F.collect_set("mark").alias("marks"))


def _joined(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    name, key, tid = (fresh(docs, c) for c in ("_marks", "_key", "_tid"))
    keyed = docs.withColumn(key, F.col(id_col).cast("long")).withColumn(tid, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    found = found.select(F.col("doc_id").alias(key), F.col("tid").alias(tid), F.col("marks").alias(name))
    return keyed.join(found, [key, tid], "left").select(*[F.col(f"`{c}`") for c in docs.columns], name), name


def _keep(words: list[bytes], marks: pa.ListScalar) -> list[bytes]:
    if not marks.is_valid:
        return words
    change, found = np.zeros(len(words) + 1, np.int32), marks.values.to_numpy(zero_copy_only=False)
    at, whole = found // 2, found % 2 == 1
    np.add.at(change, np.where(whole, np.maximum(0, at - REACH), at), 1)
    np.add.at(change, np.minimum(len(words), at + WINDOW), -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]


def summarize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_words, n_removed, kept_sha256), one for each row of `docs`.

    A word goes if a window of 50 words over it also starts in a document with a smaller id; windows are judged on the
    input. Repeats within one document stay, so do rows alike in id. Null and empty texts have no words; rows without
    an id keep all words and take none from others. An empty table gives an empty table.
    """
    joined, _ = _joined(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), repeated_spans(docs, id_col, text_col), "doc_id", "text")

    def run(batches):
        for batch in slices(batches):
            out = []
            for text, marks in zip(texts_of(batch.column(1)), batch.column(2), strict=True):
                words = text.split()
                kept = _keep(words, marks)
                out.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, zip(*out, strict=True))], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with the removed words gone from the text, the others joined by one space; texts that lose none stay as they are."""
    joined, name = _joined(docs, repeated_spans(docs, id_col, text_col), id_col, text_col)
    places = [joined.columns.index(text_col), joined.columns.index(name)]

    def run(batches):
        for batch in slices(batches):
            raw, marks = batch.column(places[0]), batch.column(places[1])
            texts = [b" ".join(_keep(t.split(), s)).decode() if s.is_valid else x.as_py() for t, s, x in zip(texts_of(raw), marks, raw, strict=True)]
            columns = [pa.array(texts, raw.type) if i == places[0] else batch.column(i) for i in range(batch.num_columns) if i != places[1]]
            yield pa.RecordBatch.from_arrays(columns, [c for c in batch.schema.names if c != name])

    return joined.mapInArrow(run, docs.schema)


def op1_substring(spark, sf_dir: str) -> DataFrame:
    return summarize(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, p, array_to_string(w[p : p + 49], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50)
), firsts AS (
  SELECT s, min(doc_id) AS first FROM windows GROUP BY s
), gone AS (
  SELECT DISTINCT doc_id, p + k AS q FROM windows JOIN firsts USING (s), range(50) AS r(k) WHERE first < doc_id
), words AS (
  SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS q FROM d
), kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY q) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, q) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
