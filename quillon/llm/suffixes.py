"""Suffix-array dedup: bytes covered by a long string that also starts elsewhere.

A repeated string of 400 bytes begins two suffixes that share their first 400 bytes, so equal neighbours in a sorted
list of all suffixes (each cut at 400 bytes) show every repeat. Sorting each byte's suffix would move hundreds of times
the text, so the list holds fewer, chosen by hashes that only ever rule suffixes out; what is repeated is decided by
the bytes of the sorted suffixes alone:

1. Every window of 400 bytes has an anchor: its least 32-byte gram by hash, the leftmost if it occurs twice. Equal
   windows have equal grams at equal offsets. Consecutive windows of one anchor form a run, and its bytes a segment.
2. Grams that occur once in the corpus leave with all their windows. Where a segment's digest occurs twice or more, the
   suffix from its start, cut at its end, stands for all its windows; neighbouring ones that occur together elsewhere too
   share a suffix (`_chunked`). One of several equal segments goes on beside those whose digest occurs once. Those with no
   core (bytes that many of its windows hold) that another segment has leave. What is left, at the edges of repeated
   passages, is cut into blocks of BLOCK windows, treated likewise, and of the blocks that are left after that each
   window's suffix stands for itself.
3. These suffixes are range-partitioned by their leading bytes with sampled splitters, sorted in each bucket by multikey
   quicksort, and compared with their neighbours, also across buckets (`repeats.equal_suffixes`).
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import apart, fresh, materialize, record_batch, release, slices, text_blocks, texts_of
from .repeats import equal_suffixes
from .rolling import FIRST

LENGTH, GRAM = 400, 32
#: Windows of a block.
BLOCK = 16
#: Windows of a long text that are looked at together.
PIECE = 1 << 18
_LOW = np.uint64(0xFFFFFFFF)


@dataclass(frozen=True)
class Shape:
    """Lengths that follow from `length`, the bytes of a window (GRAM + BLOCK at least)."""

    length: int = LENGTH

    def __post_init__(self):
        if self.length < GRAM + BLOCK:
            raise ValueError(f"a window has {GRAM + BLOCK} bytes at least, not {self.length}")

    @property
    def left(self) -> int:
        """Windows whose anchor lies at least this far in hold [anchor - left, anchor + GRAM), the others [anchor, anchor + left + GRAM)."""
        return (self.length - GRAM) // 2

    @property
    def core(self) -> int:
        """Bytes that all windows of a block hold: those its last full window starts with."""
        return self.length - BLOCK + 1


def window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of each `width` consecutive ones: prefix and suffix minima of blocks of that width."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    prefix = np.minimum.accumulate(blocks, axis=1).ravel()
    suffix = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(suffix[:n], prefix[width - 1 : width - 1 + n])


def anchor_runs(raw: np.ndarray, at: np.ndarray, shape: Shape = Shape()) -> tuple[np.ndarray, ...] | None:
    """Runs of windows with one anchor in texts laid end to end at offsets `at`: text, first and last window, anchor, and hashes.

    The hashes: of the gram, of the first and the last window, of the bytes left and right of the anchor that the run's
    windows hold (0 where no window of the run holds them).
    """
    length, left = shape.length, shape.left
    long = np.flatnonzero(np.diff(at) >= length)
    if not len(long):
        return None
    h = FIRST(raw, (GRAM, length, left + GRAM))
    grams, windows, sides = h[GRAM], h[length], h[left + GRAM]
    least = window_minimum((grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64), length - GRAM + 1)
    counts = at[long + 1] - at[long] - length + 1
    first = np.cumsum(counts) - counts
    starts = np.arange(counts.sum()) + np.repeat(at[long] - first, counts)
    text = np.repeat(long, counts)
    anchor = (least[starts] & _LOW).astype(np.int64)
    new = np.r_[True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])]
    s0 = starts[new]
    s1 = starts[np.r_[np.flatnonzero(new)[1:] - 1, len(starts) - 1]]
    text, anchor = text[new], anchor[new]
    before = np.where(s0 <= anchor - left, sides[np.maximum(anchor - left, 0)], np.uint64(0))
    behind = np.where(s1 > anchor - left, sides[np.minimum(anchor, len(sides) - 1)], np.uint64(0))
    return text, s0 - at[text], s1 - at[text], anchor - at[text], grams[anchor], windows[s0], windows[s1], before, behind


def _pieces(batch: pa.RecordBatch, name: str, length: int):
    """Blocks of texts as `text_blocks` gives them, with the offset of each in its text; long texts come in overlapping pieces."""
    for first, last, raw, at in text_blocks(batch, name, PIECE):
        if len(raw) <= 2 * PIECE:
            yield first, raw, at, 0
        else:
            for base in range(0, len(raw) - length + 1, PIECE):
                part = raw[base : base + PIECE + length - 1]
                yield first, part, np.array([0, len(part)]), base


def anchors(keyed: DataFrame, shape: Shape) -> DataFrame:
    """Anchor runs of every text of `keyed` (doc_id, tid, text)."""
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "tid", "s0", "s1", "anchor", "gram", "first", "last", "left", "right")])

    def run(batches):
        for batch in batches:
            ids, tids = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            for first, raw, at, base in _pieces(batch, "text", shape.length):
                if (found := anchor_runs(raw, at, shape)) is not None:
                    text, s0, s1, anchor, *hashes = found
                    yield record_batch(schema, ids[first + text], tids[first + text], s0 + base, s1 + base, anchor + base, *[x.view(np.int64) for x in hashes])

    return keyed.mapInArrow(run, ", ".join(f"`{f.name}` long" for f in schema))


def block_rows(raw: np.ndarray, lo: np.ndarray, hi: np.ndarray, anchor: np.ndarray, shape: Shape) -> tuple[np.ndarray, ...]:
    """The ranges [lo, hi) of windows cut into blocks by their distance from the anchor: bounds, anchor, first and last window, core, 32 bits of each window."""
    h = FIRST(raw, (shape.length, shape.core))
    least, most = (anchor - hi + 1) // BLOCK, (anchor - lo) // BLOCK
    counts = most - least + 1
    of = np.repeat(np.arange(len(lo)), counts)
    block = least[of] + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    end = anchor[of] - block * BLOCK
    start, stop = np.maximum(lo[of], end - BLOCK + 1), np.minimum(hi[of], end + 1)
    windows, cores = h[shape.length].view(np.int64), h[shape.core].view(np.int64)
    sizes = stop - start
    each = np.repeat(start - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array((windows[each] >> 32).astype(np.int32)))
    return start, stop, anchor[of], windows[start], windows[stop - 1], cores[end], lists


#: What the suffix of a range of windows stands for.
CHUNK, SEGMENT, BLOCK_OF, LONE = 0, 1, 2, 3
_BLOCK = pa.schema([*[(n, pa.int64()) for n in ("doc_id", "tid", "lo", "hi", "anchor", "first", "last", "core")], ("windows", pa.list_(pa.int32()))])
_SUFFIX = pa.schema([("level", pa.int32()), ("suffix", pa.binary()), *[(n, pa.int64()) for n in ("doc_id", "tid", "lo", "hi")]])


def _spec(schema: pa.Schema) -> str:
    kinds = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.list_(pa.int32()): "array<int>"}
    return ", ".join(f"`{f.name}` {kinds[f.type]}" for f in schema)


def _by_text(keyed: DataFrame, ranges: DataFrame, rows_of, schema: pa.Schema) -> DataFrame:
    """What `rows_of` makes of each text and its `ranges` (doc_id, tid, r), as arrays of their fields: columns after doc_id and tid."""

    def run(batches):
        for batch in slices(batches):
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch.column(2)), batch.column(3), strict=True)
            for doc, tid, text, found in rows:
                fields = [f.to_numpy(zero_copy_only=False) for f in found.values.flatten()]
                for columns in rows_of(np.frombuffer(text, np.uint8), *fields):
                    named = dict(zip([n for n in schema.names if n not in ("doc_id", "tid")], columns, strict=True))
                    n = len(columns[0])
                    named |= {"doc_id": np.full(n, doc), "tid": np.full(n, tid)}
                    yield record_batch(schema, *[named[c] for c in schema.names])

    collected = ranges.groupBy("doc_id", "tid").agg(F.collect_set("r").alias("ranges"))
    return keyed.join(collected, ["doc_id", "tid"]).select("doc_id", "tid", "text", "ranges").mapInArrow(run, _spec(schema))


def _blocks(keyed: DataFrame, ranges: DataFrame, shape: Shape) -> DataFrame:
    """Blocks (see `block_rows`) of `ranges` (r: lo, hi, anchor); near ones are hashed together."""

    def rows(raw, lo, hi, anchor):
        order = np.argsort(lo, kind="stable")
        lo, hi, anchor = lo[order], hi[order], anchor[order]
        i = 0
        while i < len(lo):
            j = int(np.searchsorted(lo, lo[i] + PIECE, side="right"))
            base = int(lo[i])
            start, stop, at, *values = block_rows(raw[base : int(hi[i:j].max()) + shape.length - 1], lo[i:j] - base, hi[i:j] - base, anchor[i:j] - base, shape)
            yield (start + base, stop + base, at + base, *values)
            i = j

    return _by_text(keyed, ranges, rows, _BLOCK)


def _suffixes(keyed: DataFrame, ranges: DataFrame, shape: Shape) -> DataFrame:
    """The suffixes, each cut at the end of what it stands for, of `ranges` (r: kind, lo, hi)."""

    def rows(raw, kind, lo, hi):
        for i in range(0, len(lo), 2048):
            a, b = lo[i : i + 2048], hi[i : i + 2048]
            shown = [raw[x:y].tobytes() for x, y in zip(a.tolist(), (b - 1 + shape.length).tolist(), strict=True)]
            yield kind[i : i + 2048], pa.array(shown, pa.binary()), a, b

    return _by_text(keyed, ranges, rows, _SUFFIX)


def _resolved(runs: DataFrame, cores: list[str], kept: tuple[str, ...] = ()) -> DataFrame:
    """The runs of windows that can be repeated: their `digest`, `whole` (another run has it), by_<core> (another segment has that core).

    `open`: the run stands for its bytes wherever parts of it are still to be compared (one of several equal ones does, or more).
    """
    segment = ["first", "last", "length"]
    runs = runs.withColumn("length", F.col("hi") - F.col("lo"))
    place = F.xxhash64("doc_id", "tid", "lo")
    segments = materialize(runs.groupBy(*segment).agg(F.count("*").alias("n"), F.min(place).alias("one"), *[F.min(c).alias(c) for c in cores]))
    judged = segments
    for c in cores:
        shared = apart(segments.where(f"`{c}` <> 0").groupBy(c).agg(F.count("*").alias("m")).where("m > 1"), c)
        judged = judged.join(shared.select(c, F.lit(True).alias(f"by_{c}")), c, "left")
    flags = [f"by_{c}" for c in cores]
    judged = judged.where(" or ".join(["n > 1", *flags])).select(*segment, "n", "one", *flags)
    joined = runs.drop(*[c for c in cores if c not in kept]).join(judged, segment)
    marks = {"digest": F.xxhash64(*segment), "whole": F.col("n") > 1, "open": (F.col("n") == 1) | (place == F.col("one"))}
    found = materialize(joined.withColumns(marks).drop("n", "one", *segment))
    release(runs.sparkSession, segments)
    return found


#: Segments that follow each other and are whole form a chunk, which ends after a digest divisible by CHUNK_SEGMENTS or CHUNK_WINDOWS on.
CHUNK_SEGMENTS, CHUNK_WINDOWS = 8, 1 << 14


def _chunked(found: DataFrame) -> DataFrame:
    """Ranges (doc_id, tid, r: kind, lo, hi) that stand for all whole segments of `found`: chunks that occur twice or more as such, or segments.

    One chunk of several equal ones also goes as segments, so a segment meets its equals in whatever chunks they are.
    """
    order = W.partitionBy("doc_id", "tid").orderBy("lo")
    rows = found.where("whole").select("doc_id", "tid", "lo", "hi", "digest", *[F.lag(c).over(order).alias(f"last_{c}") for c in ("lo", "hi", "digest")])
    once = rows.where("last_lo is null or last_lo <> lo")
    starts = F.expr(f"last_lo is null or last_hi <> lo or last_digest % {CHUNK_SEGMENTS} = 0 or last_lo div {CHUNK_WINDOWS} <> lo div {CHUNK_WINDOWS}")
    numbered = once.withColumn("chunk", F.sum(starts.cast("int")).over(order))
    held = numbered.groupBy("doc_id", "tid", "chunk").agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "digest"))).alias("s"))
    digest, place = F.xxhash64(F.transform("s", lambda x: x["digest"])), F.xxhash64("doc_id", "tid", "lo")
    chunks = materialize(held.select("doc_id", "tid", F.get("s", F.lit(0))["lo"].alias("lo"), F.element_at("s", -1)["hi"].alias("hi"), digest.alias("digest"), F.transform("s", lambda x: F.struct(x["lo"].alias("lo"), x["hi"].alias("hi"))).alias("s")))
    equal = apart(chunks.groupBy("digest").agg(F.count("*").alias("n"), F.min(place).alias("one")).where("n > 1").drop("n"), "digest")
    joined = chunks.join(equal, "digest", "left")
    parts = F.transform("s", lambda x: F.struct(F.lit(SEGMENT).alias("kind"), x["lo"].alias("lo"), x["hi"].alias("hi")))
    whole = F.array(F.struct(F.lit(CHUNK).alias("kind"), F.col("lo"), F.col("hi")))
    asked = F.when(F.col("one").isNull(), parts).when(F.col("one") == place, F.concat(whole, parts)).otherwise(whole)
    return joined.select("doc_id", "tid", F.explode(asked).alias("r"))


_NO_ID = -(1 << 63)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("doc_id"), F.xxhash64(text).alias("tid"), text.alias("text"))


def _split_ranges(split: DataFrame) -> DataFrame:
    """Ranges (doc_id, tid, r: kind, lo, hi) that stand for the blocks of `split`: the whole ones, and of the open ones windows that others may equal.

    Equal windows lie in blocks of one core, so a window that no other block of its core has (by 32 bits of its digest) leaves.
    """
    whole = split.where("whole").select("doc_id", "tid", F.struct(F.lit(BLOCK_OF).alias("kind"), "lo", "hi").alias("r"))
    windows = split.where("open and by_core").select("doc_id", "tid", "lo", "core", F.posexplode("windows").alias("i", "window"))
    twice = apart(windows.groupBy("core", "window").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "core", "window")
    lo = F.col("lo") + F.col("i")
    lone = windows.join(twice, ["core", "window"]).select("doc_id", "tid", F.struct(F.lit(LONE).alias("kind"), lo.alias("lo"), (lo + 1).alias("hi")).alias("r"))
    return whole.unionByName(lone)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Rows (doc_id, tid, spans): for each text with repeated bytes, ranges [lo, hi) that cover them.

    tid is xxhash64 of the text; a null id is the least 64-bit number. Spans may touch and overlap.
    """
    keyed, spark, shape = _keyed(docs, id_col, text_col), docs.sparkSession, Shape(length)
    every = materialize(anchors(keyed, shape))
    twice = apart(every.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"), "gram")
    runs = materialize(every.join(twice, "gram").drop("gram"))
    release(spark, every)
    found = _resolved(runs.withColumnsRenamed({"s0": "lo"}).withColumn("hi", F.col("s1") + 1).drop("s1"), ["left", "right"])
    release(spark, runs)
    middle = F.col("anchor") - shape.left + 1
    side = lambda name, lo, hi: F.when(F.col("open") & F.col(f"by_{name}") & (lo < hi), F.struct(lo.alias("lo"), hi.alias("hi"), "anchor"))
    sides = F.array(side("left", F.col("lo"), F.least("hi", middle)), side("right", F.greatest("lo", middle), F.col("hi")))
    blocks = materialize(_blocks(keyed, found.select("doc_id", "tid", F.explode(F.array_compact(sides)).alias("r")), shape))
    split = _resolved(blocks, ["core"], ("core", "windows"))
    release(spark, blocks)
    ranges = materialize(_chunked(found).unionByName(_split_ranges(split)))
    release(spark, found, split)
    suffixes = materialize(_suffixes(keyed, ranges, shape))
    release(spark, ranges)
    n_bytes = suffixes.agg(F.sum(F.octet_length("suffix"))).first()[0] or 0
    equal = equal_suffixes(suffixes, ["doc_id", "tid", "lo", "hi"], int(n_bytes))
    release(spark, suffixes)
    return equal.groupBy("doc_id", "tid").agg(F.collect_set(F.struct("lo", (F.col("hi") - 1 + length).alias("hi"))).alias("spans"))


def _removed(n: int, spans: pa.ListScalar) -> np.ndarray:
    change = np.zeros(n + 1, np.int32)
    lo, hi = (spans.values.field(k).to_numpy(zero_copy_only=False) for k in ("lo", "hi"))
    np.add.at(change, lo, 1)
    np.add.at(change, hi, -1)
    return np.cumsum(change[:-1]) > 0


def _joined(docs: DataFrame, spans: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """`docs` with a struct column (doc_id, tid, spans) beside its own columns, and that column's name."""
    name, key, tid = (fresh(docs, c) for c in ("_spans", "_key", "_tid"))
    keyed = docs.withColumn(key, F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID))).withColumn(tid, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    found = spans.select(F.col("doc_id").alias(key), F.col("tid").alias(tid), F.col("spans").alias(name))
    return keyed.join(found, [key, tid], "left").select(*[F.col(f"`{c}`") for c in docs.columns], name), name


def summarize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept_sha256), one for each row of `docs`.

    Null and empty texts have no bytes. Texts are judged on the input: overlapping repeats count, so do repeats within
    one text, and all rows of a group of copies lose what they share. Rows alike in id and text repeat each other.
    An empty table gives an empty table.
    """
    joined, name = _joined(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), repeated_spans(docs, id_col, text_col, length), "doc_id", "text")

    def run(batches):
        for batch in slices(batches):
            out = []
            for text, spans in zip(texts_of(batch.column(1)), batch.column(2), strict=True):
                if spans.is_valid:
                    gone = _removed(len(text), spans)
                    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                    out.append((len(text), int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
                else:
                    out.append((len(text), 0, 0, hashlib.sha256(text).hexdigest()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, zip(*out, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """`docs` with the bytes of strings of `length` bytes that start twice or more cut out of the text.

    A cut inside a character also takes that character. Rows without repeats stay as they are, null texts too.
    """
    joined, name = _joined(docs, repeated_spans(docs, id_col, text_col, length), id_col, text_col)
    places = [joined.columns.index(text_col), joined.columns.index(name)]

    def run(batches):
        for batch in slices(batches):
            raw, spans = batch.column(places[0]), batch.column(places[1])
            cut = lambda t, s: np.frombuffer(t, np.uint8)[~_removed(len(t), s)].tobytes().decode(errors="ignore")
            texts = [cut(t, s) if s.is_valid else x.as_py() for t, s, x in zip(texts_of(raw), spans, raw, strict=True)]
            columns = [pa.array(texts, raw.type) if i == places[0] else batch.column(i) for i in range(batch.num_columns) if i != places[1]]
            yield pa.RecordBatch.from_arrays(columns, [c for c in batch.schema.names if c != name])

    return joined.mapInArrow(run, docs.schema)


def op3_suffix_array(spark, sf_dir: str) -> DataFrame:
    return summarize(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP3_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents
), windows AS (
  SELECT r, i, md5(substr(h, 2 * i + 1, 800)) AS s FROM (SELECT r, h, unnest(range(0, length(h) // 2 - 399)) AS i FROM d WHERE length(h) >= 800)
), twice AS (
  SELECT s FROM windows GROUP BY s HAVING count(*) > 1
), found AS (
  SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM windows SEMI JOIN twice USING (s)
), runs AS (
  SELECT r, min(i) AS lo, max(i) + 400 AS hi FROM (SELECT r, i, sum(CASE WHEN before IS NULL OR i > before + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS g FROM found) GROUP BY r, g
), gaps AS (
  SELECT r, lo, hi, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo), 0) AS after FROM runs
), cut AS (
  SELECT r, sum(hi - lo) AS removed, count(*) AS spans, string_agg(substr(h, CAST(2 * after + 1 AS BIGINT), CAST(2 * (lo - after) AS BIGINT)), '' ORDER BY lo) || substr(any_value(h), CAST(2 * max(hi) + 1 AS BIGINT)) AS kept
  FROM gaps JOIN d USING (r) GROUP BY r
)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN cut USING (r)
"""
