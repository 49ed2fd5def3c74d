"""Repeats in large tables of keys or suffixes: range partition by sampled splitters, local multikey sort, compare across boundaries."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import least_count, materialize, record_batch

#: Rows of numbers, and bytes of suffixes, that one bucket holds on average, at most.
BUCKET_ROWS, BUCKET_BYTES = 400_000, 1 << 25
#: Leading bytes that suffixes are range-partitioned by.
LEAD = 24
#: Keys of eight bytes after which rows that are still tied are compared as a whole.
CHECKED = 8
#: Rows of one Arrow batch that a bucket returns.
PART = 100_000


def multikey_sort(n: int, depths: int, key_at: Callable[[int, np.ndarray], np.ndarray], equal: Callable[[np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Order of `n` rows by their keys, and which of the ordered rows differ from the one before them.

    Multikey quicksort: the key of a depth, `key_at(depth, rows)`, orders only rows that all keys before it left tied,
    and a depth at which no tied rows differ moves nothing. With `equal(rows)`, which of `rows` equal the one before them
    in all keys, groups of equal rows are done after CHECKED depths, or twice as many, and so on.
    """
    order, new, tied, check = np.arange(n), np.zeros(n, bool), np.arange(n), CHECKED
    new[:1] = True
    for depth in range(depths):
        if not len(tied):
            break
        if equal is not None and depth == check:
            check *= 2
            first = new[tied]
            group = np.cumsum(first)
            tied = tied[np.bincount(group, ~(first | equal(order[tied])))[group] > 0]
            if not len(tied):
                break
        group, values = np.cumsum(new[tied]), key_at(depth, order[tied])
        same = group[1:] == group[:-1]
        if not (same & (values[1:] != values[:-1])).any():
            continue
        inner = np.lexsort((values, group))
        order[tied], values = order[tied][inner], values[inner]
        new[tied[1:][same & (values[1:] != values[:-1])]] = True
        group = np.cumsum(new[tied])
        tied = tied[np.bincount(group)[group] > 1]
    return order, new


def _whole(batches) -> pa.Table | None:
    found = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(found) if found else None


PLACE = ("doc_id", "tid", "pos")


def met_before(rows: DataFrame, count: int) -> tuple[DataFrame, DataFrame]:
    """Of `rows` (key, context, doc_id, tid, pos; 64-bit numbers without nulls), about `count` of them: places met before, and places open.

    Rows of one key and one context are a class. Met before: another row of the class has a smaller doc_id. Open: no
    row of the class has, but the key has other classes, so what a class shares with another is still to be compared.

    Splitters sampled from the rows deal them into ranges of (key, context, doc_id, tid, pos), so even one key that most
    rows have spreads over many buckets. A bucket sorts its rows and decides what lies within it. Of its first class the
    rows of the least doc_id, and of its first and last key the rows that are open if the key goes on elsewhere, wait
    for the neighbours; each bucket reports its first and last class for them. Rows wait only for the least doc_id that
    a bucket has of a class, so a very common key makes a few for each bucket. `rows` is planned twice: for the
    splitters and to be dealt.
    """
    names = ["key", "context", *PLACE]
    dealt = rows.select(*names).repartitionByRange(least_count(count, BUCKET_ROWS, rows.sparkSession), *names)
    schema = pa.schema([("kind", pa.int32()), *[(n, pa.int64()) for n in names], ("several", pa.bool_())])

    def run(batches):
        if (whole := _whole(batches)) is None:
            return
        columns = [whole.column(n).to_numpy() for n in names]
        order, new = multikey_sort(len(columns[0]), 3, lambda depth, at: columns[depth][at])
        key, context, doc, tid, pos = (c[order] for c in columns)
        starts_key = np.r_[True, key[1:] != key[:-1]]
        starts = np.flatnonzero(starts_key | np.r_[True, context[1:] != context[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        of = np.repeat(np.arange(len(starts)), sizes)
        run_of = np.cumsum(starts_key) - 1
        several = (np.bincount(run_of[starts]) > 1)[run_of]
        least = doc == doc[starts][of]
        edge = (run_of == 0) | (run_of == run_of[-1])
        waits = least & ((of == 0) | (edge & ~several))
        ends = starts[sorted({0, len(starts) - 1})]
        for kind, at in ((1, np.flatnonzero(~least)), (2, np.flatnonzero(least & several & ~waits)), (3, np.flatnonzero(waits)), (4, ends)):
            for i in range(0, len(at), PART):
                part = at[i : i + PART]
                keys = [c[part] if kind > 2 else np.zeros(len(part), np.int64) for c in (key, context)]
                yield record_batch(schema, np.full(len(part), kind, np.int32), *keys, doc[part], tid[part], pos[part], several[part])

    marked = materialize(dealt.mapInArrow(run, "kind int, " + ", ".join(f"`{n}` long" for n in names) + ", several boolean"))
    reports = marked.where("kind = 4")
    classes = reports.groupBy("key", "context").agg(F.min("doc_id").alias("least"))
    keys = reports.groupBy("key").agg((F.max("several") | (F.min("context") != F.max("context"))).alias("many"))
    waiting = marked.where("kind = 3").join(classes, ["key", "context"]).join(keys, "key")
    place = lambda df, where: df.where(where).select(*PLACE)
    met = place(marked, "kind = 1").unionByName(place(waiting, "doc_id > least"))
    return met, place(marked, "kind = 2").unionByName(place(waiting, "doc_id = least and (many or several)"))


def _extreme(keys, n: int, least: bool) -> int:
    """A row that is first, or last, by the keys that the functions `keys` give of rows."""
    rows = np.arange(n)
    for key in keys:
        values = key(rows)
        rows = rows[values == (values.min() if least else values.max())]
    return int(rows[0])


def equal_suffixes(suffixes: DataFrame, place: list[str], n_bytes: int) -> DataFrame:
    """Rows `place` of `suffixes` (level, suffix, *place) whose level and bytes another row also has. n_bytes: of all suffixes, about.

    Splitters sampled from the rows range-partition the suffixes by their first LEAD bytes. Suffixes that have these in
    common are dealt on by a digest and their place, so even a suffix that most rows have spreads over many buckets. A
    bucket sorts its suffixes by multikey quicksort, eight bytes a key, and compares neighbours. A row whose only equals
    may lie in another bucket is alone of its kind in its own, and of the kind that is first or last there by lead and
    digest; it waits for the reports of such kinds, two rows a bucket. An empty table gives an empty table.
    """
    key = ["suffix", "level"]
    dealt = suffixes.select(*key, *place, F.xxhash64("suffix").alias("digest"))
    dealt = dealt.repartitionByRange(least_count(n_bytes, BUCKET_BYTES, suffixes.sparkSession), F.substring("suffix", 1, LEAD), "digest", "level", *place)
    schema = pa.schema([("kind", pa.int32()), ("suffix", pa.binary()), ("level", pa.int32()), *[(n, pa.int64()) for n in place], ("n", pa.int64())])

    def run(batches):
        if (whole := _whole(batches)) is None:
            return
        column = whole.column("suffix").cast(pa.large_binary()).combine_chunks()
        level = whole.column("level").to_numpy().astype(np.uint64)
        columns = [whole.column(n).to_numpy() for n in place]
        at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        size = np.diff(at)
        raw = np.concatenate([np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]], np.zeros(8, np.uint8)])
        at = at - at[0]
        words = np.ndarray((len(raw) - 7,), ">u8", raw, strides=(1,))
        last = (int(size.max()) + 7) // 8

        def key_at(depth, rows):
            if depth == last:  # zeros behind the end are told from zero bytes by the size
                return size[rows].astype(np.uint64) << np.uint64(32) | level[rows]
            left = size[rows] - 8 * depth
            values = words[np.minimum(at[rows] + 8 * depth, len(words) - 1)].astype(np.uint64)
            cut = (8 * (8 - np.clip(left, 0, 8))).astype(np.uint64)
            return np.where(left > 0, values >> cut % np.uint64(64) << cut % np.uint64(64), np.uint64(0))

        blob, ends_at, levels = raw.tobytes(), at.tolist(), level.tolist()

        def equal(rows):
            out, before = np.zeros(len(rows), bool), None
            for i, r in enumerate(rows.tolist()):
                now = (blob[ends_at[r] : ends_at[r + 1]], levels[r])
                out[i] = now == before
                before = now
            return out

        order, new = multikey_sort(len(size), last + 1, key_at, equal)
        starts = np.flatnonzero(new)
        sizes = np.diff(np.r_[starts, len(order)])
        of = np.cumsum(new) - 1
        digest = whole.column("digest").to_numpy()
        dealt_by = [*(lambda r, d=d: key_at(d, r) for d in range(min(LEAD // 8, last))), lambda r: np.minimum(size[r], LEAD), lambda r: digest[r], lambda r: level[r]]
        edges = sorted({int(of[order == _extreme(dealt_by, len(order), least)][0]) for least in (True, False)})
        ends = starts[edges]
        for kind, found in ((1, np.flatnonzero(sizes[of] > 1)), (2, ends[sizes[edges] == 1]), (3, ends)):
            for i in range(0, len(found), PART):
                part = found[i : i + PART]
                rows = order[part]
                shown = column.take(pa.array(rows)).cast(pa.binary()) if kind > 1 else pa.nulls(len(part), pa.binary())
                yield record_batch(schema, np.full(len(part), kind, np.int32), shown, level[rows].astype(np.int32), *[c[rows] for c in columns], sizes[of[part]])

    marked = materialize(dealt.mapInArrow(run, "kind int, suffix binary, level int, " + ", ".join(f"`{n}` long" for n in place) + ", n long"))
    reports = marked.where("kind = 3").groupBy(*key).agg(F.sum("n").alias("total")).where("total > 1")
    waiting = marked.where("kind = 2").join(reports, key)
    return marked.where("kind = 1").select(*place).unionByName(waiting.select(*place))
