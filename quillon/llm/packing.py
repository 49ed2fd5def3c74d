"""Best-fit packing into bins of several permitted lengths."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, words_of

#: Permitted sequence lengths, in tokens.
CAPACITIES = (512, 1024, 2048, 4096, 8192)
#: What opening a bin costs beside its length (a sequence's share of fixed work), in tokens.
BIN_COST = 32
#: Pieces that one packer sees on average, at most.
PACK_PIECES = 20_000


def opening_size(need: int, waiting, capacities: tuple[int, ...] = CAPACITIES, bin_cost: int = BIN_COST) -> int:
    """The permitted length to open for a piece of `need` tokens: the one of least cost for each token it will hold.

    `waiting[size]` is how many tokens are still to come in pieces of at most that size. A bin can later take what fits
    beside its first piece; of that room it counts as filled what waiting pieces of fitting size hold.
    """
    best, choice = None, capacities[-1]
    for c in capacities:
        if c >= need:
            filled = need + min(c - need, waiting[c - need])
            cost = (c + bin_cost) / filled
            if best is None or cost < best:
                best, choice = cost, c
    return choice


def best_fit(sizes: list[int], capacities: tuple[int, ...] = CAPACITIES, bin_cost: int = BIN_COST) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """For each size its (bin, offset), and for each bin its (length, tokens).

    Sizes come largest first. A piece goes to the open bin with the least room that holds it, the newest of equal ones;
    if none does, a bin of `opening_size` opens. At the end each bin shrinks to the least permitted length that holds
    its contents. A size of zero takes no room; none may exceed the largest length.
    """
    largest = capacities[-1]
    count = [0] * (largest + 1)
    for s in sizes:
        count[s] += s
    waiting, total = [0] * (largest + 1), 0
    for s, tokens in enumerate(count):
        total += tokens
        waiting[s] = total
    gone, spots, bins = 0, [], []
    by_room: dict[int, list[int]] = {}
    rooms = 0
    for s in sizes:
        gone += s
        left = rooms >> s
        if left:
            room = s + (left & -left).bit_length() - 1
            held = by_room[room]
            b = held.pop()
            if not held:
                rooms &= ~(1 << room)
        else:
            length = opening_size(max(s, 1), _Waiting(waiting, s, total - gone), capacities, bin_cost)
            b, room = len(bins), length
            bins.append([length, 0])
        spots.append((b, bins[b][1]))
        bins[b][1] += s
        room -= s
        if room not in by_room or not by_room[room]:
            by_room[room] = []
            rooms |= 1 << room
        by_room[room].append(b)
    return spots, [(next(c for c in capacities if c >= used), used) for _, used in bins]


class _Waiting:
    """Tokens in pieces yet to come of at most some size, when those come largest first."""

    def __init__(self, waiting: list[int], now: int, left: int):
        self.waiting, self.now, self.left = waiting, now, left

    def __getitem__(self, size: int) -> int:
        return min(self.left, self.waiting[min(size, self.now)])


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacities: tuple[int, ...] = CAPACITIES, bin_cost: int = BIN_COST) -> DataFrame:
    """Rows (doc_id, piece, start, n_tokens, bin_id, bin_offset, bin_tokens, capacity): where each piece of each document goes.

    A document has a token for each word and one end token. It is cut into pieces of the largest length, from the
    start; `start` is a piece's first token. Documents are dealt by a hash into packs of about PACK_PIECES pieces, as many as
    the pieces call for; each pack sorts its pieces, largest first, and packs them on its own, so bins never span packs. Only sizes are
    shuffled. bin_id is unique over all packs. Null and empty texts are an end token alone. Null ids stay null; rows
    alike are packed each. An empty table gives an empty table.
    """
    capacities, largest = tuple(sorted(capacities)), max(capacities)
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.xxhash64(F.col(id_col), text)
    # rows alike in id and text are numbered apart, so that they are dealt like any others; the numbers are written with the sizes
    sizes = materialize(docs.select(F.col(id_col).cast("long").alias("doc_id"), digest.alias("h"), F.monotonically_increasing_id().alias("row"), (F.size(words_of(text)) + 1).cast("long").alias("tokens")))
    n = -(-int(sizes.agg(F.sum(F.ceil(F.col("tokens") / largest))).first()[0] or 0) // PACK_PIECES) or 1
    names = ["doc_id", "piece", "start", "n_tokens", "bin_id", "bin_offset", "bin_tokens", "capacity"]

    def run(batches):
        from pyspark import TaskContext

        rows = [r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True)]
        pieces = [(min(largest, t - s), h, d, s // largest, s) for d, h, t in rows for s in range(0, t, largest)]
        pieces.sort(key=lambda p: (-p[0], p[1], p[3]))
        spots, bins = best_fit([p[0] for p in pieces], capacities, bin_cost)
        pack_id = TaskContext.get().partitionId() << 40
        for i in range(0, len(pieces), 20_000):
            out = [(d, k, s, size, pack_id + b, o, bins[b][1], bins[b][0]) for (size, _, d, k, s), (b, o) in zip(pieces[i : i + 20_000], spots[i : i + 20_000], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names)

    return sizes.repartition(n, "h", "row").select("doc_id", "h", "tokens").mapInArrow(run, ", ".join(f"{c} long" for c in names))


def op6_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
