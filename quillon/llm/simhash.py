"""SimHash near-duplicates: 64-bit fingerprints, pigeonhole blocks, Hamming verification, components."""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, apart, fresh, materialize, release, slices, texts_of
from .components import connected_components

SHINGLE = 3
SEED = 42
MAX_DISTANCE = 2
#: 16-bit blocks; two fingerprints that differ in at most two bits agree in two of the four.
BLOCKS, BLOCK_BITS = 4, 16
#: Members of a block that are joined with each other, at most.
JOINED = 64


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Fingerprint of one UTF-8 text: a bit is set if it is set in over half of its shingles' hashes."""
    words = text.translate(ASCII_LOWER).split()
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    n = max(1, len(words) - shingle + 1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Rows (doc_id, fp) with the fingerprint as a signed 64-bit number, one for each row of `docs`."""

    def run(batches):
        for batch in slices(batches):
            prints = np.fromiter((fingerprint(t, shingle) for t in texts_of(batch.column(1))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def _block_key(pair: tuple[int, int]):
    i, j = pair
    part = lambda k: F.shiftrightunsigned("fp", k * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1).cast("long"))
    table = F.lit(list(combinations(range(BLOCKS), 2)).index(pair)).cast("long")
    return F.shiftleft(table, 2 * BLOCK_BITS) + F.shiftleft(part(i), BLOCK_BITS) + part(j)


def linked_fingerprints(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) that connect exactly the distinct fingerprints `fp` within MAX_DISTANCE bits, directly or by a path.

    Pigeonhole: a close pair agrees in two of four blocks, so fingerprints join on pairs of blocks, and the Hamming
    distance of each pair that meets is verified. The join is over blocks of at most JOINED members. Larger blocks are
    refined instead (`_refined`), so no block's pairs are all formed.
    """
    keyed = distinct.select("fp", F.explode(F.array(*[_block_key(p) for p in combinations(range(BLOCKS), 2)])).alias("block"))
    sizes = apart(keyed.groupBy("block").agg(F.count("*").alias("n")).where("n > 1"), "block")
    members = materialize(keyed.join(sizes, "block"))
    few = members.where(F.col("n") <= JOINED)
    pairs = few.select("block", F.col("fp").alias("a")).join(few.select("block", F.col("fp").alias("b")), "block").where("a < b").select("a", "b")
    joined = pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_DISTANCE)
    return joined.unionByName(_refined(members.where(F.col("n") > JOINED).select("fp").distinct())).distinct()


def _refined(candidates: DataFrame) -> DataFrame:
    """Edges (a, b) that connect exactly the `candidates` within MAX_DISTANCE bits: those of blocks with very many members.

    They meet at midpoints: each offers itself and its 64 one-bit neighbours, and two of them share an offer exactly if
    they differ in at most two bits. An offer has at most 65 takers, so the verified pairs are read off bounded groups.
    """
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << b if b < 63 else -(1 << 63)).cast("long") for b in range(64)])
    offers = candidates.select("fp", F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("offer"))
    takers = offers.groupBy("offer").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    pairs = takers.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b")
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_DISTANCE)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Rows (doc_id, fp, component_id), one for each row of `docs`.

    Two rows link if their fingerprints differ in at most two bits; component_id is the smallest doc_id reachable,
    the row's own included. Null, empty and wordless texts have fingerprint zero and link like any other. Rows of
    equal fingerprint form one node, so a group of copies costs one candidate. A null doc_id stays null and never
    names a component of rows that have ids. Repeated rows each come back. An empty table gives an empty table.
    """
    prints = materialize(fingerprints(docs, id_col, text_col, shingle))
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected_components(linked_fingerprints(nodes.select("fp")))
    rooted = materialize(nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    linked = rooted.where("fp <> root").select("root").distinct()
    firsts = rooted.join(linked, "root", "left_semi").groupBy("root").agg(F.min("least").alias("first"))
    classes = rooted.join(firsts, "root", "left").select("fp", F.coalesce("first", "least").alias("component_id"))
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


#: Wide sketches: SimHashes of WIDE_BITS bits of the distinct five-word shingles of a text.
WIDE_BITS, WIDE_SHINGLE = 1024, 5
#: Texts link from this Jaccard similarity of their shingle sets, as a fraction.
SIMILAR = (4, 5)
#: Texts, about, whose shingles tell which are common; those in this many of them are, and so many at most are told apart.
SAMPLE_TEXTS, COMMON_TEXTS, COMMON_SHINGLES = 8_000, 4, 200_000
#: Bits of the shingle sketch in which a candidate pair differs, at most, for small sets and for those of LARGE_SET shingles or more;
#: exact similarity decides what is left. At 0.8 the mean is 155 and the deviation 11, for sets of four and five shingles (the worst
#: case) 192 and 12.5, so these are four deviations off: of pairs at just 0.8, three in 100,000 are farther, of those at 0.82 none to speak of.
WIDE_DISTANCE, LARGE_SET = (242, 199), 50
#: Rounds of votes at most, and nodes that a node offers to compare in each key, at first.
PIVOT_ROUNDS, OFFERS = 3, 8
#: Members of a key that meet in one cell, on average at most; larger keys become pairs of parts.
CELL_MEMBERS = 2048
_SEEDS = np.random.default_rng(99).integers(0, 1 << 64, WIDE_BITS // 64, np.uint64)


def wide_sketch(base: np.ndarray) -> np.ndarray:
    """A SimHash of WIDE_BITS bits, as bytes: a bit is set if it is set in over half of the hashes that the features' 64-bit hashes `base` give."""
    ones = np.zeros(WIDE_BITS, np.int64)
    for i in range(0, len(base), 2048):
        h = base[i : i + 2048, None] ^ _SEEDS[None, :]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        ones += np.unpackbits((h ^ (h >> np.uint64(32))).view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint16)
    return np.packbits(2 * ones > len(base), bitorder="little")


def _hashes(features) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, features), np.uint64)


def shingles(words: list[bytes]) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of WIDE_SHINGLE words; of all words together if they are fewer."""
    grams = map(b" ".join, zip(*(words[i:] for i in range(WIDE_SHINGLE)), strict=False)) if len(words) >= WIDE_SHINGLE else [b" ".join(words)]
    return np.unique(_hashes(grams))


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int64), *arrays])))


def common_shingles(texts: DataFrame) -> np.ndarray:
    """Hashes of the shingles that many of about SAMPLE_TEXTS texts, picked by hash, have: the most common last."""

    def run(batches):
        for batch in slices(batches):
            for text in texts_of(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(text.translate(ASCII_LOWER).split()).view(np.int64))], ["gram"])

    share = min(1.0, SAMPLE_TEXTS / max(1, texts.count()))
    picked = texts.where(F.pmod(F.xxhash64("t"), F.lit(1 << 30)) < int(share * (1 << 30))).select("text").mapInArrow(run, "gram long")
    often = picked.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON_TEXTS)
    return np.array([r.gram for r in often.orderBy(F.desc("n"), "gram").limit(COMMON_SHINGLES).collect()][::-1], np.int64)


def prefix(grams: np.ndarray, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first n - ceil(0.8 n) + 1 of n sorted shingles, in one order for all texts: those not in `common` by hash, then common ones by rank.

    Of two sets of a similarity of 0.8 or more, each shares at least 0.8 of itself with the other. The first shared shingle
    in the order has all other shared ones behind it, so it is in both prefixes: no such pair is without a shared key,
    whatever the order is. Common shingles come last only because rare ones make few candidates.
    """
    n = len(grams)
    place = np.zeros(n, np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, grams), len(common) - 1)
        place = np.where(common[at] == grams, rank[at] + 1, 0)
    least, whole = SIMILAR
    return grams[np.argsort(place, kind="stable")[: n - -(-least * n // whole) + 1]]


def _sketched(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, t, node, n, keys, sketch): a digest of the lower-cased words, the number of shingles, the first of them (see `prefix`), their sketch."""
    found = common_shingles(docs)
    rank = np.argsort(found, kind="stable")
    common = found[rank]

    def run(batches):
        for batch in slices(batches):
            nodes, sizes, keys, sketches = [], [], [], []
            for text in texts_of(batch.column(2)):
                words = text.translate(ASCII_LOWER).split()
                grams = shingles(words)
                keys.append(prefix(np.sort(grams.view(np.int64)), common, rank))
                nodes.append(xxhash.xxh3_64_intdigest(b" ".join(words)))
                sizes.append(len(grams))
                sketches.append(wide_sketch(grams).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), _lists(keys), _lists(sketches)], ["doc_id", "t", "node", "n", "keys", "sketch"])

    return docs.mapInArrow(run, "doc_id long, t long, node long, n long, keys array<long>, sketch array<long>")


def _most_apart(n, m):
    """Bits in which the sketches of sets of `n` and `m` shingles that are 0.8 similar may differ, at most."""
    return F.when(F.least(n, m) >= LARGE_SET, WIDE_DISTANCE[1]).otherwise(WIDE_DISTANCE[0])


def _allowed(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The `pairs` (a, b) whose numbers of shingles and sketches allow a similarity of 0.8."""
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    apart_ = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    sized = pairs.join(side("a"), "a").join(side("b"), "b").where(SIMILAR[1] * F.least("na", "nb") >= SIMILAR[0] * F.greatest("na", "nb"))
    return sized.where(apart_ <= _most_apart("na", "nb")).select("a", "b")


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """The `pairs` (a, b) whose shingle sets are 0.8 similar or more; the sets are made only of texts in a pair."""

    def run(batches):
        for batch in slices(batches):
            sets = [shingles(text.translate(ASCII_LOWER).split()).view(np.int64) for text in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(sets)], ["node", "grams"])

    used = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    picked = nodes.join(used, "node", "left_semi").select("node", "doc_id", "t")
    own = texts.join(picked, ["doc_id", "t"]).select("node", "text").dropDuplicates(["node"])
    sets = materialize(own.mapInArrow(run, "node long, grams array<long>"))
    side = lambda c: sets.select(F.col("node").alias(c), F.col("grams").alias(f"g{c}"))
    least, whole = SIMILAR
    enough = (least + whole) * F.size(F.array_intersect("ga", "gb")) >= least * (F.size("ga") + F.size("gb"))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(enough).select("a", "b")


def offers(nodes: np.ndarray, labels: np.ndarray, sizes: np.ndarray, places: np.ndarray, sketches: np.ndarray, most: int):
    """For each node of a cell the `most` nearest nodes with another label that may link: node, partner, whether there are more.

    Sizes and sketches must allow a link, and so must the key's places in both prefixes if no key before it is shared: a
    pair meets under the first key that it shares, so it need not meet where too little of either set follows.
    """
    far = np.iinfo(np.int32).max
    least, whole = SIMILAR
    for i in range(0, len(nodes), 32):
        mine = np.s_[i : i + 32]
        n, both = sizes[mine, None], sizes[mine, None] + sizes
        near = labels[mine, None] != labels
        near &= whole * np.minimum(n, sizes) >= least * np.maximum(n, sizes)
        common = -(-least * both // (least + whole))
        near &= (n - places[mine, None] >= common) & (sizes - places >= common)
        x, y = np.nonzero(near)
        if not len(x):
            continue
        bits = np.bitwise_count(sketches[i + x] ^ sketches[y]).sum(1, dtype=np.int32)
        bits[bits > np.where(np.minimum(sizes[i + x], sizes[y]) >= LARGE_SET, WIDE_DISTANCE[1], WIDE_DISTANCE[0])] = far
        apart_ = np.full(near.shape, far, np.int32)
        apart_[x, y] = bits
        found = (apart_ < far).sum(1)
        best = np.argsort(apart_, axis=1, kind="stable")[:, :most]
        x, y = np.nonzero(np.arange(best.shape[1])[None, :] < found[:, None])
        yield nodes[i + x], nodes[best[x, y]], found[x] > most


def _cells(dealt: DataFrame, most: int) -> DataFrame:
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("more", pa.bool_())])

    def run(batches):
        now, rows = None, []

        def close():
            if len(rows) > 1:
                numbers = [np.array(c, np.int64) for c in list(zip(*rows, strict=True))[:4]]
                sketches = np.array([r[4] for r in rows], np.int64).view(np.uint64)
                for found in offers(*numbers, sketches, most):
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, found)), schema=schema)

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for key, row in zip(zip(*columns[:3], strict=True), zip(*columns[3:], strict=True), strict=True):
                if key != now:
                    yield from close()
                    now, rows = key, []
                rows.append(row)
        yield from close()

    return dealt.mapInArrow(run, "a long, b long, more boolean")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _voted(labelled: DataFrame, seen: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b): each node with the pivot of another group that most of its keys name. A key names two random members."""
    # node digests are random numbers: the least and the largest of them after a change of bits are random members
    drawn = F.col("node").bitwiseXOR(F.xxhash64(F.pmod(F.xxhash64("key"), F.lit(4)), F.lit(turn)))
    ends = [F.min_by("node", drawn).alias("p"), F.min_by("label", drawn).alias("lp"), F.max_by("node", drawn).alias("q"), F.max_by("label", drawn).alias("lq")]
    named = apart(labelled.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), *ends).where("x <> y").drop("x", "y"), "key")
    pivot = F.when(F.col("lp") != F.col("label"), F.col("p")).when(F.col("lq") != F.col("label"), F.col("q"))
    votes = labelled.join(named, "key").select("node", pivot.alias("pivot")).where("pivot is not null").groupBy("node", "pivot").agg(F.count("*").alias("n"))
    pairs = votes.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"), "node", "pivot", "n").join(seen, ["a", "b"], "left_anti")
    best = pairs.groupBy("node").agg(F.max_by("pivot", F.shiftleft("n", 32) + F.pmod(F.xxhash64("pivot"), F.lit(1 << 32))).alias("pivot"))
    return _ordered(best.select(F.col("node").alias("a"), F.col("pivot").alias("b")))


def _roots(sketched: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows (node, root) of the nodes that link to others; root is one of the group.

    All pairs of nodes that share a key are candidates, but pairs within one group need no comparison. So groups grow
    first by votes: each node is compared with one pivot of another group, in rounds until PIVOT_ROUNDS have passed or one
    links nothing. Then, in keys that still hold several groups, each node offers its nearest nodes of other groups, OFFERS
    of them a key, and all offers are compared. While a node had more to offer, it offers eight times as many in another
    round. When none had, every pair of different groups that may link has been compared, so the groups are exact.
    """
    spark = sketched.sparkSession
    nodes = materialize(sketched.groupBy("node").agg(F.min(F.struct("doc_id", "t", "n", "keys", "sketch")).alias("m")).select("node", "m.*"))
    members = nodes.select("node", F.posexplode("keys").alias("place", "key"))
    shared = apart(members.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key"), "key")
    held = materialize(members.join(shared, "key").select("key", "node", "place"))
    seen, groups = nodes.select(F.col("node").alias("a"), F.col("node").alias("b")).where("false"), None

    def labelled(held: DataFrame) -> DataFrame:
        if groups is None:
            return held.withColumn("label", F.col("node"))
        found = materialize(held.drop("label").join(groups, "node", "left").select("key", "node", "place", F.coalesce("root", "node").alias("label")))
        several = apart(found.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("m")).where("x <> y").select("key", "m"), "key")
        left = materialize(found.join(several, "key"))
        release(spark, held, found)
        return left

    def grown(links: DataFrame) -> DataFrame:
        stars = links if groups is None else groups.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(links)
        return materialize(connected_components(stars))

    held = labelled(held)
    for turn in range(PIVOT_ROUNDS):
        now = materialize(_voted(held, seen, turn))
        links = materialize(_verified(_allowed(now, nodes), nodes, texts))
        seen = materialize(seen.unionByName(now))
        none = links.isEmpty()
        groups = grown(links)
        held = labelled(held)
        if none:
            break
    most, more = OFFERS, True
    while more:
        found = materialize(_cells(_placed(held, nodes), most))
        more = not found.where("more").isEmpty()
        now = materialize(_ordered(found).join(seen, ["a", "b"], "left_anti"))
        release(spark, found)
        if not now.isEmpty():
            groups = grown(materialize(_verified(now, nodes, texts)))
            seen = materialize(seen.unionByName(now))
        if more:
            held, most = labelled(held), 8 * most
    return groups


def _placed(held: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows (key, i, j, node, label, n, place, sketch), sorted by cell: of a key with many members each pair of parts, by a hash, is a cell."""
    spark, parts = held.sparkSession, F.ceil(F.col("m") / CELL_MEMBERS).cast("int")
    mine = F.pmod(F.xxhash64("node"), parts).cast("int")
    dealt = held.select("key", "node", "place", "label", mine.alias("p"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("o"))
    placed = dealt.select("key", F.least("p", "o").alias("i"), F.greatest("p", "o").alias("j"), "node", "place", "label").join(nodes.select("node", "n", "sketch"), "node")
    count = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return placed.repartition(count, "key", "i", "j").select("key", "i", "j", "node", "label", "n", "place", "sketch").sortWithinPartitions("key", "i", "j")


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (doc_id, t, root) of the rows of `docs` that have an id; t is a hash of the text, root the same number for all of a group."""
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = texts.select("doc_id", F.xxhash64("text").alias("t"), "text")
    sketched = materialize(_sketched(texts))
    rows = materialize(sketched.select("doc_id", "t", "node"))
    return rows.join(_roots(sketched, texts), "node", "left").select("doc_id", "t", F.coalesce("root", "node").alias("root"))


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, component_id) for documents that are near-duplicates of others: five-word shingle sets of a Jaccard similarity of 0.8 or more, or a chain of such.

    Texts with the same words in any case (by a 64-bit digest) are one node. Nodes whose prefixes share a shingle are
    candidates, which no pair of a similarity of 0.8 misses; sizes
    and SimHash distance drop what cannot be 0.8 similar, and the shingle sets (of 64-bit hashes) decide the rest.
    Keys with many members are cut into parts by a hash, and each pair of parts is a cell, so all pairs are still seen.
    Rows without an id take no part; rows of one id are one document.
    """
    rows = materialize(_grouped(docs, id_col, text_col))
    firsts = rows.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n")).where("n > 1")
    return rows.join(firsts, "root").select("doc_id", "component_id").distinct()


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one document of each near-duplicate group kept: the one with the smallest id, of one id the one with the smallest hash of its text.

    Groups link as in `similar_groups`, but rows of one id and different texts are documents of their own. Of rows alike
    in id and text the least by the other columns stays. Rows without an id are kept. Columns and values stay as they are.
    """
    row, t, m = (fresh(docs, c) for c in ("_row", "_t", "_m"))
    grouped = materialize(_grouped(docs, id_col, text_col))
    firsts = grouped.groupBy("root").agg(F.min(F.struct("doc_id", "t")).alias("first"))
    gone = grouped.join(firsts, "root").where(F.struct("doc_id", "t") != F.col("first")).select(F.col("doc_id").alias(row), F.col("t").alias(t)).distinct()
    keyed = docs.where(F.col(id_col).isNotNull()).withColumn(row, F.col(id_col).cast("long")).withColumn(t, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    kept = keyed.join(gone, [row, t], "left_anti").groupBy(row, t).agg(F.min(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias(m))
    return kept.select(*[F.col(m)[c].alias(c) for c in docs.columns]).unionByName(docs.where(docs[id_col].isNull()))


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
