"""Mixing sources to target weights: water-filled targets, hash-random order, distributed prefix sums, exact cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh, materialize, words_of

WEIGHTS = (3, 1, 2)
SHARE, MOST_EPOCHS = 1.5, 2
#: Rows that one range of hash keys holds on average, at most.
RANGE_ROWS = 4096
#: Rows alike in id, source and size that are numbered together, about; entries of more that are broadcast, at most.
PART_ROWS, MOST_BROADCAST = 4096, 10_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = MOST_EPOCHS) -> DataFrame:
    """Rows (source, source_size, target, n_rows, rank), one for each source of `sizes` (source, size).

    Sources in code point order, null last, take `weights` in turn. `share` of all sizes is split by weight; no
    source gets over `cap` times its size, and what is over goes to the others by weight. The level L for which
    sum(min(cap * size, L * weight)) is the whole is the largest of the levels that treat the first k sources, by
    size over weight, as full.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    ranked = by.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    weighed = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
    order = W.orderBy(F.col("source_size") / F.col("weight"), "rank")
    full = F.coalesce(F.sum(cap * F.col("source_size")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    level = (F.lit(share) * F.sum("source_size").over(W.partitionBy()) - full) / left
    target = F.least((cap * F.col("source_size")).cast("double"), F.max("level").over(W.partitionBy()) * F.col("weight"))
    return weighed.withColumn("level", level).select("source", "source_size", target.alias("target"), "n_rows", "rank")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = MOST_EPOCHS) -> DataFrame:
    """Rows (doc_id, size, source_size, target, taken), one for each row of `docs`.

    Those of `mix_by_source` without the source. size counts words (null text: 0). Within a source, rows follow the MD5 of their id, a hash-random order that
    reruns repeat; whole epochs are taken while the budget lasts and the last one is cut at the exact word. Keys are
    cut into ranges of RANGE_ROWS rows by their leading hex digits; sums of ranges are accumulated first, then rows
    within their range, so a source with a third of all rows spreads over many tasks. Rows alike in id and size are
    one entry with a count until the end. A null id hashes like an empty one; a null source is a source. An empty
    table gives an empty table.
    """
    return mix_by_source(docs, id_col, text_col, source_col, weights, share, cap).drop("source")


def _entries(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], share: float, cap: int) -> DataFrame:
    """Rows (doc_id, source, size, n, source_size, target, epochs, rest): rows alike in these are one entry of n.

    Of the words that the last epoch takes, `rest` is what is left at the entry's first row (below zero: nothing), so the
    k-th row takes epochs * size and, of rest - k * size, what lies between zero and size.
    """
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.size(words_of(F.col(text_col))).cast("long").alias("size"), key.alias("key"))
    sizes = materialize(rows)
    targets = source_targets(sizes, weights, share, cap)
    digits = F.greatest(F.lit(0), F.ceil(F.log(F.col("n_rows") / RANGE_ROWS) / F.log(F.lit(16.0)))).cast("int")
    plan = materialize(targets.withColumn("digits", digits))
    entries = sizes.groupBy("source", "key", "doc_id", "size").agg(F.count("*").alias("n"))
    ranged = entries.join(plan, entries.source.eqNullSafe(plan.source)).select(entries.source, "rank", F.expr("substring(key, 1, digits)").alias("range"), "key", "doc_id", "size", "n", "source_size", "target")
    within = W.partitionBy("rank", "range").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    summed = ranged.groupBy("rank", "range").agg(F.sum(F.col("size") * F.col("n")).alias("words"))
    starts = summed.select("rank", "range", F.coalesce(F.sum("words").over(W.partitionBy("rank").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    placed = ranged.withColumn("before", F.coalesce(F.sum(F.col("size") * F.col("n")).over(within), F.lit(0))).join(starts, ["rank", "range"])
    epochs = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(0)
    rest = F.floor("target") - F.col("epochs") * F.col("source_size") - F.col("start") - F.col("before")
    return placed.withColumn("epochs", epochs).select("doc_id", "source", "size", "n", "source_size", "target", "epochs", rest.alias("rest"))


def _taken(size: str, copy: str) -> Column:
    """Words that row number `copy` of an entry takes."""
    left = F.col("rest") - F.col(copy) * F.col(size)
    return (F.col("epochs") * F.col(size) + F.greatest(F.lit(0).cast("long"), F.least(F.col(size), left))).cast("long")


def mix_by_source(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = MOST_EPOCHS) -> DataFrame:
    """Rows (doc_id, source, size, source_size, target, taken): `mix` with each row's source."""
    entries = _entries(docs, id_col, text_col, source_col, weights, share, cap)
    # in two steps, so that no array grows with an entry of very many rows
    parts = entries.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {PART_ROWS}"))))
    copies = parts.withColumn("copy", F.explode(F.sequence(F.col("part") * PART_ROWS, F.least(F.col("n"), (F.col("part") + 1) * PART_ROWS) - 1)))
    return copies.select("doc_id", "source", "size", "source_size", "target", _taken("size", "copy").alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """`docs` as the mix takes them: a row for each epoch, none where nothing is taken.

    A document cut by the budget keeps its first words, joined by one space; rows without words go, as they take
    nothing. Rows alike in id, source and size are told apart only by order, so their takes are dealt among them by count:
    they are numbered by text, and where very many are alike (null ids), first within parts by a hash of the text.
    """
    row, size, at, now, part = (fresh(docs, c) for c in ("_id", "_size", "_at", "_now", "_part"))
    # one key without nulls serves the numbering and the join, so texts are shuffled once
    key = lambda i, s: F.to_json(F.array(F.col(i).cast("string"), F.col(s).cast("string")))
    counted = docs.withColumn(row, key(id_col, source_col)).withColumn(size, F.size(words_of(F.col(text_col))).cast("long")).where(F.col(size) > 0)
    takes = materialize(_entries(docs, id_col, text_col, source_col, WEIGHTS, SHARE, MOST_EPOCHS).where("size > 0").select(key("doc_id", "source").alias(row), F.col("size").alias(size), "n", "epochs", "rest"))
    common = takes.where(F.col("n") > PART_ROWS).select(row, size, F.ceil(F.col("n") / PART_ROWS).cast("int").alias(part))
    by_text = lambda *columns: F.row_number().over(W.partitionBy(*columns).orderBy(F.col(text_col))) - 1
    n_common = common.count()
    if n_common:
        common = F.broadcast(common) if n_common <= MOST_BROADCAST else common
        many = counted.join(common, [row, size]).withColumn(part, F.pmod(F.xxhash64(text_col), F.col(part)))
        sizes = many.groupBy(row, size, part).agg(F.count("*").alias("n"))
        before = sizes.select(row, size, part, F.coalesce(F.sum("n").over(W.partitionBy(row, size).orderBy(part).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(now))
        many = many.withColumn(at, by_text(row, size, part)).join(before, [row, size, part]).withColumn(at, F.col(at) + F.col(now)).drop(part, now)
        numbered = counted.join(common, [row, size], "left_anti").withColumn(at, by_text(row, size)).unionByName(many)
    else:
        numbered = counted.withColumn(at, by_text(row, size))
    held = [fresh(numbered, c) for c in ("epochs", "rest")]
    takes = takes.select(row, size, *[F.col(c).alias(h) for c, h in zip(("epochs", "rest"), held, strict=True)])
    left = F.col(held[1]) - F.col(at) * F.col(size)
    words = F.col(held[0]) * F.col(size) + F.greatest(F.lit(0).cast("long"), F.least(F.col(size), left))
    joined = numbered.join(takes, [row, size]).withColumn(now, words.cast("long")).where(F.col(now) > 0)
    parts = F.expr(f"explode(transform(sequence(0, cast((`{now}` - 1) div `{size}` as int)), k -> least(`{size}`, `{now}` - k * `{size}`)))")
    spread = joined.select(*[F.col(f"`{c}`") for c in docs.columns], size, parts.alias(part))
    cut = F.when(F.col(part) < F.col(size), F.array_join(F.slice(words_of(F.col(text_col)), 1, F.col(part).cast("int")), " ")).otherwise(F.col(text_col))
    return spread.withColumn(text_col, cut).select(*docs.columns)


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source
), w AS (
  SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM s
), l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER (ORDER BY source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY source_size / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), t AS (
  SELECT source, source_size, least(CAST(2 * source_size AS DOUBLE), max(level) OVER () * weight) AS target FROM l
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before,
    CASE WHEN t.source_size > 0 THEN CAST(floor(t.target) AS BIGINT) // t.source_size ELSE 0 END AS epochs
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, CAST(floor(target) AS BIGINT) - epochs * source_size - before)) AS BIGINT) AS taken FROM p
"""
