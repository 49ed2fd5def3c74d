"""A training-corpus pipeline: rules drop junk, near-copies and repeated passages go, sources are mixed, sequences packed.

Each stage reads what the one before wrote, so it first deletes the intermediate tables that earlier stages left, but
for those its own input still reads.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from quillon.llm.common import materialize, release, sweep, written
from quillon.llm.mixing import mixed_documents
from quillon.llm.packing import pack
from quillon.llm.quality import keep_good
from quillon.llm.simhash import deduplicate
from quillon.llm.suffixes import remove_repeats

#: A repeated string from this length on is a passage: 50 short words of Latin letters have 200 bytes and more.
PASSAGE_BYTES = 200
#: Folders of tables that earlier stages wrote for themselves.
_LEFT: set[str] = set()


def _stage(work: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that first deletes the tables of earlier stages that its input does not read."""

    @wraps(work)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        sweep(spark, _LEFT, docs)
        before = written()
        out = work(spark, docs, sf_dir)
        _LEFT.update(written() - before)
        return out

    return run


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighed rules keep."""
    return keep_good(docs)


@_stage
def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return deduplicate(docs)


@_stage
def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the bytes of long strings that also start elsewhere."""
    return remove_repeats(docs, length=PASSAGE_BYTES)


@_stage
def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and of the last epoch as far, as their source's budget takes them."""
    return mixed_documents(docs)


@_stage
def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes in the packed sequences."""
    return pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", simhash_near_dedup),
    ("suffix-array dedup", suffix_array_dedup),
    ("mixing sources to target weights", source_mixing),
    ("best-fit packing", best_fit_packing),
]

#: The stages fit a model, follow links and hash; SQL cannot say that. tests/llm/test_pipeline.py has plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        made = materialize(stage(spark, docs, sf_dir))
        release(spark, docs)
        docs = made
    return STAGES[-1][1](spark, docs, sf_dir)
