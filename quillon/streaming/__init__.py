"""Structured Streaming into a dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..operators.dataset import Dataset
from ..sources.ingest import conform


def committing(dataset: Dataset, stream: DataFrame, name: str = "stream") -> DataStreamWriter:
    """A writer that commits each micro-batch of `stream` as one transaction, so readers see whole batches or nothing.

    The manifest records the last micro-batch under the stream's `name`, in the version that holds its rows. A batch
    that is replayed, as after a failure between the commit and the checkpoint, is found there and commits nothing.
    """

    def commit(batch: DataFrame, number: int) -> None:
        if number > dataset.last_batch(name):
            with dataset.begin() as txn:
                txn.stream = (name, number)
                txn.insert(conform(batch, dataset.schema))

    return stream.writeStream.foreachBatch(commit)
