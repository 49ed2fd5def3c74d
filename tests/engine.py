"""What several engine tests use."""

from quillon.operators.dataset import Dataset
from quillon.plans.schema import Schema


def make(spark, path, *fields):
    return Dataset.create(spark, str(path / "data"), Schema.of(*fields))


def frame(dataset, *rows):
    return dataset.spark.createDataFrame(list(rows), dataset.schema.spark()).coalesce(1)


def commit(dataset, *rows):
    with dataset.begin() as txn:
        txn.insert(frame(dataset, *rows))


def values(df):
    """Rows as plain tuples, in an order of their own."""
    return sorted((tuple(r) for r in df.collect()), key=repr)
