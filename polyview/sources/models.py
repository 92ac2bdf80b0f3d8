"""Fitted models as files: a table of one row that holds the model's parameters."""

from __future__ import annotations

import pickle

from pyspark.sql import SparkSession


def save_model(spark: SparkSession, model, path: str) -> None:
    """Write a fitted model to a folder that Spark can reach; a folder that is there is replaced."""
    row = (type(model).__module__, type(model).__qualname__, bytearray(pickle.dumps(model)))
    spark.createDataFrame([row], "module string, name string, data binary").coalesce(1).write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str):
    """The model that ``save_model`` wrote. It is unpickled, so the file must be one's own."""
    row = spark.read.parquet(path).first()
    if not row.module.startswith(f"{__package__.split('.')[0]}."):
        raise ValueError(f"{row.module}.{row['name']} is no model of this package")
    return pickle.loads(bytes(row.data))
