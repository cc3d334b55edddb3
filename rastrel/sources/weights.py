"""Weights of a network as rows (layer, shape, values)."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cells import strip_module


def write(spark: SparkSession, weights: Mapping[str, np.ndarray], path: str) -> None:
    rows = [(k, [int(n) for n in v.shape], np.asarray(v, np.float32).ravel().tolist()) for k, v in weights.items()]
    spark.createDataFrame(rows, "layer string, shape array<int>, v array<float>").write.mode("overwrite").parquet(path)


def save(layers: DataFrame, path: str) -> None:
    """Rows (layer, shape, v) of any number of layers; nothing passes the driver."""
    layers.select("layer", "shape", F.col("v").cast("array<float>").alias("v")).write.mode("overwrite").parquet(path)


def table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumn("layer", strip_module(F.col("layer")))


def read(spark: SparkSession, path: str) -> dict[str, np.ndarray]:
    return {r["layer"]: np.array(r["v"], np.float32).reshape(r["shape"]) for r in table(spark, path).toLocalIterator()}
