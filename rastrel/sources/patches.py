"""Patch tables: partitioned by split and class, factor and label sides paired."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cells import target

KEYS = ["split", "cls", "r", "c"]


def write(patches: DataFrame, path: str) -> None:
    """Overwrites; readers of one split and class read those files only."""
    patches.write.mode("overwrite").partitionBy("split", "cls").parquet(path)


def pair(factors: DataFrame, labels: DataFrame, require: bool = True) -> DataFrame:
    """Factor patches that have a label patch of the same split, class and place, classes in order, then places."""
    d = factors.join(labels, KEYS)
    if require and d.isEmpty():
        raise ValueError("no patch has both factors and labels")
    return d


def read(spark: SparkSession, factors: str, labels: str, split: str) -> DataFrame:
    """Paired patches of one split, label arrays as training targets."""
    f, y = (spark.read.parquet(p).where(F.col("split") == split) for p in (factors, labels))
    return pair(f, y).withColumn("label", F.transform("label", target))
