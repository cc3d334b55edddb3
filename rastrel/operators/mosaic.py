"""Masks, median mosaics and risk statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cells import RISK_NAMES, risk_class


def masked(values: DataFrame, mask: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Values where the mask (keys, on) is on; null elsewhere."""
    return mask.join(values, keys, "left").select(*keys, F.when(F.col("on"), F.col(value)).alias(value))


def median_mosaic(maps: DataFrame, pixel: list[str], value: str = "p", base: DataFrame | None = None) -> DataFrame:
    """Median over the maps of each pixel, nulls left out; only pixels of `base`, if given."""
    d = maps.join(base.select(*pixel).distinct(), pixel, "left_semi") if base is not None else maps
    return d.groupBy(*pixel).agg(F.median(value).alias(value))


def risk_names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(RISK_NAMES)), "bin int, risk_level string")


def risk_histogram(values: DataFrame, value: str = "p") -> DataFrame:
    """bin, risk_level, pixel_count, percentage of all valid pixels: half-open bins, the last closed.

    Values outside 0..1 are in no bin but count in the denominator; empty classes stay. Partial counts of at most
    six keys are all that is shuffled.
    """
    spark = values.sparkSession
    counts = values.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(risk_class(F.col(value)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    d = risk_names(spark).join(F.broadcast(counts), "bin", "left")  # six rows at most
    return d.join(F.broadcast(total)).select("bin", "risk_level", F.coalesce("n", F.lit(0)).alias("pixel_count"), (F.coalesce("n", F.lit(0)) / F.col("total") * 100).alias("percentage"))
