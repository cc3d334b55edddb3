"""Tiles, prediction windows and the resolution of their overlaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def tiles(spark: SparkSession, height: int, width: int, tile: int = 2048, overlap: int = 64) -> DataFrame:
    """Write windows (r0, r1, c0, c1) and read windows with a halo (h_r0 ...), cut at the raster."""
    starts = lambda n, name: spark.range(0, max(0, n), tile).select(F.col("id").cast("int").alias(name))
    d = starts(height, "r0").join(starts(width, "c0"))
    end = lambda a, n: F.least(F.col(a) + tile, F.lit(n))
    d = d.select("r0", end("r0", height).alias("r1"), "c0", end("c0", width).alias("c1"))
    lo, hi = lambda a: F.greatest(F.col(a) - overlap, F.lit(0)), lambda a, n: F.least(F.col(a) + overlap, F.lit(n))
    return d.select("*", lo("r0").alias("h_r0"), hi("r1", height).alias("h_r1"), lo("c0").alias("h_c0"), hi("c1", width).alias("h_c1"))


def n_starts(n: int, crop: int, overlap: int) -> int:
    """Number of windows along an axis; none unless it is longer than the overlap."""
    return max(0, -(-(n - overlap) // (crop - overlap)))


def prediction_windows(spark: SparkSession, height: int, width: int, crop: int, overlaps: list[int]) -> DataFrame:
    """overlap, r, c, h, w: windows at every multiple of the stride that starts before the last overlap; cut at the raster."""
    made = None
    for o in overlaps:
        s = crop - o
        axis = lambda n, name, o=o, s=s: spark.range(n_starts(n, crop, o)).select((F.col("id") * s).cast("int").alias(name))
        d = axis(height, "r").join(axis(width, "c")).select(F.lit(o).alias("overlap"), "r", "c", F.least(F.lit(crop), height - F.col("r")).alias("h"), F.least(F.lit(crop), width - F.col("c")).alias("w"))
        made = d if made is None else made.unionByName(d)
    return made


def owner(y: Column, n: int, crop: int, overlap: Column | int) -> Column:
    """Start of the window that writes position y last: no window needs to score more than it owns."""
    stride = crop - (overlap if isinstance(overlap, Column) else F.lit(overlap))
    last = F.ceil((n - (crop - stride)) / stride) - 1
    return (F.least(F.floor(y / stride), last) * stride).cast("int")


def last_writer(writes: DataFrame, pixel: list[str], value: str, order: list[str]) -> DataFrame:
    """Of all that was written to a pixel, the value of the greatest `order`."""
    return writes.groupBy(*pixel).agg(F.max_by(value, F.struct(*order)).alias(value))
