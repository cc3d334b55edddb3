"""Raster tables: scans with pushed-down windows, metadata checks, float32 sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cells import fill_nodata


def read(spark: SparkSession, path: str, window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Cells (r, c, ...) of a Parquet raster; `window` (r0, r1, c0, c1), ends left out, reaches the scan as a filter."""
    d = spark.read.parquet(path)
    if window is None:
        return d
    r0, r1, c0, c1 = window
    return d.where((F.col("r") >= r0) & (F.col("r") < r1) & (F.col("c") >= c0) & (F.col("c") < c1))


def write(cells: DataFrame, path: str, value: str = "v", nodata: float = -9999.0) -> None:
    """Single-precision raster with nodata for missing values, sorted by cell within its files so that windows prune."""
    out = cells.withColumn(value, fill_nodata(F.col(value), nodata).cast("float"))
    out.sortWithinPartitions("r", "c").write.mode("overwrite").parquet(path)


def check_alignment(meta: DataFrame) -> DataFrame:
    """Rasters (raster, height, width, crs, x0, y0, dx, dy) that don't agree with the first one by name."""
    first = meta.orderBy("raster").limit(1).select(*[F.col(c).alias(f"_{c}") for c in meta.columns])
    same = F.lit(True)
    for c in meta.columns:
        if c != "raster":
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return meta.join(F.broadcast(first)).where(~same).select(meta.columns)


def bounds(cells: DataFrame) -> tuple[int, int]:
    """Height and width of a dense raster from row 0, column 0 on."""
    top = cells.agg(F.max("r"), F.max("c")).first()
    return (0, 0) if top[0] is None else (int(top[0]) + 1, int(top[1]) + 1)
