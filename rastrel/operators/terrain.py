"""Terrain derivatives of an elevation grid: nodata fill, Sobel slope, D8 directions and receivers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cells import jittered
from .stencil import neighbourhood

NO_FLOW = 255
# Directions in the order N, NE, E, SE, S, SW, W, NW, as places in a row-major 3 x 3 neighbourhood.
D8_PLACES = (1, 2, 5, 8, 7, 6, 3, 0)
D8_STEPS = ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))


def jitter(dem: DataFrame) -> DataFrame:
    """r, c, z (float, null where nodata): single precision with the flat-breaking trend."""
    return dem.select("r", "c", jittered(F.col("z"), F.col("r"), F.col("c")).alias("z"))


def fill_missing(dem: DataFrame) -> DataFrame:
    """Adds `filled`: nodata cells get the mean of their valid 3 x 3 neighbours (mirrored border), 0 without any."""
    d = neighbourhood(dem, "z", "mirror")
    values = F.filter(F.array(*[F.col(f"nb.n{i}").cast("double") for i in range(9)]), lambda x: x.isNotNull())
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)
    return d.withColumn("filled", F.coalesce(F.col("z").cast("double"), F.when(F.size(values) > 0, mean), F.lit(0.0))).drop("nb")


def sobel_slope(dem: DataFrame, dx: float = 1.0, dy: float = 1.0) -> DataFrame:
    """r, c, slope: degrees in single precision, null where the elevation is."""
    d = neighbourhood(fill_missing(dem), "filled", "mirror")
    n = [F.col(f"nb.n{i}") for i in range(9)]
    gx = ((n[2] + 2 * n[5] + n[8]) - (n[0] + 2 * n[3] + n[6])) / F.lit(8.0 * abs(dx))
    gy = ((n[6] + 2 * n[7] + n[8]) - (n[0] + 2 * n[1] + n[2])) / F.lit(8.0 * abs(dy))
    slope = F.degrees(F.atan(F.sqrt(gx * gx + gy * gy))).cast("float")
    return d.select("r", "c", F.when(F.col("z").isNotNull(), slope).alias("slope"))


def d8(dem: DataFrame, mode: str = "strict") -> DataFrame:
    """r, c, dir: 0..7 for the largest drop, the first of equal ones; 255 without a drop or elevation.

    strict: drops in single precision, diagonals as they are. corrected: diagonal drops divided by the square root of 2.
    """
    d = neighbourhood(dem, "z", "edge")
    scale = [2**-0.5 if mode == "corrected" and i % 2 else 1.0 for i in range(8)]
    drop = [(F.col("z") - F.col(f"nb.n{p}")) * F.lit(s).cast("float") if s != 1 else F.col("z") - F.col(f"nb.n{p}") for p, s in zip(D8_PLACES, scale, strict=True)]
    drops = F.array(*[F.coalesce(x, F.lit(float("-inf")).cast("float")) for x in drop])
    best = F.array_max("_drops")
    flow = F.when((best <= 0) | F.col("z").isNull(), NO_FLOW).otherwise(F.array_position("_drops", best).cast("int") - 1)
    return d.withColumn("_drops", drops).select("r", "c", flow.cast("int").alias("dir"))


def receivers(flow: DataFrame, height: int, width: int) -> DataFrame:
    """id, ptr: flat index of each cell and of the one it drains to; null without flow or off the grid."""
    dr, dc = (F.element_at(F.array(*[F.lit(s[k]) for s in D8_STEPS]), F.col("dir") + 1) for k in (0, 1))
    moved = flow.withColumn("_on", F.col("dir") != NO_FLOW).withColumn("dir", F.when(F.col("_on"), F.col("dir")).otherwise(0))
    moved = moved.withColumn("_r", F.col("r") + dr).withColumn("_c", F.col("c") + dc)
    inside = F.col("_on") & F.col("_r").between(0, height - 1) & F.col("_c").between(0, width - 1)
    flat = lambda r, c: F.col(r).cast("long") * width + F.col(c)
    return moved.select(flat("r", "c").alias("id"), F.when(inside, flat("_r", "_c")).alias("ptr"))
