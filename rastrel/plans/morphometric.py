"""Elevation to morphometric susceptibility: slope, drainage, slope units, joint probability, unit maxima, smoothing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import drainage, flood, rank, tiles
from ..session import staged, unbroadcast
from ..sources import rasters


@dataclass(frozen=True)
class Settings:
    """Cell size, least slope of cells that count, smoothing width (None: none), strict or corrected semantics, tile size.

    corrected: depressions are filled, diagonal drops divided by the square root of 2, smoothing weighs valid cells only.
    """

    dx: float = 1.0
    dy: float = 1.0
    min_slope: float = 0.0
    sigma: float | None = None
    mode: str = "strict"
    tile: int = tiles.TILE


def drained(dem: DataFrame, height: int, width: int, s: Settings = Settings()) -> DataFrame:
    """id, r, c, slope, dir, ptr, root, acc, beta: one accumulation loop carries both sums and the roots.

    Nodata cells weigh 1 and slope 0; beta is single precision.
    """
    z = tiles.from_cells(dem, ["z"], height, width, s.tile)
    if s.mode == "corrected":
        z = flood.fill_tiles(staged(z, "dem-tiles"), height, width, s.tile)
    flow = staged(tiles.terrain(z, height, width, s.dx, s.dy, s.mode, s.tile), "terrain-tiles")
    sums = drainage.accumulate_tiles(flow, [None, "slope"], height, width, s.tile)
    both = flow.select("tr", "tc", "slope", "dir").join(unbroadcast(sums), ["tr", "tc"])
    cells = tiles.to_cells(both, ["slope", "dir", "ptr", "root", "acc_0", "acc_1"])
    beta = (F.col("acc_1") / F.col("acc_0")).cast("float")
    flat = F.col("r").cast("long") * width + F.col("c")
    return cells.select(flat.alias("id"), "r", "c", "slope", F.col("dir").cast("int").alias("dir"), F.nullif(F.col("ptr"), F.lit(-1).cast("long")).alias("ptr"), "root", F.col("acc_0").cast("long").alias("acc"), beta.alias("beta"))


def joint(cells: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Labels and joint probability of the valid cells that are steep enough."""
    labelled = staged(drainage.unit_labels(staged(cells, "drained-cells")), "labelled")
    return rank.joint_probability(labelled.where(F.col("slope") >= s.min_slope))


def susceptibility(dem: DataFrame, height: int, width: int, s: Settings = Settings()) -> DataFrame:
    """r, c, ps_l: 0 for valid cells outside slope units, null for nodata."""
    return _index(staged(drainage.unit_labels(staged(drained(dem, height, width, s), "drained-cells")), "labelled"), height, width, s)


def run(dem: DataFrame, out: str, s: Settings = Settings(), intermediates: bool = True) -> None:
    """Rasters `ps_l` and, if asked for, `beta` and `flow_acc` under `out`, from a dense elevation grid; one drainage pass for all."""
    height, width = rasters.bounds(dem)
    cells = staged(drainage.unit_labels(staged(drained(dem, height, width, s), "drained-cells")), "labelled")
    if intermediates:
        rasters.write(cells.select("r", "c", F.col("beta").alias("v")), f"{out}/beta")
        rasters.write(cells.select("r", "c", F.col("acc").cast("double").alias("v")), f"{out}/flow_acc")
    rasters.write(_index(cells, height, width, s).withColumnRenamed("ps_l", "v"), f"{out}/ps_l")


def _index(cells: DataFrame, height: int, width: int, s: Settings) -> DataFrame:
    units = staged(rank.unit_maximum(rank.joint_probability(cells.where(F.col("slope") >= s.min_slope))), "units")
    out = rank.spread_units(cells, units).select("r", "c", "ps_l")
    if not s.sigma:
        return out
    smoothed = tiles.gaussian(tiles.from_cells(out, ["ps_l"], height, width, s.tile), "ps_l", height, width, s.sigma, s.mode, s.tile)
    return tiles.to_cells(smoothed, ["ps_l"])
