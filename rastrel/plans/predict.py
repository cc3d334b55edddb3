"""Factors to risk classes: overlap runs of a scorer, last writers, mask, median mosaic, statistics."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cells import clean_factor, null_nodata
from ..operators import mosaic, score, tiles, windows
from ..sources import rasters, reports

OVERLAPS = (20, 43, 71, 111, 147)


def pixel_local(factors: DataFrame, weights: Sequence[float], bias: float, mask: DataFrame | None = None) -> DataFrame:
    """Scores of a scorer that looks at one pixel: all overlap runs agree, so each pixel is scored once."""
    clean = factors.withColumn("v", clean_factor(F.col("v")))
    p = score.linear_score(clean, weights, bias)
    return mosaic.masked(p, mask, ["r", "c"], "p") if mask is not None else p


def windowed_tiles(stack: DataFrame, height: int, width: int, crop: int, overlaps: Sequence[int], load: Callable[[], Callable[[np.ndarray], np.ndarray]], num_bands: int, tile: int, masked: bool = False, present: str | None = None) -> DataFrame:
    """overlap, r, c, p of a scorer that looks at whole windows, from tiles (.., b0, b1, ...) of `tile` cells a side.

    A tile with a halo of crop - 1 cells below and to the right holds all windows that start in it, of all overlaps:
    each pixel is shuffled to its tile and the halos it lies in, not to every window. A window gives the pixels that
    it writes last; those of a tile's windows form one rectangle. `load`, run once in a task, gives a function from
    (bands, crop, crop), cleaned, in the tiles' precision, to probabilities (crop, crop). masked: null where the first
    band has no data. present: an array of the tiles that is NaN where the raster has no cell; such are left out.
    """
    count = {o: (windows.n_starts(height, crop, o), windows.n_starts(width, crop, o)) for o in overlaps}
    runs = [o for o in overlaps if min(count[o])]
    bands = [f"b{i}" for i in range(num_bands)]
    held: list[Callable[[np.ndarray], np.ndarray]] = []

    def span(start: int, size: int, n: int, stride: int, k: int) -> tuple[range, int]:
        """Starts of the windows in start .. start + size, and where the pixels that they own end."""
        first, after = -(-start // stride), min(k, -(-(start + size) // stride))
        return range(first * stride, after * stride, stride), n if after == k else after * stride

    def work(x: tiles.Halo) -> dict[str, np.ndarray]:
        if not held:
            held.append(load())
        raw = np.stack([x.arrays[b] for b in bands])
        clean = np.clip(np.nan_to_num(raw), 0, 1)
        out = {}
        for o in runs:
            rows, end = span(x.r0, x.h, height, crop - o, count[o][0])
            cols, right = span(x.c0, x.w, width, crop - o, count[o][1])
            p = np.zeros((max(0, end - rows.start) if len(rows) else 0, max(0, right - cols.start) if len(cols) else 0))
            for r in rows if p.size else ():
                for c in cols:
                    win = np.zeros((num_bands, crop, crop), raw.dtype)
                    cut = clean[:, r - x.r0 : r - x.r0 + crop, c - x.c0 : c - x.c0 + crop]
                    win[:, : cut.shape[1], : cut.shape[2]] = cut
                    h = (end if r == rows[-1] else r + crop - o) - r
                    w = (right if c == cols[-1] else c + crop - o) - c
                    p[r - rows.start : r - rows.start + h, c - cols.start : c - cols.start + w] = held[0](win)[:h, :w]
            here = lambda a, p=p, r=rows.start - x.r0, c=cols.start - x.c0: a[r : r + p.shape[0], c : c + p.shape[1]]
            if masked and p.size:
                p[np.isnan(here(raw[0]))] = np.nan
            out[f"p{o}"] = p
            if present:
                out[f"on{o}"] = ~np.isnan(here(x.arrays[present]))
        return out

    if not runs:
        return stack.sparkSession.createDataFrame([], "overlap int, r int, c int, p double")
    made = {f"p{o}": "double" for o in runs} | ({f"on{o}": "boolean" for o in runs} if present else {})
    scored = tiles.stencil(stack, [*bands, *([present] if present else [])], crop - 1, height, width, work, made, tile, before=0)
    start = lambda at, s: (F.ceil(F.col(at) / F.lit(s)) * s).cast("int")

    def wide(o: int):
        s, k = crop - o, count[o][1]
        last = F.ceil((F.col("c0") + F.col("w")) / F.lit(s)) >= k
        return (F.when(last, F.lit(width)).otherwise(F.ceil((F.col("c0") + F.col("w")) / F.lit(s)) * s) - start("c0", s)).cast("int")

    values = ["p", "on"] if present else ["p"]
    parts = F.array(*[F.struct(F.lit(o).alias("overlap"), start("r0", crop - o).alias("r0"), start("c0", crop - o).alias("c0"), wide(o).alias("w"), *[F.col(f"{v}{o}").alias(v) for v in values]) for o in runs])
    cells = tiles.to_cells(scored.select(F.explode(parts).alias("x")).select("x.*"), values, keep=["overlap"])
    return cells.where("on").drop("on") if present else cells


def windowed(factors: DataFrame, height: int, width: int, crop: int, overlaps: Sequence[int], load: Callable[[], Callable[[np.ndarray], np.ndarray]], num_bands: int, tile: int | None = None, precision: str = "float") -> DataFrame:
    """overlap, r, c, p of `windowed_tiles` for the cells r, c, f (array of bands) that are given, and no others.

    tile: two crops a side if not given. precision: float or double, of what the scorer sees.
    """
    tile = tile or 2 * crop
    bands = [f"b{i}" for i in range(num_bands)]
    flat = factors.select("r", "c", *[F.get("f", F.lit(i)).cast(precision).alias(b) for i, b in enumerate(bands)], F.lit(1).cast("float").alias("present"))
    return windowed_tiles(tiles.from_cells(flat, [*bands, "present"], height, width, tile), height, width, crop, overlaps, load, num_bands, tile, present="present")


def risk_map(maps: DataFrame, base: DataFrame | None = None, pixel: tuple[str, ...] = ("r", "c")) -> tuple[DataFrame, DataFrame]:
    """Median mosaic of overlap maps, and its risk histogram."""
    m = mosaic.median_mosaic(maps, list(pixel), "p", base)
    return m, mosaic.risk_histogram(m)


def run(factors: DataFrame, out: str, load: Callable[[], Callable[[np.ndarray], np.ndarray]], num_bands: int, crop: int = 512, overlaps: Sequence[int] = OVERLAPS, base: DataFrame | None = None, nodata: float | None = -9999.0, tile: int | None = None) -> None:
    """Factors (r, c, band, v) to `maps` (one run for each overlap), `risk` (median raster) and `risk_csv` under `out`.

    Pixels without data in the first factor are scored as zeros, where a window needs them, and masked in the maps;
    so neither the median raster nor the statistics have them. Such are null, NaN and, if given, `nodata`.
    """
    height, width = rasters.bounds(factors)
    tile = tile or 2 * crop
    known = factors.withColumn("v", null_nodata(F.col("v"), nodata))
    stack = tiles.from_bands(known, num_bands, height, width, tile)
    windowed_tiles(stack, height, width, crop, overlaps, load, num_bands, tile, masked=True).write.mode("overwrite").partitionBy("overlap").parquet(f"{out}/maps")
    median, _ = risk_map(factors.sparkSession.read.parquet(f"{out}/maps"), base)
    rasters.write(median, f"{out}/risk", value="p")
    risk = factors.sparkSession.read.parquet(f"{out}/risk").select(F.nullif(F.col("p"), F.lit(-9999.0).cast("float")).cast("double").alias("p"))
    reports.risk_csv(mosaic.risk_histogram(risk), f"{out}/risk_csv")
