"""Label and factor rasters to split, paired patch tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cells import clean_factor
from ..operators import sample, tiles
from ..session import staged
from ..sources import patches as sink


def samples(labels: DataFrame, height: int, width: int, block: int = 2048, crop: int = 512, mode: str = "strict") -> DataFrame:
    """r, c, code, split of the balanced samples whose patches can be cut."""
    kept = sample.contained(sample.balanced(labels, width), height, width, block, crop, mode)
    return sample.split(kept.select("r", "c", "code"), width)


def write_patches(labels: DataFrame, factors: DataFrame, height: int, width: int, out: str, block: int = 2048, crop: int = 512, mode: str = "strict", tile: int = tiles.TILE) -> None:
    """Factor patches (r, c, band, pixels) and label patches (r, c, label) under `out`, by split and class."""
    chosen = samples(labels, height, width, block, crop, mode).withColumn("cls", F.when(F.col("code") == 1, "1").otherwise("0"))
    keys = staged(chosen.select("r", "c", "split", "cls"), "patch-keys")
    place = [F.col("patch_r").alias("r"), F.col("patch_c").alias("c")]
    clean = factors.withColumn("v", clean_factor(F.col("v")).cast("float"))
    pixels = staged(tiles.from_cells(clean, ["v"], height, width, tile, by=["band"]), "factor-tiles")
    f = sample.patch_arrays(keys, pixels, ["v"], crop, tile, by=["band"]).select(*place, "band", F.col("v").alias("pixels"))
    codes = staged(tiles.from_cells(labels, ["code"], height, width, tile), "label-tiles")
    y = sample.patch_arrays(keys, codes, ["code"], crop, tile).select(*place, F.transform("code", lambda x: x.cast("int")).alias("label"))
    sink.write(f.join(keys, ["r", "c"]), f"{out}/factors")
    sink.write(y.join(keys, ["r", "c"]), f"{out}/labels")
