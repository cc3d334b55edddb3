"""Class positions, balancing, block and containment rules, patches, stratified splits."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..functions.cells import NON_SLIDE, SLIDE
from ..session import ship_package, staged
from .lookup import lookup
from .tiles import TILE, lists, make_table, values_of

TRAIN, VALIDATE = 0.6, 0.8


def mixing_key(r: Column, c: Column, width: int) -> Column:
    """Arithmetic hash of a position, so that any engine can repeat a seeded order."""
    return ((r.cast("long") * width + c) * 7919 + 104729) % 65537


def class_positions(labels: DataFrame) -> DataFrame:
    """r, c, code of the slide and non-slide cells."""
    return labels.where(F.col("code").isin(SLIDE, NON_SLIDE)).select("r", "c", "code")


def ranked_in_class(rows: DataFrame, width: int, keys: tuple[str, ...], parts: int = 256) -> DataFrame:
    """Adds `rank` (from 0) within `keys` in order of (mixing key, r, c), dealt over ranges of the key.

    A class may hold nearly all rows; ranges of the hash keep any one window small.
    """
    d = rows.withColumn("_key", mixing_key(F.col("r"), F.col("c"), width)).withColumn("_part", F.floor(F.col("_key") * parts / 65537).cast("int"))
    totals = d.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_part").orderBy("_key", "r", "c")
    d = d.withColumn("_in", F.row_number().over(inside) - 1).join(F.broadcast(totals), [*keys, "_part"])  # classes x parts rows
    return d.withColumn("rank", F.col("_before") + F.col("_in")).drop("_key", "_part", "_before", "_in")


def balanced(labels: DataFrame, width: int) -> DataFrame:
    """Positions of both classes; non-slide is cut to the number of slides if it is larger, in hash order. Distinct by place."""
    rows = class_positions(labels).dropDuplicates(["r", "c"])
    slides = F.broadcast(rows.agg(F.count(F.when(F.col("code") == SLIDE, 1)).alias("_slides")))  # one row
    ranked = ranked_in_class(rows, width, ("code",)).join(slides)
    return ranked.where((F.col("code") == SLIDE) | (F.col("rank") < F.col("_slides"))).select("r", "c", "code")


def contained(samples: DataFrame, height: int, width: int, block: int, crop: int, mode: str = "strict") -> DataFrame:
    """Samples whose patch lies wholly inside their block; adds block_r, block_c. An odd crop keeps none.

    corrected: the patch may cross blocks and only has to lie inside the raster.
    """
    half = crop // 2
    br, bc = (F.floor(F.col(x) / block) * block for x in "rc")
    d = samples.withColumn("block_r", br.cast("int")).withColumn("block_c", bc.cast("int"))
    even = F.lit(crop % 2 == 0)
    if mode == "corrected":
        return d.where(even & (F.col("r") >= half) & (F.col("r") + half <= height) & (F.col("c") >= half) & (F.col("c") + half <= width))
    wh, ww = F.least(F.lit(block), height - F.col("block_r")), F.least(F.lit(block), width - F.col("block_c"))
    inside = (F.col("r") - half >= F.col("block_r")) & (F.col("r") + half <= F.col("block_r") + wh) & (F.col("c") - half >= F.col("block_c")) & (F.col("c") + half <= F.col("block_c") + ww)
    return d.where(inside & even & (wh >= crop) & (ww >= crop))


def split(samples: DataFrame, width: int) -> DataFrame:
    """Adds split (train, val, test): 60, 20, 20 per cent of each class in hash order, cut at whole numbers."""
    rows = staged(samples, "samples")
    ranked = ranked_in_class(rows, width, ("code",))
    sizes = F.broadcast(rows.groupBy("code").agg(F.count(F.lit(1)).alias("_n")))  # a row for each class
    ranked = ranked.join(sizes, "code")
    name = F.when(F.col("rank") < F.floor(F.col("_n") * F.lit(TRAIN)), "train").when(F.col("rank") < F.floor(F.col("_n") * F.lit(VALIDATE)), "val").otherwise("test")
    return ranked.select("r", "c", "code", name.alias("split"))


#: Cells of the slices that are cut from one tile in one go, so that a tile with many samples is dealt over tasks.
SLICE_CELLS = 1 << 24


def patch_arrays(samples: DataFrame, pixels: DataFrame, values: Sequence[str], crop: int, tile: int = TILE, by: Sequence[str] = ()) -> DataFrame:
    """`by`, patch_r, patch_c and the row-major arrays (crop x crop) of the patches around samples (r, c).

    pixels: tiles of `tile` cells a side, `by` (say, the band) telling several of one place apart. A patch is put
    together from one slice of each tile that it touches, so slices are shuffled and not pixels; a patch within one
    tile is a slice. The samples of a tile are dealt into groups of bounded size, each with its own copy of the tile.
    Cells without a tile are NaN.
    """
    ship_package(samples.sparkSession)
    half, by = crop // 2, list(by)
    top, left = F.col("r") - half, F.col("c") - half
    touched = lambda a: F.explode(F.sequence(F.floor(a / tile).cast("int"), F.floor((a + crop - 1) / tile).cast("int")))
    want = samples.select(F.col("r").cast("int").alias("patch_r"), F.col("c").cast("int").alias("patch_c"), touched(top).alias("tr"), left.alias("_left"))
    want = staged(want.select("patch_r", "patch_c", "tr", touched(F.col("_left")).alias("tc")), "patch-slices")
    counts = staged(want.groupBy("tr", "tc").agg(F.count(F.lit(1)).alias("n")), "patch-counts")
    groups = counts.select("tr", "tc", F.ceil(F.col("n") * (crop * crop) / F.lit(SLICE_CELLS)).cast("int").alias("_groups"))
    bands = F.collect_list(F.struct(*by)) if by else F.array(F.struct(F.lit(0).alias("_")))  # a struct for each band
    info = staged(pixels.groupBy("tr", "tc").agg(bands.alias("_bands")).join(groups, ["tr", "tc"]), "patch-tiles")
    asked = lookup(want, info, ["tr", "tc"], counts).where("_groups is not null")
    group = F.pmod(F.xxhash64("patch_r", "patch_c"), F.col("_groups")).cast("int")
    asked = asked.select("tr", "tc", group.alias("_group"), "patch_r", "patch_c", F.explode("_bands").alias("_b"))
    asked = asked.select(*[F.col(f"_b.{b}").alias(b) for b in by], "tr", "tc", "_group", "patch_r", "patch_c")
    held = pixels.join(groups, ["tr", "tc"]).withColumn("_group", F.explode(F.sequence(F.lit(0), F.col("_groups") - 1)))
    held = held.select(*by, "tr", "tc", "_group", "r0", "c0", "h", "w", *values)
    kinds = ", ".join([*[f"`{b}` {pixels.schema[b].dataType.simpleString()}" for b in by], "patch_r int, patch_c int", *[f"`{v}` {pixels.schema[v].dataType.simpleString()}" for v in values]])
    piece = StructType.fromDDL(kinds + ", a int, b int, h int, w int")
    piece_schema = to_arrow_schema(piece)
    whole = StructType.fromDDL(kinds)
    whole_schema = to_arrow_schema(whole)

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return piece_schema.empty_table()
        r0, c0, h, w = (left[p][0].as_py() for p in ("r0", "c0", "h", "w"))
        arrays = [values_of(left[v], 0).reshape(h, w) for v in values]
        rows, cuts = [], [[] for _ in values]
        for r, c in zip(right["patch_r"].to_pylist(), right["patch_c"].to_pylist(), strict=True):
            t, q = r - half, c - half
            a, b, i, j = max(t, r0), min(t + crop, r0 + h), max(q, c0), min(q + crop, c0 + w)
            if a < b and i < j:
                rows.append((*[left[x][0].as_py() for x in by], r, c, a - t, i - q, b - a, j - i))
                for out, x in zip(cuts, arrays, strict=True):
                    out.append(x[a - r0 : b - r0, i - c0 : j - c0])
        if not rows:
            return piece_schema.empty_table()
        cols = [list(x) for x in zip(*rows, strict=True)]
        return make_table(piece_schema, [*cols[:-4], *[lists(x) for x in cuts], *cols[-4:]])

    def join(t: pa.Table) -> pa.Table:
        out = []
        for v in values:
            made = None
            for k in range(t.num_rows):
                x = values_of(t[v], k)
                a, b, h, w = (t[p][k].as_py() for p in ("a", "b", "h", "w"))
                if made is None:
                    made = np.full((crop, crop), np.nan if x.dtype.kind == "f" else 0, x.dtype)
                made[a : a + h, b : b + w] = x.reshape(h, w)
            out.append(lists([made]))
        return make_table(whole_schema, [*[[t[x][0].as_py()] for x in (*by, "patch_r", "patch_c")], *out])

    keys = [*by, "tr", "tc", "_group"]
    pieces = staged(held.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(cut, piece), "patch-pieces")
    full = (F.col("h") == crop) & (F.col("w") == crop)
    parts = pieces.where(~full).groupBy(*by, "patch_r", "patch_c").applyInArrow(join, whole)
    return pieces.where(full).select(whole.names).unionByName(parts)
