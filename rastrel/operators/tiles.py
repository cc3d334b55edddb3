"""Rasters as tiles: one row holds the arrays of a tile; stencils get a halo by an exchange of edge strips alone."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import ship_package
from .smooth import kernel
from .terrain import D8_PLACES, NO_FLOW

TILE = 512
PLACE = ["tr", "tc", "r0", "c0", "h", "w"]
PLACE_KINDS = "tr int, tc int, r0 int, c0 int, h int, w int"
#: NumPy's names of the border rules: `mirror` repeats the cell inside the edge, `edge` the edge, `reflect` the edge and what is inside it.
BORDERS = {"mirror": "reflect", "edge": "edge", "reflect": "symmetric"}


def tile_of(position: Column, tile: int) -> Column:
    return F.floor(position / tile).cast("int")


def extent(k: int, n: int, tile: int) -> tuple[int, int]:
    """Start and length of the k-th tile along an axis of n cells."""
    return k * tile, min(tile, n - k * tile)


def lists(arrays: Sequence[np.ndarray]) -> pa.Array:
    """Arrow lists, one for each array."""
    flat = [np.ascontiguousarray(a).ravel() for a in arrays]
    ends = np.concatenate([[0], np.cumsum([len(a) for a in flat])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(flat) if flat else np.zeros(0)))


def values_of(column: pa.ChunkedArray | pa.Array, k: int) -> np.ndarray:
    """The k-th list of an Arrow column as an array."""
    return column[k].values.to_numpy(zero_copy_only=False)


def make_table(schema: pa.Schema, columns: list) -> pa.Table:
    """Columns (lists of values or Arrow arrays) as a table of `schema`."""
    return pa.Table.from_arrays([c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def from_cells(cells: DataFrame, values: Sequence[str], height: int, width: int, tile: int = TILE, by: Sequence[str] = ()) -> DataFrame:
    """`by`, tr, tc, r0, c0, h, w and an array (row-major, double or float as the column is) for each of `values`.

    Each cell is shuffled once, to its tile. Null and absent cells are NaN. `by` tells rasters or bands apart.
    """
    ship_package(cells.sparkSession)
    kinds = {v: "float" if cells.schema[v].dataType.simpleString() == "float" else "double" for v in values}
    rows = cells.select(*by, tile_of(F.col("r"), tile).alias("tr"), tile_of(F.col("c"), tile).alias("tc"), F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), *[F.col(v).cast(k).alias(v) for v, k in kinds.items()])
    lead = [f"`{b}` {cells.schema[b].dataType.simpleString()}" for b in by]
    out = StructType.fromDDL(", ".join([*lead, PLACE_KINDS, *[f"`{v}` array<{k}>" for v, k in kinds.items()]]))
    schema = to_arrow_schema(out)

    def pack(t: pa.Table) -> pa.Table:
        tr, tc = t["tr"][0].as_py(), t["tc"][0].as_py()
        (r0, h), (c0, w) = extent(tr, height, tile), extent(tc, width, tile)
        at = (t["r"].to_numpy() - r0) * w + t["c"].to_numpy() - c0
        arrays = []
        for v, k in kinds.items():
            a = np.full(h * w, np.nan, np.float32 if k == "float" else np.float64)
            a[at] = t[v].to_numpy()
            arrays.append(lists([a]))
        return make_table(schema, [*[[t[b][0].as_py()] for b in by], [tr], [tc], [r0], [c0], [h], [w], *arrays])

    return rows.groupBy(*by, "tr", "tc").applyInArrow(pack, out)


def from_bands(factors: DataFrame, num_bands: int, height: int, width: int, tile: int = TILE) -> DataFrame:
    """tr .. w and arrays b0, b1, ... (float) of rows (r, c, band, v): all bands of a tile in one row, each cell shuffled once."""
    ship_package(factors.sparkSession)
    rows = factors.select(tile_of(F.col("r"), tile).alias("tr"), tile_of(F.col("c"), tile).alias("tc"), F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), F.col("band").cast("int").alias("band"), F.col("v").cast("float").alias("v"))
    out = StructType.fromDDL(", ".join([PLACE_KINDS, *[f"b{i} array<float>" for i in range(num_bands)]]))
    schema = to_arrow_schema(out)

    def pack(t: pa.Table) -> pa.Table:
        tr, tc = t["tr"][0].as_py(), t["tc"][0].as_py()
        (r0, h), (c0, w) = extent(tr, height, tile), extent(tc, width, tile)
        a = np.full((num_bands, h * w), np.nan, np.float32)
        a[t["band"].to_numpy(), (t["r"].to_numpy() - r0) * w + t["c"].to_numpy() - c0] = t["v"].to_numpy()
        return make_table(schema, [[tr], [tc], [r0], [c0], [h], [w], *[lists([x]) for x in a]])

    return rows.groupBy("tr", "tc").applyInArrow(pack, out)


def to_cells(tiles: DataFrame, values: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """`keep`, r, c and each value of the tiles' cells, by expressions; NaN becomes null."""
    d = tiles.select(*keep, "r0", "c0", "w", F.posexplode(F.arrays_zip(*values)).alias("_at", "_v"))
    real = lambda v: tiles.schema[v].dataType.elementType.simpleString() in ("float", "double")
    out = [F.when(~F.isnan(f"_v.{v}"), F.col(f"_v.{v}")).alias(v) if real(v) else F.col(f"_v.{v}").alias(v) for v in values]
    return d.select(*keep, (F.col("r0") + F.expr("_at div w")).cast("int").alias("r"), (F.col("c0") + F.col("_at") % F.col("w")).cast("int").alias("c"), *out)


@dataclass
class Halo:
    """A tile (place, h, w) and what lies around it: arrays of the cells within `halo` of it that are on the raster."""

    r0: int
    c0: int
    h: int
    w: int
    halo: int
    top: int
    left: int
    arrays: dict[str, np.ndarray]

    def padded(self, name: str, border: str) -> np.ndarray:
        """(h + 2 halo, w + 2 halo): off-raster cells by the border rule."""
        a, n = self.arrays[name], self.halo
        up, low = n - self.top, self.h + n + self.top - a.shape[0]
        left, right = n - self.left, self.w + n + self.left - a.shape[1]
        return np.pad(a, ((up, max(0, low)), (left, max(0, right))), BORDERS[border])

    def inner(self, name: str) -> np.ndarray:
        return self.arrays[name][self.top : self.top + self.h, self.left : self.left + self.w]


def _strips(names: Sequence[str], schema: pa.Schema, before: int, after: int, height: int, width: int, tile: int):
    """Each tile to itself, and the strips of it that lie in other tiles' halos to these."""
    far_b, far_a = -(-before // tile), -(-after // tile)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {n: batch.schema.get_field_index(n) for n in batch.schema.names}
            for k in range(batch.num_rows):
                tr, tc, r0, c0, h, w = (batch.column(at[p])[k].as_py() for p in PLACE)
                bodies = [values_of(batch.column(at[n]), k).reshape(h, w) for n in names]
                rest = [[], [], [], [], [], [], *[[] for _ in names]]
                for i in range(tr - far_a, tr + far_b + 1):
                    for j in range(tc - far_a, tc + far_b + 1):
                        (i0, ih), (j0, jw) = extent(i, height, tile), extent(j, width, tile)
                        if i < 0 or j < 0 or ih <= 0 or jw <= 0:
                            continue
                        a, b = max(r0, i0 - before), min(r0 + h, i0 + ih + after)
                        c, d = max(c0, j0 - before), min(c0 + w, j0 + jw + after)
                        if a < b and c < d:
                            cut = [x[a - r0 : b - r0, c - c0 : d - c0] for x in bodies]
                            for col, v in zip(rest, [i, j, a, c, b - a, d - c, *cut], strict=True):
                                col.append(v)
                lead = [pa.array(x, pa.int32()) for x in rest[:6]]
                yield pa.RecordBatch.from_arrays([*lead, *[lists(x).cast(f.type) for x, f in zip(rest[6:], list(schema)[6:], strict=True)]], schema=schema)

    return run


def stencil(tiles: DataFrame, values: Sequence[str], halo: int, height: int, width: int, work: Callable[[Halo], dict[str, np.ndarray]], out: dict[str, str], tile: int = TILE, before: int | None = None) -> DataFrame:
    """tr .. w and the arrays that `work` gives for each tile with its halo: `out` names them and their element types.

    What is shuffled is each tile once and its edge strips (halo wide) once for each neighbour. before: another width
    of the halo above and to the left (0: none). A task holds one tile with its halo at a time.
    """
    ship_package(tiles.sparkSession)
    before = halo if before is None else before
    kinds = [(v, tiles.schema[v].dataType.simpleString()) for v in values]
    pieces = StructType.fromDDL(", ".join([PLACE_KINDS, *[f"`{v}` {k}" for v, k in kinds]]))
    made = StructType.fromDDL(", ".join([PLACE_KINDS, *[f"`{n}` array<{k}>" for n, k in out.items()]]))
    schema = to_arrow_schema(made)
    sent = tiles.select(*PLACE, *values).mapInArrow(_strips(values, to_arrow_schema(pieces), before, halo, height, width, tile), pieces)

    def assemble(t: pa.Table) -> pa.Table:
        tr, tc = t["tr"][0].as_py(), t["tc"][0].as_py()
        (r0, h), (c0, w) = extent(tr, height, tile), extent(tc, width, tile)
        a, c = max(0, r0 - before), max(0, c0 - before)
        b, d = min(height, r0 + h + halo), min(width, c0 + w + halo)
        arrays: dict[str, np.ndarray] = {}
        for v in values:
            for k in range(t.num_rows):
                x = values_of(t[v], k)
                if v not in arrays:
                    arrays[v] = np.full((b - a, d - c), np.nan if x.dtype.kind == "f" else 0, x.dtype)
                r, q, n, m = (t[p][k].as_py() for p in ("r0", "c0", "h", "w"))
                arrays[v][r - a : r - a + n, q - c : q - c + m] = x.reshape(n, m)
        made = work(Halo(r0, c0, h, w, halo, r0 - a, c0 - c, arrays))
        return make_table(schema, [[tr], [tc], [r0], [c0], [h], [w], *[lists([made[n]]) for n in out]])

    return sent.groupBy("tr", "tc").applyInArrow(assemble, made)


# ---- stencils ------------------------------------------------------------------------------------------------------
def _around(a: np.ndarray, h: int, w: int, at: int = 0) -> list[np.ndarray]:
    """The nine neighbours (row-major) of the h x w cells that start at (at + 1, at + 1)."""
    return [a[at + i : at + i + h, at + j : at + j + w] for i in range(3) for j in range(3)]


def jittered(z: np.ndarray, r0: int, c0: int) -> np.ndarray:
    """Single precision with the flat-breaking trend of the raster's own rows and columns."""
    r, c = np.arange(r0, r0 + z.shape[0])[:, None], np.arange(c0, c0 + z.shape[1])
    return (z.astype(np.float64) + (r + 2 * c) % 8 * 1e-6).astype(np.float32)


def slope_of(z: np.ndarray, h: int, w: int, dx: float, dy: float) -> np.ndarray:
    """Sobel slope in degrees; z is padded by 2. Nodata is filled by the mean of its valid neighbours, 0 without any."""
    z = z.astype(np.float64)
    near = _around(z, h + 2, w + 2)
    n = sum((~np.isnan(x)).astype(np.int64) for x in near)
    total = sum(np.nan_to_num(x) for x in near)
    f = np.where(np.isnan(near[4]), total / np.maximum(n, 1), near[4])
    m = _around(f, h, w)
    gx = ((m[2] + 2 * m[5] + m[8]) - (m[0] + 2 * m[3] + m[6])) / (8.0 * abs(dx))
    gy = ((m[6] + 2 * m[7] + m[8]) - (m[0] + 2 * m[1] + m[2])) / (8.0 * abs(dy))
    slope = np.degrees(np.arctan(np.sqrt(gx * gx + gy * gy))).astype(np.float32)
    return np.where(np.isnan(z[2 : 2 + h, 2 : 2 + w]), np.float32(np.nan), slope)


def direction_of(z: np.ndarray, h: int, w: int, at: int, mode: str) -> np.ndarray:
    """D8 codes; z is padded by at + 1."""
    near = _around(z, h, w, at)
    drops = np.empty((8, h, w), np.float32)
    for k, place in enumerate(D8_PLACES):
        drops[k] = near[4] - near[place]
        if mode == "corrected" and k % 2:
            drops[k] *= np.float32(2**-0.5)
    drops[np.isnan(drops)] = -np.inf
    best = drops.argmax(0)
    return np.where(drops.max(0) > 0, best, NO_FLOW).astype(np.int16)


def terrain(tiles: DataFrame, height: int, width: int, dx: float = 1.0, dy: float = 1.0, mode: str = "strict", tile: int = TILE) -> DataFrame:
    """tr .. w, slope (float, NaN where nodata) and dir (smallint) of tiles of z: one exchange of strips for both."""

    def work(x: Halo) -> dict[str, np.ndarray]:
        x.arrays["z"] = jittered(x.arrays["z"], x.r0 - x.top, x.c0 - x.left)
        return {"slope": slope_of(x.padded("z", "mirror"), x.h, x.w, dx, dy), "dir": direction_of(x.padded("z", "edge"), x.h, x.w, 1, mode)}

    return stencil(tiles, ["z"], 2, height, width, work, {"slope": "float", "dir": "smallint"}, tile)


def gaussian(tiles: DataFrame, value: str, height: int, width: int, sigma: float = 2.0, mode: str = "strict", tile: int = TILE) -> DataFrame:
    """tr .. w and the smoothed value (double); nodata stays. strict: nodata counts as 0. corrected: weights of valid cells only."""
    taps = np.array(kernel(sigma))
    radius = len(taps) // 2

    def both(a: np.ndarray, h: int, w: int) -> np.ndarray:
        rows = sum(t * a[:, k : k + w] for k, t in enumerate(taps))
        return sum(t * rows[k : k + h] for k, t in enumerate(taps))

    def work(x: Halo) -> dict[str, np.ndarray]:
        v = x.padded(value, "reflect").astype(np.float64)
        s = both(np.nan_to_num(v), x.h, x.w)
        if mode == "corrected":
            with np.errstate(invalid="ignore", divide="ignore"):
                s = s / both((~np.isnan(v)).astype(np.float64), x.h, x.w)
        return {value: np.where(np.isnan(x.inner(value)), np.nan, s)}

    return stencil(tiles, [value], radius, height, width, work, {value: "double"}, tile)
