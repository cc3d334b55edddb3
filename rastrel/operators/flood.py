"""Depression filling: each cell rises to the lowest height over which it can spill to the raster's border or to nodata.

The height of a spill path is its highest cell, so only paths of a minimum spanning tree matter. Trees grow by rounds in
which every component spills over its lowest edge: inside a tile on arrays, and between tiles on a table of the tiles'
border cells.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import ship_package, staged, unstage
from .lookup import lookup
from .tiles import PLACE, PLACE_KINDS, TILE, Halo, from_cells, lists, stencil, tile_of, to_cells, values_of

#: The node that all water ends in.
OCEAN = -1
MAX_ROUNDS = 64


def spill_forest(n: int, a: np.ndarray, b: np.ndarray, height: np.ndarray, sink: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each of n nodes: the highest edge on its lowest way to a sink (-inf for sinks), and that sink.

    Each round every component without a sink takes its lowest edge; edges are in one strict order, so the only cycles
    are pairs that take the same edge, which become one component. A component's lowest edge is no higher than the
    edge by which another spills into it, so a node's level is the maximum of its components' lowest edges.
    """
    order = np.lexsort((b, a, height))
    a, b, height = a[order], b[order], height[order]
    comp, level = np.arange(n), np.full(n, -np.inf)
    while True:
        ends = np.stack([a, b], 1).ravel()
        first = np.full(n, -1)
        first[ends[::-1]] = np.repeat(np.arange(len(a)), 2)[::-1]  # the last write stays: the lowest edge
        first[sink] = -1
        on = np.flatnonzero(first >= 0)
        if not len(on):
            return level, comp
        up, taken = np.arange(n), np.full(n, -np.inf)
        e = first[on]
        up[on] = np.where(a[e] == on, b[e], a[e])
        taken[on] = height[e]
        pair = on[(up[up[on]] == on) & (on < up[on])]
        up[pair] = pair
        while not np.array_equal(nxt := up[up], up):
            up = nxt
        level = np.maximum(level, taken[comp])
        comp = up[comp]
        a, b = up[a], up[b]
        left = (a != b) & ~(sink[a] & sink[b])
        a, b, height = a[left], b[left], height[left]


def _neighbours(h: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Each pair of 8-neighbours of an h x w grid once."""
    g = np.arange(h * w).reshape(h, w)
    pairs = [(g[:, :-1], g[:, 1:]), (g[:-1], g[1:]), (g[:-1, :-1], g[1:, 1:]), (g[:-1, 1:], g[1:, :-1])]
    return np.concatenate([x.ravel() for x, _ in pairs]), np.concatenate([y.ravel() for _, y in pairs])


def _rim(h: int, w: int) -> np.ndarray:
    edge = np.ones((h, w), bool)
    edge[1:-1, 1:-1] = False
    return edge


def _beside(nodata: np.ndarray) -> np.ndarray:
    """Cells with an 8-neighbour that is on; nodata has a margin of one cell all around."""
    h, w = nodata.shape[0] - 2, nodata.shape[1] - 2
    return np.logical_or.reduce([nodata[i : i + h, j : j + w] for i in range(3) for j in range(3)])


def _flooded(z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Within one tile: heights after a flood from its border cells and from nodata, each cell's sink, and the pairs of neighbours."""
    h, w = z.shape
    dry = np.isnan(z)
    sink = (_rim(h, w) | _beside(np.pad(dry, 1))).ravel()
    a, b = _neighbours(h, w)
    flat = z.ravel()
    some = ~(dry.ravel()[a] | dry.ravel()[b])
    a, b = a[some], b[some]
    level, root = spill_forest(h * w, a, b, np.maximum(flat[a], flat[b]), sink | dry.ravel())
    return np.where(np.isnan(flat), np.nan, np.maximum(flat, level)), root, a, b


def _spills(x: Halo, width: int) -> dict[str, np.ndarray]:
    """Edges between the tile's border cells, to those of other tiles and to the ocean, the lowest of each pair."""
    z = x.inner("z").astype(np.float64)
    h, w = z.shape
    local = np.arange(h * w)
    ids = (local // w + x.r0) * width + local % w + x.c0
    level, root, a, b = _flooded(z)
    rim = _rim(h, w).ravel()
    label = np.where(rim[root], ids[root], OCEAN)
    ends = [(label[a], label[b], np.maximum(level[a], level[b]))]
    grid = np.full((h + 2, w + 2), np.nan)
    on = np.zeros((h + 2, w + 2), bool)
    y, left = x.arrays["z"], 1 - x.left
    up = 1 - x.top
    grid[up : up + y.shape[0], left : left + y.shape[1]] = y
    on[up : up + y.shape[0], left : left + y.shape[1]] = True
    here = np.flatnonzero(rim & ~np.isnan(z.ravel()))
    r, c = here // w, here % w
    for dr in (-1, 0, 1):
        for dc in (-1, 0, 1):
            i, j = r + dr, c + dc
            outside = (i < 0) | (i >= h) | (j < 0) | (j >= w)
            other, there = grid[i + 1, j + 1], on[i + 1, j + 1]
            lost = np.isnan(other)  # nodata, or off the raster
            ends.append((ids[here][lost], np.full(lost.sum(), OCEAN), z.ravel()[here][lost]))
            across = outside & there & ~lost
            ends.append((ids[here][across], ((i + x.r0) * width + j + x.c0)[across], np.maximum(z.ravel()[here], other)[across]))
    p, q, e = (np.concatenate(v) for v in zip(*ends, strict=True))
    p, q = np.minimum(p, q), np.maximum(p, q)
    apart = p != q
    p, q, e = p[apart], q[apart], e[apart]
    order = np.lexsort((e, q, p))
    p, q, e = p[order], q[order], e[order]
    new = np.ones(len(p), bool)
    new[1:] = (p[1:] != p[:-1]) | (q[1:] != q[:-1])
    return {"p": p[new], "q": q[new], "e": e[new]}


def _lowest(edges: DataFrame) -> DataFrame:
    p, q = F.least("p", "q"), F.greatest("p", "q")
    return edges.where("p <> q").groupBy(p.alias("p"), q.alias("q")).agg(F.min("e").alias("e"))


def spill_levels(edges: DataFrame) -> DataFrame:
    """node, level: the lowest height over which each node of `edges` (p, q, e) reaches OCEAN; null if it can't.

    The rounds of `spill_forest` on tables: pick, jump to the roots, contract. Components at least halve each round;
    one that many nodes or edges point to is looked up without a gathering of these in one task.
    """
    edges = staged(_lowest(edges), "spills")
    nodes = edges.select(F.col("p").alias("node")).unionByName(edges.select(F.col("q").alias("node"))).where(F.col("node") != OCEAN).distinct()
    labels = staged(nodes.select("node", F.col("node").alias("comp"), F.lit(None).cast("double").alias("level")), "spill-labels")
    for _ in range(MAX_ROUNDS):
        if edges.isEmpty():
            break
        both = edges.select(F.col("p").alias("comp"), F.col("q").alias("up"), "*").unionByName(edges.select(F.col("q").alias("comp"), F.col("p").alias("up"), "*"))
        picks = both.where(F.col("comp") != OCEAN).groupBy("comp").agg(F.min(F.struct("e", "p", "q", "up")).alias("m")).select("comp", F.col("m.up").alias("up"), F.col("m.e").alias("e"))
        picks = staged(picks, "spill-picks")
        back = picks.select(F.col("comp").alias("up"), F.col("up").alias("_back"))
        roots = lookup(picks, back, ["up"]).select("comp", F.when((F.col("_back") == F.col("comp")) & (F.col("comp") < F.col("up")), F.col("comp")).otherwise(F.col("up")).alias("up"), "e", F.lit(True).alias("moved"))
        roots = staged(roots, "spill-roots", instead_of=picks)
        while not roots.where("moved").isEmpty():
            further = roots.select(F.col("comp").alias("up"), F.col("up").alias("_further"))
            jumped = lookup(roots.drop("moved"), further, ["up"])
            roots = staged(jumped.select("comp", F.coalesce("_further", "up").alias("up"), "e", (F.coalesce("_further", "up") != F.col("up")).alias("moved")), "spill-roots", instead_of=roots)
        to = roots.select("comp", "up", F.col("e").alias("_e"))
        labels = staged(lookup(labels, to, ["comp"]).select("node", F.coalesce("up", "comp").alias("comp"), F.greatest("level", "_e").alias("level")), "spill-labels", instead_of=labels)
        for end in ("p", "q"):
            moved = lookup(edges, to.select(F.col("comp").alias(end), F.col("up").alias("_up")), [end]).withColumn(end, F.coalesce("_up", end)).drop("_up")
            edges = staged(_lowest(moved) if end == "q" else moved, "spills", instead_of=edges)
        unstage(roots)
    else:
        raise RuntimeError(f"spill levels did not settle in {MAX_ROUNDS} rounds")
    return labels.select("node", F.when(F.col("comp") == OCEAN, F.col("level")).alias("level"))


def fill_tiles(tiles: DataFrame, height: int, width: int, tile: int = TILE) -> DataFrame:
    """tr .. w, z (double) of tiles of z with all depressions filled; nodata stays and takes water like the border."""
    ship_package(tiles.sparkSession)
    spills = stencil(tiles, ["z"], 1, height, width, lambda x: _spills(x, width), {"p": "long", "q": "long", "e": "double"}, tile)
    edges = spills.select(F.explode(F.arrays_zip("p", "q", "e")).alias("x")).select("x.*")
    levels = spill_levels(edges)
    row, col = F.expr(f"node div {width}L"), F.col("node") % width
    news = levels.select(tile_of(row, tile).alias("tr"), tile_of(col, tile).alias("tc"), "node", "level")
    made = StructType.fromDDL(f"{PLACE_KINDS}, z array<double>")
    schema = to_arrow_schema(made)

    def rise(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return schema.empty_table()
        tr, tc, r0, c0, h, w = (left[p][0].as_py() for p in PLACE)
        z, root, _, _ = _flooded(values_of(left["z"], 0).astype(np.float64).reshape(h, w))
        ids = right["node"].to_numpy()
        water = np.full(h * w, -np.inf)
        water[(ids // width - r0) * w + ids % width - c0] = right["level"].to_numpy(zero_copy_only=False)
        filled = np.maximum(z, water[root])  # NaN stays
        cols = [[tr], [tc], [r0], [c0], [h], [w], lists([filled])]
        return pa.Table.from_arrays([c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return tiles.select(*PLACE, "z").groupBy("tr", "tc").cogroup(news.groupBy("tr", "tc")).applyInArrow(rise, made)


def fill(dem: DataFrame, height: int, width: int, tile: int = TILE) -> DataFrame:
    """r, c, z of a cell table with all depressions filled (8 neighbours); null stays null."""
    return to_cells(fill_tiles(from_cells(dem, ["z"], height, width, tile), height, width, tile), ["z"])
