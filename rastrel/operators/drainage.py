"""Drainage forests: upstream sums and terminal cells by pointer doubling, inside tiles first and then between them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import ship_package, staged, unbroadcast, unstage
from .lookup import lookup
from .terrain import D8_STEPS, NO_FLOW
from .tiles import PLACE, PLACE_KINDS, TILE, lists, tile_of, values_of

MAX_ROUNDS = 32


def accumulate(nodes: DataFrame, weights: Sequence[str]) -> DataFrame:
    """id, ptr, root and, for each weight w, acc_w: its sum over the cell and all cells that drain through it.

    After k rounds a cell's sum covers what lies less than 2**k steps upstream, and its pointer has jumped as far
    downstream. A cell whose pointer has passed its end is settled and takes no part in later rounds: others look
    up its root, and what they add to it is kept apart until one aggregate at the end. All weights and the roots
    share the rounds. Null weights count as 0. A cycle can't settle and raises. A cell that many point to is looked up
    without a gathering of these in one task.
    """
    sums = [f"acc_{w}" for w in weights]
    start = nodes.select("id", "ptr", F.col("ptr").alias("next"), F.coalesce("ptr", "id").alias("root"), *[F.coalesce(F.col(w).cast("double"), F.lit(0.0)).alias(s) for w, s in zip(weights, sums, strict=True)])
    parts = [staged(start, "drainage")]
    for _ in range(MAX_ROUNDS):
        moving = parts[-1].where("next is not null")
        if moving.isEmpty():
            break
        settled = _settled(parts).where("root is not null").select(F.col("id").alias("next"), F.lit(None).cast("long").alias("_next"), F.col("root").alias("_root"))
        ahead = moving.select(F.col("id").alias("next"), F.col("next").alias("_next"), F.col("root").alias("_root")).unionByName(settled)
        gained = staged(moving.groupBy(F.col("next").alias("id")).agg(*[F.sum(s).alias(f"_{s}") for s in sums], F.count(F.lit(1)).alias("n")), "gained")
        more = [(F.col(s) + F.coalesce(F.col(f"_{s}"), F.lit(0.0))).alias(s) for s in sums]
        found = lookup(moving, unbroadcast(ahead), ["next"], gained.select(F.col("id").alias("next"), "n"))
        jumped = found.join(unbroadcast(gained), "id", "left").select("id", "ptr", F.col("_next").alias("next"), F.col("_root").alias("root"), *more)
        none = F.lit(None).cast("long")
        late = gained.join(unbroadcast(moving.select("id")), "id", "left_anti").select("id", none.alias("ptr"), none.alias("next"), none.alias("root"), *[F.col(f"_{s}").alias(s) for s in sums])
        parts.append(staged(jumped.unionByName(late), "drainage"))
        unstage(gained)
    else:
        raise ValueError("the drainage graph has a cycle")
    out = _settled(parts).groupBy("id").agg(F.max("ptr").alias("ptr"), F.max("root").alias("root"), *[F.sum(s).alias(s) for s in sums])
    out = staged(out, "drained")
    unstage(*parts)
    return out


def _settled(parts: Sequence[DataFrame]) -> DataFrame:
    """Settled cells of all rounds, and what came late for them (without a root)."""
    return reduce(DataFrame.unionByName, [p.where("next is null") for p in parts])


# ---- tiles ---------------------------------------------------------------------------------------------------------
def _targets(d: np.ndarray, r0: int, c0: int, h: int, w: int, height: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each cell of a tile: the local index it drains to (-1: none in the tile), and the raster's (-1: none)."""
    d = d.astype(np.int64)
    steps = np.array([*D8_STEPS, (0, 0)])
    k = np.where(d == NO_FLOW, len(D8_STEPS), d)
    at = np.arange(h * w)
    r, c = at // w + steps[k, 0], at % w + steps[k, 1]
    flows = (d != NO_FLOW) & (r + r0 >= 0) & (r + r0 < height) & (c + c0 >= 0) & (c + c0 < width)
    inside = flows & (r >= 0) & (r < h) & (c >= 0) & (c < w)
    return np.where(inside, r * w + c, -1), np.where(flows, (r + r0) * width + c + c0, -1)


def _settle(ptr: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Last cell of each path within the tile, and sums (weights, cells) over each cell and all that drain through it."""
    root = np.where(ptr >= 0, ptr, np.arange(len(ptr)))
    ahead, sums = ptr.copy(), sums.copy()
    for _ in range(MAX_ROUNDS):
        on = np.flatnonzero(ahead >= 0)
        if not len(on):
            return root, sums
        to = ahead[on]
        sums += np.stack([np.bincount(to, s[on], len(ptr)) for s in sums])
        root[on], ahead[on] = root[to], ahead[to]
    raise ValueError("the drainage graph has a cycle")


def _weights(batch, row: int, weights: Sequence[str], n: int) -> np.ndarray:
    return np.stack([np.nan_to_num(values_of(batch[w], row).astype(np.float64)) if w else np.ones(n) for w in weights])


def accumulate_tiles(tiles: DataFrame, weights: Sequence[str | None], height: int, width: int, tile: int = TILE) -> DataFrame:
    """tr .. w, ptr, root (ids; ptr -1: none) and acc_0, acc_1, ... of tiles (.., dir, weights); a weight of None is 1 a cell.

    Paths are settled inside each tile first. What leaves a tile and where its border cells lead to makes a graph of
    border cells alone, on which `accumulate` doubles pointers; its sums and roots are filled back into the tiles. So
    what is shuffled in rounds is bounded by the tiles' borders, and each tile itself is shuffled once.
    """
    ship_package(tiles.sparkSession)
    n_w = len(weights)
    named = [w for w in weights if w]
    sums = [f"s{i}" for i in range(n_w)]
    edge = StructType.fromDDL("leaves boolean, id long, to long, " + ", ".join(f"{s} double" for s in sums))
    edge_schema = to_arrow_schema(edge)

    def border(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                r0, c0, h, w = (batch[p][k].as_py() for p in PLACE[2:])
                ptr, far = _targets(values_of(batch["dir"], k), r0, c0, h, w, height, width)
                root, acc = _settle(ptr, _weights(batch, k, weights, h * w))
                own = lambda i, r0=r0, c0=c0, w=w: (i // w + r0) * width + i % w + c0
                out = np.flatnonzero((ptr < 0) & (far >= 0))
                grid = np.arange(h * w).reshape(h, w)
                rim = np.unique(np.concatenate([grid[0], grid[-1], grid[:, 0], grid[:, -1]]))
                n = len(out) + len(rim)
                cols = [np.arange(n) < len(out), np.concatenate([own(out), own(rim)]), np.concatenate([far[out], own(root[rim])])]
                cols += [np.concatenate([a[out], np.zeros(len(rim))]) for a in acc]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, edge_schema, strict=True)], schema=edge_schema)

    graph = staged(tiles.select(*PLACE, "dir", *named).mapInArrow(border, edge), "tile-borders")
    leaving = graph.where("leaves").drop("leaves")
    arrive = graph.where("not leaves").select(F.col("id").alias("to"), F.col("to").alias("ptr"))
    nodes = staged(leaving.join(unbroadcast(arrive), "to"), "tile-exits")
    ends = nodes.select(F.col("ptr").alias("id")).distinct().join(unbroadcast(nodes.select("id")), "id", "left_anti")
    ends = ends.select("id", F.lit(None).cast("long").alias("ptr"), *[F.lit(0.0).alias(s) for s in sums])
    solved = accumulate(nodes.select("id", "ptr", *sums).unionByName(ends), sums)
    solved = nodes.select("id", "to").join(unbroadcast(solved.select("id", "root", *[F.col(f"acc_{s}").alias(s) for s in sums])), "id")
    solved = staged(solved, "tile-solved")
    zero = [F.lit(0.0).alias(s) for s in sums]
    news = solved.select(F.col("to").alias("id"), F.lit(None).cast("long").alias("root"), *sums).unionByName(solved.select("id", "root", *zero))
    row, col = F.expr(f"id div {width}L"), F.col("id") % width
    news = news.select(tile_of(row, tile).alias("tr"), tile_of(col, tile).alias("tc"), "id", "root", *sums)
    made = StructType.fromDDL(f"{PLACE_KINDS}, ptr array<long>, root array<long>, " + ", ".join(f"acc_{i} array<double>" for i in range(n_w)))
    made_schema = to_arrow_schema(made)

    def fill(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return made_schema.empty_table()
        tr, tc, r0, c0, h, w = (left[p][0].as_py() for p in PLACE)
        ptr, far = _targets(values_of(left["dir"], 0), r0, c0, h, w, height, width)
        start = _weights(left, 0, weights, h * w)
        ids, onward = right["id"].to_numpy(), right["root"].to_numpy().astype(np.float64)
        at = (ids // width - r0) * w + ids % width - c0
        for i, s in enumerate(sums):
            start[i] += np.bincount(at, right[s].to_numpy(), h * w)[: h * w]
        root, acc = _settle(ptr, start)
        out = (root // w + r0) * width + root % w + c0
        known = ~np.isnan(onward)
        further = np.full(h * w, -1, np.int64)
        further[at[known]] = right["root"].filter(pa.array(known)).to_numpy()
        out = np.where(further[root] >= 0, further[root], out)
        cols = [[tr], [tc], [r0], [c0], [h], [w], lists([far]), lists([out]), *[lists([a]) for a in acc]]
        return pa.Table.from_arrays([c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(cols, made_schema, strict=True)], schema=made_schema)

    return tiles.select(*PLACE, "dir", *named).groupBy("tr", "tc").cogroup(news.groupBy("tr", "tc")).applyInArrow(fill, made)


def unit_labels(cells: DataFrame) -> DataFrame:
    """Adds `label`: 1..K by rising root over cells that drain into another; cells that don't have 0.

    Ranks are taken over the distinct roots, in ranges that are numbered one by one. A large basin's cells aren't gathered.
    `cells` is read several times; stage it first.
    """
    from .rank import positions

    roots = cells.where("ptr is not null").select("root").distinct()
    numbered = staged(positions(roots, "root", "_at").select("root", (F.col("_at") + 1).cast("int").alias("_label")), "roots")
    return lookup(cells, unbroadcast(numbered), ["root"]).withColumn("label", F.when(F.col("ptr").isNotNull(), F.col("_label")).otherwise(0)).drop("_label")
