"""Tile form against the row form, whatever the tiles' size."""

import random

import pytest

from rastrel.operators import drainage, smooth, terrain, tiles


def dem(spark, h, w, seed=1, low=0, high=6, holes=0.08):
    rng = random.Random(seed)
    rows = [(r, c, None if rng.random() < holes else rng.randint(low, high) / 4 + (h - r) * 0.125) for r in range(h) for c in range(w)]
    return spark.createDataFrame(rows, "r int, c int, z double"), rows


def same(got, want, digits=6):
    a, b = (sorted(tuple(-1e9 if x is None else round(x, digits) if isinstance(x, float) else x for x in r) for r in map(tuple, d.collect())) for d in (got, want))
    assert len(a) == len(b) and all(x == pytest.approx(y, abs=10**-digits * 2) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("tile", [3, 8, 64])
def test_stencils_on_tiles(spark, tile):
    d, _ = dem(spark, 21, 17)
    t = tiles.from_cells(d, ["z"], 21, 17, tile)
    got = tiles.to_cells(tiles.terrain(t, 21, 17, 2.0, 3.0, "strict", tile), ["slope", "dir"])
    z = terrain.jitter(d)
    same(got.select("r", "c", "slope"), terrain.sobel_slope(z, 2.0, 3.0), 4)
    same(got.selectExpr("r", "c", "int(dir)"), terrain.d8(z))
    for mode in ("strict", "corrected"):
        smoothed = tiles.to_cells(tiles.gaussian(t, "z", 21, 17, 2.0, mode, tile), ["z"])
        same(smoothed, smooth.gaussian(d.withColumnRenamed("z", "v"), 2.0, mode))


@pytest.mark.parametrize(("h", "w"), [(1, 9), (9, 1), (2, 2), (1, 1)])
def test_stencils_on_thin_rasters(spark, h, w):
    d, _ = dem(spark, h, w, seed=h * 10 + w, holes=0.2)
    t = tiles.from_cells(d, ["z"], h, w, 4)
    got = tiles.to_cells(tiles.terrain(t, h, w, tile=4), ["slope", "dir"])
    same(got.select("r", "c", "slope"), terrain.sobel_slope(terrain.jitter(d)), 4)
    same(got.selectExpr("r", "c", "int(dir)"), terrain.d8(terrain.jitter(d)))
    same(tiles.to_cells(tiles.gaussian(t, "z", h, w, 2.0, tile=4), ["z"]), smooth.gaussian(d.withColumnRenamed("z", "v"), 2.0))


def test_cells_come_back(spark):
    d, _ = dem(spark, 11, 7)
    same(tiles.to_cells(tiles.from_cells(d, ["z"], 11, 7, 4), ["z"]), d)
    both = d.selectExpr("r", "c", "1 as band", "z").unionByName(d.selectExpr("r", "c", "2 as band", "z + 1 as z"))
    same(tiles.to_cells(tiles.from_cells(both, ["z"], 11, 7, 4, by=["band"]), ["z"], keep=["band"]), both.select("band", "r", "c", "z"))


def chain_dem(n):
    return [(r, c, float(-(r * n + (c if r % 2 == 0 else n - 1 - c)) * 0.25)) for r in range(n) for c in range(n)]


def star_dem(n):
    m = n // 2
    return [(r, c, float(max(abs(r - m), abs(c - m)))) for r in range(n) for c in range(n)]


@pytest.mark.parametrize("kind", ["random", "chain", "star"])
def test_drainage_on_tiles(spark, kind):
    n = 20
    rows = {"random": lambda: dem(spark, n, n, seed=5)[1], "chain": lambda: chain_dem(n), "star": lambda: star_dem(n)}[kind]()
    d = spark.createDataFrame(rows, "r int, c int, z double")
    z = terrain.jitter(d)
    cells = terrain.receivers(terrain.d8(z), n, n).collect()
    ptr = {r["id"]: r["ptr"] for r in cells}
    acc, slope_sum, root = {i: 0 for i in ptr}, {i: 0.0 for i in ptr}, {}
    slopes = {r["r"] * n + r["c"]: r["slope"] or 0.0 for r in terrain.sobel_slope(z).collect()}
    for i in ptr:
        at = i
        while at is not None:
            acc[at] += 1
            slope_sum[at] += slopes[i]
            root[i], at = at, ptr[at]
    t = tiles.terrain(tiles.from_cells(d, ["z"], n, n, 6), n, n, tile=6)
    out = tiles.to_cells(drainage.accumulate_tiles(t, [None, "slope"], n, n, 6), ["ptr", "root", "acc_0", "acc_1"])
    got = {r["r"] * n + r["c"]: r for r in out.collect()}
    assert len(got) == n * n
    for i, r in got.items():
        assert (r["ptr"] if r["ptr"] >= 0 else None, r["root"], r["acc_0"]) == (ptr[i], root[i], acc[i])
        assert r["acc_1"] == pytest.approx(slope_sum[i], rel=1e-5)
