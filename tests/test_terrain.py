"""Micro-grids with hand-made answers, and an independent per-cell loop."""

import math

import numpy as np
import pytest

from rastrel.operators import drainage, rank, smooth, terrain
from rastrel.plans import morphometric


def grid(spark, rows, name="z"):
    return spark.createDataFrame([(i, j, None if v is None else float(v)) for i, row in enumerate(rows) for j, v in enumerate(row)], f"r int, c int, {name} double")


def collect(df, value, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["r"], r["c"]] = np.nan if r[value] is None else r[value]
    return out


def loop_d8(z):
    h, w = z.shape
    out = np.full((h, w), 255)
    for i in range(h):
        for j in range(w):
            if np.isnan(z[i, j]):
                continue
            best, at = 0, 255
            for k, (dr, dc) in enumerate(terrain.D8_STEPS):
                n = z[min(max(i + dr, 0), h - 1), min(max(j + dc, 0), w - 1)]
                d = np.float32(z[i, j]) - np.float32(n)
                if d > best:
                    best, at = d, k
            out[i, j] = at
    return out


def test_pit_stays(spark):
    z = terrain.jitter(grid(spark, [[9, 9, 9], [9, 1, 9], [9, 9, 9]]))
    assert collect(z, "z", (3, 3))[1, 1] < 2


def test_jitter_is_lost_on_high_ground(spark):
    low = collect(terrain.jitter(grid(spark, [[8] * 5] * 5)), "z", (5, 5))
    high = collect(terrain.jitter(grid(spark, [[500] * 5] * 5)), "z", (5, 5))
    assert len(np.unique(low)) > 1 and len(np.unique(high)) == 1


def test_ties_and_diagonals_take_the_first_direction(spark):
    z = grid(spark, [[5, 5, 5], [5, 5, 3], [5, 5, 3]]).withColumn("z", __import__("pyspark").sql.functions.col("z").cast("float"))
    assert collect(terrain.d8(z), "dir", (3, 3))[1, 1] == 2  # E before SE


@pytest.mark.parametrize("seed", range(4))
def test_d8_and_slope_against_a_loop(spark, seed):
    rng = np.random.default_rng(seed)
    h, w = [(6, 7), (1, 8), (9, 1), (5, 5)][seed]
    z = rng.integers(0, 5, (h, w)).astype(float)
    z[rng.random((h, w)) < 0.15] = np.nan
    cells = grid(spark, [[None if np.isnan(x) else x for x in row] for row in z])
    f = terrain.jitter(cells)
    zj = collect(f, "z", (h, w)).astype(np.float32)
    assert (collect(terrain.d8(f), "dir", (h, w)) == loop_d8(zj)).all()
    mirror = lambda a, n: 0 if n == 1 else (-a if a < 0 else 2 * (n - 1) - a if a >= n else a)
    at = lambda m, i, j: m[mirror(i, h), mirror(j, w)]
    filled = zj.astype(float)
    for i in range(h):
        for j in range(w):
            if np.isnan(zj[i, j]):
                around = [at(zj, i + a, j + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
                around = [x for x in around if not np.isnan(x)]
                filled[i, j] = np.mean(around, dtype=float) if around else 0
    got = collect(terrain.sobel_slope(f), "slope", (h, w))
    for i in range(h):
        for j in range(w):
            gx = sum((2 - abs(a)) * (at(filled, i + a, j + 1) - at(filled, i + a, j - 1)) for a in (-1, 0, 1)) / 8
            gy = sum((2 - abs(b)) * (at(filled, i + 1, j + b) - at(filled, i - 1, j + b)) for b in (-1, 0, 1)) / 8
            want = np.nan if np.isnan(zj[i, j]) else math.degrees(math.atan(math.hypot(gx, gy)))
            assert (np.isnan(want) and np.isnan(got[i, j])) or abs(got[i, j] - want) < 1e-4


def test_long_chain_settles_in_few_rounds(spark):
    n = 1000
    nodes = spark.range(n).selectExpr("id", "CASE WHEN id < 999 THEN id + 1 END ptr", "1.0D one")
    rows = {r["id"]: r for r in drainage.accumulate(nodes, ["one"]).collect()}
    assert all(rows[i]["acc_one"] == i + 1 and rows[i]["root"] == 999 for i in range(n))


def test_cycle_raises(spark, monkeypatch):
    monkeypatch.setattr(drainage, "MAX_ROUNDS", 4)
    with pytest.raises(ValueError):
        drainage.accumulate(spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0)], "id long, ptr long, one double"), ["one"])


def test_roots_have_label_zero_and_counts_add_up(spark):
    none = [None] * 6
    cells = morphometric.drained(grid(spark, [none, [6, 5, 4, 3, 2, 1], none]), 3, 6).persist()
    out = {r["c"]: (r["label"], r["acc"]) for r in drainage.unit_labels(cells).where("r = 1").collect()}
    assert out[5] == (0, 6) and {out[c][0] for c in range(5)} == {1}
    roots = [r["acc"] for r in cells.collect() if r["ptr"] is None]
    assert sum(roots) == 18


def test_a_tie_at_the_border_leaves_the_grid(spark):
    flow = terrain.d8(terrain.jitter(grid(spark, [[6, 5, 4, 3]])))
    assert [r["dir"] for r in flow.orderBy("c").collect()][:3] == [1, 1, 1]  # NE repeats E
    assert all(r["ptr"] is None for r in terrain.receivers(flow, 1, 4).collect())


def test_average_ranks_share_ties(spark):
    d = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 2, 2, 2, 5])], "i int, v double")
    got = {r["i"]: r["cdf"] for r in rank.average_rank_cdf(d, "v", "cdf").collect()}
    assert got == {0: 0.0, 1: 0.5, 2: 0.5, 3: 0.5, 4: 1.0}
    assert rank.average_rank_cdf(d.limit(1), "v", "cdf").first()["cdf"] == 0


def test_smoothing_counts_nodata_as_zero(spark):
    rows = [[1.0] * 7 for _ in range(7)]
    rows[3][3] = None
    z = grid(spark, rows, "v")
    strict = collect(smooth.gaussian(z, 1.0), "v", (7, 7))
    fixed = collect(smooth.gaussian(z, 1.0, "corrected"), "v", (7, 7))
    assert np.isnan(strict[3, 3]) and strict[3, 2] < 0.95 and abs(fixed[3, 2] - 1) < 1e-9
