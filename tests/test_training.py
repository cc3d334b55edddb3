"""Loader, mini-batches against a single process, runs by configuration, logs, patches and windows on tiles."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rastrel.operators import loader, metrics, sample, tiles
from rastrel.plans import explain, predict, train
from rastrel.sources import catalog, config, rasters


@pytest.mark.parametrize("n", [1, 2, 7, 64, 1000])
def test_epochs_are_permutations(spark, n):
    d = spark.range(n).select(*[loader.permuted(F.col("id"), n, e, 3).alias(f"e{e}") for e in (1, 2)]).collect()
    for e in ("e1", "e2"):
        assert sorted(r[e] for r in d) == list(range(n))
    if n > 60:
        moved = [abs(r["e1"] - i) for i, r in enumerate(d)]
        assert [r["e1"] for r in d] != [r["e2"] for r in d] and np.mean(moved) > n / 5


def test_batches(spark):
    rows = loader.indexed(spark.createDataFrame([(k,) for k in random.Random(1).sample(range(1000), 50)], "key long"), "key")
    plain = loader.batches(rows, 50, 8).collect()
    assert [r["index"] for r in sorted(plain, key=lambda r: r["key"])] == list(range(50)) and max(r["batch"] for r in plain) == 6
    shuffled = loader.batches(rows, 50, 8, epoch=2, seed=1, drop_last=True).collect()
    assert sorted(r["place"] for r in shuffled) == list(range(48))


def rows_of(spark, n, seed=0):
    rng = random.Random(seed)
    rows = [(i, [rng.random(), rng.random()]) for i in range(n)]
    return [(k, f, -1 if k % 7 == 3 else int(f[0] + 0.2 * f[1] > 0.6)) for k, f in rows]


def test_minibatches_against_one_process(spark):
    rows = rows_of(spark, 45)
    d = spark.createDataFrame(rows, "key long, f array<double>, y long")
    fit = train.fit_batches(d.repartition(3), d, 2, size=8, epochs=3, rate=0.05, seed=4)
    w, m1, m2, steps = np.zeros(3), np.zeros(3), np.zeros(3), 0
    for epoch in (1, 2, 3):
        place = {r["id"]: r["p"] for r in spark.range(45).select("id", loader.permuted(F.col("id"), 45, epoch, 4).alias("p")).collect()}
        order = sorted(range(45), key=place.get)
        losses = []
        for lo in range(0, 40, 8):
            some = [rows[i] for i in order[lo : lo + 8] if rows[i][2] >= 0]
            x, y = np.array([[*f, 1.0] for _, f, _ in some]), np.array([t for _, _, t in some])
            p = 1 / (1 + np.exp(-x @ w))
            losses.append(-np.log(np.where(y == 1, p, 1 - p)).mean())
            g = (p - y) @ x / len(y)
            steps += 1
            m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
            w = w - 0.05 * (m1 / (1 - 0.9**steps)) / (np.sqrt(m2 / (1 - 0.999**steps)) + 1e-8)
        assert fit.log[epoch - 1][1] == pytest.approx(np.mean(losses))
    assert fit.last == pytest.approx(w.tolist())
    spread = train.fit_batches(d, d, 2, size=4, epochs=8, rate=0.1, workers=3)
    assert spread.log[-1][1] < spread.log[0][1] and max(f1 for _, _, f1, _ in spread.log) > 0.7


def test_a_run_by_configuration(spark, tmp_path):
    d = spark.createDataFrame(rows_of(spark, 60), "key long, f array<double>, y long")
    values = {"train_output": str(tmp_path), "num_epochs": "4", "lr": "0.1", "patience": "9", "batch_size": "8", "num_bands": "2"}
    params = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(values.items())], "position long, name string, value string")
    zero = train.test(d, str(tmp_path)).first()  # before there are weights
    assert zero["n"] == 0 and zero["f1"] == zero["accuracy"] == 0.0
    tested = train.run(params, {"train": d, "val": d, "test": d}).first()
    log = spark.read.parquet(f"{tmp_path}/log").orderBy("epoch").collect()
    assert [r["epoch"] for r in log] == [1, 2, 3, 4] and tested["n"] == sum(1 for r in rows_of(spark, 60) if r[2] >= 0)
    assert tested["f1"] == pytest.approx(max(r["f1"] for r in log))
    with pytest.raises(KeyError):
        train.run(params.where("name <> 'lr'"), {})
    factors = spark.createDataFrame([(r, c, b, (r + c + b) / 9) for r in range(4) for c in range(4) for b in range(2)], "r int, c int, band int, v double")
    files = spark.createDataFrame([("", "Slope.tif"), ("", "ndvi.tif")], "dir string, name string")
    ranked = explain.run(params, factors, files, F.col("r") < 2, f"{tmp_path}/out", (1, 1), 2).orderBy("rank").collect()
    assert sorted(r["name"] for r in ranked) == ["NDVI", "Slope"] and sum(r["importance"] for r in ranked) == pytest.approx(1)
    assert spark.read.parquet(f"{tmp_path}/out/local").count() == 8 and spark.read.parquet(f"{tmp_path}/out/decision").count() == 2
    with pytest.raises(FileNotFoundError):
        explain.run(params.withColumn("value", F.when(F.col("name") == "train_output", f"{tmp_path}/none").otherwise(F.col("value"))), factors, files, F.col("r") < 2, f"{tmp_path}/out2")


def test_observed_metrics_are_logged(spark, tmp_path):
    d = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0), (-1, 1)], "y int, pred int")
    rows, seen = metrics.observed(d)
    rows.write.format("noop").mode("overwrite").save()
    made = metrics.append_log(spark, str(tmp_path / "log"), "r", 1, seen, 0.5)
    want = metrics.binary_metrics(d).first()
    got = spark.read.parquet(str(tmp_path / "log")).first()
    assert made["f1"] == want["f1"] and all(got[k] == want[k] for k in ("n", "tp", "fp", "fn", "tn", "precision", "recall", "accuracy")) and got["loss"] == 0.5


def test_patches_from_slices(spark, monkeypatch):
    h, w, crop = 23, 20, 6
    grid = np.arange(h * w, dtype=float).reshape(h, w)
    cells = spark.createDataFrame([(r, c, b, float(grid[r, c] + 1000 * b)) for r in range(h) for c in range(w) for b in (0, 1)], "r int, c int, band int, v double")
    places = [(r, c) for r in range(3, h - 2) for c in range(3, w - 2)] + [(0, 0), (h - 1, w - 1)]
    samples = spark.createDataFrame(places, "r int, c int")
    for tile, cap in ((4, 1 << 24), (7, 150), (64, 400)):  # many groups for one tile, too
        monkeypatch.setattr(sample, "SLICE_CELLS", cap)
        t = tiles.from_cells(cells, ["v"], h, w, tile, by=["band"])
        got = {(r["band"], r["patch_r"], r["patch_c"]): np.array(r["v"]).reshape(crop, crop) for r in sample.patch_arrays(samples, t, ["v"], crop, tile, by=["band"]).collect()}
        assert len(got) == 2 * len(places)
        padded = np.pad(grid, crop, constant_values=np.nan)
        for (b, r, c), v in got.items():
            want = padded[r - 3 + crop : r + 3 + crop, c - 3 + crop : c + 3 + crop] + 1000 * b
            assert np.array_equal(v, want, equal_nan=True)


def test_windows_do_not_depend_on_tiles(spark):
    rng = np.random.default_rng(2)
    d = spark.createDataFrame([(i, j, [float(v) for v in rng.random(2)]) for i in range(11) for j in range(9)], "r int, c int, f array<double>")
    load = lambda: lambda a: a.sum(0) / 10 + a.mean()
    runs = [{(r["overlap"], r["r"], r["c"]): r["p"] for r in predict.windowed(d, 11, 9, 4, [1, 2, 10], load, 2, tile).collect()} for tile in (3, 5, 32)]
    assert len(runs[0]) == 2 * 99 and runs[0] == pytest.approx(runs[1]) and runs[0] == pytest.approx(runs[2])


def test_pixels_without_data_are_masked(spark, tmp_path):
    gone = {(r, c) for r in range(12) for c in range(12) if (r * 5 + c) % 6 == 0}
    odd = {p: v for p, v in zip(sorted(gone), [None, float("nan"), -9999.0] * 8, strict=True)}
    rows = [(r, c, b, odd[r, c] if b == 0 and (r, c) in gone else (r + c + b) / 30) for r in range(12) for c in range(12) for b in (0, 1)]
    d = spark.createDataFrame(rows, "r int, c int, band int, v double")
    predict.run(d, str(tmp_path), lambda: lambda x: x.mean(0), 2, 4, [1, 2])
    maps = spark.read.parquet(f"{tmp_path}/maps").where("p is null").select("r", "c").distinct().collect()
    assert {(r["r"], r["c"]) for r in maps} == gone
    counts = spark.read.option("header", True).csv(f"{tmp_path}/risk_csv").collect()
    assert sum(int(r["Pixel Count"]) for r in counts) == 120
    assert spark.read.parquet(f"{tmp_path}/risk").where("p = -9999").count() == 24


def test_patches_may_cross_blocks_in_corrected_mode(spark):
    s = spark.createDataFrame([(32, 32, 1), (3, 9, 1), (60, 60, 1), (61, 9, 1)], "r int, c int, code int")
    places = lambda mode: {(r["r"], r["c"]) for r in sample.contained(s, 64, 64, 32, 8, mode).collect()}
    assert places("corrected") == {(32, 32), (60, 60)} and places("strict") == {(60, 60)}


def test_alignment_and_listings(spark, tmp_path):
    meta = spark.createDataFrame([("a", 3, 4, "x"), ("b", 3, 4, "x"), ("c", 3, 5, "x"), ("d", 3, 4, None)], "raster string, height int, width int, crs string")
    assert [r["raster"] for r in rasters.check_alignment(meta).orderBy("raster").collect()] == ["c", "d"]
    (tmp_path / "Slope").mkdir()
    for name in ("Slope/a.tif", "z.txt"):
        (tmp_path / name).write_bytes(b"x")
    assert {(r["dir"], r["name"]) for r in catalog.listing(spark, str(tmp_path)).collect()} == {("Slope", "a.tif"), ("", "z.txt")}
    params = spark.createDataFrame([(0, "a", "1"), (1, "b", "2"), (2, "a", "3")], "position long, name string, value string")
    assert sorted(map(tuple, config.projected(params, ["b", "z", "a"]).collect())) == [(0, "2"), (2, "1")]
