import numpy as np
import pytest
from pyspark.sql import functions as F

from rastrel.operators import attrib, metrics, mosaic, sample, windows
from rastrel.plans import predict, prepare
from rastrel.sources import config, patches, rasters, reports, weights


def test_blocks_and_odd_crops(spark):
    s = spark.createDataFrame([(4, 4, 1), (28, 28, 1), (31, 10, 1), (32, 10, 2), (36, 36, 2)], "r int, c int, code int")
    assert {(r["r"], r["c"]) for r in sample.contained(s, 64, 64, 32, 8).collect()} == {(4, 4), (28, 28), (36, 36)}
    assert sample.contained(s, 64, 64, 32, 7).count() == 0


def test_overlaps_keep_the_last_writer(spark):
    w = windows.prediction_windows(spark, 10, 9, 4, [1, 2]).collect()
    for o in (1, 2):
        own = {}
        for r in sorted((x for x in w if x["overlap"] == o), key=lambda x: (x["r"], x["c"])):
            for i in range(r["r"], r["r"] + r["h"]):
                for j in range(r["c"], r["c"] + r["w"]):
                    own[i, j] = (r["r"], r["c"])
        cells = spark.createDataFrame([(i, j) for i in range(10) for j in range(9)], "r int, c int")
        got = cells.select("r", "c", windows.owner(F.col("r"), 10, 4, o).alias("a"), windows.owner(F.col("c"), 9, 4, o).alias("b")).collect()
        assert {(x["r"], x["c"]): (x["a"], x["b"]) for x in got} == own


def test_windowed_scorer_sees_whole_windows(spark):
    h, w, crop = 7, 6, 4
    rng = np.random.default_rng(0)
    x = rng.random((2, h, w))
    d = spark.createDataFrame([(i, j, [float(v) for v in x[:, i, j]]) for i in range(h) for j in range(w)], "r int, c int, f array<double>")
    load = lambda: lambda a: a.sum(0) / 10 + a.mean()
    got = {(r["r"], r["c"]): r["p"] for r in predict.windowed(d, h, w, crop, [1], load, 2).collect()}
    want = np.zeros((h, w))
    for r in range(0, h - 1, 3):
        for c in range(0, w - 1, 3):
            pad = np.zeros((2, crop, crop), np.float32)
            cut = x[:, r : r + crop, c : c + crop]
            pad[:, : cut.shape[1], : cut.shape[2]] = cut
            want[r : r + crop, c : c + crop] = load()(pad)[: cut.shape[1], : cut.shape[2]]
    assert all(abs(want[k] - v) < 1e-5 for k, v in got.items()) and len(got) == h * w


def test_risk_edges(spark):
    d = spark.createDataFrame([(x,) for x in (0.0, 0.2, 0.8, 1.0, 1.1, -0.1, None, float("nan"))], "p double")
    got = {r["risk_level"]: (r["pixel_count"], r["percentage"]) for r in mosaic.risk_histogram(d).collect()}
    assert got["Very Low"] == (1, pytest.approx(100 / 6)) and got["Very High"][0] == 2 and got["Medium"][0] == 0


def test_metrics_without_positives(spark):
    r = metrics.binary_metrics(spark.createDataFrame([(0, 0), (-1, 1)], "y int, pred int")).first()
    assert (r["n"], r["precision"], r["recall"], r["f1"], r["accuracy"]) == (1, 0, 0, 0, 1)


def test_early_stop_and_rate(spark):
    log = spark.createDataFrame(list(enumerate([0.1, 0.3, 0.2, 0.3, 0.1, 0.9], 1)), "epoch int, f1 double")
    rows = metrics.best_epoch(log, patience=3).orderBy("epoch").collect()
    assert [r["epoch"] for r in rows] == [1, 2, 3, 4, 5] and rows[-1]["best_epoch"] == 2
    flat = spark.createDataFrame([(i, 0.5) for i in range(1, 9)], "epoch int, f1 double")
    rates = [r["rate"] for r in metrics.learning_rates(flat).orderBy("epoch").collect()]
    assert rates[-2:] == [5e-5, 5e-5]
    two = flat.withColumn("run", F.lit("a")).unionByName(log.withColumn("run", F.lit("b")))
    got = {}
    for r in metrics.learning_rates(two, patience=1, by=["run"]).orderBy("epoch").collect():
        got.setdefault(r["run"], []).append(r["rate"])
    for run, values in (("a", [0.5] * 8), ("b", [0.1, 0.3, 0.2, 0.3, 0.1, 0.9])):
        schedule = metrics.Plateau(patience=1)
        assert got[run] == [schedule.step(v) for v in values]


def test_patch_tables(spark, tmp_path):
    labels = spark.createDataFrame([(i, j, 1 if (i + j) % 5 == 0 else 2) for i in range(16) for j in range(16)], "r int, c int, code int")
    factors = labels.select("r", "c", F.explode(F.array(F.lit(0), F.lit(1))).alias("band")).withColumn("v", F.col("r") / 20 + F.col("band"))
    prepare.write_patches(labels, factors, 16, 16, str(tmp_path), block=16, crop=4)
    d = patches.read(spark, f"{tmp_path}/factors", f"{tmp_path}/labels", "train")
    r = d.first()
    assert len(r["pixels"]) == 16 and set(r["label"]) <= {0, 1} and max(r["pixels"]) <= 1


def test_config_and_sinks(spark, tmp_path):
    x = tmp_path / "c.xml"
    x.write_text("<tool><param><name>a</name><type>int</type><value>3</value></param><param><name>b</name><type>list</type><value>[1, 2]</value></param><param><name>a</name><type>int</type><value>4</value></param></tool>")
    params = config.read(spark, str(x))
    assert config.project(params, ["b", "a"]) == ["[1, 2]", "3"]
    with pytest.raises(KeyError):
        config.project(params, ["zz"])
    rasters.write(spark.createDataFrame([(0, 0, 1.5), (0, 1, None)], "r int, c int, v double"), str(tmp_path / "r"))
    assert {r["v"] for r in rasters.read(spark, str(tmp_path / "r"), (0, 1, 0, 2)).collect()} == {1.5, -9999.0}
    weights.write(spark, {"module.a": np.eye(2)}, str(tmp_path / "w"))
    assert (weights.read(spark, str(tmp_path / "w"))["a"] == np.eye(2)).all()
    reports.risk_csv(mosaic.risk_histogram(spark.createDataFrame([(0.1,)], "p double")), str(tmp_path / "csv"))
    assert "Very Low,1,100.00%" in "".join(f.read_text() for f in (tmp_path / "csv").glob("*.csv"))


def test_first_slide_and_crop(spark):
    none = spark.createDataFrame([(1, 0, True), (2, 0, False)], "batch long, pos long, has_slide boolean")
    r = attrib.first_slide_sample(none).first()
    assert (r["batch"], r["pos"], r["found"]) == (1, 0, False)
    px = spark.createDataFrame([(i, j) for i in range(8) for j in range(8)], "dr int, dc int")
    assert attrib.center_crop(px, 8, 8, 4).agg(F.min("dr"), F.max("dr")).first() == (2, 5)
