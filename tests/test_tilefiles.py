"""Tile files: round trips, windows that leave other tiles unread, commits that are all or nothing."""

import pytest
from pyspark.sql import functions as F

from rastrel.operators import tiles
from rastrel.sources import tilefiles


def cells(spark, h, w, add=0.0):
    v = F.when((F.col("r") * 3 + F.col("c")) % 7 != 0, F.col("r") + F.col("c") / 64 + add)
    return spark.range(h * w).select((F.col("id") / w).cast("int").alias("r"), (F.col("id") % w).cast("int").alias("c")).withColumn("v", v.cast("float"))


def save(d, path, h, w, tile=4):
    tilefiles.write(tiles.from_cells(d, ["v"], h, w, tile), "v", path, h, w, tile)


def rows(d):
    return sorted(map(str, d.select("r", "c", "v").collect()))


def test_round_trip_and_overwrite(spark, tmp_path):
    path = str(tmp_path / "raster")
    d = cells(spark, 13, 10)
    save(d, path, 13, 10)
    assert rows(tilefiles.read(spark, path)) == rows(d)
    save(cells(spark, 5, 6, 2.0), path, 5, 6)
    assert rows(tilefiles.read(spark, path)) == rows(cells(spark, 5, 6, 2.0))
    assert len([p for p in (tmp_path / "raster").iterdir() if p.name.startswith("v-")]) == 1  # the old version is gone
    with pytest.raises(Exception, match="no raster"):
        tilefiles.read(spark, str(tmp_path / "none")).collect()


def test_windows_read_only_their_tiles(spark, tmp_path):
    path = str(tmp_path / "raster")
    d = cells(spark, 40, 40)
    save(d, path, 40, 40)
    version = next(p for p in (tmp_path / "raster").iterdir() if p.name.startswith("v-"))
    window = (F.col("r") >= 9) & (F.col("r") < 12) & (F.col("c") > 19) & (F.col("c") <= 23)
    for tile in version.glob("*/*.tile"):  # of the hundred tiles all but one can't be read any more
        if (tile.parent.name, tile.name) != ("2", "5.tile"):
            tile.write_bytes(b"spoilt")
    found = tilefiles.read(spark, path).where(window)
    assert rows(found) == rows(d.where(window)) and len(found.collect()) == 12
    assert found.select(F.spark_partition_id()).distinct().count() == 1
    with pytest.raises(Exception, match="not a tile"):
        tilefiles.read(spark, path).where("r < 20").collect()
    assert tilefiles.read(spark, path).where("r > 100").count() == 0


def test_a_failed_write_leaves_the_old_raster(spark, tmp_path):
    path = str(tmp_path / "raster")
    save(cells(spark, 9, 9), path, 9, 9)
    broken = tiles.from_cells(cells(spark, 9, 9, 5.0), ["v"], 9, 9, 4).withColumn("h", F.when(F.col("tr") < 2, F.col("h")).otherwise(F.raise_error("lost").cast("int")))
    with pytest.raises(Exception, match="lost"):
        tilefiles.write(broken, "v", path, 9, 9, 4)
    assert rows(tilefiles.read(spark, path)) == rows(cells(spark, 9, 9))
