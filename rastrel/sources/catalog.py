"""Discovery of factor and label files from a listing (dir, name), as relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def listing(spark: SparkSession, root: str) -> DataFrame:
    """dir ('' for the root itself) and name of each file in `root` and its sub-directories, by Spark's own file source."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    tail = F.regexp_extract("path", rf"{root.rstrip('/').rsplit('/', 1)[-1]}/(.*)$", 1)
    parts = F.split(tail, "/")
    return files.select(F.when(F.size(parts) > 1, parts[0]).otherwise("").alias("dir"), F.element_at(parts, -1).alias("name"))


def factor_files(files: DataFrame, nested: bool = True) -> DataFrame:
    """band, dir, name: `.tif` files of the root by name, else (nested) the first of each sub-directory by name."""
    tif = files.where(F.col("name").endswith(".tif"))
    direct = tif.where("dir = ''")
    found = direct
    if nested and direct.isEmpty():
        found = tif.where("dir <> ''").groupBy("dir").agg(F.min("name").alias("name"))
    out = found.select((F.row_number().over(Window.orderBy("dir", "name")) - 1).alias("band"), "dir", "name")  # one row for each band
    if nested and out.isEmpty():
        raise FileNotFoundError("no factor files")
    return out


def label_file(files: DataFrame) -> DataFrame:
    """The label raster: the first `.tif` by name."""
    return files.where(F.col("name").endswith(".tif")).agg(F.min("name").alias("name"))


def raw_names(files: DataFrame) -> DataFrame:
    """band, raw: names without extension of the root's `.tif` files in order; of its `.tiff` files if it has no `.tif`."""
    root = files.where("dir = ''").withColumn("_second", F.col("name").endswith(".tiff")).where(F.col("_second") | F.col("name").endswith(".tif"))
    first = root.agg(F.min("_second").alias("_want"))  # one row
    d = root.join(F.broadcast(first), F.col("_second") == F.col("_want"))
    return d.select((F.row_number().over(Window.orderBy("name")) - 1).alias("band"), F.regexp_replace("name", r"\.tiff?$", "").alias("raw"))
