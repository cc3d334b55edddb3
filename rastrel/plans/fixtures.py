"""Grids derived from the driver's tables: elevation, factors, labels, overlap runs, predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEM_WIDTH, LABEL_WIDTH = 100, 100
#: Names of factor files: as they are known, in another case, without `_` or with a space, and unknown.
STEMS = ("slope", "ASPECT", "Temperatur", "dem", "plancurv", "Profile Cu", "NewFactor", "Dis2_Road")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dem(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.expr("CAST(o_orderkey DIV 100 AS INT)")
    z = F.expr("CASE WHEN o_custkey % 17 = 0 THEN NULL ELSE (1000 - o_orderkey DIV 100) * 0.0625D + (o_custkey % 16) * 0.0625D END")
    return _table(spark, sf_dir, "orders").select(row.alias("r"), F.expr("CAST(o_orderkey % 100 AS INT)").alias("c"), z.alias("z"))


def factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty bands of each pixel; what a null or short embedding lacks is null."""
    bands = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: F.get("embedding", i))
    d = _table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(bands).alias("band", "v"))
    return d.select(F.expr("CAST(vec_id DIV 25 AS INT)").alias("r"), F.expr("CAST(vec_id % 25 AS INT)").alias("c"), "band", (F.col("v").cast("double") * 2 + 0.5).alias("v"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.expr("CASE WHEN event_type = 'error' THEN 1 WHEN event_type IN ('view', 'purchase') THEN 2 ELSE 0 END")
    return _table(spark, sf_dir, "events").select(F.expr("CAST(event_id DIV 100 AS INT)").alias("r"), F.expr("CAST(event_id % 100 AS INT)").alias("c"), code.alias("code"))


def writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every write to (run, px), with its writer's key."""
    p = F.expr("CASE WHEN l_tax > 0.075D THEN NULL ELSE l_discount * 10D END")
    d = _table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("long").alias("run"), F.col("l_orderkey").cast("long").alias("px"), p.alias("p"), "l_partkey", "l_suppkey", "l_extendedprice")
    return d.where("p is not null")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(_table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return d.select("doc_id", F.col("source").alias("g"), F.coalesce("quality", F.lit(-1)).cast("int").alias("y"), F.expr("CASE WHEN n_chars % 3 = 0 THEN 0 ELSE 1 END").alias("pred"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing (dir, name), each file once: `.tif` and `.tiff` files, some of them in the root."""
    place = F.expr("CASE WHEN p_size % 5 < 2 THEN '' ELSE concat('dir', p_size % 5) END")
    number = F.expr("CAST(substr(p_brand, 7) AS INT) % 12")
    stem = F.coalesce(F.get(F.array(*map(F.lit, STEMS)), number), F.concat(F.lit("f"), number))
    return _table(spark, sf_dir, "part").select(place.alias("dir"), F.concat(stem, F.expr("IF(p_partkey % 3 = 0, '.tiff', '.tif')")).alias("name")).distinct()
