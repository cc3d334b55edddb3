"""Attributions: exact linear effects, importance, ranks, categories, dependence, local explanations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .sample import mixing_key

# Display name of each factor file, and category of each display name.
FACTOR_NAMES = {
    "Slope": "Slope", "Aspect": "Aspect", "Temperatur": "Temperature", "DEM": "Elevation", "Soil": "Soil",
    "Rain": "Rainfall", "Earthquake": "Seismic density", "Geology": "Lithology", "Dis2Road": "DTR", "Dis2River": "DTV",
    "Roughness": "Roughness", "Dis2Fault": "DTF", "NDVI": "NDVI", "Relief": "Relief", "Plan_Curv": "PLC",
    "Profile_Cu": "PRC", "TPI": "TPI", "Curv": "Curvature", "Population": "Population", "TWI": "TWI",
}
FACTOR_CATEGORIES = {
    "Slope": "Topographic", "Aspect": "Topographic", "Temperature": "Climatic", "Elevation": "Topographic", "Soil": "Surficial",
    "Rainfall": "Climatic", "Seismic density": "Geological", "Lithology": "Geological", "DTR": "Anthropogenic", "DTV": "Hydrological",
    "Roughness": "Topographic", "DTF": "Geological", "NDVI": "Surficial", "Relief": "Topographic", "PLC": "Topographic",
    "PRC": "Topographic", "TPI": "Topographic", "Curvature": "Topographic", "Population": "Anthropogenic", "TWI": "Hydrological",
}


def name_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(FACTOR_NAMES.items()), "file string, name string")


def category_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(FACTOR_CATEGORIES.items()), "name string, category string")


def factor_names(files: DataFrame, num_bands: int) -> DataFrame:
    """band, name: files (band, raw) named by exact match without case, then without `_` and spaces, else as they are.

    Cut or filled with Band_i to `num_bands`.
    """
    spark = files.sparkSession
    bare = lambda c: F.translate(F.lower(c), "_ ", "")
    names = name_table(spark)
    exact = F.broadcast(names.select(F.lower("file").alias("_lower"), F.col("name").alias("_exact")))
    loose = F.broadcast(names.groupBy(bare(F.col("file")).alias("_bare")).agg(F.min("name").alias("_loose")))
    d = files.withColumn("_lower", F.lower("raw")).withColumn("_bare", bare(F.col("raw"))).join(exact, "_lower", "left").join(loose, "_bare", "left")
    d = d.select("band", F.coalesce("_exact", "_loose", "raw").alias("_name"))
    bands = spark.range(num_bands).select(F.col("id").cast("int").alias("band"))
    return bands.join(F.broadcast(d), "band", "left").select("band", F.coalesce("_name", F.concat(F.lit("Band_"), (F.col("band") + 1).cast("string"))).alias("name"))


def linear_attribution(factors: DataFrame, weights: Sequence[float], background: Column) -> DataFrame:
    """r, c, band, x, phi: exact expected gradients of a linear scorer, w * (x - mean of the background)."""
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.col("band") + 1)
    mean = factors.where(background).groupBy("band").agg(F.avg("v").alias("_mean"))  # a row for each band
    return factors.join(F.broadcast(mean), "band").select("r", "c", "band", F.col("v").alias("x"), (w * (F.col("v") - F.col("_mean"))).alias("phi"))


def importance(attr: DataFrame) -> DataFrame:
    """band, mean_abs, importance (sums to 1), rank: by falling importance, later bands first among equals."""
    d = attr.groupBy("band").agg(F.avg(F.abs("phi")).alias("mean_abs"))
    total = F.sum("mean_abs").over(Window.partitionBy())  # over one row for each band
    d = d.withColumn("importance", F.coalesce(F.col("mean_abs") / F.nullif(total, F.lit(0.0)), F.lit(0.0)))
    return d.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean_abs"), F.desc("band"))))


def with_category(named: DataFrame) -> DataFrame:
    """Adds the category of `name`, Unknown without one."""
    return named.join(F.broadcast(category_table(named.sparkSession)), "name", "left").withColumn("category", F.coalesce("category", F.lit("Unknown")))


def dependence(attr: DataFrame, ranked: DataFrame, top: int = 2) -> DataFrame:
    """Values and effects of the `top` most important factors: rank, r, c, x, phi."""
    best = F.broadcast(ranked.where(F.col("rank") <= top).select("band", "rank"))
    return attr.join(best, "band").select("rank", "band", "r", "c", "x", "phi")


def decision_path(attr: DataFrame, r: int, c: int) -> DataFrame:
    """Effects of one pixel by rising size, and their running sum: waterfall, force and decision data in one."""
    d = attr.where((F.col("r") == r) & (F.col("c") == c))
    w = Window.orderBy(F.abs("phi"), "band")  # one row for each band
    return d.select("band", "x", "phi", F.row_number().over(w).alias("step"), F.sum("phi").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("path"))


def effect_limit(attr: DataFrame) -> DataFrame:
    """Largest size of an effect, the shared limit of all local maps; 1e-5 if there is none."""
    top = F.max(F.abs("phi"))
    return attr.agg(F.when(F.coalesce(top, F.lit(0.0)) == 0, F.lit(1e-5)).otherwise(top).alias("limit"))


def local_maps(attr: DataFrame, r: int, c: int, crop: int) -> DataFrame:
    """Effects of one square of `crop` pixels from (r, c), with the limit that its maps share: band, r, c, phi, limit."""
    square = attr.where(F.col("r").between(r, r + crop - 1) & F.col("c").between(c, c + crop - 1))
    return square.join(F.broadcast(effect_limit(square))).select("band", "r", "c", "phi", "limit")  # one row


def categories(spark: SparkSession) -> DataFrame:
    """position, category: the distinct categories by name, which legends number."""
    distinct = category_table(spark).select("category").distinct()
    return distinct.select((F.row_number().over(Window.orderBy("category")) - 1).alias("position"), "category")  # a fixed list


def display_sample(attr: DataFrame, rows: int = 200, scale: float = 1e4, seed: int = 42) -> DataFrame:
    """At most `rows` pixels in seeded hash order, with effects on the display scale."""
    pixels = attr.select("r", "c").distinct().orderBy(mixing_key(F.col("r"), F.col("c"), 100_003 + seed), "r", "c").limit(rows)
    return attr.join(F.broadcast(pixels), ["r", "c"]).withColumn("phi", F.col("phi") * scale)


def center_crop(pixels: DataFrame, height: int, width: int, crop: int) -> DataFrame:
    half = crop // 2
    return pixels.where(F.col("dr").between(height // 2 - half, height // 2 + half - 1) & F.col("dc").between(width // 2 - half, width // 2 + half - 1))


def first_slide_sample(samples: DataFrame, max_batches: int = 15) -> DataFrame:
    """batch, pos, found: the first sample with a slide from batch 2 on (batches from 1); batch 1, position 0 if there is none."""
    first = samples.where(F.col("has_slide") & F.col("batch").between(2, max_batches + 1)).agg(F.min(F.struct("batch", "pos")).alias("m"))
    return first.select(F.coalesce("m.batch", F.lit(1)).cast("long").alias("batch"), F.coalesce("m.pos", F.lit(0)).cast("long").alias("pos"), F.col("m").isNotNull().alias("found"))
