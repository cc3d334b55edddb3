"""Ranks over a whole table without a single-task window, average-rank distribution, unit maxima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import staged, unbroadcast
from .lookup import lookup


def positions(values: DataFrame, value: str, out: str, weight: str | None = None) -> DataFrame:
    """Exclusive running sum of `weight` (1 without) over rows in order of `value`, whose values are distinct.

    Rows are dealt into ranges and staged with their range's number, so that each range sums its own rows and only
    the ranges' totals, one row each, meet in one window.
    """
    spark = values.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = staged(values.repartitionByRange(parts, value).withColumn("_part", F.spark_partition_id()), "ranges")
    w = F.col(weight) if weight else F.lit(1)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("_part").agg(F.sum(w).alias("_total")).select("_part", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return dealt.withColumn("_in", F.coalesce(F.sum(w).over(inside), F.lit(0))).join(F.broadcast(totals), "_part").withColumn(out, F.col("_before") + F.col("_in")).drop("_part", "_in", "_before")  # a row for each range


def average_rank_cdf(cells: DataFrame, value: str, out: str) -> DataFrame:
    """Adds (average rank - 1) / (N - 1) of `value` over the rows; 0 if there is one row. Ties share their mean rank.

    Most cells may share a value: rows of frequent values aren't gathered. `cells` is read several times; stage it first.
    """
    counts = staged(cells.groupBy(value).agg(F.count(F.lit(1)).alias("_n")), "values")
    total = F.broadcast(counts.agg(F.sum("_n").alias("_all")))  # one row
    ranked = positions(counts, value, "_below", "_n").join(total)
    cdf = F.when(F.col("_all") <= 1, F.lit(0.0)).otherwise((F.col("_below") + (F.col("_n") - 1) / F.lit(2.0)) / (F.col("_all") - 1))
    return lookup(cells, unbroadcast(staged(ranked.select(value, cdf.alias(out)), "cdf")), [value], counts.withColumnRenamed("_n", "n"))


def joint_probability(cells: DataFrame) -> DataFrame:
    """Adds cdf_beta, cdf_acc and joint (their product in single precision) to valid cells (beta, acc)."""
    d = average_rank_cdf(staged(average_rank_cdf(cells, "beta", "cdf_beta"), "ranked"), "acc", "cdf_acc")
    return d.withColumn("joint", (F.col("cdf_beta") * F.col("cdf_acc")).cast("float"))


def unit_maximum(joint: DataFrame) -> DataFrame:
    """label, unit_value: largest joint value of each slope unit, 0 at least; label 0 is no unit."""
    return joint.where("label > 0").groupBy("label").agg(F.greatest(F.lit(0.0).cast("float"), F.max("joint")).alias("unit_value"))


def spread_units(cells: DataFrame, units: DataFrame) -> DataFrame:
    """Adds ps_l: the unit's value; 0 for valid cells outside units; null for nodata (slope null).

    A unit may hold a large share of the cells, as may label 0, which has no value: neither is gathered in one task.
    """
    return lookup(cells, unbroadcast(units), ["label"]).withColumn("ps_l", F.when(F.col("slope").isNotNull(), F.coalesce("unit_value", F.lit(0.0).cast("float")))).drop("unit_value")
