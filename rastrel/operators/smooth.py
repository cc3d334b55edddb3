"""Separable Gaussian smoothing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRUNCATE = 4.0


def kernel(sigma: float) -> list[float]:
    radius = int(TRUNCATE * sigma + 0.5)
    w = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-radius, radius + 1)]
    return [x / sum(w) for x in w]


def _pass(cells: DataFrame, line: str, along: str, weights: list[float]) -> DataFrame:
    """Weighted sums of v along lines: each line is one sorted array; borders reflect (-1 is 0, -2 is 1). `on` is carried."""
    radius = len(weights) // 2
    taps = F.array(*[F.struct(F.lit(i - radius).alias("o"), F.lit(w).alias("w")) for i, w in enumerate(weights)])
    lines = cells.groupBy(line).agg(F.array_sort(F.collect_list(F.struct(F.col(along), F.coalesce(F.col("v").cast("double"), F.lit(0.0)).alias("v"), "on"))).alias("_a"))
    n = F.size("_a")

    def reflected(i: Column) -> Column:
        i = F.pmod(i, 2 * n)
        return F.when(i < n, i).otherwise(2 * n - 1 - i)

    value = lambda i: F.aggregate("_taps", F.lit(0.0), lambda s, t: s + t["w"] * F.get("_a", reflected(i + t["o"]))["v"])
    lines = lines.withColumn("_taps", taps)
    return lines.select(line, F.explode(F.transform("_a", lambda x, i: F.struct(x[along].alias(along), value(i).alias("v"), x["on"].alias("on")))).alias("_x")).select(line, "_x.*")


def gaussian(cells: DataFrame, sigma: float = 2.0, mode: str = "strict") -> DataFrame:
    """r, c, v smoothed; null stays null. strict: nodata counts as 0. corrected: weights are those of valid cells only."""
    w = kernel(sigma)
    both = lambda d: _pass(_pass(d, "r", "c", w), "c", "r", w)
    d = cells.select("r", "c", "v", F.col("v").isNotNull().alias("on"))
    out = both(d)
    if mode == "corrected":
        weight = both(d.withColumn("v", F.col("on").cast("double"))).select("r", "c", F.col("v").alias("_w"))
        out = out.join(weight, ["r", "c"]).withColumn("v", F.col("v") / F.col("_w"))
    return out.select("r", "c", F.when(F.col("on"), F.col("v")).alias("v"))
