"""The linear scorer, in expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cells import class_one


def band_stack(factors: DataFrame) -> DataFrame:
    """r, c, f: values in band order, from rows (r, c, band, v)."""
    return factors.groupBy("r", "c").agg(F.transform(F.array_sort(F.collect_list(F.struct("band", "v"))), lambda x: x["v"]).alias("f"))


def linear_logit(factors: DataFrame, weights: Sequence[float], bias: float) -> DataFrame:
    """r, c, l1: weighted sum of cleaned long-form factors; a partial sum for each task, one row a pixel shuffled."""
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.col("band") + 1)
    return factors.groupBy("r", "c").agg((F.sum(F.col("v") * w) + F.lit(float(bias))).alias("l1"))


def linear_score(factors: DataFrame, weights: Sequence[float], bias: float) -> DataFrame:
    """r, c, p: probability of class 1, the other logit being 0."""
    return linear_logit(factors, weights, bias).select("r", "c", class_one(F.lit(0.0), F.col("l1")).alias("p"))
