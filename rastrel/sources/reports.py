"""Small report files; numbers are formatted as text at the sink only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def risk_csv(histogram: DataFrame, path: str) -> None:
    d = histogram.orderBy("bin").select(F.col("risk_level").alias("Risk Level"), F.col("pixel_count").alias("Pixel Count"), F.format_string("%.2f%%", "percentage").alias("Percentage"))
    d.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def importance_csv(ranked: DataFrame, path: str) -> None:
    """ranked: rank, name, category, importance."""
    d = ranked.orderBy("rank").select(F.col("rank").alias("Rank"), F.col("name").alias("Factor"), F.col("category").alias("Category"), F.format_string("%.6f", "importance").alias("Importance"))
    d.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
