"""XML configuration: typed values and ordered projections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cells import int_list

SCHEMA = "name string, description string, inout string, type string, info string, value string"


def read(spark: SparkSession, path: str) -> DataFrame:
    """position, name, type, value of each `param`; a configuration is one small file, so positions are its order."""
    d = spark.read.format("xml").option("rowTag", "param").schema(SCHEMA).load(path)
    return d.coalesce(1).select(F.monotonically_increasing_id().alias("position"), "name", "type", "value")


def typed(params: DataFrame) -> DataFrame:
    """name, type and one of int_value, float_value, bool_value, list_value, string_value."""
    at = lambda t, c: F.when(F.col("type") == t, c).alias(f"{t}_value")
    plain = F.when(~F.coalesce(F.col("type"), F.lit("")).isin("int", "float", "bool", "list"), F.col("value")).alias("string_value")
    return params.select("name", "type", at("int", F.expr("try_cast(trim(value) as int)")), at("float", F.expr("try_cast(trim(value) as double)")), at("bool", F.lower("value") == "true"), at("list", int_list(F.col("value"))), plain)


def project(params: DataFrame, names: Sequence[str], strict: bool = True) -> list[str]:
    """Values of `names` in order, the first match of each; a missing one raises, or is left out if not strict."""
    found = {r[0]: r[1] for r in params.where(F.col("name").isin(list(names))).groupBy("name").agg(F.min_by("value", "position")).collect()}
    missing = [n for n in names if n not in found]
    if missing and strict:
        raise KeyError(f"missing parameters: {', '.join(missing)}")
    return [found[n] for n in names if n in found]


def projected(params: DataFrame, names: Sequence[str]) -> DataFrame:
    """position (in `names`), value: the first match of each name; missing ones are left out."""
    first = params.where(F.col("name").isin(list(names))).groupBy("name").agg(F.min_by("value", "position").alias("value"))
    return first.select((F.array_position(F.array(*[F.lit(n) for n in names]), F.col("name")) - 1).cast("int").alias("position"), "value")
