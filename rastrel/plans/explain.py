"""Trained weights and factors to attribution tables and the importance report."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import clean_factor
from ..operators import attrib
from ..session import staged
from ..sources import catalog, config, reports, weights


def run(params: DataFrame, factors: DataFrame, files: DataFrame, background: Column, out: str, pixel: tuple[int, int] = (0, 0), crop: int = 128, top: int = 2) -> DataFrame:
    """Attribution of the linear scorer that configuration rows name (train_output, num_bands).

    factors: r, c, band, v; files: the factors' listing (dir, name), which names the bands; background: condition on
    factors. Under `out`: tables `attribution`, `importance`, `dependence` of the `top` factors, `sample` on the display
    scale, `decision` of one pixel, `local` maps around it, and the report `importance_csv`. Returns the ranked importance.
    """
    path, bands = config.project(params, ("train_output", "num_bands"))
    spark = params.sparkSession
    try:
        found = weights.read(spark, f"{path}/best")
    except AnalysisException as e:
        raise FileNotFoundError(f"no weights under {path}/best") from e
    w = [float(x) for x in found["linear.weight"].ravel()]
    clean = factors.where(F.col("band") < int(bands)).withColumn("v", clean_factor(F.col("v")))
    attr = staged(attrib.linear_attribution(clean, w, background), "attribution")
    names = attrib.factor_names(catalog.raw_names(files), int(bands))
    ranked = staged(attrib.with_category(attrib.importance(attr).join(F.broadcast(names), "band")), "importance")  # a row for each band
    r, c = pixel
    tables = {"attribution": attr, "importance": ranked, "dependence": attrib.dependence(attr, ranked, top), "sample": attrib.display_sample(attr)}
    tables |= {"decision": attrib.decision_path(attr, r, c), "local": attrib.local_maps(attr, r - crop // 2, c - crop // 2, crop)}
    for name, d in tables.items():
        d.write.mode("overwrite").parquet(f"{out}/{name}")
    reports.importance_csv(ranked, f"{out}/importance_csv")
    return ranked
