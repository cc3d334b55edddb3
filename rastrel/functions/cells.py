"""Expressions on single values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Edges and names of the risk classes; target of each label code.
RISK_EDGES = (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)
RISK_NAMES = ("Very Low", "Low", "Medium", "High", "Very High")
SLIDE, NON_SLIDE, IGNORED = 1, 2, -1


def null_nodata(v: Column, nodata: float | None = -9999.0) -> Column:
    """Nodata and NaN become NULL."""
    v = F.when(F.isnan(v), None).otherwise(v)
    return v if nodata is None else F.nullif(v, F.lit(nodata).cast("double"))


def fill_nodata(v: Column, nodata: float = -9999.0) -> Column:
    """NULL and NaN become nodata, for a sink."""
    return F.coalesce(F.nanvl(v, F.lit(None).cast("double")), F.lit(nodata))


def clean_factor(v: Column) -> Column:
    """Missing becomes 0; the rest is clipped to 0..1."""
    return F.least(F.greatest(F.coalesce(F.nanvl(v.cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))


def target(code: Column) -> Column:
    """Label code to training target: slide 1, non-slide 0, else ignored."""
    return F.when(code == SLIDE, 1).when(code == NON_SLIDE, 0).otherwise(IGNORED).cast("long")


def jittered(z: Column, r: Column, c: Column) -> Column:
    """Elevation as single precision after a tiny trend that breaks flats below 128 m; depressions stay as they are."""
    return (z.cast("double") + F.pmod(r + 2 * c, F.lit(8)) * F.lit(1e-6)).cast("float")


def class_one(l0: Column, l1: Column) -> Column:
    """Softmax of two logits, class 1."""
    return 1.0 / (1.0 + F.exp(l0 - l1))


def risk_class(p: Column) -> Column:
    """Index of the half-open risk bin, the last closed; null outside 0..1."""
    out = F.lit(None).cast("int")
    for i in reversed(range(5)):
        lo, hi = F.lit(RISK_EDGES[i]), F.lit(RISK_EDGES[i + 1])
        out = F.when((p >= lo) & ((p < hi) if i < 4 else (p <= hi)), i).otherwise(out)
    return out


def int_list(s: Column) -> Column:
    """'[0, 1]' to array(0, 1); an empty list to an empty array."""
    inner = F.trim(F.regexp_replace(s, r"^\[+|\]+$", ""))
    return F.when(inner == "", F.array().cast("array<int>")).otherwise(F.transform(F.split(inner, ","), lambda x: F.trim(x).cast("int")))


def strip_module(name: Column) -> Column:
    """Parameter name without the prefix that parallel training leaves."""
    return F.regexp_replace(name, r"^module\.", "")
