"""Look-ups by keys some of which may hold a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than this share of all rows is frequent; so there are fewer than 1 / SHARE such keys.
SHARE = 1 / 1024
#: A key with fewer rows than this is never frequent, so small tables take no detour.
LEAST = 1_000


def frequent_keys(rows: DataFrame, on: Sequence[str], counts: DataFrame | None = None, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """`on` of the keys that hold more than `share` of all rows, `least` rows at any rate: fewer than 1 / share keys.

    counts: `on` and n, where they are known already; else they are counted, with partial counts in each task. Null
    keys match nothing in a look-up, so they aren't counted.
    """
    known = " and ".join(f"`{k}` is not null" for k in on)
    n = counts if counts is not None else rows.groupBy(*on).agg(F.count(F.lit(1)).alias("n"))
    n = n.where(known)
    total = n.agg(F.sum("n").alias("_total"))  # one row
    return n.join(F.broadcast(total)).where((F.col("n") >= least) & (F.col("n") > F.col("_total") * share)).select(*on)


def lookup(rows: DataFrame, table: DataFrame, on: Sequence[str], counts: DataFrame | None = None, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """Left join of `rows` to `table`, which has one row a key: no task gets all rows of a frequent key.

    Rows of frequent keys stay where they are and meet a broadcast of those keys' rows, fewer than 1 / share of them;
    rows with a null key, which match nothing, stay there too; the others are shuffled. Both tables are read several
    times, so they should be staged or cheap.
    """
    on = list(on)
    known = " and ".join(f"`{k}` is not null" for k in on)
    heavy = F.broadcast(frequent_keys(rows, on, counts, share, least))
    hot = rows.join(heavy, on, "left_semi").join(F.broadcast(table.join(heavy, on, "left_semi")), on, "left")
    cold = rows.where(known).join(heavy, on, "left_anti").join(table, on, "left")
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema if f.name not in on]
    return hot.unionByName(cold).unionByName(rows.where(f"not ({known})").select("*", *nothing))
