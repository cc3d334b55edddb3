"""Shared pieces of the corpus operators: table reads, shared staging tables, hot-safe prefix sums."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import staged as staged  # the operators take them from here
from ..session import unstage as unstage

#: A word is a run of characters other than the space and the five ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
GAP_CHARS = " \t\n\x0b\x0c\r"
#: Rows that one window partition holds at most, on average, in `running_total`.
ROWS_PER_BUCKET = 2_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """Bind `value` once: inside `body` it is a lambda variable, so it isn't evaluated for each use."""
    return F.transform(F.array(value), body)[0]


def n_buckets(rows: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(rows / F.lit(ROWS_PER_BUCKET))).cast("long")


def running_total(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column], value: Column, out: str) -> DataFrame:
    """Exclusive prefix sum of `value` within `keys`, ordered by `bucket` and then `order`.

    Two levels, so a key of any size is dealt over its buckets: totals of each (key, bucket) are summed over the
    buckets, and the rows of one bucket are summed in a window of their own. `df` is read twice; stage it first.
    """
    rows = df.withColumn("_bucket", bucket)
    totals = rows.groupBy(*keys, "_bucket").agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_bucket", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return rows.join(offsets, [*keys, "_bucket"]).withColumn(out, F.col("_offset") + F.col("_inside")).drop("_bucket", "_offset", "_inside")


def grouped(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Rows of one key at a time, from batches that are sorted by it."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([np.asarray(batch.column(batch.schema.get_field_index(x))) for x in keys])
        cuts = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            key = tuple(k[:, lo])
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)
