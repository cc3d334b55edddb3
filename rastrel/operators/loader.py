"""Mini-batches: a gapless index, and for each epoch a keyed permutation of it instead of a sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rank import positions

ROUNDS = 16
# Fixed values of the arithmetic hash that any engine can repeat.
A, B, M = 7919, 104729, 65537


def indexed(rows: DataFrame, key: str) -> DataFrame:
    """Adds `index`, 0 .. n-1 in order of `key`, whose values are distinct: ranges are numbered one by one."""
    return positions(rows, key, "index")


def permuted(index: Column, n: int, epoch: int, seed: int) -> Column:
    """The place of each of 0 .. n-1 in the order of an epoch: a permutation, computed for each row by itself.

    Each round pairs every index with its mirror about a keyed point and swaps the pair or not by a hash that both
    compute alike; so it is one-to-one for any n, without tables or walks.
    """
    if n < 2:
        return index
    keys = F.array(*[F.struct(F.lit((seed * A + epoch * B + r * 613) * A % M * 65_543 % n).cast("long").alias("k"), F.lit((seed * B + epoch * A + r * 977) % M).cast("long").alias("b")) for r in range(ROUNDS)])

    def turn(x, s):
        mirror = F.pmod(s["k"] - x, F.lit(n))
        bit = (F.greatest(x, mirror) % M * A + s["b"]) % M % 2
        return F.when(bit == 1, mirror).otherwise(x)

    return F.aggregate(keys, index.cast("long"), turn)


def batches(rows: DataFrame, n: int, size: int, epoch: int | None = None, seed: int = 0, drop_last: bool = False) -> DataFrame:
    """Adds place and batch to rows with an `index` 0 .. n-1: in order of the index, or in an epoch's own order.

    drop_last leaves out an incomplete last batch; as n is known, by a filter alone.
    """
    place = F.col("index") if epoch is None else permuted(F.col("index"), n, epoch, seed)
    d = rows.withColumn("place", place).withColumn("batch", F.floor(F.col("place") / size).cast("long"))
    return d.where(F.col("batch") < n // size) if drop_last else d
