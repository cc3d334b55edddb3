"""Conversation prefix trie: prefixes named by digests, subtree sums by pointer jumping."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.lookup import lookup
from ..session import ship_package
from .common import staged, unstage

#: Turns of the base conversation that a rebuilt one takes at most, and conversations that share a base.
HEAD, FAMILY = 8, 5
#: Rounds cover paths of up to 2**MAX_ROUNDS turns.
MAX_ROUNDS = 40
#: A turn's digest is four numbers below 2**32, so that sums of up to 2**31 of them stay exact in a long.
LANES = 4
KEY = ["ka", "kb"]
UP = ["pa", "pb"]


def _lanes(hexed: Column) -> list[Column]:
    return [F.conv(F.substr(hexed, F.lit(8 * i + 1), F.lit(8)), 16, 10).cast("long") for i in range(LANES)]


def ranked(rows: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """Adds `pos`: place from 1 within `key` in `order`. A key of any size is dealt over ranges of (key, order).

    Each range counts its own rows; only where a key runs over several ranges the rows before are added, a table of
    at most one row for each range. Rows that are equal in key and order are one row with a number `n` beforehand
    and are counted out in the end, so no range has to hold them all. The result is staged.
    """
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rest = [c for c in rows.columns if c not in (key, *order)]
    once = rows.groupBy(key, *order).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in rest])
    dealt = staged(once.repartitionByRange(parts, key, *order).withColumn("_part", F.spark_partition_id()), name)
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    spans = dealt.groupBy(key, "_part").agg(F.sum("_n").alias("_rows"))
    carried = spans.withColumn("_before", F.sum("_rows").over(before)).where("_before is not null").select(F.col(key).alias("_k"), "_part", "_before")
    inside = Window.partitionBy("_part", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    d = dealt.withColumn("_in", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    c = F.broadcast(carried.withColumnRenamed("_part", "_p"))  # a row for each range at most
    d = d.join(c, (F.col("_part") == F.col("_p")) & F.col(key).eqNullSafe(F.col("_k")), "left")
    at = F.coalesce("_before", F.lit(0)) + F.col("_in")
    out = d.withColumn("pos", F.explode(F.sequence(at + 1, at + F.col("_n"))))
    return out.select(key, *order, *rest, "pos", "_part", F.coalesce("_before", F.lit(0)).alias("_before"))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id), and the turns of the rebuilt ones: conv_id, own, at (order: own, at), content digest, bytes.

    A rebuilt conversation is the first h turns of its family's base (conv_id - conv_id % 5) and its own turns after
    its first h; h is crc32(conv_id) % 9.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    said = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    turns = conversations.select("conv_id", "turn", role.alias("role"), said.alias("said"), F.octet_length(text).cast("long").alias("bytes"))
    own = ranked(turns, "conv_id", ["turn", "role", "said"], "trie-turns").select("conv_id", "pos", "said", "bytes")
    own = staged(own, "trie-ranked")
    h = F.coalesce(F.crc32(F.col("conv_id").cast("string").cast("binary")) % (HEAD + 1), F.lit(0))
    convs = staged(own.select("conv_id").distinct().select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base")), "trie-convs")
    heads = own.where((F.col("pos") <= HEAD) & (F.col("conv_id") % FAMILY == 0)).select(F.col("conv_id").alias("base"), "pos", "said", "bytes")
    taken = convs.join(heads, "base").where(F.col("pos") <= F.col("h")).select("conv_id", F.lit(0).alias("own"), F.col("pos").alias("at"), "said", "bytes")
    left = own.where(F.col("pos") > h).select("conv_id", F.lit(1).alias("own"), F.col("pos").alias("at"), "said", "bytes")
    return convs.select("conv_id"), taken.unionByName(left)


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, depth, key (ka, kb) of the prefix that ends there, that of the one before (pa, pb), bytes; staged.

    A prefix's key is the sum of the digests of its turns, each hashed with its depth: a running sum, so a long
    conversation is dealt over ranges like any other. 126 bits tell prefixes apart; the empty one is (0, 0).
    """
    d = ranked(turns, "conv_id", ["own", "at"], "trie-rebuilt").withColumnRenamed("pos", "depth")
    salted = F.sha2(F.concat(F.col("depth").cast("string"), F.lit(":"), F.col("said")), 256)
    d = staged(d.select("conv_id", "depth", "bytes", "_part", *[x.alias(f"l{i}") for i, x in enumerate(_lanes(salted))]), "trie-lanes")
    lanes = [f"l{i}" for i in range(LANES)]
    spans = d.groupBy("conv_id", "_part").agg(*[F.sum(x).alias(x) for x in lanes])
    before = Window.partitionBy("conv_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.select(F.col("conv_id").alias("_k"), F.col("_part").alias("_p"), *[F.sum(x).over(before).alias(f"_{x}") for x in lanes]).where("_l0 is not null")
    d = d.join(F.broadcast(carried), (F.col("_part") == F.col("_p")) & F.col("conv_id").eqNullSafe(F.col("_k")), "left")  # a row for each range at most
    upto = Window.partitionBy("_part", "conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = [F.coalesce(F.col(f"_{x}"), F.lit(0)) + F.sum(x).over(upto) for x in lanes]
    d = d.select("conv_id", "depth", "bytes", *[s.alias(f"s{i}") for i, s in enumerate(sums)], *lanes)

    def named(values: list[Column], names: list[str]) -> list[Column]:
        m = [F.pmod(v, F.lit(1 << (31 if i % 2 == 0 else 32))) for i, v in enumerate(values)]
        return [(m[2 * i] * (1 << 32) + m[2 * i + 1]).alias(k) for i, k in enumerate(names)]

    here = [F.col(f"s{i}") for i in range(LANES)]
    return staged(d.select("conv_id", "depth", "bytes", *named(here, KEY), *named([s - F.col(x) for s, x in zip(here, lanes, strict=True)], UP)), "trie-prefixes")


def subtree_sums(nodes: DataFrame, values: list[str]) -> DataFrame:
    """Key and, for each value, its sum over the node and all nodes below it; nodes: key, parent's key (root: null), values.

    Pointer jumping: a round adds each node's sum to the node 2**k above it and doubles the jump, so ⌈log2(depth)⌉
    rounds do. Nodes whose pointer has passed the root take no further part. What a node gains is kept apart and added
    up in one aggregate at the end. Many nodes may point at one (the root has all first turns): gains are partial sums
    first, and the jump is a look-up that doesn't gather a frequent target's nodes in one task.
    """
    jump = ["na", "nb"]
    moving = staged(nodes.where(f"{UP[0]} is not null").select(*KEY, *[F.col(u).alias(j) for u, j in zip(UP, jump, strict=True)], *values), "trie-moving")
    gains = []
    for _ in range(MAX_ROUNDS):
        if moving.isEmpty():
            break
        gained = staged(moving.groupBy(*jump).agg(*[F.sum(v).alias(v) for v in values], F.count(F.lit(1)).alias("n")), "trie-gained")
        gains.append(gained)
        ahead = moving.select(*[F.col(k).alias(j) for k, j in zip(KEY, jump, strict=True)], *[F.col(j).alias(f"_{j}") for j in jump])
        jumped = lookup(moving, ahead, jump, gained.select(*jump, "n")).where("_na is not null").drop(*jump)
        more = gained.select(*[F.col(j).alias(k) for j, k in zip(jump, KEY, strict=True)], *[F.col(v).alias(f"_{v}") for v in values])
        summed = jumped.join(more, KEY, "left")
        moving = staged(summed.select(*KEY, *[F.col(f"_{j}").alias(j) for j in jump], *[(F.col(v) + F.coalesce(F.col(f"_{v}"), F.lit(0))).alias(v) for v in values]), "trie-moving", instead_of=moving)
    else:
        raise RuntimeError(f"paths did not end in {MAX_ROUNDS} rounds")
    parts = [nodes.select(*KEY, *values), *[g.select(*[F.col(j).alias(k) for j, k in zip(jump, KEY, strict=True)], *values) for g in gains]]
    out = staged(reduce(DataFrame.unionByName, parts).groupBy(*KEY).agg(*[F.sum(v).alias(v) for v in values]), "trie-sums")
    unstage(moving, *gains)
    return out


def _end_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's ids, comma-joined, from rows sorted by key and id: one running state, whatever their number."""
    key, state, some = None, None, False
    done: tuple[list, list, list] = ([], [], [])

    def flush():
        if key is not None:
            for c, v in zip(done, (*key, state.hexdigest()), strict=True):
                c.append(v)

    for batch in batches:
        for a, b, i in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (a, b) != key:
                flush()
                key, state, some = (a, b), hashlib.sha256(), False
            state.update((f",{i}" if some else str(i)).encode())
            some = True
        if done[0]:
            yield pa.RecordBatch.from_arrays([pa.array(done[0], pa.int64()), pa.array(done[1], pa.int64()), pa.array(done[2])], [*KEY, "ends_sha256"])
            done = ([], [], [])
    flush()
    if done[0]:
        yield pa.RecordBatch.from_arrays([pa.array(done[0], pa.int64()), pa.array(done[1], pa.int64()), pa.array(done[2])], [*KEY, "ends_sha256"])


def trie(convs: DataFrame, found: DataFrame) -> DataFrame:
    """A row a node of the prefix trie of `found` (from `prefixes`) and of the conversations without turns in `convs`.

    ka, kb (the node's key), conv_id (smallest member), depth, parent_conv_id (root: null), n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.
    """
    ship_package(convs.sparkSession)
    inner = found.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min(UP[0]).alias(UP[0]), F.min(UP[1]).alias(UP[1]), F.max("bytes").alias("bytes"), F.count(F.lit(1)).alias("n_convs"))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    root = root.select(zero.alias("ka"), zero.alias("kb"), "conv_id", zero.alias("depth"), none.alias("pa"), none.alias("pb"), zero.alias("bytes"), "n_convs")
    nodes = staged(inner.unionByName(root), "trie-nodes")
    kids = staged(nodes.where("pa is not null").groupBy(*UP).agg(F.count(F.lit(1)).alias("n")), "trie-kids")
    below = kids.select(F.col("pa").alias("ka"), F.col("pb").alias("kb"), F.col("n").alias("n_children"))
    nodes = staged(nodes.join(below, KEY, "left").withColumn("n_children", F.coalesce("n_children", zero)), "trie-nodes", instead_of=nodes)
    above = nodes.where("n_children > 0").select(F.col("ka").alias("pa"), F.col("kb").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    sums = subtree_sums(nodes.select(*KEY, *UP, (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens")), ["n_leaves", "saved_tokens"])
    last = found.groupBy("conv_id").agg(F.max(F.struct("depth", *KEY)).alias("e")).select("conv_id", "e.ka", "e.kb")
    silent = convs.join(last.select(F.col("conv_id").alias("_c")), F.col("conv_id").eqNullSafe(F.col("_c")), "left_anti").select("conv_id", zero.alias("ka"), zero.alias("kb"))
    ends = last.unionByName(silent).where("conv_id is not null").select(*KEY, "conv_id").repartition(*KEY).sortWithinPartitions(*KEY, "conv_id")
    ends = ends.mapInArrow(_end_digests, "ka long, kb long, ends_sha256 string")
    out = lookup(nodes, above, UP, kids).join(sums, KEY).join(ends, KEY, "left")
    nobody = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select(*KEY, "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nobody).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The prefix trie of the rebuilt conversations: `trie` of `rebuilt` turns. Columns as `trie`.

    Turns are in order of turn (null first), then role and the digest of role and text; null role or text is empty.
    Repeated rows are turns of their own, one after the other. Rows without a conv_id are one conversation with neither base nor head;
    it counts as a member, but smallest members and end digests leave it out (conv_id is null where it is alone). An empty table has no nodes; a
    conversation that keeps no turn is a member of the root alone. Other columns are ignored.
    """
    convs, turns = rebuilt(conversations.select("conv_id", "turn", "role", "text"))
    return trie(convs, prefixes(turns))
