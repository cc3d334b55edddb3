"""Balanced label propagation: equal texts move to one shard while row counts stay at most one apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.lookup import lookup
from .common import n_buckets, running_total, staged

GROUP = ["_g1", "_g2"]


def _quotas(rows: int, shards: int) -> list[int]:
    """Law `rows`: the first rows % shards shards hold one more than the others."""
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def _lookup(index: Column, values: list[int]) -> Column:
    return F.element_at(F.array(*[F.lit(int(v)) for v in values]), index.cast("int") + 1)


def _occupied(blocks: DataFrame, shards: int) -> list[int]:
    """Rows in each shard; as many values as there are shards."""
    found = {r[0]: r[1] for r in blocks.groupBy("shard").agg(F.sum("n")).collect()}
    return [int(found.get(s, 0)) for s in range(shards)]


def _whole(groups: list[tuple[int, int, int]], quotas: list[int]) -> list[tuple[int, int, int, int]]:
    """Blocks (group, shard, rows) that fill whole shards: of each group (its key and rows) as many as it can fill."""
    least = max(1, min(quotas))
    left, out = [s for s, q in enumerate(quotas) if q], []
    for a, b, n in sorted(groups, key=lambda g: (-g[2], g)):
        while fit := [s for s in left if quotas[s] <= n]:
            # a shard with a row more only if that doesn't cost a whole shard
            s = (max if n % least else min)(fit, key=lambda s: (quotas[s], s))
            out.append((a, b, s, quotas[s]))
            left.remove(s)
            n -= quotas[s]
    return out


def _propagate(blocks: DataFrame, quotas: list[int], seed: int) -> tuple[DataFrame, int]:
    """One round: the blocks after it, and how many rows moved. A block is the rows of one group in one shard: they are alike, so labels move by blocks.

    Each block asks for the shard that holds most of its group, among its own and those with room. Two shards
    may always swap as much as both ask of each other; what is beyond goes into free room, in hash order. Of a group,
    rows only join blocks that are no smaller and stay or grow, so the sum of squares of the blocks grows with each
    move: rounds come to an end.
    """
    shards = len(quotas)
    free = [max(0, q - o) for q, o in zip(quotas, _occupied(blocks, shards), strict=True)]
    group = Window.partitionBy(*GROUP)
    weight = F.struct("n", F.xxhash64("shard", *GROUP, F.lit(seed)).alias("h"), "shard")
    wanted = F.max(F.when(_lookup(F.col("shard"), free) > 0, weight)).over(group)
    full = F.max(weight).over(group)
    asked = (
        blocks.withColumn("_wanted", wanted)
        .withColumn("_full", full)
        .withColumn("_best", F.when(F.col("_wanted.n") >= F.col("n"), F.col("_wanted.shard")).otherwise(F.col("shard")))
        # a full shard that holds more of the group, or as much and comes first by hash, can still be reached by a swap
        .withColumn("to", F.when((F.col("_best") == F.col("shard")) & ((F.col("_full.n") > F.col("n")) | (F.col("_full.n") == F.col("n")) & (F.coalesce("_wanted.n", F.lit(0)) < F.col("n"))), F.col("_full.shard")).otherwise(F.col("_best")))
        .select(*GROUP, "shard", "n", "to")
    )
    asked = staged(asked, "shard-asked")
    moves = asked.where("to <> shard")
    flow = {(r[0], r[1]): int(r[2]) for r in moves.groupBy("shard", "to").agg(F.sum("n")).collect()}
    grant, room = {}, list(free)
    for (a, b), n in sorted(flow.items()):
        grant[a, b] = min(n, flow.get((b, a), 0))
    for (a, b), n in sorted(flow.items()):
        more = min(n - grant[a, b], room[b])
        grant[a, b] += more
        room[b] -= more
    granted = F.element_at(F.array(*[F.lit(grant.get((a, b), 0)) for a in range(shards) for b in range(shards)]), F.col("shard") * shards + F.col("to") + 1)
    order = F.xxhash64(*GROUP, F.lit(seed))
    total = sum(flow.values())
    ranked = running_total(moves, ["shard", "to"], F.pmod(order, n_buckets(F.lit(total))), [order, F.col("_g1"), F.col("_g2")], F.col("n"), "_start")
    moved = F.greatest(F.lit(0), F.least(F.col("n"), granted - F.col("_start")))
    parts = ranked.select(*GROUP, F.explode(F.array(F.struct(F.col("shard"), (F.col("n") - moved).alias("n")), F.struct(F.col("to").alias("shard"), moved.alias("n")))).alias("p")).select(*GROUP, "p.*")
    kept = asked.where("to = shard").select(*GROUP, "shard", "n")
    blocks = staged(kept.unionByName(parts).where("n > 0").groupBy(*GROUP, "shard").agg(F.sum("n").alias("n")), "shard-blocks")
    return blocks, sum(grant.values())


def shard_documents(docs: DataFrame, shards: int = 24, seed: int = 20) -> DataFrame:
    """Shard every row of `docs` (doc_id, text); returns doc_id, size, text_crc32, law, shard, slot, grown_shard, group_rows.

    Edges link rows with equal texts. Groups that fill whole shards get them first (`_whole`); the labels of what is
    left start round-robin, and each round moves blocks under capacity quotas (`_propagate`), until none moves; rows without an edge then fill each shard up to its quota, so that row counts are at most one
    apart. Null text counts as empty (size 8, CRC 0); null doc_ids and repeated rows are rows like others, in order of
    their texts' hashes where doc_ids tie, so the result doesn't depend on the table's layout; an empty table gives no
    rows; other columns are ignored. A group larger than a shard fills whole shards first.
    """
    text = F.coalesce("text", F.lit(""))
    rows = staged(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("_g1"),
            F.xxhash64(F.lit("second"), text, F.octet_length(text)).alias("_g2"),
            F.xxhash64(F.lit(seed), "doc_id", F.when(F.col("doc_id").isNull(), F.xxhash64(text))).alias("_h"),
        ),
        "shard-rows",
    )
    total = rows.count()
    quotas = _quotas(total, shards)
    groups = staged(rows.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("group_rows")).where("group_rows > 1"), "shard-groups")
    # no more groups than twice the shards can be as large as the least shard
    whole = _whole([tuple(r) for r in groups.where(F.col("group_rows") >= max(1, min(quotas))).collect()] if total else [], quotas)
    fixed = docs.sparkSession.createDataFrame(whole, "_g1 long, _g2 long, shard int, n long")
    taken = fixed.groupBy(*GROUP).agg(F.sum("n").alias("_taken"))
    rest = groups.join(F.broadcast(taken), GROUP, "left").select(*GROUP, (F.col("group_rows") - F.coalesce("_taken", F.lit(0))).alias("n")).where("n > 0")
    full = {b[2] for b in whole}
    open_quotas = [0 if s in full else q for s, q in enumerate(quotas)]
    free = sorted((s for s in range(shards) if s not in full), key=lambda s: -quotas[s]) or [0]  # those with a row more come first
    order = F.xxhash64("_g1", "_g2", F.lit(seed))
    dealt = running_total(staged(rest, "shard-rest"), [], F.pmod(order, n_buckets(F.lit(total))), [order, F.col("_g1"), F.col("_g2")], F.col("n"), "_first")
    part = F.explode(F.sequence(F.lit(0), F.least(F.col("n"), F.lit(len(free))) - 1))
    blocks = dealt.withColumn("_j", part).select(*GROUP, _lookup(F.pmod(F.col("_first") + F.col("_j"), F.lit(len(free))), free).alias("shard"), (F.floor((F.col("n") - F.col("_j") - 1) / len(free)) + 1).cast("long").alias("n"))
    blocks = staged(blocks, "shard-blocks")
    r, still = 0, 0
    while still < 2:  # ties are broken anew in each round, so one without a move may be by chance
        blocks, moved = _propagate(blocks, open_quotas, seed + r)
        r, still = r + 1, 0 if moved else still + 1
    blocks = staged(blocks.unionByName(fixed), "shard-blocks")
    filled = _occupied(blocks, shards)

    # rows of a group take its blocks in order of their rank; a group has one block a shard at most
    ends = Window.partitionBy(*GROUP).orderBy("shard")
    spans = blocks.withColumn("_end", F.sum("n").over(ends)).groupBy(*GROUP).agg(F.sum("n").alias("group_rows"), F.array_sort(F.collect_list(F.struct("_end", "shard"))).alias("_spans"))
    spans = staged(spans, "shard-spans")
    linked = staged(lookup(rows, spans, GROUP, groups.select(*GROUP, F.col("group_rows").alias("n"))), "shard-linked")
    order = [F.col("_h"), F.col("doc_id"), *map(F.col, GROUP)]
    ranked = running_total(linked.where("group_rows is not null"), GROUP, F.pmod("_h", n_buckets(F.col("group_rows"))), order, F.lit(1), "_rank")
    placed = ranked.withColumn("shard", F.element_at(F.filter("_spans", lambda s: s["_end"] > F.col("_rank")), 1)["shard"])

    room = [q - f for q, f in zip(quotas, filled, strict=True)]
    singles = linked.where("group_rows is null")
    singles = running_total(singles, [], F.pmod("_h", n_buckets(F.lit(total))), order, F.lit(1), "_rank")
    cut = F.lit(shards - 1)
    for s in reversed(range(shards - 1)):
        cut = F.when(F.col("_rank") < sum(room[: s + 1]), F.lit(s)).otherwise(cut)
    singles = singles.withColumn("shard", cut)

    columns = ["doc_id", "size", "text_crc32", "_h", *GROUP, F.col("shard").cast("int").alias("shard"), F.coalesce("group_rows", F.lit(1)).alias("group_rows")]
    both = staged(placed.select(*columns).unionByName(singles.select(*columns)), "shard-placed")
    slots = running_total(both, ["shard"], F.pmod("_h", n_buckets(F.lit(total / shards))), order, F.lit(1), "slot")
    return slots.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "group_rows")
