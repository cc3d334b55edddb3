"""MinHash near-duplicates: inverted join over signature coordinates, exact links, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import grouped, staged, unstage
from .graph import components

#: Signature coordinates; counters a coordinate in the frequency sketch; members that a list's block holds, about.
COORDINATES, SKETCH, BLOCK = 64, 4_096, 4_096
#: Posted rows of a batch; rows of a tile of compared members; share of all rows from which a class is broadcast.
POSTED_ROWS, TILE, HOT_SHARE = 1 << 15, 512, 1 / 1_000
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_seeds = np.random.default_rng(64)
MULTIPLY = _seeds.integers(1, 1 << 32, COORDINATES, dtype=np.uint32) | np.uint32(1)
ADD = _seeds.integers(0, 1 << 32, COORDINATES, dtype=np.uint32)


def least_matches(num: int, den: int, coordinates: int = COORDINATES) -> int:
    """Coordinates that must match: 5.5 standard deviations under what a pair right at the similarity shows."""
    j = num / den
    return max(1, int(coordinates * j - 5.5 * (coordinates * j * (1 - j)) ** 0.5))


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's k-word shingles; of the whole sequence if it has fewer words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # A-Z only; the six white-space bytes only
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(h) - k + 1)
    out = np.full(n, min(len(h), k), np.uint64)
    for i in range(min(k, len(h))):
        out = (out ^ h[i : i + n]) * M1
        out ^= out >> np.uint64(29)
    out *= M2
    out ^= out >> np.uint64(32)
    return np.unique(out)


def signature(s: np.ndarray) -> np.ndarray:
    x = (s >> np.uint64(32)).astype(np.uint32)[:, None]
    out = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(x), 1024):
        np.minimum(out, (x[lo : lo + 1024] * MULTIPLY + ADD).min(0), out=out)
    return out


def _record(names: str, types: list, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names.split())


def _signed(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = shingles(text.as_py(), k)
                key = xxhash.xxh3_128_digest(s.tobytes())
                values = (doc, len(s), int.from_bytes(key[:8], "big", signed=True), int.from_bytes(key[8:], "big", signed=True), signature(s).tobytes() if len(s) else None)
                for column, v in zip(out, values, strict=True):
                    column.append(v)
            yield _record("doc_id n k1 k2 sig", [pa.int64()] * 4 + [pa.binary()], out)

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _record("node shingles", [pa.int64(), pa.binary()], [batch.column(0), [shingles(t.as_py(), k).tobytes() for t in batch.column(1)]])

    return run


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, COORDINATES)


def _slots(sig: np.ndarray) -> np.ndarray:
    return (sig >> np.uint32(7)) % np.uint32(SKETCH) + np.arange(COORDINATES, dtype=np.uint32) * np.uint32(SKETCH)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(COORDINATES * SKETCH, np.int64)
    for batch in batches:
        counts += np.bincount(_slots(_signatures(batch.column(0))).ravel(), minlength=len(counts))
    used = np.flatnonzero(counts)
    yield _record("slot n", [pa.int64()] * 2, [used, counts[used]])


def _posted(sketch, prefix: int, members: int):
    """Each class under its `prefix` rarest coordinate-value pairs; those of long lists to pairs of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity = sketch.value
        lane = np.arange(COORDINATES, dtype=np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                some = batch.slice(lo, 4096)
                sig = _signatures(some.column(2))
                token = (lane << 32) | sig.astype(np.int64)
                often = rarity[_slots(sig)]
                order = np.lexsort((token, often), axis=1)[:, :prefix]  # one order of tokens for all classes
                row = np.repeat(np.arange(len(sig)), prefix)
                col = order.ravel()
                token, often = token[row, col], often[row, col]
                node = np.asarray(some.column(0))
                blocks = -(-often // members)
                own = (node[row].astype(np.uint64) * M1 >> np.uint64(33)).astype(np.int64) % blocks
                copies = np.repeat(np.arange(len(row)), blocks)
                other = np.arange(len(copies)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                weight, small = np.asarray(some.column(1)), (sig >> np.uint32(3)).astype(np.uint8)
                raw = [x.tobytes() for x in small]
                for at in range(0, len(copies), POSTED_ROWS):
                    some_copies = copies[at : at + POSTED_ROWS]
                    a, b, r = own[some_copies], other[at : at + POSTED_ROWS], row[some_copies]
                    block = np.minimum(a, b) * (1 << 24) + np.maximum(a, b)
                    yield _record("token block node weight sig", [pa.int64()] * 4 + [pa.binary()], [token[some_copies], block, node[r], weight[r], [raw[i] for i in r.tolist()]])

    return run


def _lists(least: int):
    """Members of each list whose signatures match another member's, and the list's leader where they match it."""

    def matches(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a[:, None, :] == b[None, :, :]).sum(2, dtype=np.uint8)

    def active(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lead = matches(sig, sig[:1])[:, 0] >= least
        lead[0] = False
        on = lead.copy()
        on[0] = lead.any()
        rest = np.flatnonzero(~on)
        for lo in range(0, len(rest), 64):
            some = rest[lo : lo + 64]
            for at in range(0, len(sig), 2048):
                hit = matches(sig[some], sig[at : at + 2048]) >= least
                own = (some >= at) & (some < at + 2048)
                hit[np.flatnonzero(own), some[own] - at] = False
                on[some] |= hit.any(1)
        return on, lead

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in range(4)]
        for t in grouped(batches, ("token", "block")):
            if t.num_rows < 2:
                continue
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(-1, COORDINATES)
            on, lead = active(sig)
            if not on.any():
                continue
            node = t.column("node").to_numpy()
            for i in np.flatnonzero(on).tolist():
                for column, v in zip(out, (t.column("token")[0].as_py(), t.column("block")[0].as_py(), int(node[i]), int(node[0]) if lead[i] else None), strict=True):
                    column.append(v)
            if len(out[0]) > 20_000:
                yield _record("token block node leader", [pa.int64()] * 4, out)
                out = [[] for _ in range(4)]
        yield _record("token block node leader", [pa.int64()] * 4, out)

    return run


def _confirmed(num: int, den: int):
    """Pairs whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * both >= num * (len(x) + len(y) - both))
            yield _record("a b", [pa.int64()] * 2, [batch.column(0).filter(pa.array(keep, pa.bool_())), batch.column(1).filter(pa.array(keep, pa.bool_()))])

    return run


def _linked(num: int, den: int):
    """Links between unlike components of a list's members, by their full sets: a spanning forest of them.

    Common shingle counts are products of 0/1 matrices, a few hundred shingles at a time. A member that shares too
    few of its shingles with the rest can't be linked and is left out first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, ("token", "block")):
            raw = t.column("shingles").to_pylist()
            node, comp = t.column("node").to_numpy(), t.column("component").to_numpy()
            size = np.array([len(x) // 8 for x in raw])
            flat = np.frombuffer(b"".join(raw), np.uint64)
            _, which, often = np.unique(flat, return_inverse=True, return_counts=True)
            owner = np.repeat(np.arange(len(raw)), size)
            shared = often[which] > 1
            keep = den * np.bincount(owner[shared], minlength=len(raw)) >= num * size
            if len(np.unique(comp[keep])) < 2:
                continue
            shared &= keep[owner]
            column = np.cumsum(np.bincount(which[shared], minlength=len(often)) > 0) - 1
            cols, rows = column[which[shared]], (np.cumsum(keep) - 1)[owner[shared]]
            node, comp, size = node[keep], comp[keep], size[keep]
            order = np.argsort(cols, kind="stable")
            cols, rows = cols[order], rows[order]
            a, b = [], []
            root = {c: c for c in comp.tolist()}

            def find(c, root=root):
                while root[c] != c:
                    root[c] = c = root[root[c]]
                return c

            for top in range(0, len(node), TILE):  # rows of a tile against those from it on
                end = min(top + TILE, len(node))
                both = np.zeros((end - top, len(node) - top), np.float32)
                for at in range(0, int(cols[-1]) + 1, 512):
                    lo, hi = np.searchsorted(cols, (at, at + 512))
                    mine = rows[lo:hi] >= top
                    part = np.zeros((len(node) - top, 512), np.float32)
                    part[rows[lo:hi][mine] - top, cols[lo:hi][mine] - at] = 1
                    both += part[: end - top] @ part.T
                links = (den * both >= num * (size[top:end, None] + size[None, top:] - both)) & (comp[top:end, None] != comp[None, top:])
                for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(links))), strict=True):
                    p, q = find(int(comp[top + i])), find(int(comp[top + j]))
                    if p != q:
                        root[p] = q
                        a.append(int(node[top + i]))
                        b.append(int(node[top + j]))
            if a:
                yield _record("a b", [pa.int64()] * 2, [a, b])

    return run


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, block: int = BLOCK) -> DataFrame:
    """One row for each row of `docs`: doc_id, n_shingles, component_id (smallest doc_id reachable), kept.

    Rows with equal shingle sets form a class, which its smallest doc_id stands for. A class's MinHash signature
    is posted under its rarest coordinate-value pairs (prefix): two signatures that match in `least_matches`
    coordinates share one of them. The long lists beyond the prefix are skipped and only counted, by comparing
    signatures. Lists never give all their pairs: members are linked to the list's leader, confirmed on full
    sets, and joined to components; only lists that still hold unlike components compare full sets among
    themselves, in blocks of bounded size, and give a spanning forest. So classes of any size cost no pairs.

    A pair is missed if its signatures match in less than `least_matches`: 5.5 standard deviations under the mean
    at the threshold. Null or empty texts have no shingles and are linked with nothing. Rows with one doc_id are
    one document; a null doc_id takes its class's id, else stays alone (null). Very long texts count whole; other
    columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship_package(spark)
    least = least_matches(num, den)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = staged(texts.mapInArrow(_signed(k), "doc_id long, n long, k1 long, k2 long, sig binary"), "near-rows")
    classes = rows.where("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("weight"), F.min("sig").alias("sig"))
    classes = staged(classes, "near-classes")
    known = classes.where("node is not null")

    counts = known.select("sig").mapInArrow(_counted, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()  # COORDINATES x SKETCH rows at most
    sketch = np.zeros(COORDINATES * SKETCH, np.int64)
    sketch[counts["slot"].to_numpy(np.int64)] = counts["n"].to_numpy(np.int64)
    posted = known.select("node", "weight", "sig").mapInArrow(_posted(spark.sparkContext.broadcast(sketch), COORDINATES - least + 1, block), "token long, block long, node long, weight long, sig binary")
    posted = posted.repartition("token", "block").sortWithinPartitions("token", "block", F.desc("weight"), "node")
    active = staged(posted.mapInArrow(_lists(least), "token long, block long, node long, leader long"), "near-active")

    wanted = active.select("node").distinct()
    sets = texts.join(wanted, texts["doc_id"] == wanted["node"], "left_semi")
    sets = staged(sets.mapInArrow(_sets(k), "node long, shingles binary").where("length(shingles) > 0").dropDuplicates(["node", "shingles"]), "near-sets")
    stars = active.where("leader is not null").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()
    pairs = stars.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "x", "y")
    stars = staged(pairs.mapInArrow(_confirmed(num, den), "a long, b long"), "near-stars")
    first = components(stars)

    members = active.select("token", "block", "node").join(first, "node", "left").withColumn("component", F.coalesce("component", "node"))
    members = staged(members, "near-members")
    # lists with the same members say the same: of those, one is compared
    mark = F.xxhash64("node")
    lists = members.groupBy("token", "block").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi"), F.count(F.lit(1)).alias("_n"), F.bit_xor(mark).alias("_x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("_y"))
    unlike = lists.where("_lo <> _hi").groupBy("_n", "_x", "_y").agg(F.min(F.struct("token", "block")).alias("_l")).select("_l.token", "_l.block")
    members = members.join(unlike, ["token", "block"], "left_semi").join(sets, "node").select("token", "block", "node", "component", "shingles")
    rest = members.repartition("token", "block").sortWithinPartitions("token", "block", "node").mapInArrow(_linked(num, den), "a long, b long")
    # what the stars joined is already one node of the graph that the rest is added to
    found = components(stars.unionByName(rest))

    named = staged(classes.join(found, "node", "left").select("k1", "k2", "weight", F.coalesce("component", "node").alias("component_id")), "near-named")
    unstage(active, sets, stars, first, members, found, classes)
    classes = named
    # a class of many copies isn't dealt by its key: no more than 1 / HOT_SHARE of them are broadcast
    total = classes.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    hot = F.col("weight") >= max(2, int(total * HOT_SHARE))
    key, each = ["k1", "k2"], rows.select("doc_id", "n", "k1", "k2")
    many = F.broadcast(classes.where(hot).select(*key, F.col("component_id").alias("_hot"), F.lit(True).alias("_many")))
    marked = each.join(many, key, "left")
    apart = marked.where("_many or n = 0").select("doc_id", "n", F.col("_hot").alias("component_id"))
    dealt = marked.where("_many is null and n > 0").drop("_hot", "_many").join(classes.where(~hot).select(*key, "component_id"), key, "left").select("doc_id", "n", "component_id")
    out = apart.unionByName(dealt).select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
