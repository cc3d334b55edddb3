"""SimHash document fingerprints and a Hamming search through permuted block tables."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import GAP, let, staged

LANES = 0x0000000100000001
#: Quantile cells of doc_id; ranges inside a cell are cut evenly.
CELLS = 64


def term_hashes(text: Column) -> Column:
    """Hashes of the text's terms: pairs of neighbouring words, or the word itself where there is only one."""
    words = F.filter(F.split(text, GAP), lambda w: w != "")

    def pairs(w):
        n = F.size(w)
        several = F.transform(F.slice(w, 1, F.greatest(n - 1, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1)))
        return F.when(n == 1, F.transform(w, lambda x: F.xxhash64(x))).otherwise(several)

    return let(words, pairs)


def votes(term: Column) -> list[Column]:
    """32 sums; sum i counts, in two lanes of 32 bits, the terms whose bits i and i + 32 are set."""
    return [F.sum(F.shiftrightunsigned(term, i).bitwiseAND(F.lit(LANES))).alias(f"_v{i}") for i in range(32)]


def signed_bits(n: Column) -> Column:
    """Bit i of the fingerprint is set if more than half of the n weighted terms set it."""
    out = F.lit(0).cast("long")
    for i in range(32):
        low, high = F.col(f"_v{i}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(F.col(f"_v{i}"), 32)
        out = out.bitwiseOR(F.when(low * 2 > n, F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
        bit = 1 << (i + 32) if i < 31 else -(1 << 63)
        out = out.bitwiseOR(F.when(high * 2 > n, F.lit(bit)).otherwise(F.lit(0)).cast("long"))
    return out


def range_bucket(docs: DataFrame, rows_per_bucket: int) -> Column:
    """Bucket of a doc_id, rising with it: cells between approximate quantiles, cut evenly. Null: the first."""
    cells = docs.agg(F.percentile_approx("doc_id", [i / CELLS for i in range(CELLS + 1)], 10_000), F.count(F.lit(1))).first()
    bounds, rows = sorted(set(cells[0] or [0])), cells[1]
    parts = max(1, -(-rows // (rows_per_bucket * max(1, len(bounds) - 1))))
    key = F.col("doc_id")

    def tree(lo: int, hi: int) -> Column:
        if hi - lo <= 1:
            a, b = bounds[lo], bounds[min(lo + 1, len(bounds) - 1)]
            inside = F.floor((key - F.lit(a)).cast("double") * parts / max(1, b - a + 1))
            return F.lit(lo * parts).cast("long") + F.greatest(F.lit(0), F.least(F.lit(parts - 1), inside)).cast("long")
        mid = (lo + hi) // 2
        return F.when(key < bounds[mid], tree(lo, mid)).otherwise(tree(mid, hi))

    return F.when(key.isNull(), F.lit(-1).cast("long")).otherwise(tree(0, len(bounds)))


def with_next(df: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """Add the `value` of the next row in (_bucket, order); after the last row, that of the first."""
    inside = Window.partitionBy("_bucket").orderBy(*order)
    first = df.groupBy("_bucket").agg(F.min(F.struct(*order, F.col(value).alias("_v"))).alias("_f")).select("_bucket", "_f._v")
    every = Window.orderBy("_bucket")  # one row for each bucket
    whole = every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = first.select("_bucket", F.coalesce(F.lead(F.struct("_v")).over(every), F.first(F.struct("_v")).over(whole))["_v"].alias("_after"))
    rows = df.withColumn("_last", F.row_number().over(inside) == F.count(F.lit(1)).over(Window.partitionBy("_bucket"))).withColumn("_lead", F.lead(value).over(inside))
    return rows.join(after, "_bucket").withColumn(out, F.when(F.col("_last"), F.col("_after")).otherwise(F.col("_lead"))).drop("_last", "_lead", "_after")


def simhash(rows: DataFrame, keys: list[str], text: str = "text", out: str = "_fp") -> DataFrame:
    """Fingerprint of `text` for each distinct `keys`; no shuffle where the rows are dealt by one of them."""
    terms = rows.select(*keys, F.explode_outer(term_hashes(F.col(text))).alias("_term"))
    return terms.groupBy(*keys).agg(F.count("_term").alias("_n"), *votes(F.coalesce("_term", F.lit(0)))).select(*keys, signed_bits(F.col("_n")).alias(out))


def likeness(a: str, b: str) -> Column:
    return (F.lit(64) - F.bit_count(F.col(a).bitwiseXOR(F.col(b)))) / F.lit(64.0)


def block_masks(radius: int, blocks: int | None = None) -> list[int]:
    """Masks of the permuted tables: the bits are cut into blocks; every choice of blocks - radius of them is a table."""
    blocks = blocks or 2 * radius
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    parts = [sum(1 << i for i in range(a, b)) for a, b in zip(cuts, cuts[1:], strict=False)]
    masks = [sum(c) for c in combinations(parts, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def hamming_search(queries: DataFrame, index: DataFrame, radius: int = 3) -> DataFrame:
    """Pairs (query, found) of fingerprints `_fp` with at most `radius` unlike bits, found through block tables.

    Two such fingerprints agree on the blocks of at least one table, so none is missed. Both inputs hold each
    fingerprint once; a pair that meets in many tables is kept in the first only.
    """
    masks = block_masks(radius)

    def posted(d: DataFrame, name: str) -> DataFrame:
        entries = F.array(*[F.struct(F.lit(t).alias("t"), F.col("_fp").bitwiseAND(F.lit(m)).alias("k")) for t, m in enumerate(masks)])
        return d.select(F.col("_fp").alias(name), F.explode(entries).alias("e")).select(name, "e.*")

    x = F.col("query").bitwiseXOR(F.col("found"))
    first = F.lit(len(masks))
    for t in reversed(range(len(masks))):
        first = F.when(x.bitwiseAND(F.lit(masks[t])) == 0, F.lit(t)).otherwise(first)
    return posted(queries, "query").join(posted(index, "found"), ["t", "k"]).where((F.bit_count(x) <= radius) & (first == F.col("t"))).select("query", "found")


def fingerprint_documents(docs: DataFrame, radius: int = 3, query_step: int = 20, rows_per_bucket: int = 2_000) -> DataFrame:
    """Fingerprints of every text and of its edited text, their likenesses, and near rows by block tables.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (16 hex digits), near_edited,
    near_next, and near_rows: for rows whose doc_id is divisible by `query_step`, the number of other rows within
    `radius` bits, else null. The edited text ends in the beginning of the next text by (doc_id, text). Null
    text counts as empty, and a text without words has fingerprint 0; a null doc_id comes first; repeated rows
    are separate rows; a lone row is its own next; an empty table gives no rows; other columns are ignored.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("_bucket", range_bucket(rows, rows_per_bucket))
    rows = with_next(rows, ["doc_id", "text"], "text", "_next")
    inside = Window.partitionBy("_bucket").orderBy("doc_id", "text")
    n, cut = F.length("text"), F.floor(F.length("text") / 4).cast("int")
    rows = rows.withColumn("_row", F.row_number().over(inside)).withColumn("n_chars", n.cast("long")).withColumn("_edited", F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 4) as int))"), F.left("_next", cut)))
    both = F.array(F.struct(F.lit(0).alias("w"), F.col("text").alias("text")), F.struct(F.lit(1).alias("w"), F.col("_edited").alias("text")))
    keys = ["_bucket", "_row", "doc_id", "n_chars", "edited_sha256"]
    rows = rows.withColumn("edited_sha256", F.sha2("_edited", 256)).withColumn("_b", F.explode(both)).select(*keys, "_b.w", "_b.text")
    marks = simhash(rows, [*keys, "w"])
    marks = marks.groupBy(*keys).agg(F.max(F.when(F.col("w") == 0, F.col("_fp"))).alias("_fp"), F.max(F.when(F.col("w") == 1, F.col("_fp"))).alias("_efp"))
    marks = staged(marks, "fingerprints")
    marks = with_next(marks, ["_row"], "_fp", "_nfp")
    counted = marks.groupBy("_fp").agg(F.count(F.lit(1)).alias("_rows"), F.max(F.coalesce(F.col("doc_id") % query_step == 0, F.lit(False))).alias("_asked"))
    counted = staged(counted, "fingerprint-counts")
    near = hamming_search(counted.where("_asked"), counted.select("_fp"), radius)
    near = near.join(counted.select(F.col("_fp").alias("found"), "_rows"), "found").groupBy(F.col("query").alias("_fp")).agg((F.sum("_rows") - 1).alias("_near"))
    marks = marks.join(near, "_fp", "left")
    hexed = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    asked = F.col("doc_id") % query_step == 0
    return marks.select("doc_id", "n_chars", "edited_sha256", hexed("_fp").alias("fingerprint"), hexed("_efp").alias("edited_fingerprint"), likeness("_fp", "_efp").alias("near_edited"), likeness("_fp", "_nfp").alias("near_next"), F.when(asked, F.col("_near")).alias("near_rows"))
