"""Mixing sources to target weights: hierarchical budgets over a domain-language-source tree, seeded epochs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, n_buckets, running_total, staged

LEVELS = ["domain", "lang", "source"]
#: Default target weights of each level's names; a name that isn't listed weighs OTHER.
DOMAIN_WEIGHTS = {"web": 0.4, "books": 0.3, "forums": 0.2, "reference": 0.1}
LANG_WEIGHTS = {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}
OTHER = 0.05
#: Leaves up to which the plan is broadcast; beyond, it is joined by shuffle.
BROADCAST_LEAVES = 50_000


def default_domain() -> Column:
    """Domain of a source: the number at its end, modulo the number of domains; 0 without one."""
    names = F.array(*[F.lit(x) for x in DOMAIN_WEIGHTS])
    number = F.coalesce(F.expr("try_cast(regexp_extract(coalesce(source, ''), '([0-9]{1,9})$', 1) AS INT)"), F.lit(0))
    return F.element_at(names, F.pmod(number, F.lit(len(DOMAIN_WEIGHTS))) + 1)


def _weight(column: str, weights: Mapping[str, float], other: float) -> Column:
    out = F.lit(other)
    for name, w in weights.items():
        out = F.when(F.col(column) == name, F.lit(float(w))).otherwise(out)
    return out


def _share(nodes: DataFrame, parent: list[str], budget: str, out: str, name: str) -> DataFrame:
    """Split each parent's budget over its children by weight; what a child lacks goes to its siblings.

    Closed form of water filling: with siblings sorted by capacity a weight, a child is full if its own ratio
    times the weights from it on, plus the capacities before it, is within the budget. The others share the
    rest by weight. A child of weight 0 gets nothing.
    """
    ratio = F.when(F.col("_w") > 0, F.col("_cap") / F.col("_w")).otherwise(F.lit(float("inf")))
    w = Window.partitionBy(*parent)
    order = w.orderBy("_ratio", name)
    d = nodes.withColumn("_ratio", ratio)
    d = d.withColumn("_before", F.coalesce(F.sum(F.when(F.col("_w") > 0, F.col("_cap")).otherwise(0.0)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    d = d.withColumn("_rest", F.sum("_w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    d = d.withColumn("_full", (F.col("_w") > 0) & (F.col("_ratio") * F.col("_rest") + F.col("_before") <= F.col(budget)))
    given = F.coalesce(F.sum(F.when(F.col("_full"), F.col("_cap"))).over(w), F.lit(0.0))
    open_ = F.sum(F.when(~F.col("_full"), F.col("_w")).otherwise(0.0)).over(w)
    d = d.withColumn("_given", given).withColumn("_open", open_)
    part = F.when(F.col("_full"), F.col("_cap")).when(F.col("_open") > 0, (F.col(budget) - F.col("_given")) * F.col("_w") / F.col("_open")).otherwise(0.0)
    return d.withColumn(out, part).drop("_ratio", "_before", "_rest", "_full", "_given", "_open")


def plan_budgets(leaves: DataFrame, budget: float | None, max_epochs: int, domain_weights=None, lang_weights=None, source_weights=None) -> DataFrame:
    """Budgets of the leaves (domain, lang, source, docs, tokens): adds budget, full_epochs and rest_tokens.

    A node can give what its leaves hold times `max_epochs`. Budgets go down the tree, so a shortage is met by
    siblings first, and by an ancestor's siblings only if the whole subtree is short. Null budget: all tokens.
    """
    caps = leaves.withColumn("_leafcap", F.col("tokens") * F.lit(float(max_epochs)))
    root = caps.agg(F.coalesce(F.lit(budget).cast("double"), F.sum("tokens").cast("double")).alias("_b0"))
    top = caps.groupBy("domain").agg(F.sum("_leafcap").alias("_cap")).withColumn("_w", _weight("domain", domain_weights or DOMAIN_WEIGHTS, OTHER)).join(F.broadcast(root))  # one row
    top = _share(top.withColumn("_root", F.lit(0)), ["_root"], "_b0", "_b1", "domain").select("domain", "_b1")
    mid = caps.groupBy("domain", "lang").agg(F.sum("_leafcap").alias("_cap")).withColumn("_w", _weight("lang", lang_weights or LANG_WEIGHTS, OTHER)).join(top, "domain")
    mid = _share(mid, ["domain"], "_b1", "_b2", "lang").select("domain", "lang", "_b2")
    low = caps.withColumn("_cap", F.col("_leafcap")).withColumn("_w", _weight("source", source_weights or {}, 1.0)).join(mid, ["domain", "lang"])
    low = _share(low, ["domain", "lang"], "_b2", "_b3", "source")
    low = low.withColumn("budget", F.floor(F.col("_b3") + 1e-6).cast("long"))
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("long")
    return low.withColumn("full_epochs", whole).select(*LEVELS, "docs", "tokens", "budget", "full_epochs", (F.col("budget") - F.col("full_epochs") * F.col("tokens")).alias("rest_tokens"))


def mix(docs: DataFrame, budget: float | None = None, max_epochs: int = 4, seed: int = 17, domain: Column | None = None, domain_weights=None, lang_weights=None, source_weights=None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each document and epoch that the mix takes: doc_id, domain, lang, source, epoch, n_tokens, start_token, take_tokens.

    Tokens are words. A leaf that must give its tokens k times and a rest takes k whole epochs and, of epoch k,
    the prefix of that many tokens in an order seeded by epoch and doc_id, or by the text where doc_id is null; rows of
    one doc_id follow by hashes of text and `keep`, so the result doesn't depend on the table's layout. The last document
    of a prefix may be cut (take_tokens < n_tokens). Null lang or source count as ''; null text has no words and is taken
    only in whole epochs; repeated rows are separate documents; an empty table gives no rows. Columns in `keep` are carried.
    """
    names = {"lang": F.coalesce("lang", F.lit("")), "source": F.coalesce("source", F.lit(""))}
    rows = docs.select("doc_id", (default_domain() if domain is None else domain).alias("domain"), *[c.alias(k) for k, c in names.items()], F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("n_tokens"), F.xxhash64("text", *keep).alias("_tie"), *[F.col(c).alias(f"_keep_{c}") for c in keep])
    rows = staged(rows, "mix-rows")
    leaves = rows.groupBy(*LEVELS).agg(F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").alias("tokens"))
    plan = staged(plan_budgets(leaves, budget, max_epochs, domain_weights, lang_weights, source_weights), "mix-plan")
    small = plan.count() <= BROADCAST_LEAVES
    rows = rows.join(F.broadcast(plan) if small else plan, LEVELS).where("budget > 0")
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.col("_tie").cast("string")))
    rows = rows.withColumn("_key", F.md5(F.concat_ws(":", F.lit(seed), "full_epochs", name).cast("binary")))
    # the first 8 hex digits deal a leaf into ranges of its order, so buckets follow the order itself
    bucket = F.shiftright(F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") * n_buckets(F.col("docs")), 32)
    rows = running_total(rows, LEVELS, bucket, [F.col("_key"), F.col("doc_id"), F.col("_tie")], F.col("n_tokens"), "start_token")
    rest = F.greatest(F.lit(0), F.least(F.col("n_tokens"), F.col("rest_tokens") - F.col("start_token")))
    last = F.when(rest > 0, F.array(F.col("full_epochs"))).otherwise(F.array().cast("array<bigint>"))
    whole = F.when(F.col("full_epochs") > 0, F.sequence(F.lit(0).cast("bigint"), F.col("full_epochs") - 1)).otherwise(F.array().cast("array<bigint>"))
    rows = rows.withColumn("_rest", rest).withColumn("epoch", F.explode(F.concat(whole, last)))
    partial = F.col("epoch") == F.col("full_epochs")
    own = [c for c in LEVELS if c not in keep]
    return rows.select("doc_id", *own, "epoch", "n_tokens", F.when(partial, F.col("start_token")).alias("start_token"), F.when(partial, F.col("_rest")).otherwise(F.col("n_tokens")).alias("take_tokens"), *[F.col(f"_keep_{c}").alias(c) for c in keep])
