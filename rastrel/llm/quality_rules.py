"""Quality rules: text statistics in one pass, and decision lists learnt from labelled statistics by sequential covering."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAP, GAP_CHARS, let, staged

# Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Bits for a word's place beside its window's hash: enough for most texts, and for any string that Spark can hold.
POS_BITS, ALL_BITS = 24, 31
#: Statistics that rules may test, and the ratios they are made from.
FEATURES = {
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "marks_per_word": "n_marks / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "chars_per_word": "word_chars / greatest(n_words, 1)",
}
#: Cut points tested for each statistic: quantiles of the labelled rows at these shares.
CUTS = (0.0, 0.02, 0.05, 0.1, 0.3, 0.5, 0.7, 0.85, 0.9, 0.94, 0.97, 1.0)


def _repeat_words(w: Column) -> Column:
    """Words in 3-word windows that occur twice or more."""
    n = F.size(w)
    return F.when(n < 3, F.lit(0).cast("long")).when(n < 1 << POS_BITS, _covered(w, n, POS_BITS)).otherwise(_covered(w, n, ALL_BITS))


def _covered(w: Column, n: Column, bits: int) -> Column:
    """Windows are sorted by (hash, position) in one long each, of which the position has `bits` bits."""
    mask = (1 << bits) - 1
    codes = F.transform(F.slice(w, 1, F.greatest(n - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(F.lit(~mask)).bitwiseOR(i.cast("long")))

    def repeated(s):
        def at(v):
            return v.bitwiseAND(F.lit(mask)).cast("int")

        def same(a, b):  # by hash first, then by the words themselves: as an array's overlap these are looked at only then
            p, q = at(a), at(b)
            return (F.shiftright(a, bits) == F.shiftright(b, bits)) & F.arrays_overlap(F.array(F.lit(True)), F.array((F.get(w, p) == F.get(w, q)) & (F.get(w, p + 1) == F.get(w, q + 1)) & (F.get(w, p + 2) == F.get(w, q + 2))))

        return F.filter(s, lambda v, i: F.coalesce(same(v, F.get(s, i - 1)), F.lit(False)) | F.coalesce(same(v, F.get(s, i + 1)), F.lit(False)))

    spots = let(F.array_sort(codes), lambda s: F.array_sort(F.transform(repeated(s), lambda v: v.bitwiseAND(F.lit(mask)))))
    return let(spots, lambda p: F.aggregate(F.transform(p, lambda v, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - v, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x))


def statistics(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_marks, n_upper of each whole text.

    Null or empty text: all 0. Lines are split at \\n and counted if they hold a word. Repeated rows stay.
    """
    text = F.coalesce("text", F.lit(""))

    def without(chars: str) -> Column:
        return F.length(text) - F.length(F.translate(text, chars, ""))

    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, GAP_CHARS, "")) > 0)
    counts = let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d")))
    words = let(F.filter(F.split(text, GAP), lambda x: x != ""), lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w).alias("r")))
    d = docs.select("doc_id", *keep, words.alias("_w"), counts.alias("_l"), (F.length(text) - without(GAP_CHARS)).alias("_wc"), without(SYMBOLS).alias("_s"), without("!?").alias("_m"), without("ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("_u"))
    fields = {"n_words": F.col("_w.n"), "word_chars": F.col("_wc"), "n_symbols": F.col("_s"), "n_dup_lines": F.col("_l.n") - F.col("_l.d"), "n_repeat_words": F.col("_w.r"), "n_lines": F.col("_l.n"), "n_marks": F.col("_m"), "n_upper": F.col("_u")}
    return d.select("doc_id", *keep, *[c.cast("long").alias(k) for k, c in fields.items()])


#: Rejecting a good row costs as much as missing so many bad ones.
GOOD_COST = 10


@dataclass(frozen=True)
class Rule:
    """Reject where every condition (statistic, 'ge' or 'lt', threshold) holds."""

    conditions: tuple[tuple[str, str, float], ...]

    def column(self) -> Column:
        out = F.lit(True)
        for name, op, at in self.conditions:
            x = F.expr(FEATURES[name])
            out = out & ((x >= F.lit(at)) if op == "ge" else (x < F.lit(at)))
        return out


def _cells(stats: DataFrame) -> tuple[dict[str, list[float]], list[tuple[tuple[int, ...], int, int]]]:
    """Labelled statistics: counts of good and bad rows in each cell between the cut points of all statistics.

    At most (cuts + 1) ** statistics cells whatever the number of rows; all labelled rows count.
    """
    quantiles = stats.agg(*[F.percentile_approx(F.expr(e), list(CUTS), 10_000).alias(k) for k, e in FEATURES.items()]).first()
    cuts = {k: sorted({float(x) for x in (quantiles[k] or [])}) for k in FEATURES}
    # half-way between neighbouring quantiles, so that a threshold keeps its distance from either side
    cuts = {k: [(a + b) / 2 for a, b in zip(v, v[1:])] for k, v in cuts.items()}

    def cell(k: str) -> Column:
        x, out = F.expr(FEATURES[k]), F.lit(0)
        for at in cuts[k]:
            out = out + (x >= F.lit(at)).cast("int")
        return out.alias(k)

    rows = stats.select(*[cell(k) for k in FEATURES], "quality").groupBy(*FEATURES).agg(F.sum((F.col("quality") == 1).cast("long")), F.sum((F.col("quality") == 0).cast("long"))).collect()
    return cuts, [(tuple(r[: len(FEATURES)]), int(r[-2]), int(r[-1])) for r in rows]


def learn_rules(stats: DataFrame, max_rules: int = 8, max_conditions: int = 3, least_precision: float = 0.97, least_cover: float = 0.004) -> list[Rule]:
    """Sequential covering over labelled statistics (quality 1 good, 0 bad): grow, prune, keep, remove what is covered.

    Each rule grows by the condition with the best m-estimate of precision, good rows weighing GOOD_COST times, is
    pruned to the shortest prefix that is as precise, and is kept if its precision and cover are enough; else its
    first condition is struck off and another rule is tried. Without labels of both kinds there are no rules.
    """
    cuts, cells = _cells(stats)
    names = list(FEATURES)
    bad_all = sum(c[2] for c in cells)
    good_all = sum(c[1] for c in cells)
    rules: list[Rule] = []
    if not bad_all or not good_all:
        return rules
    prior = bad_all / (bad_all + good_all)

    def holds(cell, condition):
        f, op, at = condition
        return (cell[0][f] > at) == (op == "ge")

    def score(rows):
        g, b = sum(c[1] for c in rows), sum(c[2] for c in rows)
        return (b + 10 * prior) / (b + GOOD_COST * g + 10), b, g

    left = cells
    tests = [(f, op, i) for f, k in enumerate(names) for i in range(len(cuts[k])) for op in ("ge", "lt")]
    while len(rules) < max_rules:
        grown, rows, best = [], left, score(left)
        while len(grown) < max_conditions and rows:
            options = []
            for t in tests:
                sub = [c for c in rows if holds(c, t)]
                s = score(sub)
                if s[1] >= max(3, least_cover * bad_all):
                    options.append((s[0], s[1], t, sub))
            if not options or max(options, key=lambda o: (o[0], o[1]))[0] <= best[0] + 1e-9:
                break
            top = max(options, key=lambda o: (o[0], o[1]))
            grown.append(top[2])
            rows, best = top[3], (top[0], top[1], 0)
        # prune: drop the last conditions while precision over what is left stays as high
        while len(grown) > 1:
            shorter = [c for c in left if all(holds(c, t) for t in grown[:-1])]
            if score(shorter)[0] + 0.002 < score([c for c in left if all(holds(c, t) for t in grown)])[0]:
                break
            grown.pop()
        hit = [c for c in left if all(holds(c, t) for t in grown)] if grown else []
        s = score(hit) if hit else (0, 0, 0)
        if not grown:
            break
        if s[1] < max(3, least_cover * bad_all) or s[1] < least_precision * (s[1] + s[2]):
            tests.remove(grown[0])  # another start may do
            continue
        rules.append(Rule(tuple((names[f], op, cuts[names[f]][i]) for f, op, i in grown)))
        left = [c for c in left if not all(holds(c, t) for t in grown)]
    return rules


def verdict(rules: list[Rule]) -> Column:
    """Ordered conditional expression: number of the first rule that rejects, 0 if none."""
    out = F.lit(0)
    for i, rule in reversed(list(enumerate(rules, 1))):
        out = F.when(rule.column(), F.lit(i)).otherwise(out)
    return out


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics and verdict of every row of `docs`: adds base_failed, rule (first that rejects, 0 none) and kept.

    Rules are learnt from labelled rows that pass the base, so that none repeats it. A labelled row counts once for each distinct (doc_id, quality); null labels don't count. Null text fails the
    base; an empty table gives no rows; with no labels every row that passes the base is kept.
    """
    stats = staged(statistics(docs), "quality-stats")
    marked = stats.join(labels.select("doc_id", "quality").where("quality is not null").distinct(), "doc_id")
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    rules = learn_rules(marked.where(~failed))
    return stats.withColumn("base_failed", failed).withColumn("rule", verdict(rules)).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
