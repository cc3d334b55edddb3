"""Language ID: a bidirectional gated recurrent network over bytes, trained by backpropagation through time in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import ship_package

#: Bound of the training sample: labelled rows, and spans of each one's whole text.
SAMPLE_ROWS, SAMPLE_SPANS = 4_000, 3
#: Bytes that one state runs over; a text is cut into such chunks, all of which are labelled.
CHUNK = 128
#: Chunks that run side by side.
LANES = 1_024
HIDDEN = 8
#: A letter by its category; of what Python counts as a word's character without digits, numbers like a half are none.
LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"


@dataclass
class Network:
    """Gates of both directions: byte tables `t`, recurrent weights `u` (reset, update | new), and the output layer."""

    langs: list[str]
    p: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, langs: list[str], seed: int, h: int = HIDDEN) -> Network:
        rng = np.random.default_rng(seed)
        n = lambda *s, scale: (rng.standard_normal(s) * scale).astype(np.float32)
        p = {"wo": n(2 * h, len(langs), scale=0.3), "bo": np.zeros(len(langs), np.float32)}
        for d in "fb":
            p |= {f"tg{d}": n(256, 2 * h, scale=0.3), f"tn{d}": n(256, h, scale=0.3), f"ug{d}": n(h, 2 * h, scale=0.3), f"un{d}": n(h, h, scale=0.3)}
        return cls(langs, p)

    def states(self, x: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States of one direction over x (time, lanes), in the order of x. The logistic gates are shifted tanh."""
        p, h = self.p, self.p[f"un{d}"].shape[0]
        tg, tn, ug, un = (np.ascontiguousarray(p[k + d]) for k in ("tg", "tn", "ug", "un"))
        out = np.empty((*x.shape, h), np.float32)
        s = np.zeros((x.shape[1], h), np.float32)
        for t in range(x.shape[0]):
            g = tg.take(x[t], axis=0)
            g += s @ ug
            np.tanh(g, out=g)
            g += 1
            g *= 0.5
            r, z = g[:, :h], g[:, h:]
            a = s @ un
            c = tn.take(x[t], axis=0)
            if keep is not None:
                keep.append((s, g, a))
            c += a * r
            np.tanh(c, out=c)
            s = c + z * (s - c)
            out[t] = s
            if keep is not None:
                keep[-1] += (c,)
        return out

    def probabilities(self, x: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Language probabilities of every position: (time, lanes, languages). n: bytes of each lane."""
        steps = np.arange(x.shape[0])[:, None]
        back = np.where(steps < n, n - 1 - steps, steps)  # each lane's own bytes, from its end
        lane = np.arange(x.shape[1])
        full = bool((n == x.shape[0]).all())
        b = self.states(np.ascontiguousarray(x[::-1]) if full else x[back, lane], "b")
        both = np.concatenate([self.states(x, "f"), b[::-1] if full else b[back, lane]], axis=2)
        logits = both.reshape(-1, both.shape[2]) @ self.p["wo"]
        logits += self.p["bo"]
        np.exp(logits, out=logits)  # states lie within -1..1, so this can't overflow
        logits /= logits.sum(1, keepdims=True)
        return logits.reshape(*x.shape, -1)

    def gradient(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss over every position of full lanes and its gradient, backwards through time."""
        p, h, (steps, lanes) = self.p, HIDDEN, x.shape
        runs, xs = {"f": [], "b": []}, {"f": x, "b": np.ascontiguousarray(x[::-1])}
        hf, hb = self.states(xs["f"], "f", runs["f"]), self.states(xs["b"], "b", runs["b"])
        both = np.concatenate([hf, hb[::-1]], axis=2).reshape(-1, 2 * h)
        logits = both @ p["wo"] + p["bo"]
        logits -= logits.max(1, keepdims=True)
        q = np.exp(logits)
        q /= q.sum(1, keepdims=True)
        ys, w = np.tile(y, steps), np.tile(weight, steps) / steps
        loss = float(-(w * np.log(q[np.arange(len(ys)), ys] + 1e-9)).sum())
        q[np.arange(len(ys)), ys] -= 1
        q *= w[:, None]
        grad = {"wo": both.T @ q, "bo": q.sum(0)}
        up = (q @ p["wo"].T).reshape(steps, lanes, 2 * h)
        for d, part in (("f", up[:, :, :h]), ("b", up[::-1, :, h:])):
            gt, gn = np.zeros_like(p[f"tg{d}"]), np.zeros_like(p[f"tn{d}"])
            gu, gm = np.zeros_like(p[f"ug{d}"]), np.zeros_like(p[f"un{d}"])
            ds = np.zeros((lanes, h), np.float32)
            for t in reversed(range(steps)):
                s, g, a, c = runs[d][t]
                r, z = g[:, :h], g[:, h:]
                ds = ds + part[t]
                dc = ds * (1 - z) * (1 - c * c)
                da, dr, dz = dc * r, dc * a, ds * (s - c)
                dg = np.concatenate([dr, dz], axis=1) * g * (1 - g) * 2  # the gate is tanh of the sum, halved
                gm += s.T @ da
                gu += s.T @ dg
                np.add.at(gt, xs[d][t], dg)
                np.add.at(gn, xs[d][t], dc)
                ds = ds * z + da @ p[f"un{d}"].T + dg @ p[f"ug{d}"].T
            grad |= {f"tg{d}": gt, f"tn{d}": gn, f"ug{d}": gu, f"un{d}": gm}
        return loss, grad


def sample(docs: DataFrame, seed: int) -> pd.DataFrame:
    """SAMPLE_ROWS labelled rows at most, each with SAMPLE_SPANS spans at seeded places of its whole text.

    Of each language the first by hash: a floor that all languages have (one row at least, even if that makes more
    rows than SAMPLE_ROWS), and a share in proportion of what is left.
    """
    rows = docs.where("lang is not null and text is not null and trim(text) <> ''").withColumn("_h", F.xxhash64(F.lit(seed), "doc_id", "text"))
    found = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("_h").alias("first")).collect()  # a row for each language
    floor = {r["lang"]: min(r["n"], max(1, SAMPLE_ROWS // (4 * len(found)))) for r in found}
    more = min(1.0, max(0, SAMPLE_ROWS - sum(floor.values())) / max(1, sum(r["n"] for r in found) - sum(floor.values())))
    wanted = [(r["lang"], floor[r["lang"]] + int(more * (r["n"] - floor[r["lang"]])), r["n"], r["first"]) for r in found]
    # by rank alone every task would send as many rows as the sample has, so a share is taken first
    shares = docs.sparkSession.createDataFrame([(k, q, int(min(1.0, (2.0 * q + 50) / n) * (1 << 30)), first) for k, q, n, first in wanted], "lang string, _quota long, _share long, _first long")
    rows = rows.join(F.broadcast(shares), "lang").where((F.pmod("_h", F.lit(1 << 30)) < F.col("_share")) | (F.col("_h") == F.col("_first")))
    spans = [F.substr("text", (F.pmod(F.xxhash64("_h", F.lit(i)), F.greatest(F.length("text") - CHUNK, F.lit(1))) + 1).cast("int"), F.lit(CHUNK)) for i in range(SAMPLE_SPANS)]
    rows = rows.select("lang", "_h", "_quota", *[s.alias(f"s{i}") for i, s in enumerate(spans)])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("_h"))
    return rows.withColumn("_rank", rank).where("_rank <= _quota").orderBy("_h").drop("_h", "_quota", "_rank").toPandas()


def train(docs: DataFrame, seed: int = 5, epochs: int = 5, lanes: int = 128, rate: float = 0.01) -> Network | None:
    """A network learnt from docs' text and lang; None without labelled texts. Adam, rarer languages weigh more."""
    rows = sample(docs, seed)
    langs = sorted(set(rows["lang"]))
    if not langs:
        return None
    net, steps = Network.fresh(langs, seed), CHUNK // 2
    x, y = [], []
    for lang, *spans in rows.itertuples(index=False):
        for s in spans:
            b = np.frombuffer(s.encode()[:CHUNK], np.uint8)
            for at in range(0, max(1, len(b) - steps + 1), steps):
                cut = b[at : at + steps]
                x.append(np.resize(cut, steps))  # short texts repeat
                y.append(langs.index(lang))
    x, y = np.array(x), np.array(y)
    share = np.bincount(y, minlength=len(langs)) / len(y)
    rng = np.random.default_rng(seed)
    m1, m2, k = {n: 0.0 for n in net.p}, {n: 0.0 for n in net.p}, 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for lo in range(0, len(order), lanes):
            some = order[lo : lo + lanes]
            w = 1 / np.sqrt(share[y[some]])
            _, grad = net.gradient(np.ascontiguousarray(x[some].T), y[some], (w / w.sum()).astype(np.float32))
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            k += 1
            for n, g in grad.items():
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                m1[n] = 0.9 * m1[n] + 0.1 * g
                m2[n] = 0.99 * m2[n] + 0.01 * g * g
                net.p[n] -= (rate * (m1[n] / (1 - 0.9**k)) / (np.sqrt(m2[n] / (1 - 0.99**k)) + 1e-8)).astype(np.float32)
    return net


def label(net: Network, texts: list[str | None]) -> tuple[list[str], list[float], list[int]]:
    """Language, pooled probability and number of positions labelled with that language, of each whole text."""
    raw = [t.encode("utf-8", "replace") if t and LETTER.search(t) else b"" for t in texts]
    n = np.array([len(b) for b in raw])
    chunks = -(-n // CHUNK)
    owner = np.repeat(np.arange(len(raw)), chunks)
    total, hits = np.zeros((len(raw), len(net.langs))), np.zeros((len(raw), len(net.langs)), np.int64)
    padded = np.frombuffer(b"".join(b.ljust(int(c) * CHUNK, b"\0") for b, c in zip(raw, chunks, strict=True)), np.uint8).reshape(-1, CHUNK)
    first = np.concatenate([[0], np.cumsum(chunks)[:-1]]) if len(raw) else np.zeros(0, int)
    size = np.minimum(CHUNK, n[owner] - CHUNK * (np.arange(len(owner)) - first[owner]))
    order = np.argsort(-size, kind="stable")
    whole = int((size == CHUNK).sum())
    cuts = [*range(0, whole, LANES), *range(whole, len(order), LANES), len(order)]
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        if lo == hi:
            continue
        some = order[lo:hi]
        longest = int(size[some].max())
        q = net.probabilities(np.ascontiguousarray(padded[some, :longest].T), size[some])
        valid = np.arange(longest)[:, None] < size[some]
        best = q.argmax(2)
        for k in range(len(net.langs)):
            total[:, k] += np.bincount(owner[some], (q[:, :, k] * valid).sum(0), len(raw))
            hits[:, k] += np.bincount(owner[some], ((best == k) & valid).sum(0), len(raw)).astype(np.int64)
    pick = total.argmax(1)
    score = total[np.arange(len(raw)), pick] / np.maximum(n, 1)
    some = n > 0
    return [net.langs[k] if s else UNKNOWN for k, s in zip(pick, some, strict=True)], np.clip(score, 0, 1).tolist(), np.where(some, hits[np.arange(len(raw)), pick], 0).tolist()


def _predictions(net: Network | None, step: int = 64):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                some = batch.slice(lo, step)
                texts = some.column(some.schema.get_field_index("text")).to_pylist()
                lang, score, hits = label(net, texts) if net else ([UNKNOWN] * len(texts), [0.0] * len(texts), [0] * len(texts))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(hits, pa.int64())], [*some.schema.names, "lang_pred", "score", "n_positions"])

    return run


def identify(docs: DataFrame, net: Network | None, keep: tuple[str, ...] = ("doc_id",), give_text: bool = False) -> DataFrame:
    """Label every position of every whole text and pool: `keep`, lang_pred, score, n_positions (and text, if asked).

    Null texts and texts without a letter get `und`, score 0, as does every row if nothing could be learnt. Very
    long texts are cut into chunks that are all labelled; repeated rows stay; an empty table gives no rows.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(*keep, "text")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    out = rows.mapInArrow(_predictions(net), f"{kinds}, lang_pred string, score double, n_positions long")
    return out if give_text else out.drop("text")


def fold(parts: int) -> Column:
    """Remainder that decides whether a document may be learnt from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts
