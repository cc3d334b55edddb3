"""Quality classifier: a byte-level convolutional network in numpy, trained by backpropagation, over overlapping chunks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import ship_package

#: Bound of the training sample: documents, and spans of each one's whole text (all of it where it has no more chunks).
SAMPLE_ROWS, SAMPLE_SPANS = 4_000, 24
#: Bytes of a chunk and of a filter; chunks overlap by one byte less than a filter, so every place of a text has its window.
CHUNK, WIDTH = 256, 8
STRIDE = CHUNK - WIDTH + 1
EMBED, FILTERS, HIDDEN = 6, 24, 16
#: Chunks, and texts, that are worked on side by side.
LANES, STEP = 64, 64


@dataclass
class Network:
    """e: byte embeddings. w, b: filters over WIDTH bytes. Each chunk gives its largest response to each filter; maxima
    and means of these over the chunks, and the text's length, feed a hidden layer (v, c) and one logit (o, d)."""

    p: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        n = lambda *s, scale: (rng.standard_normal(s) * scale).astype(np.float32)
        zero = lambda *s: np.zeros(s, np.float32)
        return cls({"e": n(256, EMBED, scale=0.5), "w": n(WIDTH * EMBED, FILTERS, scale=0.3), "b": zero(FILTERS), "v": n(2 * FILTERS + 1, HIDDEN, scale=0.2), "c": zero(HIDDEN), "o": n(HIDDEN, scale=0.3), "d": zero(1)})

    def responses(self, x: np.ndarray, size: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Largest response of each filter in each chunk, (chunks, filters), and its place. x: bytes (chunks, CHUNK)."""
        best = np.empty((len(x), FILTERS), np.float32)
        at = np.empty((len(x), FILTERS), np.int64) if where else None
        for lo in range(0, len(x), LANES):
            part = self.p["e"].take(x[lo : lo + LANES], axis=0).reshape(-1, x.shape[1] * EMBED)
            places = x.shape[1] - WIDTH + 1
            s0, s1 = part.strides
            windows = np.lib.stride_tricks.as_strided(part, (len(part), places, WIDTH * EMBED), (s0, s1 * EMBED, s1))
            r = (windows.reshape(-1, WIDTH * EMBED) @ self.p["w"]).reshape(len(part), places, FILTERS)
            n = np.maximum(size[lo : lo + LANES] - WIDTH + 1, 1)  # a text shorter than a filter has one padded window
            if (n < places).any():
                r[np.arange(places) >= n[:, None]] = -np.inf
            best[lo : lo + LANES] = r.max(1)
            if at is not None:
                at[lo : lo + LANES] = r.argmax(1)
        return best + self.p["b"], at

    def pooled(self, best: np.ndarray, size: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Maximum and mean over each text's chunks of the responses, negative ones being 0, and the logarithm of its
        size: (texts, 2 filters + 1); and each chunk's weight in the mean, by its bytes."""
        a = np.maximum(best, 0)
        each = np.maximum(size, 1).astype(np.float32)
        total = np.add.reduceat(each, first)
        weight = each / np.repeat(total, np.diff(np.append(first, len(size))))
        means = np.add.reduceat(a * weight[:, None], first)
        return np.concatenate([np.maximum.reduceat(a, first), means, np.log(total)[:, None] / 8], axis=1), weight

    def logits(self, pooled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.tanh(pooled @ self.p["v"] + self.p["c"])
        return h @ self.p["o"] + self.p["d"], h

    def gradient(self, x: np.ndarray, size: np.ndarray, first: np.ndarray, count: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Weighted log loss of texts (runs of chunks) and its gradient: only the largest responses pass it back."""
        p = self.p
        best, at = self.responses(x, size, where=True)
        pooled, share = self.pooled(best, size, first)
        z, h = self.logits(pooled)
        q = 1 / (1 + np.exp(-z))
        loss = float(-(weight * np.where(y == 1, np.log(q + 1e-9), np.log(1 - q + 1e-9))).sum())
        dz = weight * (q - y)
        dh = dz[:, None] * p["o"] * (1 - h * h)
        dpool = dh @ p["v"].T
        owner = np.repeat(np.arange(len(first)), count)
        a = np.maximum(best, 0)
        top = a == pooled[owner, :FILTERS]
        ties = np.add.reduceat(top.astype(np.float32), first)
        da = top * (dpool[:, :FILTERS] / ties)[owner] + dpool[owner, FILTERS:-1] * share[:, None]
        da *= best > 0
        k, f = np.nonzero(da)
        g = da[k, f]
        taken = x[k[:, None], at[k, f][:, None] + np.arange(WIDTH)]  # the bytes under each largest response
        flat = p["e"][taken].reshape(len(k), -1)
        gw = np.zeros_like(p["w"])
        ge = np.zeros_like(p["e"])
        for j in range(FILTERS):
            mine = f == j
            gw[:, j] = g[mine] @ flat[mine]
        back = (g[:, None] * p["w"].T[f]).reshape(-1, EMBED)
        for j in range(EMBED):
            ge[:, j] = np.bincount(taken.ravel(), back[:, j], 256)
        return loss, {"e": ge, "w": gw, "b": da.sum(0), "v": pooled.T @ dh, "c": dh.sum(0), "o": h.T @ dz, "d": dz.sum(keepdims=True)}


def chunked(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Chunks of whole texts, (chunks, CHUNK) padded with 0, their sizes; each text's first chunk and number of chunks."""
    n = np.array([len(b) for b in raw])
    count = np.maximum(1, -(-(n - WIDTH + 1) // STRIDE))
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    x = np.zeros((int(count.sum()), CHUNK), np.uint8)
    for b, at, k in zip(raw, first, count, strict=True):
        whole = np.zeros(int(k) * STRIDE + WIDTH - 1, np.uint8)
        whole[: len(b)] = np.frombuffer(b, np.uint8)
        x[at : at + k] = np.lib.stride_tricks.sliding_window_view(whole, CHUNK)[::STRIDE]
    place = np.arange(len(x)) - np.repeat(first, count)
    return x, np.minimum(CHUNK, np.repeat(n, count) - place * STRIDE), first, count


def sample(docs: DataFrame, labels: DataFrame, seed: int) -> tuple[list[tuple[int, list[str]]], dict[int, int]]:
    """(quality, spans) of SAMPLE_ROWS labelled documents at most, half of each label if there are as many; and labelled documents by label.

    A document with several labels counts with the lowest, one with several texts with the smallest. The first by hash
    of doc_id; spans are the text's chunks, SAMPLE_SPANS of them evenly spread where it has more.
    """
    marked = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    there = docs.where("doc_id is not null").select("doc_id").distinct()
    rows = marked.join(there, "doc_id", "left_semi").withColumn("_h", F.xxhash64(F.lit(seed), "doc_id"))
    found = {r["quality"]: r["n"] for r in rows.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    half = SAMPLE_ROWS // 2
    quota = {k: min(n, max(half, SAMPLE_ROWS - found.get(1 - k, 0))) for k, n in found.items()}
    # by rank alone every task would send as many rows as the sample has, so a share is taken first
    share = F.lit(0)
    for k, q in quota.items():
        share = F.when(F.col("quality") == k, int(min(1.0, (2.0 * q + 50) / found[k]) * (1 << 30))).otherwise(share)
    rank = F.row_number().over(Window.partitionBy("quality").orderBy("_h", "doc_id"))
    few = rows.where(F.pmod("_h", F.lit(1 << 30)) < share).withColumn("_rank", rank)
    few = few.where(" or ".join(f"quality = {k} and _rank <= {q}" for k, q in quota.items()) or "false").select("doc_id", "quality", "_h")
    length = F.length("text")
    chunks = F.greatest(F.lit(1), F.ceil((length - WIDTH + 1) / F.lit(STRIDE)))
    last, spans = F.greatest(F.lit(0), length - CHUNK), F.least(chunks, F.lit(SAMPLE_SPANS)).cast("int")
    start = lambda i: F.when(chunks <= SAMPLE_SPANS, i * STRIDE).otherwise(i * last / F.lit(SAMPLE_SPANS - 1)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), spans - 1), lambda i: F.substr(F.col("text"), start(i) + 1, F.lit(CHUNK)))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(few), "doc_id")  # SAMPLE_ROWS rows
    got = texts.groupBy("doc_id", "quality", "_h").agg(F.min("text").alias("text")).orderBy("_h", "doc_id").select("quality", cut.alias("spans")).collect()
    return [(r["quality"], r["spans"]) for r in got], found


def train(docs: DataFrame, labels: DataFrame, seed: int = 13, epochs: int = 16, lanes: int = 64, rate: float = 0.01) -> Network | None:
    """A network learnt from docs' text and labels' quality; None without both kinds of label. Adam; label shares are the corpus's."""
    rows, found = sample(docs, labels, seed)
    if len({k for k, _ in rows}) < 2:
        return None
    net = Network.fresh(seed)
    y = np.array([k for k, _ in rows])
    taken = np.bincount(y, minlength=2)
    weigh = np.array([found[k] / taken[k] for k in (0, 1)], np.float32)[y]
    spans = [[s.encode("utf-8", "replace")[:CHUNK] for s in each] or [b""] for _, each in rows]
    count = np.array([len(s) for s in spans])
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    size = np.array([len(s) for each in spans for s in each])
    x = np.frombuffer(b"".join(s.ljust(CHUNK, b"\0") for each in spans for s in each), np.uint8).reshape(-1, CHUNK)
    rng = np.random.default_rng(seed)
    m1, m2, k = {n: 0.0 for n in net.p}, {n: 0.0 for n in net.p}, 0
    steps = epochs * -(-len(rows) // lanes)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), lanes):
            some = order[lo : lo + lanes]
            n = count[some]
            at = np.concatenate([np.arange(first[i], first[i] + count[i]) for i in some])
            w = weigh[some]
            _, grad = net.gradient(x[at], size[at], np.concatenate([[0], np.cumsum(n)[:-1]]), n, y[some], w / w.sum())
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            step = rate * (1 - k / steps)
            k += 1
            for name, g in grad.items():
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                m1[name] = 0.9 * m1[name] + 0.1 * g
                m2[name] = 0.99 * m2[name] + 0.01 * g * g
                net.p[name] -= (step * (m1[name] / (1 - 0.9**k)) / (np.sqrt(m2[name] / (1 - 0.99**k)) + 1e-8)).astype(np.float32)
    return net


def probabilities(net: Network, texts: list[str | None]) -> np.ndarray:
    """Probability of label 1 of each whole text; null: empty."""
    x, size, first, count = chunked([(t or "").encode("utf-8", "replace") for t in texts])
    best, _ = net.responses(x, size)
    z, _ = net.logits(net.pooled(best, size, first)[0])
    return 1 / (1 + np.exp(-z.astype(np.float64)))


def _scores(net: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, STEP):
                part = batch.slice(lo, STEP)
                *kept, text = part.columns
                yield pa.RecordBatch.from_arrays([*kept, pa.array(probabilities(net, text.to_pylist()), pa.float64())], [*part.schema.names[:-1], "score"])

    return run


def score(docs: DataFrame, net: Network | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep`, score (0 to 1, higher: label 1 likelier), predicted (1 from 0.5 on) of every whole text.

    Only the text's bytes go into a score: equal texts have equal scores, repeated rows all stay. Null text: empty;
    empty texts get a score as well. Where nothing could be learnt every score is 0.5. An empty table gives no rows;
    other columns are ignored.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(*keep, "text")
    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    scored = rows.mapInArrow(_scores(net), f"{kinds}, score double") if net else rows.drop("text").withColumn("score", F.lit(0.5))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
