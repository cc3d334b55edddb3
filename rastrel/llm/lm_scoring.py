"""LM scoring: a causal self-attention model over subword ids, trained in numpy on every training row, dealt over the tasks; so are its tables and unigram."""

from __future__ import annotations

import base64
import os
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lookup import lookup
from ..session import ship_package
from .common import staged, unstage

#: Inputs of a window, and how many of its last positions it scores; windows overlap by the rest.
WINDOW, SCORED = 32, 24
#: Windows of a batch: their attention fits a core's cache.
LANES = 96
#: Batches whose responsibilities are added together.
HELD = 4
#: Width of the states, and mixture components of the output.
WIDTH, EXPERTS = 24, 96
#: Bounds: words whose counts are broadcast (others are counted by an exchange, exactly), rows they are chosen from.
HEAD_WORDS, HEAD_ROWS = 100_000, 20_000
#: Bounds of the sample from which the gate's starting values come: rows, and characters of each one's seeded span.
SAMPLE_ROWS, SAMPLE_CHARS = 4_000, 1_500
#: Training rows of a learner, on average, and the rate at which it begins.
LEARNER_ROWS, LEARNER_RATE = 4_096, 0.003
#: Weight of the word unigram beside the attention model, and of the corpus's subword counts in each expert.
UNIGRAM_WEIGHT, SMOOTHING = 0.15, 0.02
#: Words that are scored together: bounds a task's memory.
BLOCK_WORDS = 20_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


class Encoder:
    """Ids of a word with the space before it; so a text's ids say its words exactly. The last id is the end."""

    _loaded: dict[str, Encoder] = {}

    @classmethod
    def load(cls, path: str) -> Encoder:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.end = max(ranks.values()) + 1
        self.size = self.end + 1
        #: Ids that begin a word, or end the text: what follows a whole word.
        self.starts = np.zeros(self.size, bool)
        self.starts[[i for b, i in ranks.items() if b[:1] == b" "]] = True
        self.starts[self.end] = True

    def word(self, w: bytes) -> list[int]:
        try:
            return self.encoding.encode_ordinary(" " + w.decode())
        except UnicodeDecodeError:
            return self.encoding._encode_bytes(b" " + w)

    def words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and how many each has: encoded in one go, where no word holds other white space."""
        if words:
            try:
                text = b" ".join(words).decode()
                if len(text.split()) == len(words):
                    ids = np.array(self.encoding.encode_ordinary(" " + text))
                    first = np.flatnonzero(self.starts[ids])
                    if len(first) == len(words):
                        return ids, np.diff(first, append=len(ids))
            except UnicodeDecodeError:
                pass
        each = [self.word(w) for w in words]
        return np.array([i for x in each for i in x], np.int64), np.array([len(x) for x in each], np.int64)


class Words:
    """Ids and 64-bit keys of words by slot: 0 is the end, then the head words, then those of the block in hand."""

    _loaded: dict[str, Words] = {}

    @classmethod
    def load(cls, run: str, head: list[bytes], path: str) -> Words:
        """A worker that is used again in one run keeps its head words."""
        if run not in cls._loaded:
            cls._loaded.clear()
            cls._loaded[run] = cls(head, path)
        return cls._loaded[run]

    def __init__(self, head: list[bytes], path: str):
        self.encoder = Encoder.load(path)
        self.head = len(head)
        self.slot = {b"": 0} | {w: i for i, w in enumerate(head, 1)}
        self.used = self.size = 0  # ids, words
        self.first, self.n, self.ids = (np.zeros(1 << 18, np.int64) for _ in range(3))
        self.key = np.zeros(1 << 18, np.uint64)
        self._learn([[self.encoder.end]], [b""])
        self._learn(None, head)
        self.kept = self.used, self.size

    def _put(self, name: str, at: int, values: np.ndarray) -> None:
        held = getattr(self, name)
        if at + len(values) > len(held):
            held = np.concatenate([held, np.zeros(max(len(held), len(values)), held.dtype)])
            setattr(self, name, held)
        held[at : at + len(values)] = values

    def _learn(self, each: list[list[int]] | None, words: list[bytes]) -> None:
        ids, n = self.encoder.words(words) if each is None else (np.array(sum(each, [])), np.array(list(map(len, each))))
        self._put("key", self.size, np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))
        self._put("n", self.size, n)
        self._put("first", self.size, self.used + np.cumsum(n) - n)
        self._put("ids", self.used, ids)
        self.used += len(ids)
        self.size += len(words)

    def slots(self, texts: list[list[bytes]]) -> np.ndarray:
        """Slots of the texts' words, each text with its end; those beyond the head hold until the next call."""
        every: list[bytes] = []
        for t in texts:
            every += t
            every.append(b"")
        out = np.fromiter(map(self.slot.get, every, repeat(-1)), np.int64, len(every))
        rare = np.flatnonzero(out < 0)
        self.used, self.size = self.kept
        out[rare] = self.size + np.arange(len(rare))
        self._learn(None, [every[i] for i in rare.tolist()])
        return out


@dataclass
class Laid:
    """Texts laid out for windows: each text's ids after WINDOW - SCORED ends, and filled with ends to whole windows."""

    inputs: np.ndarray  # with the ends before
    starts: np.ndarray  # of each window in `inputs`
    targets: np.ndarray  # (windows, SCORED)
    place: np.ndarray  # of each id among the targets
    upto: np.ndarray  # ids up to each word's end

    @classmethod
    def of(cls, words: Words, slots: np.ndarray, tokens: np.ndarray) -> Laid:
        """tokens: words of each text, its end included."""
        k = words.n[slots]
        upto = np.cumsum(k)
        flat = words.ids[np.repeat(words.first[slots] - (upto - k), k) + np.arange(int(upto[-1]))]
        lengths = np.diff(upto[np.cumsum(tokens) - 1], prepend=0)
        n = -(-lengths // SCORED)
        lead = WINDOW - SCORED
        room = np.cumsum(n * SCORED) - n * SCORED  # of each text among the targets
        place = np.arange(len(flat)) + np.repeat(room - (np.cumsum(lengths) - lengths), lengths)
        text = np.repeat(np.arange(len(n)), n)
        targets = np.full(int(n.sum()) * SCORED, words.encoder.end, np.int64)
        targets[place] = flat
        inputs = np.full(len(targets) + lead * len(n) + 1, words.encoder.end, np.int64)
        inputs[place + lead * (np.repeat(np.arange(len(n)), lengths) + 1) + 1] = flat  # a position's input is the id before it
        return cls(inputs, np.arange(len(text)) * SCORED + lead * text, targets.reshape(-1, SCORED), place, upto)

    def windows(self, some: np.ndarray | slice) -> tuple[np.ndarray, np.ndarray]:
        """Inputs (n, WINDOW) and targets (n, SCORED)."""
        return self.inputs[self.starts[some][:, None] + np.arange(WINDOW)], self.targets[some]

    def on(self) -> np.ndarray:
        """(windows, SCORED): which targets are ids of a text; each one is scored once."""
        out = np.zeros(self.targets.size, bool)
        out[self.place] = True
        return out.reshape(-1, SCORED)


def _row_sums(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values in `at`, in order, and the sum of each one's rows."""
    order = np.argsort(at)
    at = at[order]
    first = np.flatnonzero(np.diff(at, prepend=at[0] - 1))
    return at[first], np.add.reduceat(rows[order], first)


def _add_rows(to: np.ndarray, at: np.ndarray, rows: np.ndarray, few: int = 8) -> None:
    """to[at] += rows, where `at` may name a row several times.

    The k-th rows of all values that have so many are added at once; the few most frequent values' other rows by a product.
    """
    if not len(at):
        return
    order = np.argsort(at)
    at = at.take(order)
    first = np.flatnonzero(np.diff(at, prepend=at[0] - 1))
    n = np.diff(first, append=len(at))
    by = np.argsort(-n)
    first, n = first.take(by), n.take(by)
    sums = rows.take(order.take(first), axis=0)
    k, more = 1, len(n)
    while (more := int(np.searchsorted(-n[:more], -k))) > few:
        sums[:more] += rows.take(order.take(first[:more] + k), axis=0)
        k += 1
    for i in range(more):
        some = rows.take(order[first[i] + k : first[i] + n[i]], axis=0)
        sums[i] += np.ones(len(some), rows.dtype) @ some
    to[at.take(first)] += sums


CAUSAL = np.where(np.arange(WINDOW)[None, :] <= np.arange(WINDOW - SCORED, WINDOW)[:, None], 0, -1e9).astype(np.float32)


def _exps(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp of each row's scores, and the rows' sums: taken below the row's largest score where a sum is beyond single precision."""
    ones = np.ones(scores.shape[-1], scores.dtype)
    with np.errstate(over="ignore"):
        out = np.exp(scores)
        total = out @ ones
    far = ~((total > 1e-25) & (total < 1e25))
    if far.any():
        some = scores[far]
        out[far] = some = np.exp(some - some.max(-1, keepdims=True))
        total[far] = some @ ones
    return out, total


def _and_one(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a + b, and a column of ones for the bias of what comes next."""
    out = np.empty((len(a), a.shape[1] + 1), a.dtype)
    np.add(a, b, out=out[:, :-1])
    out[:, -1] = 1
    return out


@dataclass
class Model:
    """One block of causal attention whose state mixes EXPERTS distributions over all subwords.

    p(id | before) = sum over k of gate_k(state) * table[id, k]: each column of the table sums to 1, so the
    mixture does. The gate learns by gradient, the table by expectation maximisation: first from a sample, on the
    driver, then both from every training row, by a `Learner` for each bucket of rows.
    """

    p: dict[str, np.ndarray]
    table: np.ndarray
    starts: np.ndarray  # ids that follow a whole word
    shares: np.ndarray  # of each id in the corpus
    folded: tuple[np.ndarray, ...] | None = None  # what `gates` derives from the parameters, when the gate has been learnt

    @classmethod
    def fresh(cls, starts: np.ndarray, shares: np.ndarray, seed: int) -> Model:
        rng = np.random.default_rng(seed)
        d, size = WIDTH, len(shares)
        n = lambda *s, scale: (rng.standard_normal(s) * scale).astype(np.float32)
        p = {"e": n(size, d, scale=0.5), "e2": n(size, d, scale=0.3), "pos": n(WINDOW, d, scale=0.1), "q": n(d, d, scale=0.25), "k": n(d, d, scale=0.25), "v": n(d, d, scale=0.25), "o": n(d, d, scale=0.25)}
        p |= {"w1": n(d, d, scale=0.25), "b1": np.zeros(d, np.float32), "w2": n(d, d, scale=0.25), "g": n(d, EXPERTS, scale=0.3), "bg": np.zeros(EXPERTS, np.float32)}
        return cls(p, np.repeat(shares[:, None], EXPERTS, 1).astype(np.float32), starts, shares)

    def states(self, x: np.ndarray) -> np.ndarray:
        """States of the inputs of windows x (n, WINDOW)."""
        p, n, d = self.p, len(x), WIDTH
        e = p["e"].take(x, axis=0)
        wide = e.reshape(n, -1)  # whole windows are added as long rows
        wide += p["pos"].ravel()
        wide[:, d:] += p["e2"].take(x[:, :-1], axis=0).reshape(n, -1)  # each input also knows the one before it
        return e

    def fold(self) -> tuple[np.ndarray, np.ndarray]:
        """Scores and values are products of the inputs' states and one matrix each, so keys and values are never formed."""
        p = self.p
        return p["q"] @ p["k"].T * p["q"].dtype.type(WIDTH**-0.5), p["v"] @ p["o"]

    def forward(self, x: np.ndarray):
        """Gates for the last SCORED positions of windows x (n, WINDOW)."""
        p, n, d = self.p, len(x), WIDTH
        qk, vo = self.fold()
        e = self.states(x)
        tail = np.ascontiguousarray(e[:, WINDOW - SCORED :]).reshape(-1, d)
        tq = (tail @ qk).reshape(n, SCORED, d)
        s = tq @ e.transpose(0, 2, 1)
        s += CAUSAL
        s, total = _exps(s)
        s *= (1 / total)[:, :, None]
        a = (s @ e).reshape(-1, d)
        h = _and_one(a @ vo, tail)
        m = h @ np.vstack([p["w1"], p["b1"]])
        np.maximum(m, 0, out=m)
        h2 = _and_one(m @ p["w2"], h[:, :d])
        g = h2 @ np.vstack([p["g"], p["bg"]])
        g, total = _exps(g)
        g *= (1 / total)[:, None]
        return g.reshape(n, SCORED, -1), (qk, vo, e, tail, tq, s, a, h, m, h2)

    def gates(self, x: np.ndarray) -> np.ndarray:
        """As `forward`, flat and undivided."""
        return self.sized_gates(x)[0]

    def sized_gates(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Undivided gates, and each row's sum."""
        p, n, d = self.p, len(x), WIDTH
        if self.folded is None:
            self.folded = *self.fold(), np.vstack([p["w1"], p["b1"]]), np.vstack([p["g"], p["bg"]])
        qk, vo, w1, last = self.folded
        e = self.states(x)
        tail = np.ascontiguousarray(e[:, WINDOW - SCORED :]).reshape(-1, d)
        s = (tail @ qk).reshape(n, SCORED, d) @ e.transpose(0, 2, 1)
        s += CAUSAL
        s, total = _exps(s)
        a = (s @ e).reshape(-1, d)
        a /= total.reshape(-1, 1)
        h = _and_one(a @ vo, tail)
        m = h @ w1
        np.maximum(m, 0, out=m)
        h[:, :d] += m @ p["w2"]
        return _exps(h @ last)

    def settle(self, counts: np.ndarray) -> None:
        """The table from counts of (id, expert)."""
        self.table = np.multiply(counts, ((1 - SMOOTHING) / counts.sum(0, dtype=float)).astype(counts.dtype), dtype=counts.dtype).astype(np.float32, copy=False)
        self.table += (SMOOTHING * self.shares[:, None]).astype(np.float32)

    def likelihood(self, laid: Laid) -> tuple[np.ndarray, np.ndarray]:
        """Of each id: log10 of its probability, and of the probability that a word begins there or the text ends."""
        out = np.empty((3, laid.targets.size), np.float32)
        begin = self.table[self.starts].sum(0, dtype=float).astype(np.float32)
        for lo in range(0, len(laid.targets), LANES):
            x, y = laid.windows(slice(lo, lo + LANES))
            g, total = self.sized_gates(x)
            some = slice(lo * SCORED, lo * SCORED + len(g))
            out[0, some] = total
            np.matmul(g, begin, out=out[1, some])
            np.einsum("ij,ij->i", g, self.table.take(y.ravel(), axis=0), out=out[2, some])
        out = np.maximum(out.take(laid.place, axis=1), np.float32(1e-30))
        total, begins, p = np.log(out, out=out)
        total, begins, p = (x.astype(np.float64) * np.log10(np.e) for x in (total, begins, p))
        return p - total, begins - total

    def gradient(self, x: np.ndarray, y: np.ndarray, on: np.ndarray):
        """Mean loss over positions `on`, gradient of the gate's part, responsibilities of the experts."""
        p, n, d = self.p, len(x), WIDTH
        g, (qk, vo, e, tail, tq, s, a, h, m, h2) = self.forward(x)
        g = g.reshape(n * SCORED, -1)
        r = self.table.take(y.ravel(), axis=0)
        r *= g
        total = r @ np.ones(r.shape[1], r.dtype) + r.dtype.type(1e-30)
        r *= (1 / total)[:, None]
        known = max(1, int(on.sum()))
        loss = -float((np.log(total) * on.ravel()).sum()) / known
        dg = g
        dg -= r
        if known < len(dg):
            dg[~on.ravel()] = 0
        each = dg.dtype.type(1 / known)  # the gradient is linear in dg: narrower arrays are divided
        last = h2.T @ dg
        last *= each
        grad = {"g": last[:d], "bg": last[d]}
        dh = dg @ (p["g"].T * each)
        grad["w2"] = m.T @ dh
        dm = dh @ p["w2"].T
        dm *= m > 0
        first = h.T @ dm
        grad["w1"], grad["b1"] = first[:d], first[d]
        dh += dm @ p["w1"].T
        dvo = a.T @ dh
        grad["v"], grad["o"] = dvo @ p["o"].T, p["v"].T @ dvo
        da = dh @ vo.T
        ds = da.reshape(n, SCORED, d) @ e.transpose(0, 2, 1)
        ds -= np.einsum("ij,ij->i", da, a).reshape(n, SCORED, 1)
        ds *= s
        de = s.transpose(0, 2, 1) @ da.reshape(n, SCORED, d)
        de += ds.transpose(0, 2, 1) @ tq
        dt = (ds @ e).reshape(-1, d)
        dqk = tail.T @ dt * p["q"].dtype.type(d**-0.5)
        grad["q"], grad["k"] = dqk @ p["k"], dqk.T @ p["q"]
        dh += dt @ qk.T
        de[:, WINDOW - SCORED :] += dh.reshape(n, SCORED, d)
        grad["pos"] = (np.ones(n, de.dtype) @ de.reshape(n, -1)).reshape(WINDOW, d)
        # of the embeddings, only the rows in use: the others' gradient is 0
        both = np.zeros((n, WINDOW, 2 * d), de.dtype)
        both[:, :, :d], both[:, :-1, d:] = de, de[:, 1:]
        used, sums = _row_sums(x.ravel(), both.reshape(-1, 2 * d))
        grad["e"], grad["e2"] = (used, sums[:, :d]), (used, sums[:, d:])
        return loss, grad, r.reshape(n, SCORED, -1)


class Adam:
    """Steps of a model's parameters along their gradients."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.p, self.steps = p, 0
        self.m1, self.m2 = ({n: np.zeros_like(v) for n, v in p.items()} for _ in range(2))

    def step(self, grad: dict, rate: float) -> None:
        self.steps += 1
        for n, g in grad.items():
            at, g = g if isinstance(g, tuple) else (slice(None), g)
            a, b = self.m1[n][at], self.m2[n][at]  # of some rows, these are copies
            a *= 0.9
            a += 0.1 * g
            b *= 0.99
            b += 0.01 * (g * g)
            self.m1[n][at], self.m2[n][at] = a, b
            step = np.sqrt(b * (1 / (1 - 0.99**self.steps)))
            step += 1e-6
            np.divide(a, step, out=step)
            step *= rate / (1 - 0.9**self.steps)
            self.p[n][at] -= step


#: Parameters with a row for each id.
BY_ID = "e", "e2"


class Learner:
    """Training from a given model on some rows, each one once: what the gate's parameters gained, and the experts' responsibilities."""

    def __init__(self, start: Model, rows: float, seed: int = 0):
        """rows: about so many will come; the rate falls by nine tenths over them."""
        self.start, self.rows, self.seen = start, max(1.0, rows), 0
        self.model = Model({n: v.copy() for n, v in start.p.items()}, start.table, start.starts, start.shares)
        self.adam, self.rng = Adam(self.model.p), np.random.default_rng(seed)
        self.soft, self.n = np.zeros(start.table.shape), np.zeros(len(start.shares), np.int64)

    def learn(self, laid: Laid, rows: int) -> None:
        on = laid.on()
        self.n += np.bincount(laid.targets.ravel()[laid.place], minlength=len(self.n))
        order = self.rng.permutation(len(on))
        held: list[tuple[np.ndarray, np.ndarray]] = []  # responsibilities that aren't added yet
        for lo in range(0, len(order), LANES):
            some = order[lo : lo + LANES]
            x, y = laid.windows(some)
            o = on[some]
            done = min(1.0, (self.seen + rows * lo / len(order)) / self.rows)
            _, grad, r = self.model.gradient(x, y, o)
            self.adam.step(grad, LEARNER_RATE * (1 - 0.9 * done))
            held.append((y[o], r[o]))
            if len(held) == HELD or lo + LANES >= len(order):
                _add_rows(self.soft, *map(np.concatenate, zip(*held, strict=True)))
                held.clear()
        self.seen += rows

    def by_id(self, ids: np.ndarray) -> np.ndarray:
        """Of each id: its responsibilities, then the gains of its own parameters times its count."""
        gains = [(self.model.p[n][ids] - self.start.p[n][ids]) * self.n[ids, None] for n in BY_ID]
        return np.concatenate([self.soft[ids], *gains], 1).astype(np.float32)

    def others(self) -> np.ndarray:
        """Gains of all other parameters times the number of ids."""
        return np.concatenate([(self.model.p[n] - v).ravel() for n, v in self.start.p.items() if n not in BY_ID]).astype(np.float32) * np.float32(self.n.sum())


def joined(start: Model, n: np.ndarray, by_id: np.ndarray, others: np.ndarray) -> Model:
    """The model of all learners, from sums of what they have learnt: means of the gains, weighted by ids, and the table anew."""
    u = n + 0.01
    share = (1 / np.maximum(n, 1)[:, None]).astype(np.float32)
    p = {k: start.p[k] + by_id[:, EXPERTS + i * WIDTH : EXPERTS + (i + 1) * WIDTH] * share for i, k in enumerate(BY_ID)}
    at = 0
    for k, v in start.p.items():
        if k not in BY_ID:
            p[k] = (v + others[at : at + v.size].reshape(v.shape) / max(1, n.sum())).astype(np.float32)
            at += v.size
    model = Model(p, start.table, start.starts, u / u.sum())
    model.settle(by_id[:, :EXPERTS] + (1e-3 * model.shares[:, None]).astype(np.float32))
    return model


def train(texts: list[str], path: str, seed: int = 3, epochs: int = 6, lanes: int = 64, rate: float = 0.02) -> Model:
    """A model learnt from `texts`: the gate by Adam, the experts' table by stepwise expectation maximisation."""
    words = Words([], path)
    encoder = words.encoder
    split = [words_of(t) for t in texts]
    slots = words.slots(split) if split else np.zeros(0, np.int64)
    tokens = np.array([len(t) + 1 for t in split], np.int64)
    u = np.full(encoder.size, 0.01)
    if not split:
        return Model.fresh(encoder.starts, u / u.sum(), seed)
    laid = Laid.of(words, slots, tokens)
    on = laid.on()
    u += np.bincount(laid.targets.ravel(), on.ravel(), encoder.size)
    model = Model.fresh(encoder.starts, u / u.sum(), seed)
    # experts begin as the successors of the commonest ids; the rest share the last ones
    x, y = laid.windows(slice(None))
    before, flat = x[:, WINDOW - SCORED :][on], y[on]
    common = np.argsort(-np.bincount(before, minlength=len(u)), kind="stable")[: EXPERTS - 8]
    own = EXPERTS - 8 + np.arange(len(u)) % 8
    own[common] = np.arange(len(common))
    counts = np.zeros((len(u), EXPERTS), np.float32)
    np.add.at(counts, (flat, own[before]), np.float32(1))
    counts += (1e-3 * model.shares[:, None]).astype(np.float32)
    model.settle(counts)
    x, y = x.astype(np.int32), y.astype(np.int32)
    del split, slots, laid, before, flat  # the driver is small
    rng = np.random.default_rng(seed)
    adam = Adam(model.p)
    every = epochs * -(-len(y) // lanes)
    scale = 1.0  # of `counts`, so that fading needs no pass over it
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(order), lanes):
            some = order[lo : lo + lanes]
            o = on[some]
            _, grad, r = model.gradient(x[some], y[some], o)
            adam.step(grad, rate * (1 - 0.9 * (adam.steps + 1) / every))
            scale *= 1 - min(0.5, 2.0 * len(some) / len(y))
            _add_rows(counts, y[some][o], r[o] * np.float32(1 / scale))
            if adam.steps % 16 == 0 or adam.steps == every:
                counts *= np.float32(scale)
                scale = 1.0
                model.settle(counts)
    return model


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, list[list[bytes]]]]:
    """Texts of column `text`, in blocks of about BLOCK_WORDS words, each with the place of its first row."""
    texts: list[list[bytes]] = []
    held = at = 0
    for t in batch.column(batch.schema.get_field_index("text")):
        texts.append(words_of(t.as_py()))
        held += len(texts[-1]) + 1
        if held > BLOCK_WORDS:
            yield at, texts
            at += len(texts)
            texts, held = [], 0
    if texts:
        yield at, texts


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the words of a partition's sample."""
    counts: Counter[bytes] = Counter()
    for batch in batches:
        for text in batch.column(0):
            counts.update(words_of(text.as_py()))
    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])


#: What a row of the corpus's statistics holds: the count of a head word, of an id with what a learner has of it, of all words with the learner's other gains.
HEAD, ID, ALL = range(3)
STATS = "kind int, id long, n long, more binary"


def _stats(kind: int, ids: np.ndarray, n: np.ndarray, more: list[bytes] | None = None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), kind, np.int32)), pa.array(ids.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(more if more is not None else [None] * len(ids), pa.binary())], ["kind", "id", "n", "more"])


def _observed(shared, path: str):
    """Counts of the head words and ids, and what a learner has of them, of a partition's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, head, key, rows = shared.value
        words = Words.load(key, head, path)
        n_head, total, learner = np.zeros(len(head) + 1, np.int64), 0, None
        for batch in batches:
            for _, texts in _blocks(batch):
                learner = learner or Learner(model, rows)
                tokens = np.array([len(t) + 1 for t in texts])
                slots = words.slots(texts)
                n_head += np.bincount(slots[slots <= words.head], minlength=len(n_head))
                total += len(slots)
                learner.learn(Laid.of(words, slots, tokens), len(texts))
        if learner:
            used = np.flatnonzero(n_head)
            yield _stats(HEAD, used, n_head[used])
            used = np.flatnonzero(learner.n)
            for some in np.array_split(used, -(-len(used) // 10_000)):
                yield _stats(ID, some, learner.n[some], [x.tobytes() for x in learner.by_id(some)])
            yield _stats(ALL, np.array([0]), np.array([total]), [learner.others().tobytes()])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the statistics of each (kind, id)."""
    count: Counter[tuple[int, int]] = Counter()
    parts: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for kind, i, n, more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            count[kind, i] += n
            if more is not None:
                x = np.frombuffer(more, np.float32)
                if (kind, i) in parts:
                    parts[kind, i] += x
                else:
                    parts[kind, i] = x.astype(np.float64)
    rows = list(count)
    more = [parts[r].astype(np.float32).tobytes() if r in parts else None for r in rows]
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([count[r] for r in rows], pa.int64()), pa.array(more, pa.binary())], ["kind", "id", "n", "more"])


@dataclass
class Corpus:
    """What the scoring pass is told of the corpus."""

    counts: np.ndarray  # of the end and the head words, by slot
    tokens: int


def log_sum(part: np.ndarray, log: np.ndarray) -> np.ndarray:
    """log10(part + 10 ** log), also where the power is too small for a float."""
    return np.where(part > 0, np.log10(np.where(part > 0, part, 1) + 10.0**log), log)


#: A row is a document (key null), with the sums of its head words, or one of its other words, with the model's log10 of it.
SCORED_ROWS = "row long, doc_id long, teach boolean, n_tokens long, n_known long, base double, score double, key long"
ROW_NAMES = [x.split()[0] for x in SCORED_ROWS.split(", ")]


def word_scores(model: Model, words: Words, corpus: Corpus, slots: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 of each word's probability by attention and unigram (without the unigram's share where it isn't a head word), and which are head words.

    A word's ids begin where a word may begin and end where the next may: so the probabilities of all words
    and the end sum to 1 at most.
    """
    laid = Laid.of(words, slots, tokens)
    p, b = model.likelihood(laid)
    first = laid.upto - words.n[slots]
    own = np.add.reduceat(p, first) - b[first]
    follows = slots != 0
    own[follows] += b[laid.upto[follows]]
    known = slots <= words.head
    u = corpus.counts[np.where(known, slots, 0)] * known * (UNIGRAM_WEIGHT / max(1, corpus.tokens))
    return log_sum(u, own + np.log10(1 - UNIGRAM_WEIGHT)), known


def _scored(shared, path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, head, key, corpus = shared.value
        words = Words.load(key, head, path)
        row = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        for batch in batches:
            ids, teach = batch.column(0), np.logical_not(batch.column(2).to_numpy(zero_copy_only=False).astype(bool))
            for at, texts in _blocks(batch):
                n, tokens = len(texts), np.array([len(t) + 1 for t in texts])
                slots = words.slots(texts)
                score, known = word_scores(model, words, corpus, slots, tokens)
                text = np.repeat(np.arange(n), tokens)
                count = corpus.counts[slots[known]]
                sums = [np.bincount(text[known], v, n) for v in (count > 0, np.log10(count + 0.5), score[known])]
                rare = ~known
                far = int(rare.sum())
                t = teach[at : at + n]
                none = lambda k: np.zeros(k, np.int64)
                word = pa.array(np.arange(n + far) >= n)
                long = lambda a, b, only=None: pa.array(np.concatenate([a, b]).astype(np.int64), mask=only)
                isdoc, isword = ~np.asarray(word), np.asarray(word)
                doc_id = pa.concat_arrays([ids.slice(at, n).cast(pa.int64()), pa.nulls(far, pa.int64())])
                columns = [long(row + np.arange(n), row + text[rare]), doc_id, pa.array(np.concatenate([t, t[text[rare]]])), long(tokens, none(far), isword), long(np.rint(sums[0]), none(far), isword)]
                columns += [pa.array(np.concatenate([sums[1], np.zeros(far)]), mask=isword), pa.array(np.concatenate([sums[2], score[rare]])), long(none(n), words.key[slots[rare]].view(np.int64), isdoc)]
                yield pa.RecordBatch.from_arrays(columns, ROW_NAMES)
                row += n

    return run


def observe(model: Model, head: list[bytes], key: str, teach: DataFrame, path: str) -> tuple[Corpus, Model]:
    """Statistics of all training texts: counts, and the model learnt further from every one of them, gate and tables.

    Rows (turn, text) are dealt over learners by `turn` and learnt in order of it, so the model doesn't depend on
    the table's layout; the number of learners grows with the rows.
    """
    spark = teach.sparkSession
    rows = teach.count()
    learners = max(1, -(-rows // LEARNER_ROWS))
    shared = spark.sparkContext.broadcast((model, head, key, rows / learners))
    dealt = teach.repartitionById(learners, F.pmod("turn", F.lit(learners)).cast("int")).sortWithinPartitions("turn", "text")
    stats = staged(dealt.select("text").mapInArrow(_observed(shared, path), STATS).repartition("kind", "id").mapInArrow(_added, STATS), "lm-stats")
    counts, n = np.zeros(len(head) + 1, np.int64), np.zeros(len(model.shares), np.int64)
    by_id, others = np.zeros((len(n), EXPERTS + len(BY_ID) * WIDTH), np.float32), np.zeros(sum(v.size for k, v in model.p.items() if k not in BY_ID))
    tokens = 0
    for r in stats.toLocalIterator():  # a row for each head word and id at most
        if r["kind"] == HEAD:
            counts[r["id"]] = r["n"]
        elif r["kind"] == ID:
            n[r["id"]] = r["n"]
            by_id[r["id"]] = np.frombuffer(r["more"], np.float32)
        else:
            tokens = r["n"]
            others += np.frombuffer(r["more"], np.float32)
    unstage(stats)
    shared.unpersist()
    return Corpus(counts, tokens), joined(model, n, by_id, others)


def score_documents(docs: DataFrame, held_out: str, tokenizer: str | None = None, seed: int = 3) -> DataFrame:
    """Scores of every whole text: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    `held_out` is a SQL condition on doc_id; the other rows teach. A word's probability is the attention model's, over
    the word's ids, with UNIGRAM_WEIGHT of the word unigram: a distribution over all words and the end. Windows overlap
    and each id is scored once.

    The gate, the experts' tables and the unigram learn from every word of every training row. Only the values that the
    gate's learning starts from come from a bounded sample (SAMPLE_ROWS spans of SAMPLE_CHARS), and the choice of the
    words whose counts are broadcast, which changes no result. Words beyond the HEAD_WORDS commonest are counted by an exchange, told apart by
    64 bits: so base and unigram are exact whatever the vocabulary's size.

    Null or empty text: only the end. Null doc_id: not held out; repeated rows are rows of their own; other columns
    are ignored; without training rows N is 0 and the base is uniform; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship_package(spark)
    path = tokenizer or default_tokenizer()
    flag = F.coalesce(F.expr(held_out), F.lit(False))
    turn = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(1 << 30))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", flag.alias("held")).withColumn("turn", turn)
    teach = rows.where("not held")
    span = F.substr("text", (F.pmod(F.xxhash64("turn", "doc_id"), F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(1))) + 1).cast("int"), F.lit(SAMPLE_CHARS))
    share = min(1.0, 1.2 * HEAD_ROWS / max(1, teach.count()))
    drawn = teach.where("text is not null").where(F.col("turn") < int(share * (1 << 30))).select(span.alias("text"), "turn")
    drawn = staged(drawn, "lm-sample")  # HEAD_ROWS spans, about
    sample = [r[0] for r in drawn.orderBy("turn", "text").limit(SAMPLE_ROWS).collect()]
    often = drawn.select("text").mapInArrow(_counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    head = [bytes(r[0]) for r in often.orderBy(F.desc("n"), "word").limit(HEAD_WORDS).collect()]
    unstage(drawn)
    key = uuid.uuid4().hex
    corpus, model = observe(train(sample, path, seed), head, key, teach.select("turn", "text"), path)
    shared = spark.sparkContext.broadcast((model, head, key, corpus))

    scored = staged(rows.select("doc_id", "text", "held").mapInArrow(_scored(shared, path), SCORED_ROWS), "lm-scored")
    used = scored.where("key is not null").select("row", "key", "teach", "score")
    counts = staged(used.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_if("teach").alias("times")), "lm-counts")
    each = lookup(used, counts.select("key", "times"), ["key"], counts.select("key", "n"))
    with_unigram = F.log10(F.pow(F.lit(10.0), "score") + F.col("times") * F.lit(UNIGRAM_WEIGHT / max(1, corpus.tokens)))
    score = F.when(F.col("times") > 0, with_unigram).otherwise(F.col("score"))
    rare = each.groupBy("row").agg(F.sum(score).alias("_score"), F.sum(F.log10(F.col("times") + 0.5)).alias("_base"), F.count_if(F.col("times") > 0).alias("_known"))
    distinct = int(counts.where("times > 0").count()) + int((corpus.counts > 0).sum())
    denominator = F.log10(F.lit(corpus.tokens + 0.5 * (distinct + 1)))
    plus = lambda c, zero: F.col(c) + F.coalesce(F.col(f"_{c}"), F.lit(zero))
    found = scored.where("key is null").join(rare.withColumnRenamed("_known", "_n_known"), "row", "left")
    return found.select(
        "doc_id", (~F.col("teach")).alias("held_out"), "n_tokens", plus("n_known", 0).alias("n_known"), F.lit(corpus.tokens).cast("long").alias("train_tokens"), (plus("base", 0.0) - F.col("n_tokens") * denominator).alias("base_score"), plus("score", 0.0).alias("score")
    )
