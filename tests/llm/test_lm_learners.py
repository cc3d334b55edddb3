"""The language model learns from every training row, by learners that don't depend on the table's layout."""

import math

import numpy as np
import pytest

from rastrel.llm import lm_scoring

RARE = "zebra quantum violin"


def rows():
    return [(i, ("the cat sat on the mat " if i % 2 else "red green blue ") * 30 + (RARE if i == 61 else "")) for i in range(80)]


def learnt(spark, monkeypatch, data, **sizes):
    """Scores, and the model before and after the pass over all training rows."""
    kept, real = [], lm_scoring.observe
    with monkeypatch.context() as m:
        for k, v in sizes.items():
            m.setattr(lm_scoring, k, v)
        m.setattr(lm_scoring, "observe", lambda *a: kept.append((a[0], *real(*a))) or kept[-1][1:])
        out = {r["doc_id"]: r["score"] for r in lm_scoring.score_documents(data, "doc_id >= 70").collect()}
    return out, kept[0][0], kept[0][2]


def test_gate_learns_from_rows_outside_the_sample(spark, monkeypatch):
    data = spark.createDataFrame(rows(), "doc_id long, text string")
    _, before, after = learnt(spark, monkeypatch, data, SAMPLE_ROWS=1, LEARNER_ROWS=20)
    encoder = lm_scoring.Encoder.load(lm_scoring.default_tokenizer())
    for w in RARE.encode().split():  # in one training row only
        at = encoder.word(w)
        assert (after.p["e"][at] != before.p["e"][at]).any(1).all()
    unseen = encoder.word(b"telescope")
    assert (after.p["e"][unseen] == before.p["e"][unseen]).all()
    assert all((after.p[k] != v).any() for k, v in before.p.items())


def test_many_learners_do_not_depend_on_layout(spark, monkeypatch):
    data = spark.createDataFrame(rows(), "doc_id long, text string")
    one, _, _ = learnt(spark, monkeypatch, data.repartition(1), SAMPLE_ROWS=5, LEARNER_ROWS=15)
    other, _, _ = learnt(spark, monkeypatch, data.repartition(7, "doc_id"), SAMPLE_ROWS=5, LEARNER_ROWS=15)
    assert len(one) == 80 and all(one[i] == pytest.approx(other[i], rel=1e-4) for i in one)


def test_choice_of_head_words_changes_no_score(spark, monkeypatch):
    data = spark.createDataFrame(rows(), "doc_id long, text string")
    one, _, _ = learnt(spark, monkeypatch, data, SAMPLE_ROWS=5, HEAD_WORDS=2)
    other, _, _ = learnt(spark, monkeypatch, data, SAMPLE_ROWS=5, HEAD_WORDS=9)
    assert all(one[i] == pytest.approx(other[i], rel=1e-6) for i in one)


def fresh(seed, size=40):
    m = lm_scoring.Model.fresh(np.ones(size, bool), np.full(size, 1 / size), seed)
    m.table = np.random.default_rng(seed).dirichlet(np.ones(size), lm_scoring.EXPERTS).T.astype(np.float32)
    return m


def test_learners_are_joined_by_weighted_means():
    start, rng = fresh(1), np.random.default_rng(5)
    texts = [[rng.integers(0, 20 + 20 * k, n) for n in (50, 30, 90 * (k + 1))] for k in range(2)]
    words = lm_scoring.Words([], lm_scoring.default_tokenizer())
    learners = []
    for some in texts:
        flat = np.concatenate(some)
        laid = lm_scoring.Laid.of(words, np.zeros(len(flat), np.int64), np.array([len(x) for x in some]))
        laid.targets.ravel()[laid.place] = flat
        laid.inputs[:] = rng.permutation(np.resize(flat, len(laid.inputs)))
        laid.targets[~laid.on()] = 39
        learners.append(lm_scoring.Learner(start, 3))
        learners[-1].learn(laid, 3)
    a, b = learners
    ids = np.arange(40)
    m = lm_scoring.joined(start, a.n + b.n, a.by_id(ids) + b.by_id(ids), a.others() + b.others())
    for k, v in start.p.items():
        na, nb = (a.n[:, None], b.n[:, None]) if k in lm_scoring.BY_ID else (a.n.sum(), b.n.sum())
        mean = (na * a.model.p[k] + nb * b.model.p[k]) / np.maximum(na + nb, 1)
        assert np.allclose(m.p[k], np.where(na + nb > 0, mean, v), atol=1e-5), k
    assert np.allclose(a.soft.sum(1), a.n, rtol=1e-4) and np.allclose(m.table.sum(0), 1, atol=1e-4)


@pytest.mark.parametrize("scale", [1, 30, 1000])
def test_gates_of_large_scores(scale):
    m = fresh(2)
    m.p["e"] *= scale
    m.p["bg"] -= 200 * (scale > 1)
    x = np.random.default_rng(3).integers(0, 40, (5, lm_scoring.WINDOW))
    g = m.gates(x).reshape(5, lm_scoring.SCORED, -1)
    e = m.p["e"][x].astype(float)
    e[:, 1:] += m.p["e2"][x[:, :-1]]
    e += m.p["pos"]
    p = {k: v.astype(float) for k, v in m.p.items()}
    tail = e[:, lm_scoring.WINDOW - lm_scoring.SCORED :]
    s = (tail @ p["q"]) @ (e @ p["k"]).transpose(0, 2, 1) / math.sqrt(lm_scoring.WIDTH) + lm_scoring.CAUSAL
    s = np.exp(s - s.max(2, keepdims=True))
    h = tail + (s / s.sum(2, keepdims=True)) @ (e @ p["v"]) @ p["o"]
    z = (h + np.maximum(h @ p["w1"] + p["b1"], 0) @ p["w2"]) @ p["g"] + p["bg"]
    z = np.exp(z - z.max(2, keepdims=True))
    assert np.allclose(g / g.sum(2, keepdims=True), z / z.sum(2, keepdims=True), atol=2e-2 if scale > 100 else 1e-3)
    assert np.isfinite(m.gradient(x, x[:, -lm_scoring.SCORED :], np.ones((5, lm_scoring.SCORED), bool))[0])
