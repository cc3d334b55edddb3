"""What the language model's passes save changes no value."""

import time

import numpy as np
import pytest

from rastrel.llm import lm_scoring


def drawn(rng, n):
    """Ids as frequent as a text's, and a row for each."""
    return np.minimum(rng.zipf(1.2, n), 40_000), rng.random((n, lm_scoring.EXPERTS), dtype=np.float32)


@pytest.mark.parametrize("n", [0, 1, 2, 50, 9_000])
def test_rows_are_added_to_their_ids(n):
    rng = np.random.default_rng(n)
    for at, rows in (drawn(rng, n), (np.zeros(n, np.int64), rng.random((n, 3), dtype=np.float32)), (np.arange(n)[::-1], rng.random((n, 3), dtype=np.float32))):
        to = rng.random((40_001, rows.shape[1]))
        want = to.copy()
        np.add.at(want, at, rows)
        lm_scoring._add_rows(to, at, rows)
        assert np.allclose(to, want, rtol=1e-5)


def test_rows_are_added_faster_than_by_sorted_runs():
    at, rows = drawn(np.random.default_rng(3), lm_scoring.LANES * lm_scoring.SCORED * 4)
    to = np.zeros((40_001, rows.shape[1]))

    def runs():
        found, sums = lm_scoring._row_sums(at, rows)
        to[found] += sums

    took = [[], []]
    for _ in range(20):  # in turn: the machine's speed varies
        for f, t in zip((runs, lambda: lm_scoring._add_rows(to, at, rows)), took, strict=True):
            began = time.thread_time()
            f()
            t.append(time.thread_time() - began)
    assert min(took[1]) < 0.85 * min(took[0])


def test_sums_of_gates():
    rng = np.random.default_rng(1)
    m = lm_scoring.Model.fresh(np.ones(40, bool), np.full(40, 1 / 40), 1)
    m.p["b1"] += rng.standard_normal(m.p["b1"].shape).astype(np.float32)
    m.p["bg"] += rng.standard_normal(m.p["bg"].shape).astype(np.float32)
    x = rng.integers(0, 40, (5, lm_scoring.WINDOW))
    g, total = m.sized_gates(x)
    assert np.allclose(total, g.sum(1), rtol=1e-5)
    assert np.allclose(g / total[:, None], m.forward(x)[0].reshape(g.shape), atol=1e-6)
