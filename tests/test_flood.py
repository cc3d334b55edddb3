"""Depression filling against a flood with one heap."""

import heapq
import random

import pytest

from rastrel.operators import flood


def one_heap(rows, h, w):
    z = {(r, c): v for r, c, v in rows}
    near = lambda r, c: [(r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]
    out, heap = {}, []
    for p, v in z.items():
        if v is not None and any(z.get(q) is None for q in near(*p)):
            heapq.heappush(heap, (v, p))
    while heap:
        v, p = heapq.heappop(heap)
        if p in out:
            continue
        out[p] = v
        for q in near(*p):
            if z.get(q) is not None and q not in out:
                heapq.heappush(heap, (max(v, z[q]), q))
    return {p: out.get(p) for p in z}


def terrain_rows(kind, h, w, seed):
    rng = random.Random(seed)
    if kind == "rough":
        return [(r, c, float(rng.randint(0, 30))) for r in range(h) for c in range(w)]
    if kind == "holes":
        return [(r, c, None if rng.random() < 0.03 else float(rng.randint(0, 12))) for r in range(h) for c in range(w)]
    m = (h / 2, w / 2)  # one bowl over all tiles, with a notch in its rim and a peak within
    return [(r, c, 3.5 if (r, c) == (0, w // 3) else abs(r - m[0]) + abs(c - m[1]) + (9 if (r + c) % 13 == 0 else 0)) for r in range(h) for c in range(w)]


@pytest.mark.parametrize(("kind", "h", "w", "tile"), [("rough", 23, 19, 7), ("holes", 20, 26, 6), ("bowl", 21, 21, 5), ("rough", 9, 9, 64), ("rough", 1, 7, 3), ("holes", 6, 2, 2)])
def test_fill_equals_one_heap(spark, kind, h, w, tile):
    rows = terrain_rows(kind, h, w, h * w)
    got = {(r["r"], r["c"]): r["z"] for r in flood.fill(spark.createDataFrame(rows, "r int, c int, z double"), h, w, tile).collect()}
    assert got == one_heap(rows, h, w)


def test_spill_levels_on_a_path(spark):
    edges = spark.createDataFrame([(-1, 0, 1.0), *[(i, i + 1, float((i * 7) % 11)) for i in range(40)], (40, -1, 6.0), (100, 101, 2.0)], "p long, q long, e double")
    got = {r["node"]: r["level"] for r in flood.spill_levels(edges).collect()}
    h = [1.0, *[float((i * 7) % 11) for i in range(40)], 6.0]
    assert {k: v for k, v in got.items() if k < 100} == {i: min(max(h[: i + 1]), max(h[i + 1 :])) for i in range(41)}
    assert got[100] is None and got[101] is None
