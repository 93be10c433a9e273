"""Searches hold a bounded part of a block's cosines, and return the same rows."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest

from labelyard.operators import similarity


def peak(work):
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def block(queries, base, seed=0):
    v = np.random.default_rng(seed).normal(size=(queries + base, 16))
    return pd.DataFrame({"id": np.arange(queries + base), "vec": list(v), "is_query": np.arange(queries + base) < queries})


def test_a_pair_of_blocks_holds_a_strip_of_cosines():
    rows = block(4096, 4096)
    assert peak(lambda: similarity._product(5)(rows)) < 60e6


def test_cells_are_sent_in_small_frames():
    n, cells = 2000, 600
    v = np.random.default_rng(1).normal(size=(n + cells, 8))
    centres = v[n:] / np.linalg.norm(v[n:], axis=1, keepdims=True)
    some = pd.DataFrame({"id": np.arange(n), "vec": list(v[:n]), "cell": np.zeros(n, "int32"), "least": np.full(n, -2.0)})
    frames = []
    held = peak(lambda: frames.extend((len(f), f["id"].sum()) for f in similarity._reaching(centres, np.full(cells, 0.5), np.full(cells, True))(iter([some]))))
    assert sum(k for k, _ in frames) == n * (cells - 1) and sum(x for _, x in frames) == (cells - 1) * n * (n - 1) // 2
    assert max(k for k, _ in frames) <= 4096 and held < 60e6


def test_centres_are_fitted_on_strips():
    v = np.random.default_rng(2).normal(size=(8192, 8))
    assert peak(lambda: similarity.fit_centres(v, 1024, 2)) < 60e6


@pytest.mark.parametrize("k", [1, 5, 400])
def test_best_of_equals_zeros_and_nan(monkeypatch, k):
    monkeypatch.setattr(similarity, "STRIP", 1000)
    rows = block(60, 300, 3)
    for i in range(100, 200):
        rows.at[i, "vec"] = rows["vec"][70]  # copies: ties by id
    for i in (3, 80, 81):
        rows.at[i, "vec"] = np.zeros(16)
    rows.at[90, "vec"] = np.full(16, np.nan)
    rows = rows.sample(frac=1, random_state=1)
    found = similarity._product(k)(rows.assign(least=0.1))
    q, b = rows[rows["is_query"]], rows[~rows["is_query"]]
    want = []
    for i, x in zip(q["id"], similarity.unit(q["vec"]), strict=True):
        pairs = sorted((-round(float(x @ y), 6), j) for j, y in zip(b["id"], similarity.unit(b["vec"]), strict=True) if not np.isnan(y).any())
        want += [(i, j, -c) for c, j in pairs[:k] if -c >= 0.1]
    assert sorted(zip(found["query_id"], found["base_id"], found["cosine"].round(6))) == sorted(want)
