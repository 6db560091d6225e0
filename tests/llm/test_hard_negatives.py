"""Hard negatives against brute force in whole numbers."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import hard_negatives as H

COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows, every, positives=5, negatives=10, scale=256):
    """rows: (id, label, vector) that take part."""
    own = sorted((i, label, [math.floor(scale * x) for x in v]) for i, label, v in rows)
    out = []
    for a, label, v in own:
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i, m) for i, m, w in own if i != a)
        for ps, p, _ in [s for s in scored if s[2] == label][:positives]:
            inside = [(s, i) for s, i, m in scored if m != label and 30 * -ps <= 100 * -s <= 90 * -ps][:negatives]
            out += [(a, p, n + 1, i, -ps, -s) for n, (s, i) in enumerate(inside)]
    return sorted(out)


def seen(frame):
    return sorted(tuple(r[c] for c in COLUMNS) for r in frame.collect())


def mined(spark, rows, every=10, schema="vec_id long, label int, embedding array<double>", **settings):
    valid = H.valid_rows(spark.createDataFrame(rows, schema).repartition(3))
    return seen(H.mine(valid, valid.where(F.col("id") % every == 0), **settings))


def some(rng, n, width=6, labels=4):
    return [(i, int(rng.integers(labels)), (rng.normal(size=width) + 0.6).tolist()) for i in range(n)]


@pytest.mark.parametrize("block_bytes", [H.BLOCK_BYTES, 6 * 8 * 7])
def test_like_brute_force(spark, monkeypatch, block_bytes):
    """Also in small blocks of anchors, and products of few anchors and candidates."""
    monkeypatch.setattr(H, "_ANCHORS", 3)
    monkeypatch.setattr(H, "_CANDIDATES", 17)
    rows = some(np.random.default_rng(1), 300)
    found = mined(spark, rows, block_bytes=block_bytes)
    assert found == brute(rows, 10) and len(found) > 300


def test_ties_and_a_vector_that_a_third_of_all_rows_repeat(spark):
    rng = np.random.default_rng(2)
    rows = some(rng, 120, width=3) + [(1000 + i, i % 3, [1.0, 2.0, 1.0]) for i in range(90)]
    rows = [(i, label, [round(2 * x) / 2 for x in v]) for i, label, v in rows]  # few distinct scores
    assert mined(spark, rows) == brute(rows, 10)


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    good = some(rng, 60)
    odd = [(None, 1, [1.0] * 6), (70, None, [1.0] * 6), (80, 1, None), (90, 1, [1.0, None] + [1.0] * 4), (100, 1, [float("nan")] * 6), (110, 1, [float("inf")] + [0.0] * 5)]
    odd += [(120, 1, [1.0] * 5), (130, 1, []), (140, 1, [1e300] * 6), (10, 9, [5.0] * 6), good[20], good[20]]
    wide = [(*r, f"x{k}", 3, 0.5) for k, r in enumerate(good + odd)]
    found = mined(spark, wide, schema="vec_id long, label int, embedding array<double>, id string, rank int, positive_score double")
    kept = [r if r[0] != 10 else min(r, (10, 9, [5.0] * 6), key=lambda x: (x[1], x[2])) for r in good] + [(120 + 0, 1, None)][:0]
    assert found == brute(kept, 10)


@pytest.mark.parametrize("n", [0, 1, 2, 12])
def test_few_rows(spark, n):
    rows = [(10 * i, i % 2, [1.0, float(i)]) for i in range(n)]
    assert mined(spark, rows) == brute(rows, 10)


def test_zero_and_negative_scores(spark):
    rows = [(0, 0, [1.0, 0.0]), (1, 0, [0.0, 1.0]), (2, 0, [-1.0, 0.0]), (3, 1, [0.0, 5.0]), (4, 1, [-1.0, 0.0]), (5, 1, [0.0, -1.0])]
    found = mined(spark, rows)
    assert found == brute(rows, 10) and {r[1] for r in found} == {1}  # 0 lies in the window of 0, nothing in that of a negative score


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(4)
    rows = [(i, i % 3, (rng.integers(1 << 18, 1 << 19, 4) + rng.random(4)).tolist()) for i in range(60)]
    found = mined(spark, rows)
    assert max(abs(r[4]) for r in found) > 2**53 and found == brute(rows, 10)


def test_best_merges_pieces_in_any_order():
    rng = np.random.default_rng(5)
    scores = rng.integers(-3, 4, (8, 500))
    ids = rng.permutation(500)
    wanted = rng.random((8, 500)) < 0.7
    best = H.Best(8, 6)
    for part in np.array_split(rng.permutation(500), 9):
        best.offer(0, scores[:, part].astype(float), wanted[:, part], ids[part])
    for r in range(8):
        want = sorted((-s, i) for s, i, w in zip(scores[r].tolist(), ids.tolist(), wanted[r].tolist(), strict=True) if w)[:6]
        assert list(zip((-best.score[r]).tolist(), best.id[r].tolist(), strict=True)) == want
