"""The permutation index against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from tidemark.llm import permutation_index as P


def brute(rows, k=5, every=50):
    rows = {(i, tuple(v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = np.asarray([i for i, _ in rows])
    x = np.asarray([v for _, v in rows], float)
    norm = np.sqrt((x * x).sum(axis=1))
    out = {}
    for i, v, s in zip(ids, x, norm, strict=True):
        if i % every == 0:
            score = (x * v).sum(axis=1) / (norm * s)
            ranked = sorted((-c, j) for c, j in zip(score.tolist(), ids.tolist(), strict=True) if j != i)[:k]
            out[int(i)] = [(j, -c) for c, j in ranked]
    return out


def seen(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


def recall(got, want):
    hits = total = 0
    for q, rows in want.items():
        cut = rows[-1][1]
        total += len(rows)
        hits += sum(1 for _, s in got.get(q, []) if s >= cut - 1e-12)
    return hits / total


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.1"])
def test_recall_on_the_tables(spark, folder):
    sf = f"/root/testdata/{folder}"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got, want = seen(P.op8_permutation_index(spark, sf)), brute(rows)
    assert got.keys() == want.keys() and all(len(got[q]) == 5 for q in want)
    x = {i: np.asarray(v, float) for i, v in rows}
    for q, hits in got.items():
        for j, s in hits:
            assert s == pytest.approx(float(x[q] @ x[j] / np.linalg.norm(x[q]) / np.linalg.norm(x[j])), abs=1e-12)
    assert recall(got, want) >= 0.95


def test_hot_vector_odd_rows_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK_ROWS", 40)
    monkeypatch.setattr(P, "BLOCK_QUERIES", 3)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(400)] + [(1000 + i, [float(x) for x in range(1, 9)]) for i in range(200)]
    rows += [(50, None), (2000, [0.0] * 8), (2050, [1.0, None] + [1.0] * 6), (2100, [float("nan")] * 8), (2150, [float("inf")] * 8), (2200, [1.0, 2.0]), (None, [1.0] * 8)]
    rows += [(2250, [-0.0, 0.0, 1.0] + [0.0] * 5), (2300, [0.0, -0.0, 2.0] + [0.0] * 5), (100, rows[100][1])]
    vectors = spark.createDataFrame([(*r, 1, 0.5) for r in rows], "vec_id long, embedding array<double>, rank int, score double").repartition(4)
    valid = P.valid_vectors(vectors)
    got = seen(P.search(valid, valid.where("id % 50 = 0"), probes=1000))
    want = brute([r for r in rows if r[0] != 2200])
    assert got.keys() == want.keys()
    for q in want:
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]])
        assert [j for j, _ in got[q]] == [j for j, _ in want[q]]


@pytest.mark.parametrize("n", [0, 1, 3])
def test_few_rows(spark, n):
    vectors = spark.createDataFrame([(50 * i, [1.0, float(i)]) for i in range(n)], "vec_id long, embedding array<double>")
    valid = P.valid_vectors(vectors)
    got = seen(P.search(valid, valid))
    assert {q: len(h) for q, h in got.items()} == {50 * i: n - 1 for i in range(n) if n > 1}


def test_huge_and_tiny_components(spark):
    """Finite vectors of any size take part; cosine does not depend on their lengths."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(150, 4))
    scale = [1.0, 1e200, 1e-200, 1e308 / 4, 5e-300]
    rows = [(i, (x[i] * scale[i % 5]).tolist()) for i in range(150)]
    got = P.search(*(P.valid_vectors(spark.createDataFrame(r, "vec_id long, embedding array<double>")) for r in (rows, rows[::50]))).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert len(got) == 15
    for r in got:
        assert r.score == pytest.approx(float(unit[r.query_id] @ unit[r.vec_id]), abs=1e-9)
