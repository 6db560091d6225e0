"""Samples against a reference by its index, held against the counts of both sides together."""

from __future__ import annotations

import math
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import distribution_index
from tidemark.operators.distribution_index import Index, _table_name, lookups, sample_distances
from tidemark.operators.twosample import cumulative, ks_wasserstein


def index_of(spark, tmp_path, reference, **sizes):
    path = str(tmp_path / uuid.uuid4().hex)
    rows = spark.createDataFrame(reference, "name string, v double")
    Index.write(rows.groupBy("name", "v").agg(F.count("*").alias("n")), path, **sizes)
    return Index.read(spark, path), path


def plainly(spark, reference, samples):
    rows = [(f, True, v) for f, name in {(f, n) for f, n, _ in samples} for n, v in reference if n == name] + [(f, False, v) for f, _, v in samples]
    return {r.feature: r for r in ks_wasserstein(cumulative(spark.createDataFrame(rows, "feature string, is_reference boolean, v double"))).collect()}


@pytest.mark.parametrize(("page_rows", "max_pages"), [(1_024, 1_000), (4, 1_000), (1, 1_000), (4, 6)])
def test_like_counts_of_both_sides(spark, tmp_path, page_rows, max_pages):
    rng = np.random.default_rng(page_rows)
    reference = [("a", float(v)) for v in rng.integers(-20, 20, 300)] + [("b", float(v)) for v in rng.normal(size=90)] + [("c", 7.0)] * 12
    samples = []
    for k, (name, draw) in enumerate([("a", rng.integers(-25, 25, 40)), ("a", rng.integers(0, 3, 5)), ("a", [99.0] * 3), ("a", [-99.0]), ("b", rng.normal(0.5, 2, 60)), ("b", [v for n, v in reference if n == "b"][:30]), ("c", [7.0, 7.0]), ("c", [6.0, 8.0]), ("c", [9.0])]):
        samples += [(f"w{k}", name, float(v)) for v in draw]
    samples += [("whole", n, v) for n, v in reference if n == "a"]  # the same distribution
    index, _ = index_of(spark, tmp_path, reference, page_rows=page_rows, max_pages=max_pages)
    assert index.fences.count() <= max(max_pages, 3)
    found = {r.feature: r for r in sample_distances(index, spark.createDataFrame(samples, "feature string, name string, v double")).collect()}
    want = plainly(spark, reference, samples)
    assert found.keys() == want.keys()
    for f, w in want.items():
        r = found[f]
        assert (r.n_reference, r.n_current, r.ks, r.location, r.sign) == (w.n_reference, w.n_current, w.ks, w.location, w.sign), f
        assert r.wasserstein == pytest.approx(w.wasserstein, rel=1e-12, abs=1e-12), f


def test_names_without_values_and_no_samples(spark, tmp_path):
    index, _ = index_of(spark, tmp_path, [("a", 1.0), ("a", 2.0)])
    samples = spark.createDataFrame([("x", "nobody", 1.0), ("y", "a", 1.0)], "feature string, name string, v double")
    found = {r.feature: r for r in sample_distances(index, samples).collect()}
    assert (found["x"].n_reference, found["x"].n_current, found["x"].ks, found["x"].wasserstein, found["x"].sign) == (0, 1, None, None, None)
    assert (found["y"].ks, found["y"].wasserstein) == (0.5, 0.5)
    assert sample_distances(index, samples.limit(0)).count() == 0
    empty, _ = index_of(spark, tmp_path, [])
    assert sample_distances(empty, samples).where("ks is not null").count() == 0


def test_pages_are_not_shuffled_and_another_session_reads_them(spark, tmp_path):
    """What is shuffled is in proportion to the samples: the plan has no exchange over the pages, and the rows written to shuffles do not grow with the reference."""
    samples = spark.createDataFrame([("w", "a", float(v)) for v in range(50)], "feature string, name string, v double")
    written = {}
    for n in (2_000, 40_000):
        index, path = index_of(spark, tmp_path, [("a", float(v) / 7) for v in range(n)], page_rows=8)
        frame = sample_distances(index, samples)
        found = frame.collect()
        assert "tidemark_index" in frame._jdf.queryExecution().executedPlan().toString()
        written[n] = sum(shuffled(frame))
        spark.sql(f"DROP TABLE {_table_name(path)}")  # as in a session that did not write it
        assert sample_distances(Index.read(spark, path), samples).collect() == found
    assert written[40_000] <= written[2_000] < 2_000


def shuffled(frame):
    """Rows that each exchange of an executed plan wrote."""
    out = []

    def walk(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(node.plan())
        if name in ("ShuffleExchangeExec", "BroadcastExchangeExec"):
            m = node.metrics()
            key = "shuffleRecordsWritten" if name == "ShuffleExchangeExec" else "numOutputRows"
            out.append(m.apply(key).value())
        for k in range(node.children().size()):
            walk(node.children().apply(k))

    walk(frame._jdf.queryExecution().executedPlan())
    return out


def test_integrals_of_a_wide_range_stay_exact(spark, tmp_path):
    values = [1e9 + k * 1e-3 for k in range(400)] + [-1e9]
    index, _ = index_of(spark, tmp_path, [("a", v) for v in values], page_rows=16)
    sample = [1e9 + 0.2, 1e9 + 0.3]
    r = sample_distances(index, spark.createDataFrame([("w", "a", v) for v in sample], "feature string, name string, v double")).collect()[0]
    points = sorted(values + sample)
    share = lambda of, x: sum(v <= x for v in of) / len(of)
    want = math.fsum(abs(share(values, a) - share(sample, a)) * (b - a) for a, b in zip(points, points[1:], strict=False))
    assert r.wasserstein == pytest.approx(want, rel=1e-9)


@pytest.mark.parametrize(("ask_rows", "few_pages"), [(3, 1_024), (3, 0), (4_096, 0)])
def test_pages_that_many_samples_ask_are_answered_in_parts(spark, tmp_path, monkeypatch, ask_rows, few_pages):
    """A Python task is handed ask_rows lookups of a page at a time, however many there are, and the results are the same."""
    monkeypatch.setattr(distribution_index, "ASK_ROWS", ask_rows)
    monkeypatch.setattr(distribution_index, "FEW_PAGES", few_pages)
    rng = np.random.default_rng(5)
    reference = [("a", float(v)) for v in rng.integers(0, 12, 40)] + [("b", float(v)) for v in rng.normal(size=20)]
    samples = [(f"w{k}", name, float(v)) for k, name in enumerate("ab" * 6) for v in rng.integers(-2, 14, 9)]
    index, _ = index_of(spark, tmp_path, reference)
    frame = sample_distances(index, spark.createDataFrame(samples, "feature string, name string, v double"))
    found, want = {r.feature: r for r in frame.collect()}, plainly(spark, reference, samples)
    assert found.keys() == want.keys()
    for f, w in want.items():
        r = found[f]
        assert (r.n_reference, r.n_current, r.ks, r.location, r.sign) == (w.n_reference, w.n_current, w.ks, w.location, w.sign), f
        assert r.wasserstein == pytest.approx(w.wasserstein, rel=1e-12, abs=1e-12), f
    asked = spark.createDataFrame([(f"w{k}", "a", 5.0, distribution_index.AT, 5.0, None) for k in range(200)], "feature string, name string, v double, kind int, key double, rank long")
    met = lookups(index, asked)
    assert len(met.collect()) == 200
    assert 200 / ask_rows <= max(handed(met)) <= 200


def handed(frame):
    """Rows that each join of an executed plan gave."""
    out = []

    def walk(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(node.plan())
        if name.endswith("JoinExec"):
            out.append(node.metrics().apply("numOutputRows").value())
        for k in range(node.children().size()):
            walk(node.children().apply(k))

    walk(frame._jdf.queryExecution().executedPlan())
    return out
