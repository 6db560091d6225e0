"""Operators and functions against closed forms, hand-made values and brute force."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.calibrate import build_cases, expected_signal, level_name
from tidemark.contracts import any_alert, highest_status
from tidemark.functions.canonical import canonical_json, sha256_json, utc_timestamp
from tidemark.functions.decide import exceeds, falls_below
from tidemark.functions.tails import chi2_tail, chi2_tail_one, kolmogorov_tail, ks_exact, ks_p_value
from tidemark.operators import cells, histogram, stability, twosample
from tidemark.operators import categorical as cat
from tidemark.operators.adversarial import group_folds, labelled, stratified_folds, validate
from tidemark.operators.decisions import adjusted, resolve_threshold
from tidemark.operators.longform import category_long, numeric_long
from tidemark.operators.numbering import number_rows
from tidemark.operators.running import running_sums
from tidemark.sources.synth import SCENARIOS, generate, write

# ---- tail probabilities


@pytest.mark.parametrize("x", [0.0, 0.1, 1.0, 2.7777778, 10.0, 80.0, 700.0])
def test_chi2_tail_closed_forms(x):
    assert chi2_tail(x, 2) == pytest.approx(math.exp(-x / 2), rel=1e-10)
    assert chi2_tail(x, 1) == pytest.approx(chi2_tail_one(x), rel=1e-9)
    assert chi2_tail(x, 4) == pytest.approx(math.exp(-x / 2) * (1 + x / 2), rel=1e-10)
    assert chi2_tail(x, 6) == pytest.approx(math.exp(-x / 2) * (1 + x / 2 + x * x / 8), rel=1e-10)


def exact_by_enumeration(d, n, m):
    hits = total = 0
    for places in itertools.combinations(range(n + m), n):
        i = j = 0
        top = 0.0
        for k in range(n + m):
            i, j = (i + 1, j) if k in places else (i, j + 1)
            top = max(top, abs(i / n - j / m))
        total += 1
        hits += top >= d - 1e-12
    return hits / total


@pytest.mark.parametrize("n,m,d", [(3, 3, 2 / 3), (3, 5, 0.6), (4, 7, 0.5), (2, 3, 1.0), (5, 5, 0.2), (4, 6, 5 / 12), (1, 4, 0.75)])
def test_ks_exact_by_enumeration(n, m, d):
    assert ks_exact(d, n, m) == pytest.approx(exact_by_enumeration(d, n, m), rel=1e-10)


def test_ks_known_values():
    assert ks_p_value(2 / 3, 2, 3) == (pytest.approx(6 / 10), "exact")
    assert ks_p_value(0.6, 3, 5)[0] == pytest.approx(26 / 56)
    assert ks_exact(0.0, 4, 7) == 1.0
    n = 400
    assert ks_exact(0.1, n, n) == pytest.approx(kolmogorov_tail(math.sqrt(n / 2) * 0.1), rel=0.08)
    assert 0 < ks_exact(0.9, 100, 100) < 1e-30
    assert ks_p_value(0.01, 20_000, 20_000)[1] == "asymptotic"
    assert kolmogorov_tail(0.999999) == pytest.approx(kolmogorov_tail(1.000001), rel=1e-5)


# ---- decisions


def test_equal_up_to_rounding_is_not_beyond():
    assert not exceeds(0.1 + 0.2, 0.3) and exceeds(0.31, 0.3) and not falls_below(0.3, 0.1 + 0.2) and falls_below(0.29, 0.3)


def test_benjamini_hochberg():
    assert adjusted([0.01, 0.04, 0.03, 0.002]) == pytest.approx([0.02, 0.04, 0.04, 0.008])
    assert adjusted([]) == [] and adjusted([0.9, 0.8]) == pytest.approx([0.9, 0.9])


def test_thresholds_by_presence_not_by_value():
    drift = {"distance_thresholds": {"psi": 0.1, "js": None, "wasserstein": 2.0}, "feature_thresholds": {"a": {"psi": None}, "b": {"js": 0.3}}}
    assert resolve_threshold("a", "psi", drift) == (None, "feature")
    assert resolve_threshold("b", "psi", drift) == (0.1, "global")
    assert resolve_threshold("b", "js", drift) == (0.3, "feature")
    assert resolve_threshold("a", "js", drift) == (None, "not_configured")


def test_statuses_and_alerts():
    assert highest_status(["skipped", "ok", "skipped"]) == "ok" and highest_status([]) == "skipped"
    assert highest_status(["warning", "critical", "error"]) == "error"
    assert any_alert([None, False]) is False and any_alert([None]) is None and any_alert([False, True]) is True


# ---- vectors


def test_psi_and_js_of_vectors():
    assert stability.psi([0.4, 0.6], [0.5, 0.5])["value"] == pytest.approx(0.0405463, abs=1e-6)
    assert stability.js_divergence([1, 0], [0.5, 0.5])["value"] == pytest.approx(0.3112781, abs=1e-7)
    assert stability.js_divergence([1, 0], [0, 1])["value"] == pytest.approx(1.0)
    assert stability.psi([2e300, 3e300], [4, 6])["value"] == pytest.approx(0.0, abs=1e-12)
    assert stability.psi([1], [1, 2])["status"] == "error" and stability.psi([], [])["status"] == "skipped"
    assert stability.psi([0, 0], [1, 2])["status"] == "skipped" and stability.js_divergence([-1, 2], [1, 2])["status"] == "error"
    assert stability.js_divergence([float("nan"), 2], [1, 2])["status"] == "error" and stability.psi([True, 2], [1, 2])["status"] == "error"
    for bad in (0, 1, True, "x", float("nan")):
        with pytest.raises(ValueError):
            stability.psi([1], [1], smoothing=bad)
    for bad in (0, 1, -2, float("inf")):
        with pytest.raises(ValueError):
            stability.js_divergence([1], [1], base=bad)


# ---- two samples


def brute(r, c):
    values = sorted(set(r) | set(c))
    gap = [sum(x <= v for x in r) / len(r) - sum(x <= v for x in c) / len(c) for v in values]
    d = max(map(abs, gap))
    at = next(v for v, g in zip(values, gap, strict=True) if abs(g) == d)
    w = sum(abs(g) * (b - a) for g, a, b in zip(gap, values, values[1:], strict=False))
    return d, at, w


def sides(spark, features, kind="double"):
    out = []
    for side in range(2):
        rows = [(n, float(v)) if kind == "double" else (n, v) for n, pair in features.items() for v in pair[side]]
        out.append(spark.createDataFrame(rows or [("", None)], f"f string, v {kind}"))
    names = list(features)
    wide = [f.selectExpr(*[f"if(f = '{n}', v, null) `{n}`" for n in names]) for f in out]
    return wide[0], wide[1], names


def test_ks_and_wasserstein_like_brute_force(spark):
    rng = random.Random(3)
    features = {f"f{k}": ([rng.choice([rng.gauss(0, 1), rng.randrange(4)]) for _ in range(rng.randrange(2, 90))], [rng.choice([rng.gauss(0.4, 1), rng.randrange(4)]) for _ in range(rng.randrange(2, 90))]) for k in range(6)}
    features |= {"same": ([5] * 4, [5] * 7), "known": ([0, 1, 3], [1, 2, 4, 8, 9])}
    got = {r.feature: r for r in twosample.ks_wasserstein(twosample.cumulative(numeric_long(*sides(spark, features)))).collect()}
    for name, (r, c) in features.items():
        d, at, w = brute([float(x) for x in r], [float(x) for x in c])
        assert (got[name].n_reference, got[name].n_current) == (len(r), len(c))
        assert got[name].ks == pytest.approx(d) and got[name].wasserstein == pytest.approx(w)
        if name != "same":
            assert got[name].location == pytest.approx(at) or abs(brute(r, c)[0] - d) < 1e-12
    assert got["known"].ks == pytest.approx(0.6) and got["known"].wasserstein == pytest.approx(3.4666667)


def test_quantiles_and_cells_like_numpy(spark):
    rng = random.Random(4)
    features = {"a": ([rng.gauss(0, 1) for _ in range(101)], [rng.gauss(1, 2) for _ in range(60)]), "ties": ([rng.randrange(3) for _ in range(50)], [rng.randrange(5) for _ in range(40)]), "const": ([7] * 5, [6, 7, 8, 8]), "few": ([0, 1, 2, 3], [-100, 0, 1, 100])}
    long = twosample.cumulative(numeric_long(*sides(spark, features)))
    edges = {r.feature: r for r in cells.quantile_edges(long, 10).collect()}
    found = {}
    for r in cells.numeric_cells(long, 10).collect():
        found.setdefault(r.feature, {})[r.cell] = (r.n_reference, r.n_current)
    for name in ("a", "ties", "few"):
        want = np.unique(np.quantile(np.asarray(features[name][0], float), np.linspace(0, 1, 11))[1:-1])
        assert edges[name].edges == pytest.approx(want.tolist())
        bounds = [-np.inf, *edges[name].edges, np.inf]
        counts = [np.histogram(np.asarray(x, float), bounds)[0].tolist() for x in features[name]]
        assert [found[name][k] for k in range(len(bounds) - 1)] == list(zip(*counts, strict=True))
    assert edges["const"].constant == 7 and found["const"] == {0: (0, 1), 1: (5, 1), 2: (0, 2)}
    two = {r.cell: (r.n_reference, r.n_current) for r in cells.numeric_cells(twosample.cumulative(numeric_long(*sides(spark, {"x": ([0, 1, 2, 3], [-100, 0, 1, 100])}))), 2).collect()}
    assert two == {0: (2, 3), 1: (2, 1)}


def test_psi_js_frames_agree_with_vectors(spark):
    features = {"g": (["a"] * 3 + ["b"] * 5, ["b"] * 2 + ["c"] * 2), "h": (["x"], ["x"])}
    frame = cells.category_cells(category_long(*sides(spark, features, "string")))
    got = {r.feature: r for r in stability.psi_js(frame).collect()}
    assert got["g"].psi == pytest.approx(stability.psi([3, 5, 0], [0, 2, 2])["value"]) and got["g"].js == pytest.approx(stability.js_divergence([3, 5, 0], [0, 2, 2])["value"])
    assert (got["h"].psi, got["h"].js) == (0.0, 0.0)


def test_roc_auc_like_all_pairs(spark):
    rng = random.Random(5)
    rows = [("w" + str(k % 3), rng.randrange(2), rng.choice([0.1, 0.5, rng.random()])) for k in range(200)] + [("one", 1, 0.5)] * 3 + [("w0", None, 0.5), ("w0", 1, None)]
    got = {r.feature: r.roc_auc for r in twosample.roc_auc(spark.createDataFrame(rows, "feature string, label int, score double")).collect()}
    for w in ("w0", "w1", "w2"):
        pos, neg = ([s for f, y, s in rows if f == w and y == k and s is not None] for k in (1, 0))
        assert got[w] == pytest.approx(sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg))
    assert got["one"] is None


# ---- categories


def chi(spark, r, c):
    frame = cells.category_cells(category_long(*sides(spark, {"g": ([k for k, n in r.items() for _ in range(n)], [k for k, n in c.items() for _ in range(n)])}, "string")))
    return cat.chi_square(frame).first(), cat.category_changes(frame).first(), frame


def test_chi2_known_table(spark):
    found, _, _ = chi(spark, {"a": 10, "b": 10, "c": 20}, {"a": 20, "b": 20, "c": 20})
    assert found.dof == 2 and found.chi2 == pytest.approx(2.7777778) and found.cramers_v == pytest.approx(1 / 6)
    assert chi2_tail(found.chi2, found.dof) == pytest.approx(0.2493522, abs=1e-7)


def test_rare_categories_are_pooled(spark):
    counts = {"a": 50, "b": 50, "r1": 3, "r2": 3}
    found, changes, frame = chi(spark, counts, counts)
    assert found.applies and found.n_cells == 3 and changes.n_pooled == 2
    assert changes.pooled_fraction_reference == pytest.approx(6 / 106) and changes.pooled_fraction == pytest.approx(12 / 212)
    assert {r.cell: r.n_reference for r in cat.pooled(frame).collect()}[cells.POOLED] == 6


def test_new_and_gone_categories(spark):
    found, changes, frame = chi(spark, {"stable": 30, "gone": 20}, {"stable": 30, "new": 20})
    assert not found.applies and found.chi2 is None and found.cramers_v is None and found.least_observed == 0
    assert (changes.n_new, changes.n_gone) == (1, 1)
    assert {(r.cell, r.change) for r in cat.new_and_gone(frame).collect()} == {("string:new", "new"), ("string:gone", "disappeared")}
    for bad in ({"rare_below": 0}, {"rare_below": True}, {"least_observed": 1.5}, {"least_expected": 0}, {"least_expected": float("nan")}):
        with pytest.raises(ValueError):
            cat.check_parameters(**bad)


def test_types_keep_categories_apart(spark):
    r, c = spark.sql("SELECT '1' AS g"), spark.sql("SELECT true AS g")
    assert {x.cell for x in cells.category_cells(category_long(r, c, ["g"])).collect()} == {"string:1", "boolean:true"}


# ---- running sums and numbers


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 40), st.integers(0, 5)), min_size=1, max_size=60, unique_by=lambda t: t[:2]), st.sampled_from([1, 3, 10, 1000]))
def test_running_sums_do_not_depend_on_ranges(spark, rows, buckets):
    frame = spark.createDataFrame(rows, "g string, v int, n int")
    got = {(r.g, r.v): (r.n_upto, r.next_v) for r in running_sums(frame, "g", "v", ["n"], buckets).collect()}
    for g, v, _ in rows:
        later = [x for h, x, _ in rows if h == g and x > v]
        assert got[g, v] == (sum(n for h, x, n in rows if h == g and x <= v), min(later, default=None))


def test_medians_like_numpy(spark):
    rows = [(g, v) for g, values in {"odd": [3, 1, 2], "even": [4.5, 1, 9, 2], "ties": [2, 2, 2, 5], "one": [7]}.items() for v in map(float, values)] + [("odd", None), ("none", None)]
    got = {r.g: r.quantile for r in twosample.medians(spark.createDataFrame(rows, "g string, v double"), "g", "v").collect()}
    assert got == {"odd": 2.0, "even": 3.25, "ties": 2.0, "one": 7.0}


def test_rare_categories_are_one_for_the_learner(spark, monkeypatch):
    from tidemark.operators import adversarial

    monkeypatch.setattr(adversarial, "MOST_CATEGORIES", 2)
    rows = [("a", 1.0)] * 5 + [("b", 2.0)] * 3 + [("c", 9.0), ("d", None), (None, 3.0)]
    train = spark.createDataFrame(rows, "x0 string, x1 double")
    _, scored, _ = adversarial._prepared(train, spark.createDataFrame([("a", 1.0), ("c", None), ("new", 2.0), (None, 5.0)], train.schema), ["categorical", "numeric"])
    assert [tuple(r) for r in scored.select("x0", "x1", "x1_missing").collect()] == [("a", 1.0, 0.0), (adversarial.OTHER, 1.5, 1.0), (adversarial.OTHER, 2.0, 0.0), (adversarial.MISSING, 5.0, 0.0)]


def test_group_folds_balance_labels(spark):
    rng = random.Random(11)
    rows = [(g, int(rng.random() < 0.3), k) for g in range(600) for k in range(rng.choice([1, 1, 2, 5, 12]))]
    dealt = group_folds(spark.createDataFrame(rows, "group_id long, label int, k int"), 4, 7)
    share = {}
    for r in dealt.groupBy("label", "fold").count().collect():
        share.setdefault(r.label, {})[r.fold] = r["count"]
    for by_fold in share.values():
        total = sum(by_fold.values())
        assert len(by_fold) == 4 and all(abs(n / total - 0.25) < 0.05 for n in by_fold.values())


def test_group_folds_with_few_and_uneven_groups(spark):
    """Every label's rows of a fold differ from an even share by at most the largest group's, also where sizes go over four decades."""
    rng = random.Random(5)
    for n_splits, sizes in ((3, [(700, 3), (500, 90), (2, 400), (30, 30), (1, 1), (5, 0), (0, 7)]), (4, [(int(10 ** rng.uniform(0, 3)), int(10 ** rng.uniform(0, 3))) for _ in range(60)]), (5, [(1, 0)] * 23 + [(0, 1)] * 14)):
        rows = [(g, y) for g, n in enumerate(sizes) for y in (0, 1) for _ in range(n[y])]
        dealt = group_folds(spark.createDataFrame(rows, "group_id long, label int"), n_splits, 7).cache()
        assert dealt.count() == len(rows) and dealt.select("group_id", "fold").distinct().count() == len({g for g, _ in rows})
        found = {(r.fold, r.label): r["count"] for r in dealt.groupBy("fold", "label").count().collect()}
        for y in (0, 1):
            even, largest = sum(n[y] for n in sizes) / n_splits, max(n[y] for n in sizes)
            assert all(abs(found.get((f, y), 0) - even) <= largest for f in range(n_splits)), (n_splits, y, found)


def test_equal_rows_are_dealt_evenly(spark):
    rows = labelled(spark.createDataFrame([(1.0,)] * 901, "v double"), spark.createDataFrame([(1.0,)] * 100 + [(2.0,)], "v double"), {"v": "numeric"})
    found = stratified_folds(rows.repartition(5), 4, 3).groupBy("label", "fold").count().collect()
    assert sorted((r.label, r["count"]) for r in found) == [(0, 225), (0, 225), (0, 225), (0, 226), (1, 25), (1, 25), (1, 25), (1, 26)]


def test_number_rows(spark):
    rows = [(k * 7919 % 101, k) for k in range(101)]
    got = number_rows(spark.createDataFrame(rows, "v int, k int").repartition(5), "v", start=10).collect()
    assert [r.n - 10 for r in sorted(got, key=lambda r: r.v)] == list(range(101))


# ---- folds and adversarial validation


def test_folds_are_even_and_disjoint(spark):
    a, b = (spark.range(n).selectExpr("id % 7 * 1.0 v", f"concat('{s}', id % 11) e") for n, s in ((100, "r"), (61, "c")))
    rows = labelled(a, b, {"v": "numeric"}, "e")
    got = stratified_folds(rows, 3, 1).groupBy("label", "fold").count().collect()
    assert sorted((r.label, r["count"]) for r in got) == [(0, 33), (0, 33), (0, 34), (1, 20), (1, 20), (1, 21)]
    per = group_folds(rows, 3, 1).groupBy("group_id").agg({"fold": "min", "label": "count"}).collect()
    again = group_folds(rows, 3, 1).select("group_id", "fold").distinct().count()
    assert len(per) == again == 22


SETTINGS = {"enabled": True, "n_splits": 3, "roc_auc_threshold": 0.8, "exclude_columns": [], "group_column": None}


@pytest.mark.parametrize("shift,low,high", [(8.0, 0.95, 1.0), (0.0, 0.3, 0.7)])
def test_adversarial_sees_a_shift_and_none(spark, shift, low, high):
    rng = random.Random(6)
    make = lambda m: spark.createDataFrame([(rng.gauss(m, 1) if k % 9 else None, "abc"[k % 3]) for k in range(120)], "value double, g string")
    found = validate(make(0.0), make(shift), SETTINGS, {"value": "numeric", "g": "categorical"}, trees=8)
    assert low <= found["roc_auc"] <= high and len(found["fold_auc"]) == 3 and found["alert"] is (shift > 0)
    if shift:
        assert sum(found["feature_importance"].values()) == pytest.approx(1) and next(iter(found["feature_importance"])) == "value"


def test_adversarial_preconditions(spark):
    f = spark.createDataFrame([(1.0, "a"), (2.0, "b")], "v double, e string")
    kinds = {"v": "numeric"}
    assert validate(f, f, SETTINGS | {"enabled": False}, kinds)["status"] == "skipped"
    assert "rows" in validate(f, f, SETTINGS, kinds)["reason"]
    assert "missing in" in validate(f, f, SETTINGS | {"group_column": "z"}, kinds)["reason"]
    assert "no common" in validate(f, f, SETTINGS | {"exclude_columns": ["v"]}, kinds)["reason"]
    more = f.unionAll(f).unionAll(f)
    found = validate(more, more, SETTINGS | {"group_column": "e"}, kinds)
    assert "groups" in found["reason"] and found["n_groups"] == 2 and found["split_strategy"] == "stratified_group_kfold"
    nulls = more.selectExpr("v", "nullif(e, 'a') e")
    assert "missing values" in validate(nulls, more, SETTINGS | {"group_column": "e"}, kinds)["reason"]


# ---- display, text, generation


def test_display_bins(spark):
    assert histogram.edges_of(3.0, 3.0, 5) == [2.5, 3.5] and histogram.edges_of(100.0, 100.0, 5) == [95.0, 105.0]
    assert histogram.bin_count(1000, 0.0, 1.0, 0.5) == 11 and histogram.bin_count(10**9, 0.0, 1e9, 1.0) == 30 and histogram.bin_count(5, 1.0, 1.0, 0.0) == 1
    rows = histogram.equal_width(numeric_long(*sides(spark, {"x": ([0, 1, 2, 10], [10, 10])})), "x", 5).collect()
    assert sorted((r.side, r.bin, r.n) for r in rows if r.n) == [("current", 4, 2), ("reference", 0, 2), ("reference", 1, 1), ("reference", 4, 1)]
    frame = cells.category_cells(category_long(*sides(spark, {"g": (list("abbc"), list("cca"))}, "string")))
    assert [r.cell for r in histogram.category_shares(frame).orderBy("place").collect()] == ["string:c", "string:a", "string:b"]


def test_canonical_text():
    assert canonical_json({"b": 1, "a": [True, None, 1.0]}) == '{"a":[true,null,1.0],"b":1}'
    assert sha256_json({"a": 1, "b": 2}) == sha256_json({"b": 2, "a": 1})
    with pytest.raises(ValueError):
        canonical_json(float("nan"))
    assert utc_timestamp("2024-05-01T12:00:00+02:00") == "2024-05-01T10:00:00Z"
    for bad in ("2024-05-01T12:00:00", "x", 5):
        with pytest.raises(ValueError):
            utc_timestamp(bad)


def test_generated_tables(spark, tmp_path):
    reference, current, info = generate(spark, seed=3, n_reference=4000, n_current=2000, scenario="combined")
    r, c = reference.toPandas(), current.toPandas()
    assert r.income.isna().sum() == 80 and c.income.isna().sum() == 160
    assert r.age.between(18, 100).all() and c.age.between(18, 100).all() and c.age.mean() - r.age.mean() == pytest.approx(8, abs=1)
    assert (c.region == "central").mean() == pytest.approx(0.55, abs=0.04) and (r.region == "central").mean() == pytest.approx(0.30, abs=0.03)
    again = generate(spark, seed=3, n_reference=4000, n_current=2000, scenario="combined")[0].toPandas()
    assert sorted(map(str, again.values.tolist())) == sorted(map(str, r.values.tolist()))
    write(reference, current, info, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "reference.parquet")).count() == 4000
    with pytest.raises(Exception):  # noqa: B017
        write(reference, current, info, str(tmp_path))
    for bad in ({"scenario": "x"}, {"n_current": 0}, {"reference_missing": 2.0}):
        with pytest.raises(ValueError):
            generate(spark, **bad)
    assert SCENARIOS[0] == "none"


def test_calibration_grid():
    found = build_cases()
    assert len(found) == 27 and len({c.case_id for c in found}) == 27 and found[1].case_id == "numeric_weak_shift2_n500"
    assert level_name(0, 1) == "strong" and level_name(3, 5) == "level_4"
    assert expected_signal("combined", "drift", "age", "ks") and not expected_signal("none", "adversarial", None, "roc_auc") and not expected_signal("numeric", "drift", "region", "psi")
    for bad in ({"sizes": [0]}, {"shifts": [1.0, 1.0]}, {"missing": [0.01]}, {"sizes": []}):
        with pytest.raises(ValueError):
            build_cases(**bad)
