"""Many pairs in one plan against analyze of each by itself."""

from __future__ import annotations

import pytest

from tests.test_analysis import config
from tests.test_monitoring import same
from tidemark import analyze, calibrate
from tidemark.plans import pairs
from tidemark.plans.pairs import analyze_pairs
from tidemark.sources.synth import Batch, batches, generate

FEATURES = {"age": {"kind": "numeric", "nullable": True, "min": 0}, "region": {"kind": "categorical", "nullable": True}}


@pytest.mark.parametrize("block", [1_000, 2])
def test_pairs_together_are_pairs_alone(spark, monkeypatch, block):
    monkeypatch.setattr(pairs, "BLOCK", block)
    c = config(FEATURES)
    left = [("a", 20.0 + k % 17, "abc"[k % 3]) for k in range(60)] + [("b", 5.0, "x")] * 9 + [("b", None, None), ("c", 1.0, "a"), ("c", 2.0, "b"), (None, 1.0, "a"), ("only left", 1.0, "a")]
    right = [("a", 25.0 + k % 9, "ab"[k % 2]) for k in range(24)] + [("b", float("inf"), "y"), ("b", -3.0, "x"), ("b", 5.0, None)] + [("c", None, None)] * 3 + [("only right", 1.0, "a")]
    reference, current = (spark.createDataFrame(rows, "pair string, age double, region string").repartition(3) for rows in (left, right))
    found = dict(analyze_pairs(reference, current, "pair", c))
    assert list(found) == ["a", "b", "c", "only left", "only right"]
    for p, result in found.items():
        alone = analyze(reference.where(f"pair = '{p}'").drop("pair"), current.where(f"pair = '{p}'").drop("pair"), c)
        assert same(alone, result), p
    assert found["only left"]["schema"]["status"] == "error" and found["b"]["alerts"]


def test_grid_is_what_its_cases_are(spark):
    cases = calibrate.build_cases(sizes=[200], shifts=[8.0], missing=[0.3])
    c = config({"age": {"kind": "numeric", "nullable": True}, "income": {"kind": "numeric", "nullable": True}, "region": {"kind": "categorical", "nullable": True}}, multiple_testing="bh")
    jobs = lambda: max(spark.sparkContext.statusTracker().getJobIdsForGroup(), default=-1)
    taken = []
    for some, seeds in ((cases[:1], [1]), (cases, [1, 2])):
        began = jobs()
        runs = calibrate.run(spark, c, some, seeds, n_reference=300)
        taken.append(jobs() - began)
    assert taken[1] <= taken[0] + 6, taken
    case = cases[-1]
    reference, current, _ = generate(spark, seed=2, n_reference=300, n_current=200, scenario=case.scenario, age_shift=case.age_shift_years, drifted_missing=case.current_missing_fraction)
    want = {(r["source"], r["feature"], r["method"]): r for r in calibrate.result_rows(case, 2, analyze(reference, current, c))}
    got = {(r.source, r.feature, r.method): r.asDict() for r in runs.where(f"case_id = '{case.case_id}' and seed = 2").collect()}
    assert got.keys() == want.keys() and all(same(want[k], got[k]) for k in want)


def test_batches_do_not_depend_on_each_other_or_on_chunks(spark, monkeypatch):
    rows = lambda frame: sorted(tuple(map(str, r)) for r in frame.collect())
    one, two = Batch("a", 3, 90), Batch("b", 4, 55, missing=0.2, shift=5.0)
    whole = rows(batches(spark, [one, two]))
    monkeypatch.setattr("tidemark.sources.synth.CHUNK", 7)
    assert whole == sorted(rows(batches(spark, [one])) + rows(batches(spark, [two])))
    assert sum(r[2] == "None" for r in whole) == 2 + 11
