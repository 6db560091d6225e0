"""Files in and out, the command line, the report."""

from __future__ import annotations

import json
import math

import pytest
import yaml

from tests.test_analysis import config
from tidemark import calibrate, cli
from tidemark.report import bars, export_html, html, labels
from tidemark.sources.tables import load_config, load_table, records_frame, write_json_atomic

CSV = "n,x,flag,word,mixed,gone\n1,1.5,True,a,1,\n2,NA,False,NULL,x,\n3,inf,True,\"b,c\",2.5,nan\n"
FEATURES = {"n": {"kind": "numeric", "nullable": True}, "word": {"kind": "categorical", "nullable": True}}


def test_csv_types_and_missing_values(spark, tmp_path):
    path = tmp_path / "t.CSV"
    path.write_text(CSV)
    frame = load_table(spark, path)
    assert dict(frame.dtypes) == {"n": "bigint", "x": "double", "flag": "boolean", "word": "string", "mixed": "string", "gone": "double"}
    rows = frame.orderBy("n").collect()
    assert [r.x for r in rows] == [1.5, None, math.inf] and [r.word for r in rows] == ["a", None, "b,c"] and {r.gone for r in rows} == {None}


def test_parquet_nan_is_missing(spark, tmp_path):
    spark.createDataFrame([(1.0,), (float("nan"),)], "v double").write.parquet(str(tmp_path / "t.parquet"))
    assert sorted([r.v for r in load_table(spark, tmp_path / "t.parquet").collect()], key=str) == [1.0, None]


def test_paths(spark, tmp_path):
    with pytest.raises(TypeError):
        load_table(spark, 5)
    with pytest.raises(FileNotFoundError):
        load_table(spark, tmp_path / "no.csv")
    with pytest.raises(IsADirectoryError):
        load_table(spark, tmp_path)
    (tmp_path / "t.txt").write_text("x")
    with pytest.raises(ValueError):
        load_table(spark, tmp_path / "t.txt")
    with pytest.raises(ValueError):
        load_config(tmp_path / "t.txt")
    (tmp_path / "bad.yaml").write_text("a: [")
    with pytest.raises(ValueError):
        load_config(tmp_path / "bad.yaml")


def test_records(spark):
    frame = records_frame(spark, [{"a": 1, "b": "x"}, {"a": 2.5, "c": True}])
    assert dict(frame.dtypes) == {"a": "double", "b": "string", "c": "boolean"}
    assert {(r.a, r.b, r.c) for r in frame.collect()} == {(1.0, "x", None), (2.5, None, True)}


def test_atomic_writes(tmp_path):
    path = tmp_path / "r.json"
    write_json_atomic(path, {"a": 1})
    with pytest.raises(FileExistsError):
        write_json_atomic(path, {"a": 2})
    with pytest.raises(ValueError):
        write_json_atomic(path, {"a": float("nan")}, overwrite=True)
    write_json_atomic(path, {"a": 3}, overwrite=True)
    assert json.loads(path.read_text()) == {"a": 3} and list(tmp_path.iterdir()) == [path]
    with pytest.raises(FileNotFoundError):
        write_json_atomic(tmp_path / "no" / "r.json", {})


@pytest.fixture
def files(tmp_path):
    for name, shift in (("reference", 0), ("current", 30)):
        rows = "\n".join(f"{20 + k + shift},{'ab'[k % 2]}" for k in range(40))
        (tmp_path / f"{name}.csv").write_text(f"n,word\n{rows}\n")
    c = config(FEATURES, multiple_testing="bh")
    (tmp_path / "c.yaml").write_text(yaml.safe_dump(c))
    return tmp_path


def arguments(files, *more):
    return ["--reference", str(files / "reference.csv"), "--current", str(files / "current.csv"), "--config", str(files / "c.yaml"), "--json-output", str(files / "out.json"), *more]


def test_command_line(spark, files, capsys):
    assert cli.main(arguments(files, "--html-output", str(files / "out.html")), spark) == 0
    result = json.loads((files / "out.json").read_text())
    assert result["summary"]["has_alerts"] and "status: warning" in capsys.readouterr().out
    assert cli.main(arguments(files), spark) == 1  # it is there already
    assert cli.main(arguments(files, "--overwrite", "--fail-on-alert"), spark) == 2
    assert cli.main(arguments(files, "--html-output", str(files / "out.json"), "--overwrite"), spark) == 1
    assert cli.main(["--reference"], spark) == 1 and cli.main(["--help"], spark) == 0
    page = (files / "out.html").read_text()
    assert page.startswith("<!doctype html>") and "<svg" in page and "<script" not in page


def test_report_escapes_and_checks(spark, files):
    from tidemark import analyze

    evil = "<img src=x>"
    frame = spark.createDataFrame([(float(k), "a" if k % 2 else evil) for k in range(30)], f"`{evil}` double, g string")
    result = analyze(frame, frame)
    text = html(result, frame, frame)
    assert evil not in text and "&lt;img" in text
    with pytest.raises(ValueError):
        export_html({}, files / "x.html")
    assert labels(["string:1", "bigint:1", "string:b"]) == ["string:1", "bigint:1", "b"] and "rect" in bars([("a", 0.0, 0.0)])


def test_calibration_run_and_summary(spark, tmp_path):
    cases = calibrate.build_cases(sizes=[300], shifts=[8.0], missing=[0.3])[:3]
    c = config({"age": {"kind": "numeric", "nullable": True}, "income": {"kind": "numeric", "nullable": True}, "region": {"kind": "categorical", "nullable": True}}, multiple_testing="bh", categorical_methods=["chi2"], numeric_methods=["ks"])
    runs = calibrate.run(spark, c, cases, [1, 2], n_reference=400).cache()
    summary = {(r.drift_family, r.source, r.feature, r.method): r for r in calibrate.summarize(runs).collect()}
    shift = summary["numeric", "drift", "age", "ks"]
    assert (shift.rate_kind, shift.n_runs, shift.n_decisions, shift.observed_rate, shift.seeds) == ("detection_rate", 2, 2, 1.0, "1|2")
    assert summary["control", "drift", "age", "ks"].rate_kind == "false_alert_rate" and summary["control", "adversarial", None, "roc_auc"].observed_rate is None
    assert summary["missingness", "quality", "income", "current_missing_fraction"].observed_rate == 1.0
    info = calibrate.metadata(c, cases, [1, 2], runs)
    assert info["n_control_runs"] == 2
    calibrate.write(runs, calibrate.summarize(runs), info, str(tmp_path))
    assert spark.read.option("header", True).csv(str(tmp_path / "runs.csv")).count() == runs.count()
    with pytest.raises(ValueError):
        calibrate.summarize(runs.drop("alert"))


def test_views_of_a_result(spark):
    from tidemark import analyze
    from tidemark.plans.views import alerts_frame, checks_frame, projected, visible

    r, c = (spark.createDataFrame([(float(k + s), "ab"[k % 2]) for k in range(30)], "v double, g string") for s in (0, 40))
    result = analyze(r, c)
    checks = checks_frame(spark, result)
    assert [x.position for x in checks.orderBy("position").collect()] == list(range(checks.count()))
    bad = visible(checks, ["warning"], ["v"])
    assert {x.check for x in bad.collect()} == {"ks"} and "p_value" in bad.columns
    assert "reason" not in visible(checks, ["ok"], ["g"]).columns
    named = projected(bad, {"feature": "column", "status": "state"}, {"status": {"warning": "look"}})
    assert [tuple(x) for x in named.collect()] == [("v", "look")]
    assert alerts_frame(spark, result).count() == result["summary"]["n_alerts"] > 0
