"""The command lines of monitoring and of the demonstration data."""

from __future__ import annotations

import json

import yaml

from tests.test_monitoring import reference, settings
from tidemark.sources.__main__ import main as make_data
from tidemark.streaming.__main__ import main as monitor
from tidemark.streaming.store import Store


def test_demonstration_data(spark, tmp_path, capsys):
    out = tmp_path / "data"
    again = ["--output-dir", str(out), "--n-reference", "50", "--n-current", "20", "--scenario", "combined"]
    assert make_data(again, spark) == 0
    assert spark.read.parquet(str(out / "current.parquet")).count() == 20 == spark.read.option("header", True).csv(str(out / "current.csv")).count()
    assert json.loads((out / "metadata.json").read_text())["scenario"] == "combined"
    assert make_data([*again, "--format", "csv"], spark) == 1 and make_data([*again, "--overwrite"], spark) == 0
    assert make_data(["--n-current", "0", "--output-dir", str(tmp_path / "x")], spark) == 1 and make_data(["--scenario", "other"], spark) == 1
    assert "positive" in capsys.readouterr().err


def test_monitoring_from_folders(spark, tmp_path, capsys):
    (tmp_path / "c.yaml").write_text(yaml.safe_dump(settings(tmp_path)))
    reference(spark).write.parquet(str(tmp_path / "base.parquet"))
    for name, rows in (("events", [{"event_id": f"e{k}", "occurred_at": "2024-05-01T10:00:00Z", "features": {"age": 30.0, "region": "a"}, "prediction": 1} for k in range(4)]), ("labels", [{"event_id": f"e{k}", "y_true": 1} for k in (0, 1, 9)])):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.jsonl").write_text("\n".join(map(json.dumps, rows)))
    args = ["--config", str(tmp_path / "c.yaml"), "--reference", str(tmp_path / "base.parquet"), "--events", str(tmp_path / "events"), "--labels", str(tmp_path / "labels"), "--checkpoint", str(tmp_path / "cp"), "--once"]
    assert monitor(args, spark) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["events"] == {"processed": 3, "buffered": 1}
    store = Store(spark, str(tmp_path / "state"))
    assert store.read("feedback").count() == 2 and store.read("parked").count() == 1
    before = store.manifest["number"]
    assert monitor(args, spark) == 0  # nothing is read twice
    store.refresh()
    assert store.manifest["number"] == before
    assert monitor(args[:-3], spark) == 1 and monitor(["--config", "nowhere"], spark) == 1
