"""Monitoring: windows, idempotency, late labels, delivery, recovery, and the same by a stream."""

from __future__ import annotations

import json

import pytest
import yaml

from tests.test_analysis import config
from tidemark import analyze
from tidemark.plans.windows import Kept, analyze_windows, keep
from tidemark.sources.tables import load_monitoring_config
from tidemark.streaming import delivery
from tidemark.streaming.events import performance, tumbling_windows
from tidemark.streaming.monitor import INCOMING, Monitor, NoActiveReference, ReferenceConfigMismatch
from tidemark.streaming.settings import default_online, merged, validate_monitoring_config
from tidemark.streaming.store import IdempotencyConflict, InvalidStateTransition, PendingEvents, RecordNotFound, Store, UnsupportedSchemaVersion

FEATURES = {"age": {"kind": "numeric", "nullable": True}, "region": {"kind": "categorical", "nullable": True}}


def settings(tmp_path, **performance_):
    online = default_online(str(tmp_path / "state"), size=3, min_batch_rows=2)
    online["alerts"]["jsonl_path"] = str(tmp_path / "out" / "alerts.jsonl")
    online["performance"] |= {"enabled": True, "min_feedback_rows": 2, "baseline_accuracy": 0.9, "max_accuracy_drop": 0.1} | performance_
    analysis = config(FEATURES, numeric_methods=["wasserstein"], categorical_methods=[])
    analysis["drift"]["distance_thresholds"] = {"wasserstein": 20.0, "psi": None, "js": None}
    return merged(analysis, online)


def reference(spark):
    return spark.createDataFrame([(30.0 + k % 10, "ab"[k % 2]) for k in range(30)], "age double, region string")


def event(k, age=34.0, **more):
    return {"event_id": f"e{k}", "occurred_at": "2024-05-01T12:00:00+02:00", "features": {"age": age, "region": "a"}, "prediction": 1, "score": 0.9} | more


@pytest.fixture
def ticking():
    n = iter(range(10**6))
    return lambda: f"2024-01-01T00:00:00.{next(n):06d}Z"


def test_events_windows_labels_and_delivery(spark, tmp_path, ticking):
    m = Monitor(spark, settings(tmp_path), clock=ticking)
    with pytest.raises(NoActiveReference):
        m.ingest_events([event(0)])
    first = m.register_reference(reference(spark), "base")
    assert first["active"] and m.register_reference(reference(spark), "again")["reference_id"] == first["reference_id"]
    out = m.ingest_events([event(0), event(1), event(0)])
    assert (out["accepted"], out["duplicates"], out["buffered_rows"], out["run_ids"]) == (2, 1, 2, [])
    out = m.ingest_events([event(1), event(2, 90.0), event(3, 95.0), event(4), event(5), event(6)])
    assert (out["accepted"], out["duplicates"], out["buffered_rows"], len(out["run_ids"])) == (5, 1, 1, 2)
    rows = {r.event_id: r for r in m.store.latest("events").collect()}
    assert [rows[f"e{k}"].sequence for k in range(7)] == list(range(1, 8))
    assert rows["e0"].window_id == rows["e2"].window_id != rows["e3"].window_id and rows["e6"].state == "buffered"
    assert rows["e0"].occurred_at == "2024-05-01T10:00:00Z" and rows["e3"].state == "processed"
    envelope = m.run_envelope(out["run_ids"][0])
    assert envelope["status"] == "completed" and envelope["row_count"] == 3 and envelope["performance"]["status"] == "not_evaluated"
    assert envelope["result"]["drift"]["features"]["age"]["checks"]["wasserstein"]["value"] == pytest.approx((90 + 34 + 34) / 3 - 34.5, abs=6)

    with pytest.raises(IdempotencyConflict):
        m.ingest_events([event(2, 91.0)])
    assert m.store.read("conflicts").count() == 1 and {r.event_id: r for r in m.store.latest("events").collect()}["e2"].features == rows["e2"].features

    with pytest.raises(RecordNotFound):
        m.ingest_feedback([{"event_id": "e0", "y_true": 1}, {"event_id": "nobody", "y_true": 1}])
    assert m.store.read("feedback").count() == 0
    out = m.ingest_feedback([{"event_id": "e0", "y_true": 0}, {"event_id": "e1", "y_true": 0}, {"event_id": "e2", "y_true": 1}, {"event_id": "e6", "y_true": 1}])
    assert (out["accepted"], out["duplicates"], len(out["evaluations"])) == (4, 0, 1)
    assert out["evaluations"][0]["accuracy"] == pytest.approx(1 / 3) and out["evaluations"][0]["accuracy_alert"] is True and out["evaluations"][0]["roc_auc"] == pytest.approx(0.5)
    again = m.ingest_feedback([{"event_id": "e0", "y_true": 0}])
    assert (again["accepted"], again["duplicates"]) == (0, 1)
    with pytest.raises(IdempotencyConflict):
        m.ingest_feedback([{"event_id": "e0", "y_true": 1}])

    run = m.store.get("runs", envelope["run_id"])
    assert m.complete_again(run["run_id"], json.loads(run["result"]))["run_id"] == run["run_id"]
    with pytest.raises(IdempotencyConflict):
        m.complete_again(run["run_id"], {"other": 1})
    assert m.runs_overview().count() == 2 and m.store.runs_page(1, 1, "completed").count() == 1
    status = m.status()
    assert status["ready"] and status["events"] == {"processed": 6, "buffered": 1} and status["runs"] == {"completed": 2}

    other = m.register_reference(reference(spark).limit(25), "smaller")
    with pytest.raises(PendingEvents):
        m.activate_reference(other["reference_id"])
    m.activate_reference(other["reference_id"], discard=True)
    assert m.active_reference()["reference_id"] == other["reference_id"] and m.store.count_events("discarded") == 1
    assert m.store.read("audit").count() == 2


def same(a, b):
    """Equal but for rounding."""
    if isinstance(a, dict):
        return isinstance(b, dict) and a.keys() == b.keys() and all(same(a[k], b[k]) for k in a)
    if isinstance(a, list):
        return isinstance(b, list) and len(a) == len(b) and all(map(same, a, b))
    return a == pytest.approx(b, rel=1e-9, abs=1e-12) if isinstance(a, float) and isinstance(b, float) else a == b


def test_windows_together_are_windows_alone(spark, tmp_path):
    c = config(FEATURES | {"pay": {"kind": "numeric", "nullable": False, "min": 0}})
    ref = spark.createDataFrame([(20.0 + k % 17, "abc"[k % 3], float(k % 2)) for k in range(60)] + [(None, None, 1.0)], "age double, region string, pay double")
    rows = [("w1", 25.0 + k % 9, "ab"[k % 2], 1.0, None) for k in range(24)] + [("w2", 60.0, "new", float("inf"), str(k % 2)) for k in range(5)]
    rows += [("w3", None, None, -1.0, None)] * 4 + [("w4", -0.0, "c", None, None), ("w4", float("-inf"), "", 0.0, None)]
    current = spark.createDataFrame(rows, "w string, age double, region string, pay double, more string")
    columns = {"w1": ["age", "region", "pay"], "w2": ["age", "region", "pay", "more"], "w3": ["age", "pay"], "w4": ["age", "region"], "none": ["age"]}
    keep(ref, c).write(str(tmp_path / "kept"))
    found = analyze_windows(ref, Kept.read(spark, str(tmp_path / "kept")), current, "w", columns, c)
    assert sorted(found) == ["w1", "w2", "w3", "w4"]  # no rows, no result
    for w, result in found.items():
        alone = analyze(ref, current.where(f"w = '{w}'").select(*columns[w]), c)
        assert same(alone, result), w
    assert found["w2"]["alerts"] and found["w3"]["schema"]["missing_columns"]["current"] == ["region"]


def test_jobs_do_not_grow_with_windows(spark, tmp_path, ticking):
    m = Monitor(spark, settings(tmp_path), clock=ticking)
    m.register_reference(reference(spark), "base")
    jobs = lambda: max(spark.sparkContext.statusTracker().getJobIdsForGroup(), default=-1)
    taken, k = [], 0
    for windows in (1, 1, 7):  # the first one computes what is kept of the reference
        began = jobs()
        out = m.ingest_events([event(k + j, 200.0) for j in range(3 * windows)])
        taken.append(jobs() - began)
        assert len(out["run_ids"]) == windows
        k += 3 * windows
    assert len((tmp_path / "out" / "alerts.jsonl").read_text().splitlines()) == 9
    assert taken[2] <= taken[1] + 5, taken


def test_one_windows_fault_is_its_own(spark, tmp_path, ticking):
    m = Monitor(spark, settings(tmp_path), clock=ticking)
    m.register_reference(reference(spark), "base")
    odd = [event(k, features={"age": 30.0, "AGE": 1, "region": "a"}) for k in range(3, 6)]  # two names that Spark takes for one
    out = m.ingest_events([event(k) for k in range(3)] + odd)
    assert [m.run_envelope(r)["status"] for r in out["run_ids"]] == ["completed", "failed"]
    assert m.store.counts("events", "state") == {"processed": 3, "failed": 3}


def test_batches_and_alerts(spark, tmp_path, ticking):
    m = Monitor(spark, settings(tmp_path), clock=ticking)
    m.register_reference(reference(spark), "base")
    with pytest.raises(ValueError):
        m.process_batch("b", [{"age": 1.0, "region": "a"}])
    records = [{"age": 90.0, "region": "a"}, {"age": 95, "region": None}, {"age": 99.0, "region": "b"}]
    run = m.process_batch("b1", records)
    assert run["status"] == "completed" and json.loads(run["result"])["summary"]["has_alerts"]
    assert m.process_batch("b1", records)["run_id"] == run["run_id"]
    with pytest.raises(IdempotencyConflict):
        m.process_batch("b1", records[:2])
    lines = (tmp_path / "out" / "alerts.jsonl").read_text().splitlines()
    assert len(lines) == 1 and json.loads(lines[0])["delivery_id"] == delivery.delivery_id(run["run_id"], "jsonl")
    failing = m.process_batch("b2", [{"age": 90.0, "region": "a", "more": [1]}, {"age": 91.0, "region": "a", "more": [2]}])
    assert failing["status"] == "completed"  # what is wrong with the data is in the result
    assert json.loads(failing["result"])["schema"]["extra_columns"]["current"] == ["more"]


def test_claimed_windows_are_finished_after_a_crash(spark, tmp_path, ticking):
    m = Monitor(spark, settings(tmp_path), clock=ticking)
    m.register_reference(reference(spark), "base")
    m.ingest_events([event(0), event(1)])
    m._process_block = lambda w: (_ for _ in ()).throw(RuntimeError("crash"))
    with pytest.raises(RuntimeError):
        m.ingest_events([event(2)])
    assert m.store.count_events("claimed") == 3
    again = Monitor(spark, settings(tmp_path), clock=ticking)
    runs = again.process_ready_windows()
    assert len(runs) == 1 and runs[0]["status"] == "completed" and again.store.count_events("processed") == 3
    assert again.process_ready_windows() == []
    changed = settings(tmp_path)
    changed["analysis"]["random_seed"] = 1
    with pytest.raises(ReferenceConfigMismatch):
        Monitor(spark, changed, clock=ticking).active_reference()


def test_stream_gives_what_ingestion_gives(spark, tmp_path, ticking):
    m = Monitor(spark, settings(tmp_path), clock=ticking)
    m.register_reference(reference(spark), "base")
    source = str(tmp_path / "in")
    rows = [(f"s{k}", "2024-05-01T10:00:00Z", json.dumps({"region": "a", "age": 30.0 + k}), "1", 0.5) for k in range(7)]
    spark.createDataFrame(rows[:4], INCOMING).coalesce(1).write.parquet(source)
    read = lambda: spark.readStream.schema(INCOMING).parquet(source)
    m.stream(read(), str(tmp_path / "checkpoint")).awaitTermination()
    assert m.store.count_events("processed") == 3 and m.store.count_events("buffered") == 1
    spark.createDataFrame(rows[2:], INCOMING).coalesce(1).write.mode("append").parquet(source)
    m.stream(read(), str(tmp_path / "checkpoint")).awaitTermination()
    assert m.store.count_events("processed") == 6 and m.store.count_events("buffered") == 1
    assert m.store.read("epochs").count() == 2
    m.stream(read(), str(tmp_path / "checkpoint")).awaitTermination()
    assert m.store.read("epochs").count() == 2


@pytest.mark.parametrize("bad", [[], [1], [{"event_id": "x"}], [event(0, extra=1)], [event(0) | {"occurred_at": "2024-01-01T00:00:00"}], [event(0) | {"features": {}}], [event(0) | {"event_id": " "}]])
def test_bad_events_write_nothing(spark, tmp_path, ticking, bad):
    m = Monitor(spark, settings(tmp_path), clock=ticking)
    m.store.put("references", {"reference_id": "r", "active": True, "config_sha256": m.config_sha256})
    with pytest.raises(ValueError):
        m.ingest_events(bad)
    assert m.store.read("events").count() == 0


def test_webhook_retries_and_hides_the_address(spark, tmp_path, ticking):
    store, waits, seen = Store(spark, str(tmp_path / "s")), [], []

    def sender(url, body, headers, timeout):
        seen.append((url, headers["Idempotency-Key"], timeout))
        if len(seen) < 3:
            raise OSError(f"cannot reach {url}")
        return 204

    run = {"run_id": "r", "source": "batch", "source_id": "b", "reference_id": "f", "completed_at": "t", "status": "completed", "result": json.dumps({"summary": {}, "alerts": [{"check": "x"}]})}
    alerts = {"jsonl_path": None, "webhook_url_env": "HOOK", "timeout_seconds": 5.0, "max_attempts": 2}
    d = delivery.AlertDelivery(store, alerts, ticking, sender, {"HOOK": "https://example.org/secret"}, waits.append)
    out = d.dispatch(run)[0]
    assert (out["status"], out["attempts"], out["error"], waits) == ("failed", 2, "OSError", [1])
    out = d.dispatch(run)[0]
    assert (out["status"], out["attempts"]) == ("succeeded", 3) and len({s[1] for s in seen}) == 1
    assert d.dispatch(run)[0]["status"] == "succeeded" and len(seen) == 3
    assert d.dispatch(run | {"result": json.dumps({"summary": {}, "alerts": []})}) == []
    with pytest.raises(IdempotencyConflict):
        d.dispatch(run | {"result": json.dumps({"summary": {}, "alerts": [{"check": "y"}]})})
    with pytest.raises(ValueError):
        delivery.check_url("ftp://example.org")


def test_store_versions_and_states(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    s.put("runs", {"run_id": "a", "status": "running"})
    done = s.change("runs", s.get("runs", "a"), ("running",), "status", "completed")
    assert done["status"] == "completed" and s.latest("runs").count() == 1 and s.read("runs").count() == 2
    with pytest.raises(InvalidStateTransition):
        s.change("runs", s.get("runs", "a"), ("running",), "status", "failed")
    with pytest.raises(RecordNotFound):
        s.get("runs", "b")
    s.put("schema_info", {"key": "schema", "number": 99})
    with pytest.raises(UnsupportedSchemaVersion):
        Store(spark, str(tmp_path / "s"))


@pytest.mark.parametrize("size,groups", [(4, None), (4, "g"), (100, None)])
def test_windows_are_full_and_in_order(spark, size, groups):
    rows = [(k, "xy"[k % 2]) for k in range(23)]
    got = tumbling_windows(spark.createDataFrame(rows, "n long, g string").repartition(3), size, ["n"], groups).collect()
    want = []
    for part in [rows] if groups is None else [[r for r in rows if r[1] == g] for g in "xy"]:
        want += [(n, g, k // size) for k, (n, g) in enumerate(part[: len(part) // size * size])]
    assert sorted((r.n, r.g, r.window_no) for r in got) == sorted(want)


def test_performance_rules(spark):
    c = {"enabled": True, "min_feedback_rows": 4, "baseline_accuracy": 0.9, "max_accuracy_drop": 0.1, "baseline_roc_auc": 0.9, "max_roc_auc_drop": 0.1}
    rows = [("good", str(y), str(y), 0.9 if y else 0.1) for y in (0, 1, 0, 1)] + [("bad", str(1 - y), str(y), 0.1 if y else 0.9) for y in (0, 1, 0, 1)]
    rows += [("few", "1", "1", 0.5)] + [("one", "1", "1.0", 0.5)] * 4 + [("text", None, '"a"', None)] * 5
    samples = spark.createDataFrame(rows, "window_id string, prediction_json string, y_json string, score double")
    got = {r.window_id: r for r in performance(samples, c).collect()}
    assert (got["good"].accuracy, got["good"].roc_auc, got["good"].accuracy_alert, got["good"].status) == (1.0, 1.0, False, "evaluated")
    assert (got["bad"].accuracy, got["bad"].roc_auc, got["bad"].accuracy_alert, got["bad"].roc_auc_alert) == (0.0, 0.0, True, True)
    assert (got["few"].status, got["few"].reason, got["few"].accuracy) == ("not_evaluated", "insufficient_feedback", None)
    assert (got["one"].accuracy, got["one"].roc_auc) == (0.0, None)  # 1 and 1.0 are two labels
    assert got["text"].reason == "metrics_unavailable"
    off = {r.window_id: r.reason for r in performance(samples, c | {"enabled": False}).collect()}
    assert set(off.values()) == {"performance_disabled"}


def test_monitoring_settings(tmp_path):
    good = settings(tmp_path)
    flat = good["analysis"] | {"online": good["online"]}
    assert validate_monitoring_config(flat) == validate_monitoring_config(good)
    for section, key, value in [("window", "size", 1), ("window", "strategy", "sliding"), ("window", "min_batch_rows", 4), ("alerts", "webhook_url_env", "a-b"), ("alerts", "max_attempts", 0), ("alerts", "timeout_seconds", 0), ("performance", "min_feedback_rows", 1), ("performance", "max_accuracy_drop", None)]:
        bad = json.loads(json.dumps(good))
        bad["online"][section][key] = value
        with pytest.raises(ValueError):
            validate_monitoring_config(bad)
    path = tmp_path / "m.yaml"
    path.write_text(yaml.safe_dump(good))
    assert load_monitoring_config(path) == good
