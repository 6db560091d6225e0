"""State as runs under manifests: merges, fencing, what lookups read; typed features, and rows that are no events."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tests.test_monitoring import event, reference, settings, ticking  # noqa: F401  a fixture
from tidemark.streaming import store as stores
from tidemark.streaming.events import classify, envelopes, parsed_json, shape_of, utc_time, validated
from tidemark.streaming.monitor import INCOMING, Monitor
from tidemark.streaming.store import IdempotencyConflict, StaleWriter, Store

TIME = "2024-05-01T10:00:00Z"


def files_read(frame):
    """Files and rows that the scans of an executed frame read."""
    frame.collect()
    out = [0, 0]

    def walk(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(node.plan())
        if name == "FileSourceScanExec":
            out[0] += node.metrics().apply("numFiles").value()
            out[1] += node.metrics().apply("numOutputRows").value()
        for k in range(node.children().size()):
            walk(node.children().apply(k))

    walk(frame._jdf.queryExecution().executedPlan())
    return tuple(out)


def test_runs_are_merged_and_replaced_ones_deleted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stores, "FANOUT", 3)
    monkeypatch.setattr(stores, "GRACE", 4)
    monkeypatch.setattr(stores, "MANIFESTS", 4)
    s = Store(spark, str(tmp_path / "s"))
    for k in range(20):
        s.put("runs", {"run_id": f"r{k % 7}", "status": str(k)})
    assert {r.run_id: r.status for r in s.latest("runs").collect()} == {f"r{k % 7}": str(k) for k in range(13, 20)}
    runs = s._runs("runs")
    assert len(runs) <= 2 * 3 and max(r["level"] for r in runs) == 2
    assert files_read(s.latest("runs"))[0] <= 12
    assert len(list((tmp_path / "s" / "data" / "runs").iterdir())) <= len(runs) + 9 and len(list((tmp_path / "s" / "log").glob("0*.json"))) <= 5
    assert {r.run_id: r.status for r in Store(spark, str(tmp_path / "s")).latest("runs").collect()} == {f"r{k % 7}": str(k) for k in range(13, 20)}


def test_of_two_writers_one_wins(spark, tmp_path):
    first = Store(spark, str(tmp_path / "s"))
    second = Store(spark, str(tmp_path / "s"))
    first.put("runs", {"run_id": "a", "status": "by first"})
    with pytest.raises(StaleWriter):
        second.put("runs", {"run_id": "a", "status": "by second"})
    assert second.latest("runs").count() == 0
    second.refresh()
    assert second.get("runs", "a")["status"] == "by first"
    second.put("runs", {"run_id": "a", "status": "by second"})
    with pytest.raises(StaleWriter):
        first.put("runs", {"run_id": "b", "status": "x"})
    assert Store(spark, str(tmp_path / "s")).get("runs", "a")["status"] == "by second"


def test_a_batch_opens_its_own_buckets_only(spark, tmp_path, monkeypatch):
    """What looking a batch up reads does not grow with the history; nor does what is open."""
    monkeypatch.setattr(stores, "FANOUT", 2)
    monkeypatch.setattr(stores, "BUCKET_ROWS", 250)
    s = Store(spark, str(tmp_path / "s"))
    batch = spark.createDataFrame([(f"e{k}",) for k in (3, 700, 10**9)], "event_id string")
    took = []
    for k in range(6):
        n = 1000 << k
        began = s.last_sequence()
        rows = spark.range(began, began + n).select(F.concat(F.lit("e"), "id").alias("event_id"), (F.col("id") + 1).alias("sequence"), F.lit("h").alias("payload_sha256"), F.lit("buffered").alias("state"), F.lit(f"w{k}").alias("window_id"))
        s.accept(rows, began + n)
        s.close(s.open_events().where("sequence % 10 > 0").drop("version").withColumn("state", F.lit("processed")))
        s.close(s.open_events().drop("version").withColumn("state", F.lit("failed")))
        found = s.of_batch("ledger", batch)
        took.append(files_read(found)[1])
        assert found.join(batch, "event_id").count() == min(2, 1 + (k > 0) + (k == 0))
        assert s.open_events().count() == 0
    assert s.count_events("processed") + s.count_events("failed") == s.last_sequence() == 63_000
    assert max(took) < 2_000, took  # the history grew from 1 000 to 63 000
    assert {r.event_id for r in s.events_of(["w1"]).select("event_id").collect()} == {f"e{k}" for k in range(1000, 3000)}


def test_payloads_keep_their_types(spark, tmp_path, ticking):  # noqa: F811
    m = Monitor(spark, settings(tmp_path), clock=ticking)
    m.register_reference(reference(spark), "base")
    m.ingest_events([event(1, features={"age": 1, "region": "true"})])
    assert m.ingest_events([event(1, features={"region": "true", "age": 1})])["duplicates"] == 1
    for other in ({"age": "1", "region": "true"}, {"age": 1, "region": True}, {"age": 1.0, "region": "true"}, {"age": 1, "region": "true", "more": None}):
        with pytest.raises(IdempotencyConflict):
            m.ingest_events([event(1, features=other)])


def test_a_text_in_a_numeric_feature_does_not_fit(spark, tmp_path, ticking):  # noqa: F811
    m = Monitor(spark, settings(tmp_path), clock=ticking)
    m.register_reference(reference(spark), "base")
    odd = [{"age": "34.0", "region": "a"}, {"age": 35.0, "region": "a"}, {"age": 36.0, "region": "b"}]
    nested = [{"age": 30.0, "region": ["a"]}, {"age": 30, "region": "a"}, {"age": None, "region": "a"}]
    mixed = [{"age": 30.5, "region": True}, {"age": 30, "region": "a"}, {"age": None, "region": None}]
    out = m.ingest_events([event(k, features=f) for k, f in enumerate(odd + nested + mixed)])
    found = [m.run_envelope(r) for r in out["run_ids"]]
    assert [e["status"] for e in found] == ["completed"] * 3
    wrong = [{x["column"] for x in e["result"]["schema"]["type_mismatches"]} for e in found]
    assert wrong == [{"age"}, {"region"}, set()]
    assert found[2]["result"]["quality"]["feature_checks"]["age"][0]["details"]


def test_rows_that_are_no_events_are_kept_apart(spark, tmp_path, ticking):  # noqa: F811
    m = Monitor(spark, settings(tmp_path), clock=ticking)
    m.register_reference(reference(spark), "base")
    good = json.dumps({"age": 30.0, "region": "a"})
    rows = [("a", TIME, good, "1", 0.5), ("b", TIME, "not json", "1", 0.5), ("c", TIME, "[1]", None, None), ("d", TIME, "{}", None, None), (None, TIME, good, "1", 0.5), (" ", TIME, good, None, None)]
    rows += [("e", "2024-05-01T10:00:00", good, None, None), ("f", None, good, None, None), ("g", TIME, None, None, None), ("h", TIME, good, "{", None), ("i", TIME, good, None, float("nan")), (" j ", "2024-05-01T12:00:00+02:00", good, None, None), ("k", TIME, good + good, None, None)]
    out = m.ingest_frame(spark.createDataFrame(rows, INCOMING), "epoch 1")
    assert (out["accepted"], out["rejected"], out["buffered_rows"]) == (2, 11, 2)
    kept = m.store.latest("rejected").collect()
    assert len(kept) == 11 and all(r.reason and r.epoch == "epoch 1" for r in kept)
    assert {r.event_id for r in kept if r.reason.startswith("features")} == {"b", "c", "d", "g", "k"}
    assert sorted(r.event_id for r in m.store.open_events().collect()) == ["a", "j"]
    assert m.ingest_frame(spark.createDataFrame(rows[-2:-1], INCOMING))["duplicates"] == 1


def test_lines_of_json_by_a_stream(spark, tmp_path, ticking):  # noqa: F811
    m = Monitor(spark, settings(tmp_path), clock=ticking)
    m.register_reference(reference(spark), "base")
    lines = [{"event_id": f"s{k}", "occurred_at": TIME, "features": {"age": 30.0 + k, "region": "a"}, "prediction": 1} for k in range(4)]
    texts = [json.dumps(x) for x in lines] + ["nonsense", json.dumps(lines[0] | {"extra": 1}), json.dumps({"event_id": "x"}), json.dumps(lines[1] | {"event_id": 7}), json.dumps(lines[0])]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text("\n".join(texts))
    m.stream(spark.readStream.text(str(tmp_path / "in")), str(tmp_path / "checkpoint")).awaitTermination()
    assert m.store.counts("events", "state") == {"processed": 3, "buffered": 1}
    assert sorted(r.reason for r in m.store.latest("rejected").collect()) == ["event_id must be text that is not blank", "missing keys: features, occurred_at", "not JSON", "unknown keys: extra"]


def test_envelopes_and_values(spark):
    texts = ["1", "1.0", '"1"', "true", "null", "1,2", '{"a":1} x', '{"a":1,"a":2}', "1.10", "1.1"]
    rows = {r.t: (r.v, r.s) for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.to_json(parsed_json(F.col("t"))).alias("v"), shape_of(parsed_json(F.col("t"))).alias("s")).collect()}
    assert rows["1"] != rows["1.0"] != rows['"1"'] and rows["1.10"] == rows["1.1"] and rows["true"][1] == "BOOLEAN"
    assert {t for t in texts if rows[t][0] is None} == {"1,2", '{"a":1} x', '{"a":1,"a":2}'}
    times = {"2024-05-01T12:00:00+02:00": TIME, "2024-05-01 10:00:00.25Z": "2024-05-01T10:00:00.250000Z", "2024-05-01T10:00:00": None, "2024-02-31T10:00:00Z": None, "x": None}
    assert {r.t: r.u for r in spark.createDataFrame([(t,) for t in times], "t string").select("t", utc_time(F.col("t")).alias("u")).collect()} == times
    assert validated(envelopes(spark.createDataFrame([(None,)], "value string"))).collect()[0].reason == "not JSON"


def test_a_null_id_is_classified(spark):
    rows = spark.createDataFrame([(None, "h", 1), (None, "h", 2), (None, "g", 3)], "event_id string, payload_sha256 string, position long")
    assert sorted(r.outcome for r in classify(rows, rows.limit(0)).collect()) == ["accepted", "conflict", "duplicate"]


def test_references_that_differ_in_where_nulls_stand(spark, tmp_path, ticking):  # noqa: F811
    m = Monitor(spark, settings(tmp_path), clock=ticking)
    a = spark.createDataFrame([(1.0, None), (2.0, "a")], "age double, region string")
    b = spark.createDataFrame([(None, "a"), (2.0, None), (1.0, None)], "age double, region string")
    one, two, again = m.register_reference(a, "a"), m.register_reference(b, "b"), m.register_reference(a.repartition(2), "again")
    assert one["reference_id"] != two["reference_id"] and again["name"] == "a" and again["reference_id"] == one["reference_id"]


def labelled(k, y):
    return {"event_id": f"s{k}", "y_true": y}


def lines(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in rows))


def test_labels_before_with_and_after_their_events(spark, tmp_path, ticking):  # noqa: F811
    """All three give the same evaluations; replays change nothing."""
    events = [{"event_id": f"s{k}", "occurred_at": TIME, "features": {"age": 30.0 + k, "region": "a"}, "prediction": k % 2, "score": 0.1 * k} for k in range(6)]
    given = [labelled(k, int(k % 3 == 0)) for k in range(6)] + [labelled(0, 1), labelled(1, 1), "nonsense", {"event_id": "s1"}, {"event_id": 3, "y_true": 1}]
    found = {}
    for when in ("before", "with", "after"):
        m = Monitor(spark, settings(tmp_path / when), clock=ticking)
        m.register_reference(reference(spark), "base")
        inbox, labels_in = tmp_path / when / "events", tmp_path / when / "labels"
        by = lambda m=m, inbox=inbox, when=when: m.stream(spark.readStream.text(str(inbox)), str(tmp_path / when / "c1")).awaitTermination()
        by_label = lambda m=m, labels_in=labels_in, when=when: m.stream_labels(spark.readStream.text(str(labels_in)), str(tmp_path / when / "c2")).awaitTermination()
        inbox.mkdir(parents=True)
        if when == "before":
            lines(labels_in, "a", given)
            by_label()
            assert m.store.read("parked").count() == 8 and m.store.read("feedback").count() == 0
            lines(inbox, "a", events)
            by()
        elif when == "with":
            lines(inbox, "a", events[:4])
            by()
            lines(labels_in, "a", given)
            by_label()
            assert m.store.read("parked").count() == 2
            lines(inbox, "b", events[4:])
            by()
        else:
            lines(inbox, "a", events)
            by()
            lines(labels_in, "a", given)
            by_label()
        assert m.store.read("parked").count() == 0
        runs = {r.source_id: r.run_id for r in m.store.latest("runs").collect()}
        performance = {r.run_id: json.loads(r.metrics) for r in m.store.latest("performance").collect()}
        found[when] = sorted(json.dumps(performance[r], sort_keys=True) for r in runs.values())
        assert {r.event_id: r.y_json for r in m.store.latest("feedback").collect()} == {f"s{k}": str(int(k % 3 == 0)) for k in range(6)}
        assert [r.event_id for r in m.store.read("label_conflicts").collect()] == ["s1"]
        assert sorted(r.reason for r in m.store.latest("rejected").collect()) == ["event_id must be text that is not blank", "keys must be event_id and y_true", "not JSON"]
        written = m.store.manifest["number"]
        by(), by_label()
        assert m.store.manifest["number"] == written
    assert found["before"] == found["with"] == found["after"] and len(found["after"]) == 2 and '"evaluated"' in found["after"][0]
