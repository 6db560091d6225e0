"""Alerts in numbers: each once, in one append and by tasks, also after a failed commit."""

from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from tests.test_monitoring import ticking  # noqa: F401  a fixture
from tidemark.streaming.delivery import AlertDelivery
from tidemark.streaming.store import Store


def run_of(k):
    return {"run_id": f"r{k}", "source": "batch", "source_id": f"b{k}", "reference_id": "f", "completed_at": "t", "status": "completed", "result": json.dumps({"summary": {}, "alerts": [{"check": "x", "n": k}]})}


def test_ten_thousand_alerts_each_once(spark, tmp_path, ticking, monkeypatch):  # noqa: F811
    """The state's commit after the append fails; the next dispatch finds the lines and adds none."""
    store = Store(spark, str(tmp_path / "s"))
    path = tmp_path / "out" / "alerts.jsonl"
    d = AlertDelivery(store, {"jsonl_path": str(path), "webhook_url_env": None, "timeout_seconds": 1.0, "max_attempts": 1}, ticking)
    runs = [run_of(k) for k in range(10_000)]
    put, calls = store.put, []
    monkeypatch.setattr(store, "put", lambda table, *rows: put(table, *rows) if not calls.append(table) and len(calls) == 1 else (_ for _ in ()).throw(RuntimeError("crash")))
    with pytest.raises(RuntimeError):
        d.dispatch(*runs)
    monkeypatch.setattr(store, "put", put)
    with open(path, "a") as f:
        f.write('{"delivery_id": "cut sho')
    found = d.dispatch(*runs, run_of(10_000))
    assert {r["status"] for r in found} == {"succeeded"} and len(found) == 10_001
    whole = [json.loads(x) for x in path.read_text().splitlines() if x.endswith("}")]
    assert len(whole) == len({x["delivery_id"] for x in whole}) == 10_001
    assert [x["alerts"][0]["n"] for x in whole] == list(range(10_001))
    assert {r["status"] for r in d.dispatch(*runs)} == {"succeeded"} and len(path.read_text().splitlines()) == 10_002


def test_posts_by_tasks(spark, tmp_path, ticking):  # noqa: F811
    seen, lock = [], threading.Lock()

    class Receiver(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            with lock:
                seen.append((self.headers["Idempotency-Key"], body["alerts"][0]["n"]))
                again = sum(x == seen[-1] for x in seen)
            self.send_response(500 if body["alerts"][0]["n"] == 7 or (body["alerts"][0]["n"] == 3 and again == 1) else 204)
            self.end_headers()

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Receiver)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        store = Store(spark, str(tmp_path / "s"))
        d = AlertDelivery(store, {"jsonl_path": None, "webhook_url_env": "HOOK", "timeout_seconds": 5.0, "max_attempts": 2}, ticking, environment={"HOOK": f"http://127.0.0.1:{server.server_port}/x"})
        found = d.dispatch(*[run_of(k) for k in range(40)])
        assert [r["status"] for r in found].count("failed") == 1 and found[7]["error"] == "HTTPError"
        assert (found[7]["attempts"], found[3]["attempts"], found[0]["attempts"]) == (2, 2, 1)
        assert len({key for key, _ in seen}) == 40 and len(seen) == 42
        assert [r["attempts"] for r in d.dispatch(*[run_of(k) for k in range(40)])][7] == 4 and len(seen) == 44
    finally:
        server.shutdown()
