"""Alert delivery: a JSON-lines file and a webhook. A failed delivery never fails the run.

What is to be sent is recorded before it is tried, and each alert's outcome after. Alerts of a block go out together: lines
for the file in one append, posts to the webhook by tasks, each with its delivery's id as idempotency key, so that a
task that is run again sends nothing that the receiver takes for new. The file is looked through for ids that are there
already only where a delivery was tried before, once for all of them.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from typing import Any

import pyarrow as pa

from ..functions.canonical import canonical_json
from ..functions.shipping import ship
from .store import IdempotencyConflict, StorageError, Store

#: Posts that are under way at once, at most.
SENDERS = 16
Sender = Callable[[str, bytes, Mapping[str, str], float], int]


def delivery_id(run_id: str, channel: str) -> str:
    return hashlib.sha256(f"{run_id}:{channel}".encode()).hexdigest()[:32]


def check_url(url: str) -> str:
    parts = urllib.parse.urlsplit(url)
    if parts.scheme not in ("http", "https") or not parts.netloc:
        raise ValueError("the webhook must be an http or https address")
    return url


def post(url: str, body: bytes, headers: Mapping[str, str], timeout: float) -> int:
    request = urllib.request.Request(check_url(url), data=body, headers=dict(headers), method="POST")
    with urllib.request.urlopen(request, timeout=timeout) as answer:  # noqa: S310  the scheme is checked
        return answer.status


def payload_of(run: Mapping[str, Any]) -> dict[str, Any] | None:
    """What is delivered of a run; None without alerts."""
    result = json.loads(run["result"]) if run["result"] else {}
    if not result.get("alerts"):
        return None
    keys = ("run_id", "source", "source_id", "reference_id", "completed_at")
    return {k: run[k] for k in keys} | {"summary": result["summary"], "alerts": result["alerts"]}


class AlertDelivery:
    """Deliveries are recorded with their payload before they are tried; each goes out once."""

    def __init__(self, store: Store, config: Mapping[str, Any], clock: Callable[[], str], sender: Sender = post, environment: Mapping[str, str] | None = None, sleep: Callable[[float], None] = time.sleep):
        self.store, self.config, self.clock, self.sender, self.sleep = store, config, clock, sender, sleep
        self.environment = os.environ if environment is None else environment

    def dispatch(self, *runs: Mapping[str, Any]) -> list[dict[str, Any]]:
        """Deliveries of completed runs with alerts. All are recorded in one write before the first is sent, and in one after."""
        send = {"jsonl": self._to_file, "webhook": self._to_webhook}
        channels = [c for c, key in (("jsonl", "jsonl_path"), ("webhook", "webhook_url_env")) if self.config[key]]
        texts = [(run["run_id"], canonical_json(payload)) for run in runs if run["status"] == "completed" and (payload := payload_of(run))]
        asked = {delivery_id(run_id, c): (run_id, c, text) for run_id, text in texts for c in channels}
        known = self.store.find_all("deliveries", list(asked))
        for own, record in known.items():
            if record["payload"] != asked[own][2]:
                raise IdempotencyConflict(f"delivery {own} was made with another payload")
        now = self.clock()
        fresh = {own: {"delivery_id": own, "run_id": run_id, "channel": c, "payload": text, "status": "pending", "attempts": 0, "error": None, "created_at": now, "updated_at": now} for own, (run_id, c, text) in asked.items() if own not in known}
        self.store.put("deliveries", *fresh.values())
        records = {own: (known | fresh)[own] for own in asked}
        waiting = [r for r in records.values() if r["status"] != "succeeded"]
        tried = {}
        for channel, deliver in send.items():
            own = [r for r in waiting if r["channel"] == channel]
            if own:
                tried |= {r["delivery_id"]: self._tried(r, *outcome) for r, outcome in zip(own, deliver(own, known), strict=True)}
        self.store.put("deliveries", *tried.values())
        return [tried.get(own, r) for own, r in records.items()]

    def _tried(self, record: dict[str, Any], attempts: int, error: str | None) -> dict[str, Any]:
        return record | {"status": "failed" if error else "succeeded", "attempts": record["attempts"] + attempts, "error": error, "updated_at": self.clock()}

    def _to_file(self, records: list[dict[str, Any]], known: Mapping[str, Any]) -> list[tuple[int, str | None]]:
        """Attempts and error of each record."""
        path = self.config["jsonl_path"]
        try:
            os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
            again = {r["delivery_id"] for r in records} & known.keys()
            there, whole = _ids_in(path, again) if os.path.exists(path) else (set(), True)
            lines = [canonical_json({"delivery_id": r["delivery_id"], **json.loads(r["payload"])}) + "\n" for r in records if r["delivery_id"] not in there]
            if lines:
                with open(path, "a", encoding="utf-8") as f:
                    f.write(("" if whole else "\n") + "".join(lines))
                    f.flush()
                    os.fsync(f.fileno())
            return [(1, None)] * len(records)
        except Exception as e:  # noqa: BLE001  whatever it is, the run stands
            return [(1, safe_error(e))] * len(records)

    def _to_webhook(self, records: list[dict[str, Any]], known: Mapping[str, Any]) -> list[tuple[int, str | None]]:
        """Attempts and error of each record. Posts are sent by tasks; a sender that was given instead stays with the driver."""
        url = self.environment.get(self.config["webhook_url_env"])
        most, timeout = self.config["max_attempts"], self.config["timeout_seconds"]
        try:
            if not url:
                raise StorageError("the webhook's environment variable is not set")
            check_url(url)
        except (ValueError, StorageError) as e:
            return [(1, safe_error(e))] * len(records)
        if self.sender is not post:
            with ThreadPoolExecutor(min(len(records), SENDERS)) as pool:
                return list(pool.map(lambda r: sent(r["delivery_id"], r["payload"], url, self.sender, most, timeout, self.sleep), records))
        spark = self.store.spark
        ship(spark)
        rows = spark.createDataFrame([(k, r["delivery_id"], r["payload"]) for k, r in enumerate(records)], "place long, id string, payload string")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = [sent(i, text, url, post, most, timeout, time.sleep) for i, text in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([a for a, _ in found], pa.int64()), pa.array([e for _, e in found], pa.string())], ["place", "attempts", "error"])

        found = rows.repartition(min(len(records), SENDERS)).mapInArrow(run, "place long, attempts long, error string").collect()  # a row per alert of a block
        return [(r["attempts"], r["error"]) for r in sorted(found, key=lambda r: r["place"])]


def _ids_in(path: str, wanted: set[str]) -> tuple[set[str], bool]:
    """Those of the ids that lines of a file have, and whether the file ends with a whole line. A line that a crash cut short counts as none."""
    there: set[str] = set()
    with open(path, "rb") as f:
        if wanted:
            for line in f:
                try:
                    there.add(json.loads(line).get("delivery_id") if line.strip() else None)
                except ValueError:
                    continue
        size = f.seek(0, os.SEEK_END)
        if not size:
            return set(), True
        f.seek(size - 1)
        return there & wanted, f.read(1) == b"\n"


def sent(own: str, text: str, url: str, sender: Sender, most: int, timeout: float, sleep: Callable[[float], None]) -> tuple[int, str | None]:
    """Attempts, and the last one's error if all failed."""
    headers = {"Content-Type": "application/json", "Idempotency-Key": own}
    error = None
    for attempt in range(1, most + 1):
        try:
            status = sender(url, text.encode(), headers, timeout)
            if 200 <= status < 300:
                return attempt, None
            error = safe_error(StorageError(f"the webhook answered {status}"))
        except Exception as e:  # noqa: BLE001
            error = safe_error(e)
        if attempt < most:
            sleep(min(2 ** (attempt - 1), 5))
    return most, error


def safe_error(e: Exception) -> str:
    """The kind of error, and its text only where we wrote it: others may hold the address."""
    return str(e) if isinstance(e, StorageError | ValueError) and "://" not in str(e) else type(e).__name__
