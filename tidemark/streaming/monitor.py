"""Online monitoring: events come in, counted windows are analysed, late labels are evaluated.

Tables in, tables out: events are deduplicated, numbered and cut into windows by Spark jobs; only the
results, one document per window, pass through the driver, BLOCK windows at a time. The windows of a block
share their jobs and the reference's aggregates, which are computed once. `stream` runs the same steps as
a Structured Streaming query; a batch that is replayed after a failure finds its epoch committed, or
its events stored, and changes nothing.
"""

from __future__ import annotations

import hashlib
import json
import math
import os
import threading
from collections.abc import Callable, Mapping
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..plans.analysis import analyze
from ..plans.windows import Kept, analyze_windows, keep
from ..functions.canonical import canonical, canonical_json, content_sums, kind_of, sha256_json, utc_timestamp
from ..functions.lineage import cut
from ..operators.numbering import number_rows
from ..schema import validate_schema
from ..sources.tables import load_table, records_frame, table_format
from .delivery import AlertDelivery, Sender, post
from . import records as tables
from .events import EVENT_OPTIONAL, EVENT_REQUIRED, classify, envelopes, labels, parsed_json, payload_hash, performance, settled, type_of, validated, validated_labels
from .settings import validate_monitoring_config
from .store import IdempotencyConflict, InvalidStateTransition, PendingEvents, RecordNotFound, StorageError, Store

EVENT_KEYS = (EVENT_REQUIRED, EVENT_OPTIONAL)
FEEDBACK_KEYS = ({"event_id", "y_true"}, set())
#: Windows that are analysed together.
BLOCK = 200
#: Conflicts that a result names; it counts all of them.
LISTED = 20
INCOMING = "event_id string, occurred_at string, features string, prediction_json string, score double"


class NoActiveReference(StorageError):
    pass


class ReferenceConfigMismatch(StorageError):
    pass


def _now() -> str:
    return datetime.now(UTC).isoformat().replace("+00:00", "Z")


def _envelope(item: object, required: set[str], optional: set[str], what: str) -> dict[str, Any]:
    if not isinstance(item, Mapping) or any(not isinstance(k, str) for k in item):
        raise ValueError(f"each {what} must be a mapping with text keys")
    missing, unknown = sorted(required - set(item)), sorted(set(item) - required - optional)
    if missing or unknown:
        raise ValueError(f"{what}: missing keys {missing}, unknown keys {unknown}")
    if not isinstance(item["event_id"], str) or not item["event_id"].strip():
        raise ValueError(f"{what}: event_id must be text that is not blank")
    return dict(item)


class Monitor:
    def __init__(self, spark: SparkSession, config: Mapping[str, Any], *, clock: Callable[[], str] = _now, sender: Sender = post, environment: Mapping[str, str] | None = None, sleep: Callable[[float], None] | None = None):
        config = validate_monitoring_config(config)
        self.spark, self.analysis, self.online, self.clock = spark, config["analysis"], config["online"], clock
        self.config_sha256 = sha256_json(self.analysis)
        self.store = Store(spark, self.online["state_path"])
        self._lock = threading.RLock()
        extra = {"sleep": sleep} if sleep else {}
        self.delivery = AlertDelivery(self.store, self.online["alerts"], clock, sender, environment, **extra)

    # ---- references

    def register_reference(self, table: DataFrame | str, name: str) -> dict[str, Any]:
        """Stores a reference (a DataFrame, or the path of a CSV or Parquet table); the same content and configuration give the same record."""
        source = "dataframe" if isinstance(table, DataFrame) else table_format(table).lstrip(".")
        frame = canonical(table) if isinstance(table, DataFrame) else load_table(self.spark, table)
        found = validate_schema(frame, frame, self.analysis["schema"])
        if found["status"] != "ok":
            raise ValueError(f"the reference does not fit the schema: {found['reason']}")
        n_rows, sums = content_sums(frame)
        content = sha256_json([n_rows, sums, [[f.name, f.dataType.simpleString()] for f in frame.schema]])
        reference_id = f"ref_{hashlib.sha256(f'{content}:{self.config_sha256}'.encode()).hexdigest()[:24]}"
        known = self.store.find("references", reference_id)
        if known:
            return known
        path = f"{self.store.root}/content/{reference_id}"
        frame.write.mode("overwrite").parquet(path)
        first = not self.store.latest("references").where("active").head(1)
        record = {"reference_id": reference_id, "name": name, "content_sha256": content, "config_sha256": self.config_sha256, "source_format": source, "row_count": n_rows, "columns": frame.columns, "dtypes": [f.dataType.simpleString() for f in frame.schema], "content_path": path, "created_at": self.clock(), "active": False}
        self.store.put("references", record)
        return self.activate_reference(reference_id) if first else record

    def upload_reference(self, name: str, data: bytes) -> dict[str, Any]:
        """A reference from the bytes of a file, by the name's extension."""
        # kept with the state, where executors can read it too
        path = f"{self.store.root}/uploads/{hashlib.sha256(data).hexdigest()[:24]}-{os.path.basename(name)}"
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        out = at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).create(at, True)
        try:
            out.write(data)
        finally:
            out.close()
        return self.register_reference(path, name)

    def activate_reference(self, reference_id: str, discard: bool = False) -> dict[str, Any]:
        """Makes one reference the active one. Claimed events forbid it; buffered ones do unless discarded."""
        record = self.store.get("references", reference_id)
        if record["active"]:
            return record
        if self.store.count_events("claimed"):
            raise PendingEvents("a window is being processed")
        buffered = self.store.open_events().where("state = 'buffered'")
        n = buffered.count()
        if n and not discard:
            raise PendingEvents(f"events are buffered: {n}")
        if n:
            self.store.close(buffered.drop("version").withColumn("state", F.lit("discarded")))
        olds = [r.asDict() for r in self.store.latest("references").where("active").collect()]  # one at most
        new = {k: v for k, v in record.items() if k != "version"} | {"active": True}
        self.store.put("references", *[{k: v for k, v in o.items() if k != "version"} | {"active": False} for o in olds], new)
        details = canonical_json({"reference_id": reference_id, "previous": [o["reference_id"] for o in olds], "discarded_events": n})
        self.store.put("audit", {"audit_id": sha256_json([reference_id, self.clock(), self.store.version()])[:32], "action": "activate_reference", "details": details, "created_at": self.clock()})
        return new

    def active_reference(self) -> dict[str, Any]:
        found = self.store.latest("references").where("active").collect()
        if not found:
            raise NoActiveReference("no reference is active")
        return self._compatible(found[0].asDict(recursive=True))

    def _compatible(self, reference: dict[str, Any]) -> dict[str, Any]:
        if reference["config_sha256"] != self.config_sha256:
            raise ReferenceConfigMismatch("the reference was registered under another configuration")
        return reference

    def _content(self, reference: Mapping[str, Any]) -> DataFrame:
        return self.spark.read.parquet(reference["content_path"])

    def _kept(self, reference: Mapping[str, Any]) -> Kept:
        """The reference's aggregates, computed at first use and kept beside its content."""
        path = f"{reference['content_path']}-kept"
        if not self.store.exists(f"{path}/facts/_SUCCESS"):
            keep(self._content(reference), self.analysis).write(path)
        return Kept.read(self.spark, path)

    # ---- events

    def ingest_events(self, events: list[Mapping[str, Any]]) -> dict[str, Any]:
        """Stores events and analyses all windows that are full. All envelopes are checked before anything is written."""
        if not isinstance(events, list) or not events:
            raise ValueError("events must be a list that is not empty")
        rows = []
        for e in (_envelope(e, *EVENT_KEYS, "event") for e in events):
            if not isinstance(e["features"], Mapping) or not e["features"]:
                raise ValueError("features must be a mapping that is not empty")
            prediction = None if e.get("prediction") is None else canonical_json(e["prediction"])
            score = e.get("score")
            if score is not None and not math.isfinite(float(score)):
                raise ValueError("score must be a finite number")
            rows.append((e["event_id"].strip(), utc_timestamp(e["occurred_at"]), canonical_json(dict(e["features"])), prediction, None if score is None else float(score)))
        out = self.ingest_frame(self.spark.createDataFrame(rows, INCOMING).coalesce(1))
        if out["conflicts"]:
            more = out["n_conflicts"] - len(out["conflicts"])
            raise IdempotencyConflict(f"events whose id is known with other contents: {', '.join(out['conflicts'])}{f' and {more} more' if more else ''}")
        return {k: out[k] for k in ("accepted", "duplicates", "buffered_rows", "run_ids")}

    def ingest_frame(self, frame: DataFrame, epoch: str | None = None) -> dict[str, Any]:
        """Events as a DataFrame with the columns of INCOMING, or with one column `value` of JSON lines, in any number.

        Rows that are no events are kept in the table `rejected` with their reason and epoch, and counted;
        the table `conflicts` keeps all conflicts, of which LISTED are named.
        """
        with self._lock:
            return self._ingest(frame, epoch)

    def _ingest(self, frame: DataFrame, epoch: str | None) -> dict[str, Any]:
        reference = self.active_reference()
        position = F.monotonically_increasing_id().alias("position")
        lines = envelopes(frame) if frame.columns == ["value"] else frame.select(*[c.split()[0] for c in INCOMING.split(", ")])
        rows = cut(validated(lines).withColumn("line", F.col("line") if "line" in lines.columns else F.to_json(F.struct(*lines.columns))).select("*", position))
        n_bad = self._reject(rows.where("reason is not null"), epoch or "")
        now = F.lit(self.clock())
        digest = payload_hash("event_id", "occurred_at", "features", "shape", "prediction_json", "score").alias("payload_sha256")
        good = rows.where("reason is null").select("event_id", "occurred_at", "features", "prediction_json", "score", digest, "position")
        sorted_out = cut(classify(good, self.store.known_events(good)))
        counts = {r["outcome"]: r["count"] for r in sorted_out.groupBy("outcome").count().collect()}
        if counts.get("conflict"):
            quarantined = sorted_out.where("outcome = 'conflict'").select("event_id", "payload_sha256", F.lit(epoch or "").alias("epoch"), now.alias("received_at"))
            self.store.append("conflicts", quarantined)
        if counts.get("accepted"):
            last = self.store.last_sequence()
            accepted = number_rows(sorted_out.where("outcome = 'accepted'"), "position", "event_id", name="sequence", start=last + 1)
            numbered = accepted.drop("outcome", "position").withColumns({"reference_id": F.lit(reference["reference_id"]), "received_at": now, "state": F.lit("buffered"), "window_id": F.lit(None).cast("string")})
            self.store.accept(numbered, last + counts["accepted"])
            self._unpark(sorted_out.where("outcome = 'accepted'"))
        conflicts = [r["event_id"] for r in sorted_out.where("outcome = 'conflict'").limit(LISTED).collect()]
        runs = self.process_ready_windows()
        return {"accepted": counts.get("accepted", 0), "duplicates": counts.get("duplicate", 0), "rejected": n_bad, "n_conflicts": counts.get("conflict", 0), "conflicts": conflicts, "buffered_rows": self.store.count_events("buffered"), "run_ids": [r["run_id"] for r in runs]}

    def stream(self, source: DataFrame, checkpoint: str, **trigger: Any) -> StreamingQuery:
        """A streaming query over events (columns of INCOMING, or JSON lines in a column `value`); one epoch at a time, each committed once."""
        return self._epochs(source, checkpoint, self.ingest_frame, trigger)

    def _epochs(self, source: DataFrame, checkpoint: str, ingest: Callable[[DataFrame, str], Any], trigger: Mapping[str, Any]) -> StreamingQuery:
        def epoch(frame: DataFrame, number: int) -> None:
            name = f"{hashlib.sha256(checkpoint.encode()).hexdigest()[:16]}:{number}"
            with self._lock:  # queries over events and labels run side by side
                if self.store.find("epochs", name) is None:
                    ingest(frame, name)
                    self.store.put("epochs", {"epoch": name, "committed_at": self.clock()})

        writer = source.writeStream.foreachBatch(epoch).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start()

    # ---- windows

    def process_ready_windows(self) -> list[dict[str, Any]]:
        """Finishes windows that were claimed before a crash, then claims and analyses all that are full."""
        runs = self._process_windows(self.store.claimed_windows())
        reference = self.active_reference()
        return runs + self._process_windows(self._claim(reference["reference_id"], self.online["window"]["size"]))

    def _claim(self, reference_id: str, size: int) -> list[str]:
        """Cuts the buffered events into full windows, in the order of their sequence; the rest stays."""
        buffered = self.store.open_events().where((F.col("state") == "buffered") & (F.col("reference_id") == reference_id)).drop("version")
        total = buffered.count()
        if total < size:
            return []
        numbered = number_rows(buffered, "sequence", name="n").where(F.col("n") <= total // size * size)
        first = F.min("sequence").over(Window.partitionBy(F.floor((F.col("n") - 1) / size)))  # `size` rows
        window = F.concat(F.lit("window_"), F.substring(F.sha2(F.concat_ws(":", F.lit(reference_id), first.cast("string")), 256), 1, 32))
        full = cut(numbered.withColumn("window_id", window).withColumn("state", F.lit("claimed")).drop("n"))
        self.store.append("open", full)
        order = full.groupBy("window_id").agg(F.min("sequence").alias("first")).orderBy("first").collect()
        return [r["window_id"] for r in order]

    @staticmethod
    def _columns(events: DataFrame, reference: DataFrame) -> dict[str, tuple[tuple[str, str], ...]]:
        """By window, the names of its events' features, the reference's first, each with the type that its values have.

        The type is number, text, boolean, or none where all values are null; nested where a value is an object or
        array, mixed where scalars differ. No more than names and types comes to the driver.
        """
        value = F.explode(parsed_json(F.col("features")).cast("map<string,variant>"))
        kind = F.when(type_of(F.col("value")).isin("object", "array"), "nested").otherwise(F.nullif(type_of(F.col("value")), F.lit("null")))
        keys = events.select("window_id", value).groupBy("window_id", "key").agg(F.collect_set(kind).alias("kinds"))  # four kinds at most
        one = F.when(F.size("kinds") == 0, "none").when(F.array_contains("kinds", "nested"), "nested").when(F.size("kinds") == 1, F.element_at("kinds", 1)).otherwise("mixed")
        found: dict[str, dict[str, str]] = {}
        for r in keys.select("window_id", "key", one.alias("kind")).collect():
            found.setdefault(r["window_id"], {})[r["key"]] = r["kind"]
        ordered = lambda names: [n for n in reference.columns if n in names] + sorted(names.keys() - set(reference.columns))
        return {w: tuple((n, kinds[n]) for n in ordered(kinds)) for w, kinds in found.items()}

    @staticmethod
    def _frame(events: DataFrame, columns: tuple[tuple[str, str], ...], window: str) -> DataFrame:
        """The events' features as columns of the types that their values have, beside their window.

        Nothing is cast to what the reference expects: a text among numbers makes a column of texts, which does
        not fit a numeric feature. Nested values become arrays, which fit none.
        """

        def value(n: str, kind: str) -> Column:
            raw = F.col("m")[n]
            scalar = F.when(type_of(raw) != "null", raw)
            text = scalar.cast("string")
            typed = {
                "number": F.try_variant_get(scalar, "$", "double"), "boolean": F.try_variant_get(scalar, "$", "boolean"), "nested": F.when(text.isNotNull(), F.array(text)),
                "mixed": F.when(type_of(scalar) == "text", text).otherwise(F.concat(type_of(scalar), F.lit(":"), text)),
            }
            return typed.get(kind, text).alias(n)

        parsed = events.select(F.col("window_id").alias("w"), parsed_json(F.col("features")).cast("map<string,variant>").alias("m"))
        return canonical(parsed.select(F.col("w").alias(window), *[value(n, k) for n, k in columns]))

    def _start(self, source: str, reference: Mapping[str, Any], rows: Mapping[str, int]) -> dict[str, dict[str, Any]]:
        """By source id, its run: known ones as they are, others new."""
        ids = {s: f"run_{hashlib.sha256(f'{source}:{s}'.encode()).hexdigest()[:32]}" for s in rows}
        known = self.store.find_all("runs", list(ids.values()))
        runs = {}
        for s, run_id in ids.items():
            runs[s] = known.get(run_id) or {"run_id": run_id, "source": source, "source_id": s, "reference_id": reference["reference_id"], "config_sha256": self.config_sha256, "row_count": rows[s], "status": "running", "result": None, "error": None, "created_at": self.clock(), "completed_at": None}
        self.store.put("runs", *[r for r in runs.values() if r["run_id"] not in known])
        return runs

    def _analysed(self, run: dict[str, Any], result: Callable[[], dict[str, Any]]) -> dict[str, Any]:
        """The run, completed or failed and not yet stored; one that is so already is left as it is."""
        if run["status"] != "running":
            return run
        try:
            text = canonical_json(result())
        except Exception as e:  # noqa: BLE001  a run that fails is a result too
            return self.store.moved("runs", run, ("running",), "status", "failed", error=f"{type(e).__name__}: {str(e)[:500]}", completed_at=self.clock())
        return self.store.moved("runs", run, ("running",), "status", "completed", result=text, completed_at=self.clock())

    def complete_again(self, run_id: str, result: Mapping[str, Any]) -> dict[str, Any]:
        """A replayed completion: the same result changes nothing, another one is a conflict."""
        run = self.store.get("runs", run_id)
        if run["status"] != "completed":
            raise InvalidStateTransition(f"run {run_id} is {run['status']}")
        if run["result"] != canonical_json(result):
            raise IdempotencyConflict(f"run {run_id} was completed with another result")
        return run

    def _process_windows(self, window_ids: list[str]) -> list[dict[str, Any]]:
        """The windows' runs, in order; what was finished before is not analysed again."""
        return [run for k in range(0, len(window_ids), BLOCK) for run in self._process_block(window_ids[k : k + BLOCK])]

    def _process_block(self, window_ids: list[str]) -> list[dict[str, Any]]:
        events = cut(self.store.events_of(window_ids))
        sizes = events.groupBy("window_id").agg(F.collect_set("reference_id").alias("owners"), F.count("*").alias("n")).collect()
        mixed = [r["window_id"] for r in sizes if len(r["owners"]) != 1]
        if mixed:
            raise StorageError(f"windows with events of several references: {', '.join(sorted(mixed))}")
        runs: dict[str, dict[str, Any]] = {}
        for owner in sorted({r["owners"][0] for r in sizes}):  # one, but for windows that were claimed before a crash
            reference = self._compatible(self.store.get("references", owner))
            started = self._start("window", reference, {r["window_id"]: r["n"] for r in sizes if r["owners"][0] == owner})
            running = [w for w, run in started.items() if run["status"] == "running"]
            result_of = self._results(events.where(F.col("window_id").isin(running)), reference) if running else dict
            done = {w: self._analysed(run, lambda w=w: result_of(w)) for w, run in started.items()}
            self.store.put("runs", *[done[w] for w in running])
            runs |= done
        good = [w for w, run in runs.items() if run["status"] == "completed"]
        state = F.when(F.col("window_id").isin(good), "processed").otherwise("failed")
        self.store.close(events.where("state = 'claimed'").withColumn("state", state))
        ordered = [runs[w] for w in window_ids]
        completed = [run for run in ordered if run["status"] == "completed"]
        self._evaluate([run["run_id"] for run in completed])
        self.delivery.dispatch(*completed)
        return ordered

    def _results(self, events: DataFrame, reference: Mapping[str, Any]) -> Callable[[str], dict[str, Any]]:
        """What gives a window's result: all are computed in one go, or, where that fails, each by itself, so that one window's fault is its own."""
        content = self._content(reference)
        columns = self._columns(events, content)
        window = "window_id"
        while window.lower() in {n.lower() for own in columns.values() for n, _ in own}:
            window += "_"
        found: dict[str, Any] = {}
        shapes: dict[tuple, list[str]] = {}
        for w, own in columns.items():
            shapes.setdefault(own, []).append(w)
        for own, windows in shapes.items():  # one, unless windows differ in features or their types
            try:
                current = self._frame(events.where(F.col("window_id").isin(windows)), own, window)
                found |= analyze_windows(content, self._kept(reference), current, window, dict.fromkeys(windows, [n for n, _ in own]), self.analysis)
            except Exception:  # noqa: BLE001  found again, and recorded, by the window it belongs to
                continue

        def result(w: str) -> dict[str, Any]:
            if w in found:
                return found[w]
            # also windows whose events have no features at all
            alone = self._frame(events.where(F.col("window_id") == w), columns.get(w, ()), window)
            return analyze(content, alone.drop(window), self.analysis)

        return result

    # ---- batches

    def process_batch(self, batch_id: str, records: list[Mapping[str, Any]]) -> dict[str, Any]:
        """Analyses a ready batch at once; the same batch again gives the same run."""
        least = self.online["window"]["min_batch_rows"]
        if not isinstance(records, list) or any(not isinstance(r, Mapping) or not r for r in records):
            raise ValueError("records must be a list of mappings that are not empty")
        if len(records) < least:
            raise ValueError(f"a batch needs at least {least} rows; there are {len(records)}")
        reference = self.active_reference()
        digest = sha256_json([reference["reference_id"], [dict(r) for r in records]])
        batch = self.store.find("batches", batch_id)
        if batch is None:
            batch = {"batch_id": batch_id, "payload_sha256": digest, "reference_id": reference["reference_id"], "records": canonical_json([dict(r) for r in records]), "row_count": len(records), "state": "accepted", "run_id": None, "created_at": self.clock()}
            self.store.put("batches", batch)
        elif batch["payload_sha256"] != digest:
            raise IdempotencyConflict(f"batch {batch_id} is known with other contents")
        run = self._start("batch", reference, {batch_id: len(records)})[batch_id]
        if batch["state"] == "accepted":
            batch = self.store.change("batches", batch, ("accepted",), "state", "processing", run_id=run["run_id"])

        def current(content: DataFrame) -> DataFrame:
            names = list(dict.fromkeys(k for r in records for k in r))
            types = {f.name: f.dataType for f in content.schema}
            fields = [T.StructField(n, T.DoubleType() if n in types and kind_of(types[n]) == "numeric" else types.get(n, T.StringType())) for n in names]
            return records_frame(self.spark, records, T.StructType(fields))

        def result() -> dict[str, Any]:
            content = self._content(reference)
            return analyze(content, current(content), self.analysis)

        done = self._analysed(run, result)
        if done is not run:
            self.store.put("runs", done)
        run = done
        if batch["state"] == "processing":
            self.store.change("batches", batch, ("processing",), "state", "completed" if run["status"] == "completed" else "failed")
        if run["status"] == "completed":
            self.delivery.dispatch(run)
        return run

    # ---- labels

    def ingest_feedback(self, feedback: list[Mapping[str, Any]]) -> dict[str, Any]:
        """Stores labels, however late, and evaluates the windows they belong to. An unknown event rejects all of them."""
        if not isinstance(feedback, list) or not feedback:
            raise ValueError("feedback must be a list that is not empty")
        rows = [(f["event_id"].strip(), canonical_json(f["y_true"])) for f in (_envelope(f, *FEEDBACK_KEYS, "feedback") for f in feedback)]
        return self.ingest_feedback_frame(self.spark.createDataFrame(rows, "event_id string, y_json string").coalesce(1))

    def ingest_feedback_frame(self, frame: DataFrame) -> dict[str, Any]:
        """Labels (event_id, y_json); an unknown event, or a label that differs from a known one, rejects all of them."""
        with self._lock:
            rows = cut(frame.select("event_id", "y_json", F.monotonically_increasing_id().alias("position")))
            found = cut(settled(rows, self.store.known_events(rows), self.store.of_batch("feedback", rows)))
            unknown = found.where("outcome = 'parked'").select("event_id").limit(1).collect()
            if unknown:
                raise RecordNotFound(f"events has no {unknown[0]['event_id']!r}")
            conflicts = found.where("outcome = 'conflict'").count()
            if conflicts:
                raise IdempotencyConflict(f"labels that differ from known ones: {conflicts}")
            return self._settle(found, "")

    def ingest_labels(self, frame: DataFrame, epoch: str = "") -> dict[str, Any]:
        """Labels as they come: columns (event_id, y_json), or one column `value` of JSON lines.

        Labels whose event has not come are parked, and settled when it does; labels that differ from a known one go to
        `label_conflicts`, rows that are no labels to `rejected`. Counts of all are in the result.
        """
        with self._lock:
            given = labels(frame) if frame.columns == ["value"] else validated_labels(frame.select("event_id", "y_json")).withColumn("line", F.to_json(F.struct("event_id", "y_json")))
            rows = cut(given.select("event_id", "y_json", "reason", "line", F.monotonically_increasing_id().alias("position")))
            n_bad = self._reject(rows.where("reason is not null"), epoch)
            good = rows.where("reason is null").select("event_id", "y_json", "position")
            found = cut(settled(good, self.store.known_events(good), self.store.of_batch("feedback", good)))
            parked = found.where("outcome = 'parked'")
            n_parked = parked.count()
            if n_parked:
                self.store.append("parked", parked.select("event_id", "y_json", "position", F.lit(epoch).alias("epoch"), F.lit(self.clock()).alias("received_at")))
            return self._settle(found, epoch) | {"parked": n_parked, "rejected": n_bad}

    def stream_labels(self, source: DataFrame, checkpoint: str, **trigger: Any) -> StreamingQuery:
        """A streaming query over labels, beside that over events and with epochs of its own; see `ingest_labels`."""
        return self._epochs(source, checkpoint, self.ingest_labels, trigger)

    def _settle(self, found: DataFrame, epoch: str) -> dict[str, Any]:
        """Stores labels that `settled` accepted, keeps conflicts apart, and evaluates the completed windows that labels are of."""
        counts = {r["outcome"]: r["count"] for r in found.groupBy("outcome").count().collect()}
        now = F.lit(self.clock()).alias("received_at")
        if counts.get("conflict"):
            self.store.append("label_conflicts", found.where("outcome = 'conflict'").select("event_id", "y_json", F.lit(epoch).alias("epoch"), now))
        if counts.get("accepted"):
            self.store.append("feedback", found.where("outcome = 'accepted'").select("event_id", "y_json", now))
        affected: list[str] = []
        if counts.get("accepted") or counts.get("duplicate"):
            mine = found.where("outcome <> 'parked'").select("event_id").distinct()
            windows = self.store.known_events(mine).join(mine, "event_id").where("window_id is not null").select("window_id").distinct()
            runs = self.store.latest("runs").where("status = 'completed' and source = 'window'")
            affected = [r["run_id"] for r in runs.join(windows, runs["source_id"] == windows["window_id"], "left_semi").select("run_id").orderBy("run_id").collect()]
        return {"accepted": counts.get("accepted", 0), "duplicates": counts.get("duplicate", 0), "conflicts": counts.get("conflict", 0), "evaluations": self._evaluate(affected)}

    def _unpark(self, events: DataFrame) -> None:
        """Settles the labels that waited for these events. A crash in between leaves them parked, and the next time they are duplicates."""
        waiting = self.store.read("parked")
        mine = cut(waiting.join(events.select("event_id").distinct(), "event_id", "left_semi").drop("version"))
        if mine.isEmpty():
            return
        self._settle(cut(classify(mine, self.store.of_batch("feedback", mine), digest="y_json", order=["received_at", "position"])), "")
        self.store.replace("parked", waiting.join(mine.select("event_id").distinct(), "event_id", "left_anti").drop("version"))

    def _reject(self, bad: DataFrame, epoch: str) -> int:
        """Keeps rows (event_id, line, reason, position) that are no events or labels, and counts them."""
        n = bad.count()
        if n:
            now = self.clock()
            name = F.sha2(F.concat_ws(":", F.lit(epoch or now), "position"), 256).alias("rejected_id")
            self.store.append("rejected", bad.select(name, "event_id", F.col("line").alias("payload"), "reason", F.lit(epoch).alias("epoch"), F.lit(now).alias("received_at")))
        return n

    def _evaluate(self, run_ids: list[str]) -> list[dict[str, Any]]:
        """Performance of completed window runs: one job for all of them, stored per run."""
        if not run_ids or not self.online["performance"]["enabled"]:
            return []
        runs = self.store.find_all("runs", run_ids)
        named = self.spark.createDataFrame([(k, r["source_id"]) for k, r in runs.items()], "run_id string, window_id string")
        events = self.store.events_of([r["source_id"] for r in runs.values()])
        samples = events.join(named, "window_id").join(self.store.latest("feedback").select("event_id", "y_json"), "event_id")
        found = {r["run_id"]: r.asDict() for r in performance(samples, self.online["performance"], "run_id").collect()}
        least, out = self.online["performance"]["min_feedback_rows"], []
        known, now = self.store.find_all("performance", run_ids), self.clock()
        records = []
        for run_id in run_ids:
            metrics = found.get(run_id) or {"status": "not_evaluated", "reason": "insufficient_feedback", "feedback_rows": 0, "accuracy": None, "roc_auc": None}
            metrics = {k: v for k, v in metrics.items() if k != "run_id"} | {"min_feedback_rows": least}
            records.append({"run_id": run_id, "status": metrics["status"], "metrics": canonical_json(metrics), "created_at": known[run_id]["created_at"] if run_id in known else now, "updated_at": now})
            out.append({"run_id": run_id} | metrics)
        self.store.put("performance", *records)
        return out

    # ---- views

    def run_envelope(self, run_id: str) -> dict[str, Any]:
        """One run with its result, deliveries and performance."""
        run = self.store.get("runs", run_id)
        deliveries = self.store.latest("deliveries").where(F.col("run_id") == run_id).orderBy("channel").drop("version", "payload")
        measured = self.store.find("performance", run_id)
        keys = ("run_id", "source", "source_id", "reference_id", "row_count", "status", "error", "created_at", "completed_at")
        return {"contract_version": "1.0"} | {k: run[k] for k in keys} | {"result": run["result"] and json.loads(run["result"]), "deliveries": [r.asDict() for r in deliveries.collect()], "performance": measured and json.loads(measured["metrics"])}

    def runs_overview(self) -> DataFrame:
        """A row per run with its alert count, deliveries by state, and performance."""
        return tables.overview(self.store.latest("runs").drop("version"), self.store.latest("deliveries"), self.store.latest("performance"))

    def status(self) -> dict[str, Any]:
        """What is there: the active reference, events by state, runs by status; ready or why not."""
        try:
            reference, problem = self.active_reference(), None
        except StorageError as e:
            reference, problem = None, str(e)
        events = self.store.counts("events", "state")
        return {"ready": problem is None, "problem": problem, "reference": reference and {k: v for k, v in reference.items() if k not in ("content_path", "version")}, "events": events, "runs": self.store.counts("runs", "status"), "buffered_rows": events.get("buffered", 0), "window_size": self.online["window"]["size"]}
