"""State of monitoring as versioned Parquet tables under a log of manifests.

A record changes by a later version of it. Every append writes a run (a folder of Parquet files) and then a manifest,
which names all runs of all tables; a reader takes the last manifest and sees whole commits only. A manifest is
put in place by a rename that fails if its number is taken, so of two writers that go on from one state one wins,
and the other gets StaleWriter and has changed nothing.

FANOUT runs of a level are merged into one of the next level, in which a record has its latest version only: a table of n
appends has some log(n) runs, and a row is rewritten as often. Replaced runs are deleted GRACE commits later.

Events are kept in two places. `open` holds those that wait for a window or are in one that is not finished; it is
rewritten without what is closed, so it stays as small as the backlog. `closed` holds the others, ordered by window,
and `ledger` their ids, in buckets of the id's hash of about BUCKET_ROWS rows each, of which a batch opens those only that
its own ids fall in. So ingestion reads in proportion to its batch and to the backlog, not to the history.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable, Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lineage import cut
from . import records

SCHEMA_VERSION = 3
#: Runs of one level that are merged; commits for which replaced runs stay; manifests that stay.
FANOUT, GRACE, MANIFESTS = 8, 32, 32
#: Rows of a bucket of the ledger, about, and buckets of a run at most. A batch that falls in more buckets than LOOKED_UP reads all.
BUCKET_ROWS, MOST_BUCKETS, LOOKED_UP = 20_000, 1 << 14, 4_096
#: Tables that batches of events or labels look their ids up in.
BUCKETED = ("ledger", "feedback")
#: Tables of which every row counts, not the last of a key.
WHOLE = ("conflicts", "label_conflicts", "parked")


class StorageError(RuntimeError):
    pass


class UnsupportedSchemaVersion(StorageError):
    pass


class StaleWriter(StorageError):
    """Another writer has committed since this one last read the state."""


class RecordNotFound(StorageError, LookupError):
    pass


class IdempotencyConflict(StorageError):
    pass


class PendingEvents(StorageError):
    pass


class InvalidStateTransition(StorageError):
    pass


EVENT = "event_id string, sequence long, payload_sha256 string, reference_id string, occurred_at string, received_at string, features string, prediction_json string, score double, state string, window_id string"
TABLES = {
    "schema_info": ("key string, number long", "key"),
    "references": ("reference_id string, name string, content_sha256 string, config_sha256 string, source_format string, row_count long, columns array<string>, dtypes array<string>, content_path string, created_at string, active boolean", "reference_id"),
    "open": (EVENT, "event_id"),
    "closed": (EVENT, "event_id"),
    "ledger": ("event_id string, payload_sha256 string, sequence long, window_id string", "event_id"),
    "conflicts": ("event_id string, payload_sha256 string, epoch string, received_at string", "event_id"),
    "rejected": ("rejected_id string, event_id string, payload string, reason string, epoch string, received_at string", "rejected_id"),
    "batches": ("batch_id string, payload_sha256 string, reference_id string, records string, row_count long, state string, run_id string, created_at string", "batch_id"),
    "runs": ("run_id string, source string, source_id string, reference_id string, config_sha256 string, row_count long, status string, result string, error string, created_at string, completed_at string", "run_id"),
    "deliveries": ("delivery_id string, run_id string, channel string, payload string, status string, attempts long, error string, created_at string, updated_at string", "delivery_id"),
    "feedback": ("event_id string, y_json string, received_at string", "event_id"),
    "parked": ("event_id string, y_json string, position long, epoch string, received_at string", "event_id"),
    "label_conflicts": ("event_id string, y_json string, epoch string, received_at string", "event_id"),
    "performance": ("run_id string, status string, metrics string, created_at string, updated_at string", "run_id"),
    "audit": ("audit_id string, action string, details string, created_at string", "audit_id"),
    "epochs": ("epoch string, committed_at string", "epoch"),
}


def bucket_of(column: str, n: int) -> Column:
    """The bucket of an id; n is a power of two, and a bucket of fewer is the rest of one of more."""
    return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.schemas = {n: T._parse_datatype_string(f"{ddl}, version long") for n, (ddl, _) in TABLES.items()}
        self._last = 0
        self.manifest = self._newest()
        found = [r["number"] for r in self.latest("schema_info").collect()]
        if not found:
            self.put("schema_info", {"key": "schema", "number": SCHEMA_VERSION})
        elif found[0] != SCHEMA_VERSION:
            raise UnsupportedSchemaVersion(f"the state has version {found[0]}; this library knows {SCHEMA_VERSION}")

    # ---- files and manifests

    def _hadoop(self, path: str) -> tuple[Any, Any]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), p

    def exists(self, path: str) -> bool:
        fs, p = self._hadoop(path)
        return fs.exists(p)

    def _log(self) -> list[int]:
        """Numbers of the manifests that are there."""
        fs, p = self._hadoop(f"{self.root}/log")
        names = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _path(self, number: int) -> str:
        return f"{self.root}/log/{number:020d}.json"

    def _newest(self) -> dict[str, Any]:
        numbers = self._log()
        if not numbers:
            return {"number": 0, "sequence": 0, "tables": {}, "replaced": []}
        fs, p = self._hadoop(self._path(numbers[-1]))
        stream = fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def refresh(self) -> None:
        """Goes on from the state as it is now."""
        self.manifest = self._newest()

    def _commit(self, added: Mapping[str, list[dict[str, Any]]], whole: Iterable[str] = (), sequence: int | None = None) -> None:
        """Adds runs to tables, or in `whole` ones puts them in place of what is there, by the next manifest."""
        old = self.manifest
        tables = {n: list(runs) for n, runs in old["tables"].items()}
        number, replaced = old["number"] + 1, list(old["replaced"])
        for name, runs in added.items():
            if name in whole:
                replaced += [[number, r["path"]] for r in tables.get(name, [])]
                tables[name] = []
            tables.setdefault(name, []).extend(runs)
        gone = [path for n, path in replaced if n <= number - GRACE]
        new = {"number": number, "sequence": old["sequence"] if sequence is None else sequence, "tables": tables, "replaced": [x for x in replaced if x[0] > number - GRACE]}
        jvm = self.spark._jvm
        fs, final = self._hadoop(self._path(number))
        draft = jvm.org.apache.hadoop.fs.Path(f"{self.root}/log/draft-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        try:
            out.write(json.dumps(new).encode())
        finally:
            out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), fs.getConf())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            if self._log()[-1:] > [old["number"]]:  # also where the next manifest was removed since
                raise StaleWriter(f"another writer has committed after {old['number']}")
            context.rename(draft, final, none)  # fails where the number is taken
        except Exception as e:
            fs.delete(draft, False)
            if isinstance(e, StaleWriter) or fs.exists(final):
                raise StaleWriter(f"another writer has committed after {old['number']}") from e
            raise
        self.manifest = new
        for path in gone:
            fs.delete(jvm.org.apache.hadoop.fs.Path(path), True)
        for n in [n for n in self._log() if n <= number - MANIFESTS]:
            fs.delete(jvm.org.apache.hadoop.fs.Path(self._path(n)), False)

    def _run(self, table: str, frame: DataFrame, level: int = 0) -> dict[str, Any]:
        """Writes a run of a table: merged ones in buckets, or in the order they are asked by."""
        path = f"{self.root}/data/{table}/{uuid.uuid4().hex}"
        buckets, order = 1, "window_id" if table == "closed" else TABLES[table][1]
        if table in BUCKETED and level:
            n = frame.count()
            while buckets < MOST_BUCKETS and buckets * BUCKET_ROWS < n:
                buckets *= 2
        if buckets > 1:
            frame.withColumn("bucket", bucket_of("event_id", buckets)).repartition(min(buckets, 2_000), "bucket").sortWithinPartitions("bucket", order).write.partitionBy("bucket").parquet(path)
        elif level:
            frame.repartitionByRange(order).sortWithinPartitions(order).write.parquet(path)
        else:
            frame.write.parquet(path)
        return {"path": path, "level": level, "buckets": buckets}

    def _merge(self) -> None:
        """Merges the runs of a level that has FANOUT of them, until none has."""
        for table, runs in list(self.manifest["tables"].items()):
            while True:
                level = next((x for x in sorted({r["level"] for r in runs}) if sum(r["level"] == x for r in runs) >= FANOUT), None)
                if level is None:
                    break
                own = [r for r in runs if r["level"] == level]
                rows = self._frame(table, own)
                merged = self._run(table, (rows if table in WHOLE else records.latest(rows, TABLES[table][1])).select(*self.schemas[table].names), level + 1)
                rest = [r for r in runs if r["level"] != level]
                replaced = self.manifest["replaced"]
                self.manifest = self.manifest | {"replaced": [*replaced, *[[self.manifest["number"] + 1, r["path"]] for r in own]], "tables": self.manifest["tables"] | {table: [*rest, merged]}}
                self._commit({})
                runs = self.manifest["tables"][table]

    def _frame(self, table: str, runs: list[dict[str, Any]]) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], self.schemas[table])
        return reduce(DataFrame.union, [self.spark.read.schema(self.schemas[table]).parquet(*[r["path"] for r in runs if r["buckets"] == n]) for n in sorted({r["buckets"] for r in runs})])

    def _runs(self, table: str) -> list[dict[str, Any]]:
        return self.manifest["tables"].get(table, [])

    # ---- tables

    def version(self) -> int:
        self._last = max(self._last + 1, time.time_ns())
        return self._last

    def read(self, table: str) -> DataFrame:
        """All versions that are kept. `events` are the closed and the open ones."""
        if table == "events":
            return self.read("closed").unionByName(self.read("open"))
        return self._frame(table, self._runs(table))

    def latest(self, table: str) -> DataFrame:
        return self.read(table) if table in WHOLE else records.latest(self.read(table), "event_id" if table == "events" else TABLES[table][1])

    def _shaped(self, table: str, frame: DataFrame) -> DataFrame:
        out = frame.withColumn("version", F.lit(self.version()))
        missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.schemas[table] if f.name not in out.columns]
        return out.select("*", *missing).select(*[F.col(f.name).cast(f.dataType) for f in self.schemas[table]])

    def append(self, table: str, frame: DataFrame) -> None:
        self._commit({table: [self._run(table, self._shaped(table, frame))]})
        self._merge()

    def replace(self, table: str, frame: DataFrame) -> None:
        """The frame in place of all that the table has."""
        self._commit({table: [self._run(table, self._shaped(table, frame))]}, whole=[table])

    # ---- events

    def accept(self, frame: DataFrame, sequence: int) -> None:
        """New events, of which the last has the number `sequence`."""
        self._commit({"open": [self._run("open", self._shaped("open", frame))]}, sequence=sequence)
        self._merge()

    def open_events(self) -> DataFrame:
        """The events that are buffered or claimed, as they are now."""
        return records.latest(self.read("open"), "event_id")

    def close(self, events: DataFrame) -> None:
        """Events in their last state, in one commit: `closed` and `ledger` gain them, `open` is rewritten without them."""
        closed = cut(self._shaped("closed", events))
        rest = self.open_events().join(closed.select("event_id"), "event_id", "left_anti").select(*self.schemas["open"].names)
        runs = {"closed": self._run("closed", closed), "ledger": self._run("ledger", closed.select(*self.schemas["ledger"].names)), "open": self._run("open", rest, 1)}
        self._commit({n: [r] for n, r in runs.items()}, whole=["open"])
        self._merge()

    def of_batch(self, table: str, batch: DataFrame) -> DataFrame:
        """Rows of a bucketed table, among them all whose id is in the batch: only the buckets are read that the batch's ids fall in."""
        runs = self._runs(table)
        large = [r for r in runs if r["buckets"] > 1]
        found = self._frame(table, [r for r in runs if r["buckets"] == 1])
        if large:
            asked = batch.select(bucket_of("event_id", max(r["buckets"] for r in large)).alias("b")).distinct().limit(LOOKED_UP + 1).collect()
            schema = T.StructType([*self.schemas[table].fields, T.StructField("bucket", T.IntegerType())])
            for r in large:
                frame = self.spark.read.schema(schema).parquet(r["path"])
                # buckets are powers of two, so a run's bucket is a part of the finest one
                own = sorted({x["b"] % r["buckets"] for x in asked})
                found = found.union((frame if len(asked) > LOOKED_UP else frame.where(F.col("bucket").isin(own))).drop("bucket"))
        return found

    def known_events(self, batch: DataFrame) -> DataFrame:
        """(event_id, payload_sha256, sequence, window_id) of stored events, among them all that share an id with the batch."""
        names = ("event_id", "payload_sha256", "sequence", "window_id")
        return self.open_events().select(*names).unionByName(self.of_batch("ledger", batch).select(*names))

    def last_sequence(self) -> int:
        return self.manifest["sequence"]

    def put(self, table: str, *rows: Mapping[str, Any]) -> None:
        if not rows:
            return
        schema = T.StructType([f for f in self.schemas[table] if f.name != "version"])
        self.append(table, self.spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema).coalesce(1))

    def find(self, table: str, value: str) -> dict[str, Any] | None:
        """The latest version of one record."""
        key = TABLES[table][1]
        found = self.read(table).where(F.col(key) == value).orderBy(F.desc("version")).limit(1).collect()
        return found[0].asDict(recursive=True) if found else None

    def find_all(self, table: str, values: list[str]) -> dict[str, dict[str, Any]]:
        """The latest versions of records, by key; the keys reach the scan."""
        key = TABLES[table][1]
        found = records.latest(self.read(table).where(F.col(key).isin(values)), key).collect() if values else []
        return {r[key]: {k: v for k, v in r.asDict(recursive=True).items() if k != "version"} for r in found}

    def get(self, table: str, value: str) -> dict[str, Any]:
        found = self.find(table, value)
        if found is None:
            raise RecordNotFound(f"{table} has no {value!r}")
        return found

    def change(self, table: str, record: Mapping[str, Any], allowed: Iterable[str], field: str, state: str, **more: Any) -> dict[str, Any]:
        """A version of the record with `field` moved to `state`, from one of the allowed states only."""
        new = self.moved(table, record, allowed, field, state, **more)
        self.put(table, new)
        return new

    @staticmethod
    def moved(table: str, record: Mapping[str, Any], allowed: Iterable[str], field: str, state: str, **more: Any) -> dict[str, Any]:
        """What `change` stores, for several records that are put at once."""
        if record[field] not in allowed:
            raise InvalidStateTransition(f"{table}: {record[field]} cannot become {state}")
        return {k: v for k, v in record.items() if k != "version"} | {field: state} | more

    def runs_page(self, limit: int = 50, offset: int = 0, status: str | None = None) -> DataFrame:
        """Runs, latest first."""
        return records.page(self.latest("runs"), limit, offset, status)

    def listing(self, table: str, **equal: str) -> DataFrame:
        """Records as they are now, oldest first, by creation and key; only those whose columns equal what is given."""
        rows = self.latest(table)
        for name, value in equal.items():
            rows = rows.where(F.col(name) == value)
        created = next(c for c in ("created_at", "received_at", "committed_at", "number") if c in rows.columns)
        return rows.orderBy(created, TABLES[table][1]).drop("version")

    def count_events(self, state: str) -> int:
        rows = self.open_events() if state in ("buffered", "claimed") else self.latest("closed")
        return rows.where(F.col("state") == state).count()

    def events_of(self, windows: list[str]) -> DataFrame:
        """The events of windows as they are now. An event that is in a window stays in it, so the windows reach the scan, whose files are in their order."""
        return records.latest(self.read("events").where(F.col("window_id").isin(windows)), "event_id").drop("version")

    def claimed_windows(self) -> list[str]:
        """Windows that were claimed and not finished, oldest first."""
        return [r["window_id"] for r in records.claimed(self.open_events()).orderBy("first_sequence").collect()]

    def oldest_buffered(self, n: int) -> DataFrame:
        """The first n events that wait for a window."""
        return records.oldest(self.open_events(), "buffered", n).drop("version")

    def counts(self, table: str, field: str) -> dict[str, int]:
        """How many records are in each state."""
        return {r[field]: r["n"] for r in records.counts_by(self.latest(table), field).collect()}
