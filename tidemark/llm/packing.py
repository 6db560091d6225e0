"""Best-fit packing: bounded-space online best-fit of documents into sequences of fixed length.

Each task encodes its documents and packs them as they come. It keeps a fixed number of open bins; a
bitset says which amounts of free space occur among them, so that the tightest bin with room is one
bit scan away. When a piece fits nowhere and all bins are open, the fullest closes. Pieces leave the
task when their bin closes, so a task holds open_bins sequences at most. The few bins still open at
the tasks' ends are packed against each other, as wholes, in a second round over their sizes only.
No text or ids are shuffled, apart from those of the last open bins.

Defined results: a null or empty text is just the end id; repeated rows and null ids are packed like
any other row; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, record_batches, ship, table
from .token_ids import TOKENIZER_FILE, encoder

CAPACITY = 4096
END_ID = 1
OPEN_BINS = 256
#: Bins left open that one task of the second round packs.
SECOND_ROUND_BINS = 1 << 16
_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("bin", pa.int64()), ("offset", pa.int64()), ("open", pa.bool_())])
_PIECES_DDL = "doc_id long, piece int, start long, length long, ids binary, bin long, offset long, open boolean"
_PLACES = pa.schema([("bin", pa.int64()), ("sequence_id", pa.int64()), ("base", pa.int64())])


class OpenBins:
    """At most `limit` bins. `place` returns a bin's number and the offset in it, and which bin closed."""

    def __init__(self, capacity: int = CAPACITY, limit: int = OPEN_BINS):
        self.capacity, self.limit = capacity, limit
        self.by_free: dict[int, list[int]] = {}
        self.bits = 0  # bit f: some open bin has f free
        self.open = self.made = 0

    def place(self, size: int) -> tuple[int, int, int | None]:
        if size == self.capacity:  # a bin of its own, which needs no room among the open ones
            self.made += 1
            return self.made - 1, 0, self.made - 1
        roomy, closed = self.bits >> size, None
        if roomy:
            free = size + (roomy & -roomy).bit_length() - 1
            bin_ = self._take(free)
        else:
            if self.open == self.limit:
                fullest = (self.bits & -self.bits).bit_length() - 1
                closed = self._take(fullest)
                self.open -= 1
            free, bin_ = self.capacity, self.made
            self.made += 1
            self.open += 1
        if free == size:  # full: nothing fits any more, so it makes room for another
            self.open -= 1
            return bin_, self.capacity - free, bin_
        self.by_free.setdefault(free - size, []).append(bin_)
        self.bits |= 1 << (free - size)
        return bin_, self.capacity - free, closed

    def _take(self, free: int) -> int:
        held = self.by_free[free]
        bin_ = held.pop()
        if not held:
            self.bits ^= 1 << free
        return bin_


def _packed(tokenizer: str, end_id: int, capacity: int, open_bins: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, first = encoder(tokenizer).each, TaskContext.get().partitionId() << 32
        bins, held = OpenBins(capacity, open_bins), {}

        def rows() -> Iterator[tuple]:
            for b in batches:
                doc_ids = iter(b.column(0).to_pylist())
                for ids, ends in encode(b.column(1), end_id):
                    data, begin = memoryview(ids.astype("<u4", copy=False)).cast("B"), 0
                    for end in ends.tolist():
                        doc_id = next(doc_ids)
                        for piece, at in enumerate(range(begin, end, capacity)):
                            size = min(capacity, end - at)
                            k, offset, closed = bins.place(size)
                            held.setdefault(k, []).append((doc_id, piece, at - begin, size, bytes(data[4 * at : 4 * (at + size)]), first + k, offset, False))
                            if closed is not None:
                                yield from held.pop(closed)
                        begin = end
            for pieces in held.values():
                yield from (x[:-1] + (True,) for x in pieces)

        yield from record_batches(rows(), _PIECES, 1024)

    return run


def _second_round(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, bins = TaskContext.get().partitionId(), OpenBins(capacity, SECOND_ROUND_BINS)

        def rows() -> Iterator[tuple]:
            for b in batches:
                for bin_, used in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    k, base, _ = bins.place(used)
                    yield bin_, -1 - ((task << 32) + k), base  # below zero: no first-round number

        yield from record_batches(rows(), _PLACES)

    return run


def pack(docs: DataFrame, tokenizer: str = TOKENIZER_FILE, end_id: int = END_ID, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """Pieces with their ids (little-endian unsigned 32-bit numbers), sequence_id and offset there."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    run = _packed(tokenizer, end_id, capacity, open_bins)
    first = scratch.write(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _PIECES_DDL), "first")
    names = ["doc_id", "piece", "start", "length", "ids"]
    rest = first.where("open")
    sizes = rest.groupBy("bin").agg(F.sum("length").alias("used"))
    tasks = -(-max(1, sizes.count()) // SECOND_ROUND_BINS)
    by_size = sizes.repartition(tasks, "bin").sortWithinPartitions(F.desc("used"), "bin")
    places = scratch.write(by_size.mapInArrow(_second_round(capacity), "bin long, sequence_id long, base long"), "places")
    closed = first.where("not open").select(*names, F.col("bin").alias("sequence_id"), "offset")
    moved = rest.join(places, "bin").select(*names, "sequence_id", (F.col("base") + F.col("offset")).alias("offset"))
    return closed.unionByName(moved)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset"
    )
