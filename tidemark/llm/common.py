"""What the operators of this subpackage share: scratch tables, word splitting, hashing."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import shared_folder
from ..functions.shipping import ship

#: The characters that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
SEPARATORS = " \t\n\x0b\x0c\r"


class Scratch:
    """Tables written under the shared folder: they cut lineage and survive lost executors.

    One instance serves one operator call, in a folder of its own. `drop` removes a table that is
    no longer needed; tables that a lazily returned result still reads stay.
    """

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark = spark
        self.root = f"{shared_folder(spark)}/tidemark-{name}-{uuid.uuid4().hex}"

    def write(self, frame: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        frame.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.read(name)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        conf = self.spark._jsparkSession.sessionState().newHadoopConf()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket_of_id(column: str, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def words_of(text: str | None) -> list[bytes]:
    """Maximal runs of characters other than SEPARATORS, as UTF-8; bytes.split splits at just these."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


class HashCache(dict):
    """Word to 64-bit hash, computed once per worker; emptied when it grows past `limit` words."""

    def __init__(self, limit: int = 200_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


#: By operator, what gives back the memory that its tasks leave in a worker for those that follow; and whose turn it is.
_GIVE_BACK: dict[str, Callable[[], None]] = {}
_TURN: list[str] = [""]


def takes_turn(operator: str, give_back: Callable[[], None] | None = None) -> None:
    """To be called as a task begins: Spark keeps workers from stage to stage, and what another operator remembers, and what allocators keep of earlier tasks, would be held beside what this one needs."""
    if give_back:
        _GIVE_BACK[operator] = give_back
    if _TURN[0] != operator:
        _TURN[0] = operator
        for name, f in _GIVE_BACK.items():
            if name != operator:
                f()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values (xor-shift and multiply rounds)."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(33))


def record_batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Row tuples to Arrow batches of a bounded number of rows."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
