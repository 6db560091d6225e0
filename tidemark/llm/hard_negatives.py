"""Hard-negative mining by blocked matrix products.

Anchors meet all rows. The nearest rows of an anchor's own label are its positives; for each of these, the
nearest rows of other labels whose score lies within a window around the positive's are its hard negatives.

Anchors are cut into blocks of at most BLOCK_BYTES of vectors (about, as ids are hashed to blocks), whatever
their number. A block is broadcast, and every task goes through its candidates batch by batch: one matrix
product a batch, of which each anchor keeps its best. What a task hands on is a row per anchor and place, to
be merged with those of the other tasks; all candidates stay where they are, so nothing is shuffled but these.
A first pass over the candidates finds the positives, a second, which needs their scores, the negatives. Work
is anchors times rows, as the task asks; the shuffle is anchors times tasks.

Components are whole numbers (floor(scale * x)), held as doubles: products are exact below 2**53, which the
lengths of the vectors decide before each product; beyond, the same product is taken in 64-bit whole numbers.

Defined results: rows with a null id, null label, null vector, or a null or non-finite component take no part,
nor do vectors of another length than the commonest (the shorter on ties), nor components so large (131 072 for
64 components) that a score might not fit a 64-bit number; rows that share an id are one row, that of the smallest
label, then vector; rows of equal score are ordered by id; anchors without a positive, and positives without a
negative, have no rows; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil, isqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, ship, table

SCALE = 256
POSITIVES = 5
NEGATIVES = 10
#: A negative's score lies between these per cent of the positive's.
WINDOW = (30, 90)
#: Bytes of anchors' vectors that are broadcast together.
BLOCK_BYTES = 32 << 20
#: Anchors and candidates of one matrix product.
_ANCHORS, _CANDIDATES = 512, 4_096
#: Doubles hold all whole numbers below this.
_EXACT = 2.0**53
#: Anchors: rows whose id is divisible by this. Where it is divisible by RELABELLED, the label moves on by one.
EVERY = 100
RELABELLED, LABELS = 7, 10
_NOTHING = np.iinfo(np.int64).min


def valid_rows(vectors: DataFrame, scale: int = SCALE, id_column: str = "vec_id", label: Column | None = None, vector_column: str = "embedding") -> DataFrame:
    """(id, label, vec) of the rows that take part; vec holds whole numbers as doubles."""
    label = F.col("label").cast("long") if label is None else label
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), label.alias("label"), F.col(vector_column).cast("array<double>").alias("raw"))
    finite = F.forall("raw", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fit = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("raw").isNotNull() & (F.size("raw") > 0) & finite)
    sizes = fit.groupBy(F.size("raw").alias("size")).count().orderBy(F.desc("count"), "size").first()
    width = sizes["size"] if sizes else 1
    most = isqrt((1 << 63) // (100 * width))
    own = fit.where(F.size("raw") == width).select("id", "label", F.transform("raw", lambda x: _floor(x * scale)).alias("vec"))
    small = own.where(F.forall("vec", lambda x: F.abs(x) <= most))
    return small.groupBy("id").agg(F.min(F.struct("label", "vec")).alias("row")).select("id", "row.*")


def _floor(x: Column) -> Column:
    """floor as a double, also where a whole number of 64 bits cannot hold it (there a double has no fraction)."""
    return F.when(F.abs(x) < _EXACT, F.floor(x).cast("double")).otherwise(x)


class Block(NamedTuple):
    """Anchors that are broadcast together; windows are the least and greatest scores wanted, a row per anchor."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    least: np.ndarray | None = None
    greatest: np.ndarray | None = None


class Best:
    """The best few (score, id) of each of some rows, best first; what it takes in may come in any order and pieces."""

    def __init__(self, rows: int, k: int):
        self.k = k
        self.score = np.full((rows, k), _NOTHING, np.int64)
        self.id = np.zeros((rows, k), np.int64)

    def offer(self, first: int, scores: np.ndarray, wanted: np.ndarray, ids: np.ndarray) -> None:
        """Scores of rows from `first` on (down) against candidates (across), of which `wanted` count."""
        n = len(scores)
        floor = self.score[first : first + n, -1]
        hit = wanted & (scores >= floor[:, None])
        if np.count_nonzero(hit) > 4 * self.k * n and scores.shape[1] > self.k:
            # at first most are better than nothing; ties stay in
            shown = np.where(hit, scores, -np.inf if scores.dtype.kind == "f" else _NOTHING)
            hit &= scores >= np.partition(shown, -self.k, axis=1)[:, -self.k, None]
        row, at = np.nonzero(hit)
        if not len(row):
            return
        some = np.unique(row)
        row = np.concatenate([np.repeat(some, self.k), row])
        score = np.concatenate([self.score[first + some].ravel(), scores[hit].astype(np.int64)])
        name = np.concatenate([self.id[first + some].ravel(), ids[at]])
        order = np.lexsort((name, np.bitwise_not(score), row))  # ~s falls where s rises, for all 64-bit numbers
        row, score, name = row[order], score[order], name[order]
        begins = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        place = np.arange(len(row)) - np.repeat(begins, np.diff(np.append(begins, len(row))))
        kept = place < self.k
        self.score[first + row[kept], place[kept]] = score[kept]
        self.id[first + row[kept], place[kept]] = name[kept]


def products(anchors: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """All scores, exactly: by doubles where lengths keep every sum below 2**53."""
    length = lambda x: float(np.sqrt(np.einsum("ij,ij->i", x, x).max(initial=0)))
    if length(anchors) * length(candidates) * 1.01 < _EXACT:
        return anchors @ candidates.T
    return anchors.astype(np.int64) @ candidates.astype(np.int64).T


def _scan(shared: Broadcast, width: int, visit: Callable, report: Callable) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Goes through (id, label, vec) batches; visit gets the state, a first anchor, scores, equal labels and ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = shared.value
        state = None
        for b in batches:
            for at in range(0, b.num_rows, _CANDIDATES):
                part = b.slice(at, _CANDIDATES)
                ids, labels = (part.column(k).to_numpy() for k in (0, 1))
                vectors = part.column(2).flatten().to_numpy().reshape(-1, width)
                for first in range(0, len(block.ids), _ANCHORS):
                    to = first + _ANCHORS
                    scores = products(block.vectors[first:to], vectors)
                    state = visit(block, state, first, to, scores, block.labels[first:to, None] == labels, ids)
        if state is not None:
            yield from report(block, state)

    return run


def _positives(k: int):
    def visit(block: Block, best: Best | None, first: int, to: int, scores: np.ndarray, same: np.ndarray, ids: np.ndarray) -> Best:
        best = best or Best(len(block.ids), k)
        best.offer(first, scores, same & (block.ids[first:to, None] != ids), ids)
        return best

    def report(block: Block, best: Best) -> Iterator[pa.RecordBatch]:
        row, place = np.nonzero(best.score != _NOTHING)
        yield pa.RecordBatch.from_arrays([pa.array(block.ids[row]), pa.array(best.id[row, place]), pa.array(best.score[row, place])], ["anchor_id", "positive_id", "positive_score"])

    return visit, report


def _negatives(k: int):
    def visit(block: Block, best: list[Best] | None, first: int, to: int, scores: np.ndarray, same: np.ndarray, ids: np.ndarray) -> list[Best]:
        best = best or [Best(len(block.ids), k) for _ in range(block.least.shape[1])]
        for n, own in enumerate(best):
            inside = (scores >= block.least[first:to, n, None]) & (scores <= block.greatest[first:to, n, None])
            own.offer(first, scores, inside & ~same, ids)
        return best

    def report(block: Block, best: list[Best]) -> Iterator[pa.RecordBatch]:
        for n, own in enumerate(best):
            row, place = np.nonzero(own.score != _NOTHING)
            columns = [block.ids[row], np.full(len(row), n, np.int32), own.id[row, place], own.score[row, place]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor_id", "place", "negative_id", "negative_score"])

    return visit, report


def _matrix(frame: DataFrame, column: str, width: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The other columns of a bounded frame, and a column of arrays as a matrix."""
    found = frame.toArrow()
    values = found.column(column).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return [found.column(c).to_numpy() for c in found.column_names if c != column], values


def mine(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, for anchors among rows (id, label, vec) as `valid_rows` makes them."""
    spark = rows.sparkSession
    ship(spark)
    scratch = Scratch(spark, "negatives")
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = scratch.write(rows, "rows")
    known = rows.select(F.size("vec").alias("width")).limit(1).collect()
    n_anchors = anchors.count()
    if not known or not n_anchors:
        return spark.createDataFrame([], result)
    width = known[0]["width"]
    blocks = ceil(n_anchors * width * 8 / block_bytes)
    own = scratch.write(anchors.select("id", "label", "vec", F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block")).repartition("block"), "anchors")
    lo, hi = window
    for k in range(blocks):
        (ids, labels), vectors = _matrix(own.where(F.col("block") == k).select("id", "label", "vec"), "vec", width)
        block = spark.sparkContext.broadcast(Block(ids, labels, vectors))
        visit, report = _positives(positives)
        found = rows.mapInArrow(_scan(block, width, visit, report), "anchor_id long, positive_id long, positive_score long")
        best = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
        chosen = scratch.write(found.withColumn("place", F.row_number().over(best) - 1).where(F.col("place") < positives), f"positives/block={k}")
        block.unpersist()

        least, greatest = (np.full((len(ids), positives), x, np.int64) for x in (1, 0))  # a window that nothing is in
        at, place, score = (chosen.select("anchor_id", "place", "positive_score").toArrow().column(c).to_numpy() for c in range(3))  # at most `positives` rows per anchor of the block
        order = np.argsort(ids)
        anchor = order[np.searchsorted(ids, at, sorter=order)]
        least[anchor, place] = -(-lo * score // 100)
        greatest[anchor, place] = hi * score // 100
        block = spark.sparkContext.broadcast(Block(ids, labels, vectors, least, greatest))
        visit, report = _negatives(negatives)
        found = rows.mapInArrow(_scan(block, width, visit, report), "anchor_id long, place int, negative_id long, negative_score long")
        best = Window.partitionBy("anchor_id", "place").orderBy(F.desc("negative_score"), "negative_id")
        ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
        scratch.write(ranked, f"negatives/block={k}")
        block.unpersist()
    pairs = scratch.read("positives").join(scratch.read("negatives"), ["block", "anchor_id", "place"])
    return pairs.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % RELABELLED == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label")).cast("long")
    rows = Scratch(spark, "vectors").write(valid_rows(table(spark, sf_dir, "embeddings"), label=moved), "valid")
    return mine(rows, rows.where(F.col("id") % EVERY == 0))


OP11_SQL = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_inner_product(a.v, r.v)::BIGINT AS score
  FROM rows a JOIN rows r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 10
"""
