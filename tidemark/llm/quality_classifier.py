"""Quality classifier: histogram gradient-boosted trees over document statistics.

Labels are learnt from a bounded sample (`sample_rows`) of labelled rows outside the held-out fifth;
every whole text is scored. The sample is the rows of smallest id hash, so that it is the same on
every run; its statistics (sample_rows x 28 numbers) are all that reaches the driver.

Defined results: a null text is the empty text, and scores like it (its statistics are zeros); a
null doc_id is a row like any other; repeated rows are scored each; ids whose labels disagree or
are null are not learnt from; with no labels, or labels of one class, every score is the share of
label 1 (0.5 with none); texts of any length are read whole, each by one task; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import gbt, textstats
from .common import bucket_of_id, ship, table

#: Labelled rows that the fit reads at most.
SAMPLE_ROWS = 20_000
#: Of crc32(doc_id) mod FOLDS, remainder 0 is held out of learning.
FOLDS = 5
#: Scores from here on are predicted 1.
THRESHOLD = 0.3


def _matrix(column: pa.Array) -> np.ndarray:
    rows = [textstats.features(x or b"") for x in column.cast(pa.binary()).to_pylist()]
    return np.asarray(rows, float).reshape(len(rows), len(textstats.FEATURES))


def _with_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = _matrix(b.column(1))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(x), pa.list_(pa.float64())), *b.columns[2:]], ["label", "x", "id_hash", "text_hash"])


def training_labels(labels: DataFrame, sample_rows: int = SAMPLE_ROWS, folds: int = FOLDS) -> DataFrame:
    """At most sample_rows agreed labels (doc_id, label) outside the held-out fold; an id with a null label has none."""
    return (
        labels.where(F.col("doc_id").isNotNull() & (bucket_of_id("doc_id", folds) != 0))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("label"), F.max("quality").alias("high"), F.count(F.when(F.col("quality").isNull(), 1)).alias("nulls"))
        .where("label = high and nulls = 0")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample_rows)
        .select("doc_id", "label")
    )


def sampled(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, folds: int = FOLDS) -> pa.Table:
    """(label, x) of the rows to learn from: those of the sampled ids, of which at most 2 * sample_rows, by their hash, where ids repeat."""
    ship(docs.sparkSession)
    chosen = F.broadcast(training_labels(labels, sample_rows, folds))  # sample_rows rows at most
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").select("label", "text", F.xxhash64("doc_id").alias("id_hash"), F.xxhash64("text").alias("text_hash"))
    found = rows.mapInArrow(_with_features, "label int, x array<double>, id_hash long, text_hash long")
    return found.orderBy("id_hash", "text_hash").limit(2 * sample_rows).select("label", "x").toArrow()


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, folds: int = FOLDS, **params) -> gbt.Forest:
    """The forest learnt from the sample."""
    found = sampled(docs, labels, sample_rows, folds)
    x = np.asarray(found["x"].to_pylist(), float).reshape(found.num_rows, len(textstats.FEATURES))
    y = np.asarray(found["label"].to_pylist(), float)
    order = np.lexsort(np.column_stack([x, y]).T)  # the same forest, however the rows arrive
    return gbt.fit(x[order], y[order], **params)


def score_documents(docs: DataFrame, forest: gbt.Forest) -> DataFrame:
    """(doc_id, score) for every row."""
    ship(docs.sparkSession)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(forest.probability(_matrix(b.column(1))))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scored, "doc_id long, score double")


def keep_documents(docs: DataFrame, forest: gbt.Forest, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, whose score is at least `threshold`."""
    ship(docs.sparkSession)
    at = docs.columns.index("text")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(forest.probability(_matrix(b.column(at))) >= threshold))

    return docs.mapInArrow(kept, docs.schema)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    forest = fit(docs, table(spark, sf_dir, "labels"))
    return score_documents(docs, forest).select(
        "doc_id",
        (bucket_of_id("doc_id", FOLDS) == 0).alias("held_out"),
        "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )
