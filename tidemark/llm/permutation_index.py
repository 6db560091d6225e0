"""Approximate nearest neighbours by a permutation index, for cosine similarity.

A vector is represented by the order in which it sees the pivots, nearest first. It is posted in the
inverted files of its POSTINGS nearest pivots; a query visits the files of its PROBES nearest ones. In
a file, rows are ranked by the footrule distance between their order of the pivots and the query's
(the sum over pivots of the difference in rank), and the best share of them, ties included, is reranked
by exact cosine in double precision on the original vectors.

Only the pivots are fitted, on a bounded sample: at most PIVOTS vectors, those of smallest hash. Every
vector is indexed. Equal vectors are indexed once, with their k + 1 smallest ids, which is all that an
answer can hold of them; so a vector that a third of all rows repeat makes no long file. Files are cut
into blocks of about BLOCK_ROWS rows, and their queries into blocks of about BLOCK_QUERIES, which is
what one task group holds; each hands on k + 1 rows per query.

Defined results: rows whose vector is null, all zero, or holds a null or non-finite component take no
part, nor do rows with a null id or of another length than the commonest (the shorter on ties); rows
that repeat id and vector count once; neighbours of one score are ordered by id; with fewer than k
candidates all are returned; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, ship, table

NEIGHBOURS = 5
#: A pivot for so many distinct vectors, up to PIVOTS.
VECTORS_PER_PIVOT = 32
PIVOTS = 128
POSTINGS = 2
PROBES = 40
#: Of a file's rows, the share that is reranked, and how many at least.
RERANKED = 0.15
RERANKED_LEAST = 100
BLOCK_ROWS = 16_384
BLOCK_QUERIES = 2_048
#: Queries: rows whose id is divisible by this.
EVERY = 50


def valid_vectors(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(id, vec) of the rows that take part; vec is an array of doubles."""
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fit = rows.where(F.col("id").isNotNull() & F.col("vec").isNotNull() & finite & F.exists("vec", lambda x: x != 0))
    sizes = fit.groupBy(F.size("vec").alias("size")).count().orderBy(F.desc("count"), "size").first()
    # -0.0 and 0.0 are one value
    same = F.transform("vec", lambda x: x + F.lit(0.0))
    return fit.where(F.size("vec") == (sizes["size"] if sizes else -1)).select("id", same.alias("vec"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def scaled(x: np.ndarray) -> np.ndarray:
    """Each row times a power of two that brings its largest component near 1: the same directions, bit for bit, whose squares neither overflow nor vanish."""
    exponent = np.frexp(np.abs(x).max(axis=1, keepdims=True))[1]
    return np.ldexp(x, -exponent)


def orders(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Each row's rank of each pivot, nearest 0; ties to the earlier pivot."""
    x = scaled(x)
    seen = np.argsort(-(x / np.linalg.norm(x, axis=1, keepdims=True)) @ pivots.T, axis=1, kind="stable")
    ranks = np.empty(seen.shape, np.int16)
    np.put_along_axis(ranks, seen, np.arange(len(pivots), dtype=np.int16)[None, :], axis=1)
    return ranks


def _ordered(pivots: np.ndarray):
    """Adds each vector's order as bytes and the pivots of its nearest files."""

    def run(batches: Iterator[pa.RecordBatch], files: int) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ranks = orders(_matrix(b.column(1), pivots.shape[1]), pivots)
            nearest = np.argsort(ranks, axis=1)[:, :files].astype(np.int32)
            cuts = np.arange(0, nearest.size + 1, nearest.shape[1], dtype=np.int32)
            lists = pa.ListArray.from_arrays(cuts, pa.array(nearest.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in ranks], pa.binary()), lists], ["ids", "vec", "ranks", "files"])

    return run


def _answers(width: int, pivots: int, k: int, share: float, least: int):
    """Best k + 1 rows of one block of a file for each query of one block."""

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if queries.num_rows and rows.num_rows:
            names = queries.column("query").to_pylist()
            ids = rows.column("ids").to_pylist()
            q, v = (scaled(_matrix(t.column("vec").combine_chunks(), width)) for t in (queries, rows))
            rank_q, rank_v = (np.frombuffer(b"".join(t.column("ranks").to_pylist()), np.int16).reshape(-1, pivots) for t in (queries, rows))
            norm = np.sqrt((v * v).sum(axis=1))
            need = min(len(v), max(least, int(np.ceil(share * len(v)))))
            for name, x, order in zip(names, q, rank_q, strict=True):
                footrule = np.abs(rank_v - order).sum(axis=1, dtype=np.int64)
                near = np.flatnonzero(footrule <= np.partition(footrule, need - 1)[need - 1])
                score = (v[near] * x).sum(axis=1) / (norm[near] * np.sqrt((x * x).sum()))
                best = sorted(zip((-score).tolist(), [ids[i] for i in near], strict=True))[: k + 1]
                hits = sorted((s, i) for s, own in best for i in own)[: k + 1]
                out[0].extend([name] * len(hits))
                out[1].extend(i for _, i in hits)
                out[2].extend(-s for s, _ in hits)
        return pa.table({"query": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    return run


def _block(hashed: Column, blocks: Column) -> Column:
    return F.pmod(hashed, blocks).cast("int")


def search(rows: DataFrame, queries: DataFrame, k: int = NEIGHBOURS, postings: int = POSTINGS, probes: int = PROBES, reranked: float = RERANKED, least: int = RERANKED_LEAST) -> DataFrame:
    """query_id, rank, vec_id, score: for each query (id, vec) its k nearest found among rows (id, vec), itself left out."""
    spark = rows.sparkSession
    ship(spark)
    scratch = Scratch(spark, "permutation")
    first = Window.partitionBy("vec").orderBy("id")
    smallest = rows.distinct().withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
    distinct = scratch.write(smallest.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids")).select("ids", "vec"), "distinct")
    n = distinct.count()
    wanted = queries.distinct()
    by_vector = scratch.write(wanted.groupBy("vec").agg(F.min("id").alias("query")), "queries")
    if not n or by_vector.isEmpty():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    chosen = distinct.orderBy(F.xxhash64("vec"), F.element_at("ids", 1)).limit(min(PIVOTS, max(1, n // VECTORS_PER_PIVOT))).select("vec").collect()
    pivots = scaled(np.asarray([r["vec"] for r in chosen], float))
    pivots /= np.linalg.norm(pivots, axis=1, keepdims=True)
    add = _ordered(pivots)
    schema = "vec array<double>, ranks binary, files array<int>"
    posted = distinct.mapInArrow(lambda b: add(b, postings), f"ids array<long>, {schema}").withColumn("file", F.explode("files")).drop("files")
    posted = scratch.write(posted, "posted")
    asked = by_vector.select("query", "vec").mapInArrow(lambda b: add(b, probes), f"ids long, {schema}").withColumnRenamed("ids", "query")
    asked = scratch.write(asked.withColumn("file", F.explode("files")).drop("files"), "asked")
    # two rows per pivot
    count = lambda t, size: t.groupBy("file").agg(F.ceil(F.count("*") / size).cast("int").alias(f"of_{size}"))
    blocks = count(posted, BLOCK_ROWS).join(count(asked, BLOCK_QUERIES), "file").withColumnsRenamed({f"of_{BLOCK_ROWS}": "row_blocks", f"of_{BLOCK_QUERIES}": "query_blocks"})
    blocks = F.broadcast(scratch.write(blocks, "blocks"))
    each = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    left = asked.join(blocks, "file").withColumn("query_block", _block(F.xxhash64("query"), F.col("query_blocks"))).withColumn("row_block", each("row_blocks"))
    right = posted.join(blocks, "file").withColumn("row_block", _block(F.xxhash64("ids"), F.col("row_blocks"))).withColumn("query_block", each("query_blocks"))
    key = ["file", "row_block", "query_block"]
    answer = _answers(pivots.shape[1], len(pivots), k, reranked, least)
    found = (
        left.select(*key, "query", "vec", "ranks").groupBy(*key)
        .cogroup(right.select(*key, "ids", "vec", "ranks").groupBy(*key))
        .applyInArrow(answer, "query long, vec_id long, score double")
    )
    nearest = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    best = scratch.write(found.distinct().withColumn("n", F.row_number().over(nearest)).where(F.col("n") <= k + 1).drop("n"), "best")
    named = wanted.join(by_vector, "vec").select(F.col("id").alias("query_id"), "query")
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    hits = named.join(best, "query").where("vec_id <> query_id").withColumn("rank", F.row_number().over(own))
    return hits.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Scratch(spark, "vectors").write(valid_vectors(table(spark, sf_dir, "embeddings")), "valid")
    return search(rows, rows.where(F.col("id") % EVERY == 0))
