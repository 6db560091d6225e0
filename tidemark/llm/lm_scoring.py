"""LM scoring: marginal probability of a text under a subword lattice.

The vocabulary is that of a public subword tokenizer. Its scores give the first weights of the
pieces; expectation-maximisation over the words of all training documents fits them to the corpus. A
text's score is the log10 probability of its lower-cased words and end, each word's probability
being the sum over all its segmentations, by a forward recursion in log space. Beside it stand the
same by the first weights (first_score) and a word unigram with additive smoothing (base_score).

A deviation: no public vocabulary at hand has unigram scores. The file's are the ranks of a merge
order, so the first weights are reciprocal ranks, no more than a beginning, and `score` is that of the
fitted weights.

How it scales: word counts are summed by Spark into a table (`words`), which is as large as the
corpus makes it and is never collected. Only the COMMON most frequent words and the pieces' weights
reach every task. What a document has of other words leaves its task as postings (word, documents,
times), is joined with `words`, and comes back as one partial sum per document and task. A word
that a third of all documents hold is common, and so in no posting; should one word's postings still
fill a partition, adaptive execution splits the join.

Defined results: a null text is the empty text: one token, the end; rows that repeat are scored each;
null doc_ids are a group for the split like any other (crc32 of the empty text); an empty table gives
an empty result; with no training documents c, N and V are zero and the pieces keep their first
weights; texts of any length are read whole, each by one task; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, record_batches, ship, table
from .lattice import MARK, Lattice

VOCABULARY = "piece_bpe_32k.model"
#: crc32(doc_id) mod FOLDS: remainder 0 is held out of learning.
FOLDS = 10
#: Words that every task gets, most frequent first; all others are joined.
COMMON = 200_000
#: Rounds of expectation-maximisation over all training words.
ROUNDS = 3
#: Added to each piece's expected count, so that no piece is impossible.
SMOOTHING = 0.1
#: Words or postings that a task gathers before it hands them on.
HELD = 500_000
_LN10 = float(np.log(10))


def pieces_and_weights(vocabulary: str = VOCABULARY) -> tuple[list[str], np.ndarray]:
    """Pieces that lower-cased words can use, and first log probabilities (pieces, bytes, end).

    The file's scores rank its pieces (0, -1, -2, ...), so a piece's weight is the reciprocal of its
    rank. Bytes and the end get the weight of a piece after the last.
    """
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(vocabulary))
    pieces, weights = [], []
    for i in range(model.get_piece_size()):
        p = model.id_to_piece(i)
        if model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or MARK in p[1:] or any("A" <= c <= "Z" for c in p):
            continue
        pieces.append(p)
        weights.append(1.0 / (2.0 - min(0.0, model.get_score(i))))
    w = np.asarray(weights + [1.0 / (2.0 + model.get_piece_size())] * 257)
    return pieces, np.log(w / w.sum())


def _lower_words(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []  # bytes.lower changes A-Z only


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int | None, bytes | None]]:
    return zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True)


def _held_out(doc_id: int | None, folds: int) -> bool:
    return crc32(b"" if doc_id is None else str(doc_id).encode()) % folds == 0


def _strings(words: list[bytes]) -> pa.Array:
    return pa.array(words, pa.binary()).cast(pa.string())


def word_counts(docs: DataFrame, folds: int = FOLDS) -> DataFrame:
    """(word, c): every word of the corpus and how often training documents hold it; the null word is the end."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        ends = 0

        def rows() -> pa.RecordBatch:
            words = _strings(list(counts))
            c = pa.array(np.fromiter(counts.values(), np.int64, len(counts)))
            counts.clear()
            return pa.RecordBatch.from_arrays([words, c], ["word", "c"])

        for b in batches:
            for doc_id, text in _texts(b):
                words = _lower_words(text)
                if _held_out(doc_id, folds):
                    for w in words:
                        if w not in counts:
                            counts[w] = 0
                else:
                    counts.update(words)
                    ends += 1
                if len(counts) > HELD:
                    yield rows()
        yield rows()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([ends], pa.int64())], ["word", "c"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def fit_weights(words: DataFrame, lattice: Lattice, logp: np.ndarray, ends: int, rounds: int = ROUNDS) -> np.ndarray:
    """Log probabilities of pieces, bytes and end after expectation-maximisation over all words with a count."""
    ship(words.sparkSession)
    sc = words.sparkSession.sparkContext
    for _ in range(rounds):
        model = sc.broadcast((lattice, logp))

        def run(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            lattice, logp = model.value
            total = np.zeros(lattice.size)
            for b in batches:
                total += lattice.expected_counts(b.column(0).to_pylist(), b.column(1).to_numpy(), logp)
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["piece", "n"])

        sums = words.where("c > 0").select("word", "c").mapInArrow(run, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n"))
        expected = np.full(lattice.size, SMOOTHING)
        for r in sums.collect():  # a row per piece of the vocabulary at most
            expected[r["piece"]] += r["n"]
        expected[lattice.end] += ends
        logp = np.log(expected / expected.sum())
        model.unpersist()
    return logp


_PARTS = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("model", pa.float64()), ("first", pa.float64()), ("word", pa.string()), ("keys", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))])
_PARTS_DDL = "key long, doc_id long, n_tokens long, known long, base double, model double, first double, word string, keys array<long>, times array<int>"


def _parts(common):
    """Per document what its common words add up to; per uncommon word, the documents that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, known, base, model, first = common.value
        key = TaskContext.get().partitionId() << 36
        rare: dict[bytes, int] = {}
        posted: list[tuple[np.ndarray, np.ndarray, int]] = []
        held = 0

        def postings() -> pa.RecordBatch:
            ids = np.concatenate([p[0] for p in posted])
            times = np.concatenate([p[1] for p in posted])
            keys = np.repeat([p[2] for p in posted], [len(p[0]) for p in posted])
            order = np.argsort(ids, kind="stable")
            cuts = np.append(0, np.cumsum(np.bincount(ids, minlength=len(rare)))).astype(np.int32)
            n = len(rare)
            columns = {
                "word": _strings(list(rare)),
                "keys": pa.ListArray.from_arrays(cuts, keys[order]),
                "times": pa.ListArray.from_arrays(cuts, times[order].astype(np.int32)),
            }
            return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in _PARTS], schema=_PARTS)

        for b in batches:
            rows = []
            for doc_id, text in _texts(b):
                words = _lower_words(text)
                at = np.fromiter((number.get(w, -1) for w in words), np.int64, len(words))
                own = at[at >= 0]
                rows.append((key, doc_id, len(words) + 1, int(known[own].sum()), float(base[own].sum()), float(model[own].sum()), float(first[own].sum()), None, None, None))
                if len(own) < len(words):
                    mine = Counter(words[i] for i in np.flatnonzero(at < 0).tolist())
                    ids = np.fromiter((rare.setdefault(w, len(rare)) for w in mine), np.int64, len(mine))
                    posted.append((ids, np.fromiter(mine.values(), np.int64, len(mine)), key))
                    held += len(mine)
                key += 1
                if held > HELD:
                    yield postings()
                    rare.clear()
                    posted.clear()
                    held = 0
            yield from record_batches(rows, _PARTS)
        if posted:
            yield postings()

    return run


_MODELS = ("base", "model", "first")


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joined postings to one row per document: its uncommon words' part of known, base and model."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0

    def rows() -> pa.RecordBatch:
        keys = np.concatenate([h[0] for h in held])
        key, at = np.unique(keys, return_inverse=True)
        known, *sums = (np.bincount(at, np.concatenate([h[k] for h in held]), len(key)) for k in (1, 2, 3, 4))
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(known.astype(np.int64)), *map(pa.array, sums)], ["key", "known", *_MODELS])

    for b in batches:
        keys, times = b.column(0).flatten().to_numpy(), b.column(1).flatten().to_numpy()
        lengths = np.diff(b.column(0).offsets.to_numpy())
        held.append((keys, *(np.repeat(b.column(k).to_numpy(), lengths) * times for k in (2, 3, 4, 5))))
        size += len(keys)
        if size > 4 * HELD:
            yield rows()
            held, size = [], 0
    if held:
        yield rows()


def score_documents(docs: DataFrame, vocabulary: str = VOCABULARY, folds: int = FOLDS, common_words: int = COMMON, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score and first_score of every row."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    words = scratch.write(word_counts(docs, folds), "words")
    end, words = words.where("word is null"), words.where("word is not null")
    ends = end.agg(F.sum("c")).first()[0] or 0
    total, distinct = words.agg(F.sum("c"), F.sum(F.when(F.col("c") > 0, 1).otherwise(0))).first()
    total, distinct = (total or 0) + ends, (distinct or 0) + (ends > 0)

    pieces, first = pieces_and_weights(vocabulary)
    lattice = Lattice(pieces)
    logp = fit_weights(words, lattice, first, ends, rounds)

    floor = float(np.log10(total + 0.1 * (distinct + 1)))
    term = lambda c: np.log10(c + 0.1) - floor
    top = words.orderBy(F.desc("c"), "word").limit(common_words).select("word", "c").toArrow()
    names, c = top["word"].to_pylist(), top["c"].to_numpy()
    in_model = lambda w, lattice, *weights: np.stack(lattice.log_probabilities(w, list(weights))) / _LN10
    chunks = [in_model(names[i : i + 10_000], lattice, logp, first) for i in range(0, len(names), 10_000)]
    common = spark.sparkContext.broadcast(({w.encode(): i for i, w in enumerate(names)}, c > 0, term(c), *np.concatenate([np.zeros((2, 0)), *chunks], axis=1)))
    parts = scratch.write(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_parts(common), _PARTS_DDL), "parts")

    model = spark.sparkContext.broadcast((lattice, logp, first))

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = b.column(1).to_numpy()
            found = in_model(b.column(0).to_pylist(), *model.value)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array((c > 0).astype(np.int64)), pa.array(term(c)), *map(pa.array, found)], ["word", "known", *_MODELS])

    table_ = words.select("word", "c").mapInArrow(weighed, "word string, known long, base double, model double, first double")
    joined = parts.where("word is not null").select("word", "keys", "times").join(table_, "word").select("keys", "times", "known", *_MODELS)
    rest = joined.mapInArrow(_sums, "key long, known long, base double, model double, first double")
    own = parts.where("word is null").select("key", "doc_id", "n_tokens", "known", *_MODELS)
    sums = own.unionByName(rest, allowMissingColumns=True).groupBy("key").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), *(F.sum(x).alias(x) for x in ("known", *_MODELS))
    )
    return sums.select(
        "doc_id",
        "n_tokens",
        (F.col("known") + int(ends > 0)).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + float(term(ends))).alias("base_score"),
        (F.col("model") + float(logp[lattice.end] / _LN10)).alias("score"),
        (F.col("first") + float(first[lattice.end] / _LN10)).alias("first_score"),
    )


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import bucket_of_id

    scored = score_documents(table(spark, sf_dir, "documents"))
    return scored.withColumn("held_out", bucket_of_id("doc_id", FOLDS) == 0)
