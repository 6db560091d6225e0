"""Importance resampling: documents drawn for how much their hashed n-grams look like a target's.

Features are the n-grams of a text's words, hashed to buckets. A bucket's gain is the logarithm of its share
in the target over its share in the documents; a document weighs the sum of its features' gains, and of the
documents that are long enough those of highest weight plus seeded Gumbel noise are drawn.

Hashing each occurrence of each n-gram would be the bulk of the work, so occurrences are brought together
first. In each task, the words of a group of texts get numbers, and the suffixes of the texts are sorted by
their first words, by doubling the length that is sorted by; equal n-grams are then runs of neighbours that
share n words or more (the LCP array). Each run is hashed once, and its bucket scattered back to where its
suffixes begin. Runs end at documents' ends.

How it scales: texts are read once. A row per document with its buckets and their counts, a fraction of the
text, is written to the shared folder; totals come from one row per task and bucket, and weights from an
array of all gains (`buckets` numbers, a parameter, whatever the size of the corpus), which is sent to the
tasks. The order of scores is cut into ranges.

Defined results: a null text has no words, weight 0 and, like any text of fewer than `least_words` words,
null rank; a null id takes part as the empty text in the noise and comes first among ties; rows that repeat an
id share its noise and are ranked one by one (equal rows in any order); with no target or no documents all
counts are 0; an empty table gives an empty table; texts may be of any length; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.numbering import number_rows
from .common import Scratch, ship, table

MAX_WORDS = 1
BUCKETS = 10_000
#: Documents of fewer words are not drawn; of the others, this many of 100 are.
LEAST_WORDS = 20
SHARE = 10
SEED = "2024"
#: Bytes of texts that are sorted together, at least, unless there are no more.
_TOGETHER = 6 << 20
#: What each byte becomes: A-Z small letters, signs and control characters a separator, the rest themselves.
_BYTES = np.asarray([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)


def numbered_words(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words, the words of all texts in order as numbers, and how many each text has."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, texts.offset + len(texts) + 1)[texts.offset :]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    plain = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets - offsets[0]), pa.py_buffer(_BYTES[data]))
    parts = pc.ascii_split_whitespace(plain)
    counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    words = parts.flatten()
    real = pc.not_equal(words, "").to_numpy(zero_copy_only=False)  # white space at the ends leaves empty words
    if not real.all():
        kept = np.append(0, np.cumsum(real))[np.append(0, np.cumsum(counts))]
        counts, words = np.diff(kept), words.filter(pa.array(real))
    coded = words.dictionary_encode()
    return coded.dictionary.cast(pa.large_binary()).to_pylist(), coded.indices.to_numpy().astype(np.int64), counts


def suffixes(words: np.ndarray, left: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of all suffixes, sorted by their first `depth` words, and the number of words that each shares with the one before.

    `left` is the number of words from a place to its text's end, past which suffixes do not reach; words shared are counted up to depth.
    """
    n = len(words)
    rank, done = words + 1, 1
    while done < depth:
        after = np.zeros(n, np.int64)
        more = np.flatnonzero(left > done)
        after[more] = rank[more + done]
        rank = np.unique(rank * (int(rank.max(initial=0)) + 1) + after, return_inverse=True)[1] + 1
        done *= 2
    order = np.argsort(rank, kind="stable")
    shared = np.zeros(n, np.int64)
    alike = np.arange(1, n)
    for k in range(depth):
        a, b = order[alike - 1], order[alike]
        alike = alike[(left[a] > k) & (left[b] > k)]
        a, b = order[alike - 1], order[alike]
        alike = alike[words[a + k] == words[b + k]]
        shared[alike] = k + 1
    return order, shared


def features(texts: pa.Array, max_words: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text the number of words and of features; and of all (text, bucket) that occur, in order, the text, the bucket, and how often."""
    names, words, counts = numbered_words(texts)
    ends = np.cumsum(counts)
    text_of = np.repeat(np.arange(len(counts)), counts)
    left = ends[text_of] - np.arange(len(words)) if len(words) else np.zeros(0, np.int64)
    order, shared = suffixes(words, left, max_words)
    found = []
    for n in range(1, max_words + 1):
        begins = np.flatnonzero(shared < n)
        begins = np.append(begins, len(order))
        size = np.diff(begins)
        first = order[begins[:-1]]
        whole = left[first] >= n  # all suffixes of a run reach as far as its first, or none does
        if n == 1:
            hashed = [zlib.crc32(names[w]) % buckets for w in words[first[whole]].tolist()]
        else:
            hashed = [zlib.crc32(b" ".join([names[w] for w in words[p : p + n].tolist()])) % buckets for p in first[whole].tolist()]
        bucket = np.full(len(size), -1, np.int64)
        bucket[whole] = hashed
        at = np.empty(len(order), np.int64)
        at[order] = np.repeat(bucket, size)
        real = at >= 0
        found.append(text_of[real] * buckets + at[real])
    keys, often = np.unique(np.concatenate(found), return_counts=True)
    n_features = sum(np.maximum(counts - n + 1, 0) for n in range(1, max_words + 1))
    return counts, n_features, keys // buckets, keys % buckets, often


def bucketed(docs: DataFrame, columns: list[str], max_words: int = MAX_WORDS, buckets: int = BUCKETS) -> DataFrame:
    """`columns` of docs, n_words, n_features, and the buckets of each text's features with their counts."""
    ship(docs.sparkSession)
    names = [*columns, "n_words", "n_features", "buckets", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.num_columns - 1)
            size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < b.num_rows:
                to = min(b.num_rows, int(np.searchsorted(size, (size[at - 1] if at else 0) + _TOGETHER)) + 1)
                n_words, n_features, text, bucket, often = features(texts.slice(at, to - at), max_words, buckets)
                cuts = pa.array(np.searchsorted(text, np.arange(to - at + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(cuts, pa.array(x.astype(np.int32))) for x in (bucket, often)]
                own = [b.column(k).slice(at, to - at) for k in range(len(columns))]
                yield pa.RecordBatch.from_arrays([*own, pa.array(n_words), pa.array(n_features), *lists], names)
                at = to

    rows = docs.select(*columns, F.col("text").cast("string").alias("_text"))
    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    return rows.mapInArrow(run, ", ".join([*types, "n_words long, n_features long, buckets array<int>, counts array<int>"]))


def totals(rows: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: the features of all rows; a task hands on at most a row per bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for b in batches:
            sums += np.bincount(b.column(0).flatten().to_numpy(), b.column(1).flatten().to_numpy(), buckets).astype(np.int64)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], ["bucket", "n"])

    return rows.select("buckets", "counts").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain of the buckets that occur, from (bucket, n) of both sides."""
    both = corpus.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    each = both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    size = each.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("all_s"), F.coalesce(F.sum("t"), F.lit(0)).alias("all_t"))
    d = lambda c: F.col(c).cast("double")
    share = (d("t") + 1) * (d("all_s") + buckets) / ((d("s") + 1) * (d("all_t") + buckets))
    return each.crossJoin(F.broadcast(size)).select("bucket", F.floor(1000 * F.log(share)).alias("gain"))  # one row beside


def weighed(rows: DataFrame, gain: np.ndarray, columns: list[str]) -> DataFrame:
    """`columns`, n_words, n_features and weight of rows as `bucketed` makes them."""
    ship(rows.sparkSession)
    names = [*columns, "n_words", "n_features"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bucket, often = (b.column(len(names) + k).flatten().to_numpy().astype(np.int64) for k in (0, 1))
            cuts = np.append(0, np.cumsum(pc.list_value_length(b.column(len(names))).to_numpy().astype(np.int64)))
            upto = np.append(0, np.cumsum(gain[bucket] * often))
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in range(len(names))], pa.array(np.diff(upto[cuts]))], [*names, "weight"])

    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*names).schema.fields]
    return rows.select(*names, "buckets", "counts").mapInArrow(run, ", ".join([*types, "weight long"]))


def noise(doc_id: str = "doc_id", seed: str = SEED) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of a digest of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, max_words: int = MAX_WORDS, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, share: int = SHARE, seed: str = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (null: not drawn) of every row of docs (doc_id, text), for a target with a column text."""
    scratch = Scratch(docs.sparkSession, "resample")
    rows = scratch.write(bucketed(docs.select(F.col("doc_id").cast("long"), "text"), ["doc_id"], max_words, buckets), "rows")
    found = gains(totals(rows, buckets), totals(bucketed(target, [], max_words, buckets), buckets), buckets).toPandas()  # a row per bucket
    gain = np.zeros(buckets, np.int64)
    gain[found["bucket"].to_numpy(np.int64)] = found["gain"].to_numpy(np.int64)
    scored = weighed(rows, gain, ["doc_id"]).withColumn("score", F.col("weight") + noise(seed=seed))
    scored = scratch.write(scored, "scored")
    scratch.drop("rows")
    long = scored.where(F.col("n_words") >= least_words)
    drawn = share * long.count() // 100
    order = [F.desc("score"), F.asc_nulls_first("doc_id"), "n_features", "_tie"]
    ranked = number_rows(long.withColumn("_tie", F.monotonically_increasing_id()), *order, name="rank").drop("_tie")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    short = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(short)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


#: The CRC-32 of a word's UTF-8 bytes is taken byte by byte, from the table that its polynomial gives.
OP12_SQL = r"""
WITH RECURSIVE steps AS (
  SELECT range::BIGINT AS byte, range::BIGINT AS c, 0 AS k FROM range(256)
  UNION ALL
  SELECT byte, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
crc_table AS (
  SELECT list(c ORDER BY byte) AS entries FROM steps WHERE k = 8),
texts AS (
  SELECT 0 AS side, doc_id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
split AS (
  SELECT side, doc_id,
    coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM texts),
counted AS (
  SELECT side, doc_id, word, count(*) AS n FROM (SELECT side, doc_id, unnest(w) AS word FROM split) GROUP BY ALL),
bytes AS (
  SELECT word, list_transform(range(0, octet_length(encode(word))), lambda i: ('0x' || substr(hex(encode(word)), (2 * i + 1)::BIGINT, 2))::BIGINT) AS b
  FROM (SELECT DISTINCT word FROM counted)),
hashed AS (
  SELECT word, xor(list_reduce(list_concat([4294967295], b), lambda c, x: xor(entries[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) % 10000 AS bucket
  FROM bytes, crc_table),
buckets AS (
  SELECT bucket, coalesce(sum(n) FILTER (side = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 1), 0)::DOUBLE AS t
  FROM counted JOIN hashed USING (word) GROUP BY bucket),
gained AS (
  SELECT bucket, floor(1000 * ln((t + 1) * ((sum(s) OVER ()) + 10000) / ((s + 1) * ((sum(t) OVER ()) + 10000))))::BIGINT AS gain FROM buckets),
weights AS (
  SELECT doc_id, sum(n * gain)::BIGINT AS weight
  FROM counted JOIN hashed USING (word) JOIN gained USING (bucket) WHERE side = 0 GROUP BY doc_id),
scored AS (
  SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM split LEFT JOIN weights USING (doc_id) WHERE side = 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS FIRST) AS place, count(*) FILTER (n_features >= 20) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank FROM ranked
"""
