"""Quality rules: weak supervision in place of an all-must-pass filter.

Every rule looks at one quantity of a text and votes good, bad, or abstains. What is usual is learnt from
the corpus without labels: a rule's centre and spread are the median and the quartiles' distance over all
documents that pass the base conditions. Near the centre it votes good, far from it bad, and between it
abstains. How often each combination of votes occurs is counted over the same documents (at most 3^rules
combinations, whatever the number of documents); expectation-maximisation on these counts estimates each
rule's accuracy on good and on bad documents and the share of good ones; a document's verdict is the
posterior probability that it is good, given its votes. A rule that often faults good documents thus
weighs little, and a document is rejected by rules that agree, not by any one of them. Two base
conditions reject a document before any verdict.

Defined results: a null text is the empty text: no words, so base_failed; ties of the posterior with
the threshold keep the document; repeated rows and null ids are rows like any other; an empty table,
and one of which no document passes the base conditions, has no posterior to learn: all posteriors are
then those of the prior; texts of any length are counted whole, each by one task; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textstats
from .common import Scratch, table

#: A posterior from here on keeps the document.
KEEP_FROM = 0.5
MIN_WORDS = 50
#: Of the words, the per cent in repeated three-word windows above which the base conditions reject.
MAX_REPEAT_PERCENT = 50
#: Spreads from the centre within which a rule votes good, and beyond which bad.
GOOD_WITHIN, BAD_BEYOND = 1.5, 3.0
#: Relative error of the medians and quartiles is at most one part in so many.
ACCURACY = 10_000
#: What is believed before any document is seen, each worth PRIOR_DOCUMENTS documents: the share of good
#: documents, and a rule's two accuracies.
GOOD, RIGHT_ON_GOOD, RIGHT_ON_BAD, PRIOR_DOCUMENTS = 0.9, 0.95, 0.5, 1.0


class Rule(NamedTuple):
    """`least`: the least spread that means anything; `side`: 1 faults large values, -1 small ones, 0 both."""

    name: str
    quantity: str
    side: int
    least: float


RULES = (
    Rule("symbols", "n_symbols / greatest(n_words, 1)", 1, 0.05),
    Rule("word_length", "word_chars / greatest(n_words, 1)", 0, 0.3),
    Rule("short_words", "n_short_words / greatest(n_words, 1)", 0, 0.03),
    Rule("top_word", "n_top_word / greatest(n_words, 1)", 1, 0.02),
    Rule("repetition", "n_repeat_words / greatest(n_words, 1)", 1, 0.05),
    Rule("duplicate_lines", "n_dup_lines / greatest(n_lines, 1)", 1, 0.05),
    Rule("variety", "if(n_words > 1, ln(n_distinct) / ln(n_words), 1)", -1, 0.02),
    Rule("stops", "n_stops / greatest(n_words, 1)", 0, 0.03),
    Rule("digits", "n_digits / greatest(word_chars, 1)", 1, 0.01),
)
_SCHEMA = "doc_id long, " + ", ".join(f"{n} long" for n in textstats.COUNTS)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", *textstats.COUNTS]
    for b in batches:
        rows = np.asarray([textstats.rule_counts(x or b"") for x in b.column(1).cast(pa.binary()).to_pylist()], np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c) for c in rows.reshape(-1, len(textstats.COUNTS)).T)], names)


def counted(docs: DataFrame) -> DataFrame:
    """Counts of every whole text, and base_failed."""
    counts = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_counts, _SCHEMA)
    return counts.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def usual(counts: DataFrame) -> list[tuple[float, float]]:
    """Each rule's centre and spread over all documents that pass the base conditions."""
    quartiles = [F.percentile_approx(F.expr(r.quantity), [0.25, 0.5, 0.75], ACCURACY).alias(r.name) for r in RULES]
    found = counts.where("not base_failed").agg(*quartiles).first()
    return [(q[1], max(q[2] - q[0], r.least)) if q else (0.0, 1.0) for r, q in zip(RULES, found, strict=True)]


def votes_of(centres: list[tuple[float, float]]) -> Column:
    """A character per rule: + good, - bad, 0 abstains."""

    def vote(rule: Rule, centre: float, spread: float) -> Column:
        off = (F.expr(rule.quantity) - centre) / spread
        off = F.abs(off) if rule.side == 0 else off * rule.side
        return F.when(off <= GOOD_WITHIN, "+").when(off > BAD_BEYOND, "-").otherwise("0")

    return F.concat(*[vote(r, *c) for r, c in zip(RULES, centres, strict=True)])


def estimate(patterns: dict[str, int], rounds: int = 500) -> tuple[float, np.ndarray, np.ndarray]:
    """The share of good documents and each rule's two accuracies, by expectation-maximisation.

    Where a rule votes, it is right on good documents with its first accuracy and on bad ones with its
    second. Abstaining tells nothing. The priors are worth PRIOR_DOCUMENTS documents each, so that they
    keep estimates inside (0, 1) and say which of the two classes is the good one, and no more.
    """
    votes = _signs(patterns)
    n_rules = votes.shape[1]
    weight = np.asarray(list(patterns.values()), float)
    good, on_good, on_bad = GOOD, np.full(n_rules, RIGHT_ON_GOOD), np.full(n_rules, RIGHT_ON_BAD)
    for _ in range(rounds if len(weight) else 0):
        q = posterior(votes, good, on_good, on_bad)
        as_good, as_bad = weight * q, weight * (1 - q)
        new_good = (as_good @ (votes > 0) + PRIOR_DOCUMENTS * RIGHT_ON_GOOD) / (as_good @ (votes != 0) + PRIOR_DOCUMENTS)
        new_bad = (as_bad @ (votes < 0) + PRIOR_DOCUMENTS * RIGHT_ON_BAD) / (as_bad @ (votes != 0) + PRIOR_DOCUMENTS)
        share = float((as_good.sum() + PRIOR_DOCUMENTS * GOOD) / (weight.sum() + PRIOR_DOCUMENTS))
        moved = max(abs(share - good), float(np.abs(new_good - on_good).max()), float(np.abs(new_bad - on_bad).max()))
        good, on_good, on_bad = share, new_good, new_bad
        if moved < 1e-10:
            break
    return good, on_good, on_bad


def _signs(patterns: Iterable[str]) -> np.ndarray:
    rows = [[{"+": 1, "-": -1}.get(v, 0) for v in p] for p in patterns]
    return np.asarray(rows, float) if rows else np.zeros((0, len(RULES)))


def vote_weights(on_good: np.ndarray, on_bad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a good and a bad vote of each rule add to the log odds that the document is good."""
    return np.log(on_good / (1 - on_bad)), np.log((1 - on_good) / on_bad)


def posterior(votes: np.ndarray, good: float, on_good: np.ndarray, on_bad: np.ndarray) -> np.ndarray:
    plus, minus = vote_weights(on_good, on_bad)
    return 1 / (1 + np.exp(-(np.log(good / (1 - good)) + (votes > 0) @ plus + (votes < 0) @ minus)))


def judge(docs: DataFrame, keep_from: float = KEEP_FROM) -> DataFrame:
    """Counts, base_failed, votes, posterior and kept of every document."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "rules")
    counts = scratch.write(counted(docs), "counted")
    voted = counts.withColumn("votes", votes_of(usual(counts)))
    found = {r["votes"]: r["count"] for r in voted.where("not base_failed").groupBy("votes").count().collect()}  # 3^rules rows at most
    patterns = dict(sorted(found.items()))
    good, on_good, on_bad = estimate(patterns)
    odds = F.lit(float(np.log(good / (1 - good))))
    for k, (plus, minus) in enumerate(zip(*vote_weights(on_good, on_bad), strict=True)):
        vote = F.substring("votes", k + 1, 1)
        odds = odds + F.when(vote == "+", float(plus)).when(vote == "-", float(minus)).otherwise(0.0)
    chance = 1 / (1 + F.exp(-odds))
    return voted.withColumn("posterior", chance).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= keep_from))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior"
    )


def quality_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of op2_quality_rules, which SQL can express too."""
    return op2_quality_rules(spark, sf_dir).drop("kept", "posterior")


BASE_COUNTS_SQL = r"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
split AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM texts
),
placed AS (SELECT r, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM split),
windows AS (
  SELECT r, i, w, lead(w, 1) OVER along AS w1, lead(w, 2) OVER along AS w2
  FROM placed WINDOW along AS (PARTITION BY r ORDER BY i)
),
repeated AS (SELECT r, i FROM windows WHERE w2 IS NOT NULL QUALIFY count(*) OVER (PARTITION BY r, w, w1, w2) > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM repeated, (VALUES (0), (1), (2)) AS v(k) GROUP BY r),
counts AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM split LEFT JOIN covered USING (r)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts
"""
