"""LM scoring: counts and base score by the definition, the lattice by enumeration of segmentations."""

from __future__ import annotations

import math
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import lm_scoring as L
from tidemark.llm.lattice import MARK, Lattice

PIECES = [MARK, MARK + "a", "a", "b", "ab", "ba", "aba", MARK + "ab", "bb", "abab"]
SMALL = Lattice(PIECES)
rng = np.random.default_rng(5)
LOGP = np.log(rng.dirichlet(np.ones(SMALL.size)))


def by_enumeration(word):
    """Probability and expected piece counts, over all segmentations."""
    text = MARK + word
    number = {p: i for i, p in enumerate(PIECES)}

    def segment(at):
        if at == len(text):
            yield []
        for p, i in number.items():
            if text.startswith(p, at):
                yield from ([i, *rest] for rest in segment(at + len(p)))
        if at < len(text) and text[at] not in number:
            spelt = [SMALL.n + x for x in text[at].encode()]
            yield from ([*spelt, *rest] for rest in segment(at + 1))

    total, counts = 0.0, Counter()
    for pieces in segment(0):
        p = math.exp(sum(LOGP[i] for i in pieces))
        total += p
        for i in pieces:
            counts[i] += p
    return total, {i: c / total for i, c in counts.items()}


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("abcé", max_size=7), min_size=1, max_size=5))
def test_lattice_like_enumeration(words):
    got = SMALL.log_probability(words, LOGP)
    want = np.zeros(SMALL.size)
    times = np.arange(1.0, len(words) + 1)
    for w, g, t in zip(words, got, times, strict=True):
        p, counts = by_enumeration(w)
        assert g == pytest.approx(math.log(p))
        for i, c in counts.items():
            want[i] += t * c
    assert SMALL.expected_counts(words, times, LOGP) == pytest.approx(want)


def test_long_words_do_not_underflow():
    assert np.isfinite(SMALL.log_probability(["ab" * 3000, "é" * 2000], LOGP)).all()


def test_first_weights_are_probabilities():
    pieces, logp = L.pieces_and_weights()
    assert len(pieces) + 257 == len(logp) and np.exp(logp).sum() == pytest.approx(1)


def base(rows, folds=L.FOLDS):
    c, ends = Counter(), 0
    words = lambda t: (t or "").encode().lower().split()
    out = lambda i: crc32(("" if i is None else str(i)).encode()) % folds == 0
    for i, t in rows:
        if not out(i):
            c.update(words(t))
            ends += 1
    n, v = sum(c.values()) + ends, len(c) + (ends > 0)
    term = lambda x: math.log10((x + 0.1) / (n + 0.1 * (v + 1)))
    result = []
    for i, t in rows:
        w = words(t)
        result.append((str(i), out(i), len(w) + 1, sum(c[x] > 0 for x in w) + (ends > 0), n, round(sum(term(c[x]) for x in w) + term(ends), 6)))
    return sorted(result)


def seen(frame):
    rows = frame.collect()
    assert all(r.score < 0 for r in rows)
    return sorted((str(r.doc_id), crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % L.FOLDS == 0, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows)


def test_base_score_on_the_tables(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert seen(L.op3_lm_scoring(spark, sf)) == base(rows)


@pytest.mark.parametrize("common", [0, 3, 1000])
def test_odd_rows_and_few_common_words(spark, common):
    rows = [(i, t) for i, t in enumerate(["a b a", "", None, "A c\x0bc \xa0 é", "the the", "the " * 5000, "b", "ſ K", "x"] * 4)] + [(None, "a"), (None, None), (5, "a b"), (5, "a b")]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, word string").repartition(3)
    assert seen(L.score_documents(docs, common_words=common, rounds=1)) == base(rows)


def test_scores_do_not_depend_on_what_is_common(spark):
    rows = [(i, f"the word {i % 3} of the {i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    a, b = ({r.doc_id: r.score for r in L.score_documents(docs, common_words=n, rounds=1).collect()} for n in (2, 1000))
    assert a == pytest.approx(b)


def test_no_rows_and_no_training_rows(spark):
    assert L.score_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    held = next(i for i in range(100) if crc32(str(i).encode()) % L.FOLDS == 0)
    assert seen(L.score_documents(spark.createDataFrame([(held, "a b")], "doc_id long, text string"), rounds=1)) == base([(held, "a b")])


def plain_model(rows, rounds):
    """{row: (log10 probability, by the first weights too)}, segmentation by segmentation of dictionaries, words one by one."""
    pieces, logp = L.pieces_and_weights()
    number = {p: i for i, p in enumerate(pieces)}
    n, longest = len(pieces), max(map(len, pieces))
    out = lambda i: crc32(("" if i is None else str(i)).encode()) % L.FOLDS == 0
    words = lambda t: [w.decode() for w in (t or "").encode().lower().split()]

    def steps(text, at):
        found = [(k, (number[text[at:k]],)) for k in range(at + 1, min(len(text), at + longest) + 1) if text[at:k] in number]
        return found if text[at] in number else [*found, (at + 1, tuple(n + x for x in text[at].encode()))]

    def forward(text, w):
        total = [1.0] + [0.0] * len(text)
        for at in range(len(text)):
            for k, used in steps(text, at):
                total[k] += total[at] * math.prod(w[i] for i in used)
        return total

    first = w = np.exp(logp)
    for _ in range(rounds):
        counts = np.full(len(w), L.SMOOTHING)
        for i, t in rows:
            if out(i):
                continue
            counts[n + 256] += 1
            for word in words(t):
                text = MARK + word
                alpha, beta = forward(text, w), [0.0] * len(text) + [1.0]
                for at in range(len(text) - 1, -1, -1):
                    beta[at] = sum(math.prod(w[i] for i in used) * beta[k] for k, used in steps(text, at))
                for at in range(len(text)):
                    for k, used in steps(text, at):
                        for i in used:
                            counts[i] += alpha[at] * math.prod(w[j] for j in used) * beta[k] / alpha[-1]
        w = counts / counts.sum()
    score = lambda t, w: sum(math.log10(forward(MARK + x, w)[-1]) for x in words(t)) + math.log10(w[n + 256])
    return [(score(t, w), score(t, first)) for _, t in rows]


@pytest.mark.parametrize("rounds,common", [(0, 1000), (1, 3), (2, 0)])
def test_score_like_plain_segmentation(spark, rounds, common):
    texts = ["the quick brown fox", "The thing, unbelievable!", "", None, "漢字 and é", "aaaa bbbb the", "x" * 40 + " end", "the the the", "\u00a0 odd", "internationalisation"]
    rows = list(enumerate(texts * 2))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in L.score_documents(docs, common_words=common, rounds=rounds).collect()}
    for (i, _), (score, first) in zip(rows, plain_model(rows, rounds), strict=True):
        assert got[i].score == pytest.approx(score) and got[i].first_score == pytest.approx(first)
