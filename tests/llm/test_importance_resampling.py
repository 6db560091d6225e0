"""Importance resampling against brute force over every occurrence of every n-gram."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import importance_resampling as R

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text, n):
    w = WORD.findall((text or "").translate(LOWER))
    return w, [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def brute(docs, target, n=1, buckets=10_000, share=10, least=20, seed="2024"):
    of = lambda g: zlib.crc32(g.encode()) % buckets
    s = Counter(of(g) for _, text in docs for g in grams(text, n)[1])
    t = Counter(of(g) for text in target for g in grams(text, n)[1])
    all_s, all_t = s.total(), t.total()
    rows = []
    for doc_id, text in docs:
        w, g = grams(text, n)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in map(of, g))
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append((doc_id, len(w), len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    long = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[2]))
    drawn = share * len(long) // 100
    ranked = [(*r, k + 1 if k < drawn else None) for k, r in enumerate(long)] + [(*r, None) for r in rows if r[1] < least]
    return sorted(ranked, key=repr)


def seen(frame):
    return sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_features", "weight", "score", "rank")) for r in frame.collect()), key=repr)


def some(rng, n):
    words = ["alpha", "Beta", "GAMMA", "été", "ÉTÉ", "x1", "9", "日本", "of", "of", "the", "the-the"]
    return [(i, " ".join(rng.choice(words, int(rng.integers(0, 60))))) for i in range(n)]


@pytest.mark.parametrize("n", [1, 2, 3, 5])
@pytest.mark.parametrize("together", [1, 1 << 20])
def test_like_brute_force(spark, monkeypatch, n, together):
    monkeypatch.setattr(R, "_TOGETHER", together)
    rng = np.random.default_rng(n)
    docs, target = some(rng, 80), [t for _, t in some(rng, 9)]
    found = R.resample(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame([(t,) for t in target], "text string"), max_words=n, buckets=97, least_words=5)
    assert seen(found) == brute(docs, target, n, 97, least=5)


def test_odd_rows_and_columns(spark):
    long = "word other " * 40_000
    docs = [(None, None), (None, long), (1, ""), (2, "\x00 ,.;-_ \n"), (3, "A1b2 ÀB\x7fc"), (4, long), (4, long), (4, "some " * 25), (5, "same " * 30), (6, "same " * 30), (7, "y" * 300_000)]
    wide = [(*d, "x", 1, 2.0) for d in docs]
    frame = spark.createDataFrame(wide, "doc_id long, text string, weight string, rank int, _text double").repartition(3)
    target = spark.createDataFrame([("some word", 1), (None, 2), ("", 3)], "text string, bucket int")
    want = brute(docs, ["some word", None, ""], share=50)
    assert seen(R.resample(frame, target, share=50)) == want
    assert seen(R.resample(frame, target.limit(0), share=50)) == brute(docs, [], share=50)
    assert seen(R.resample(frame.limit(0), target)) == []


def test_rows_that_repeat_are_ranked_one_by_one(spark):
    docs = [(7, "one two three " * 10)] * 300 + [(i, "four five " * 15) for i in range(100)]
    found = R.resample(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame([("one",)], "text string"), share=90)
    assert seen(found) == brute(docs, ["one"], share=90)
    assert sorted(r.rank for r in found.collect() if r.rank) == list(range(1, 361))


def test_suffixes_in_order_with_words_shared():
    rng = np.random.default_rng(8)
    for depth in (1, 2, 3, 4, 7):
        counts = rng.integers(0, 12, 30)
        ends = np.cumsum(counts)
        words = rng.integers(0, 3, ends[-1])
        left = np.repeat(ends, counts) - np.arange(len(words))
        order, shared = R.suffixes(words, left, depth)
        suffix = [tuple(words[p : p + min(depth, left[p])].tolist()) for p in order]
        assert suffix == sorted(suffix) and sorted(order.tolist()) == list(range(len(words)))
        for k in range(1, len(suffix)):
            a, b = suffix[k - 1], suffix[k]
            assert shared[k] == next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def test_repeated_ngrams_are_hashed_once(monkeypatch):
    hashed = []
    monkeypatch.setattr(R.zlib, "crc32", lambda b, own=zlib.crc32: hashed.append(b) or own(b))
    R.features(pa.array(["a b a b a b", "a b", None, "b a b"]), 2, 100)
    assert sorted(hashed) == [b"a", b"a b", b"b", b"b a"]


def test_words_at_all_ends():
    names, words, counts = R.numbered_words(pa.array(["xx", " A  b ", "", None, "..", "c,A", " é\x1f9"]).slice(1))
    assert counts.tolist() == [2, 0, 0, 0, 2, 2]
    assert [names[w].decode() for w in words] == ["a", "b", "c", "a", "é", "9"]
