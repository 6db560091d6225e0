"""Quality classifier and quality rules."""

from __future__ import annotations

import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import gbt, textstats
from tidemark.llm import quality_classifier as Q
from tidemark.llm import quality_rules as R

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    """The base quantities by their definitions."""
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    lines = sum(bool(WORD.search(x)) for x in text.split("\n"))
    short, top = sum(len(w.encode()) <= 3 for w in words), max(Counter(words).values(), default=0)
    base = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered))
    return (*base, lines, short, top, len(set(words)), sum(c in ".!?" for c in text), sum(c in "0123456789" for c in text))


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.text(max_size=60), st.lists(st.sampled_from(["a", "b", " ", "\n", "\x0b", "é#", "😀", "\x1c", "c|d ", "7.", "word!"]), max_size=60).map("".join)))
def test_counts_by_definition(text):
    text = text.encode("utf-8", "ignore").decode()
    assert textstats.rule_counts(text.encode()) == plain_counts(text)


def test_windows_of_many_distinct_words():
    ids = np.arange(3_000_000) % 2_500_000
    assert textstats.repeated_window_words(ids) == 1_000_000


def test_rules_on_the_tables(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = R.op2_quality_rules(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        counts = plain_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts[:5]
        assert r.base_failed == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])
        assert not (r.base_failed and r.kept)
        if not r.base_failed and r.doc_id in labels:
            assert r.kept == (labels[r.doc_id] == 1)


def plain_posterior(votes, good, on_good, on_bad):
    """Bayes' rule, a vote at a time."""
    as_good, as_bad = good, 1 - good
    for v, a, b in zip(votes, on_good, on_bad, strict=True):
        if v != "0":
            as_good *= a if v == "+" else 1 - a
            as_bad *= b if v == "-" else 1 - b
    return as_good / (as_good + as_bad)


def test_posterior_of_rows_is_bayes_rule(spark):
    rows = [(i, f"a word of {i} kinds. " * (13 + i) if i % 5 else f"# {i} | " * 60) for i in range(60)] + [(None, None), (7, "")]
    rows = [(i, " ".join(f"{w}{k}" if k % 3 else w for k, w in enumerate((t or "").split())) if t else t) for i, t in rows]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, votes string")
    got = R.judge(docs).collect()
    passed = [r for r in got if not r.base_failed]
    assert len(got) == len(rows) and passed
    model = R.estimate(dict(sorted(Counter(r.votes for r in passed).items())))
    for r in got:
        assert r.posterior == pytest.approx(plain_posterior(r.votes, *model))
        assert r.kept == (not r.base_failed and r.posterior >= R.KEEP_FROM)
    for k, rule in enumerate(R.RULES):  # votes by the definition, from quartiles over what passes
        x = np.sort([float(v) for v in R.judge(docs).where("not base_failed").selectExpr(f"{rule.quantity} q").toPandas().q])
        low, mid, high = (x[max(0, int(np.ceil(len(x) * q)) - 1)] for q in (0.25, 0.5, 0.75))
        for r in R.judge(docs).selectExpr("votes", f"{rule.quantity} q").collect():
            off = (float(r.q) - mid) / max(high - low, rule.least)
            off = abs(off) if rule.side == 0 else off * rule.side
            assert r.votes[k] == ("+" if off <= R.GOOD_WITHIN else "-" if off > R.BAD_BEYOND else "0")
        if k == 2:
            break
    assert R.judge(docs.limit(0)).count() == 0
    assert not any(r.kept for r in R.judge(docs.where("doc_id is null or text = ''")).collect())


def test_estimates_find_planted_accuracies():
    rng = np.random.default_rng(2)
    n, k = 40_000, len(R.RULES)
    bad = rng.random(n) < 0.25
    detect = np.linspace(0.3, 0.8, k)
    votes = np.where(rng.random((n, k)) < np.where(bad[:, None], detect, 0.004), "-", "+")
    votes[rng.random((n, k)) < 0.1] = "0"
    good, on_good, on_bad = R.estimate(dict(Counter(map("".join, votes))))
    assert good == pytest.approx(0.75, abs=0.02)
    assert on_bad == pytest.approx(detect, abs=0.05) and (on_good > 0.99).all()


def test_posterior_beats_all_must_pass_with_weak_and_correlated_rules():
    rng = np.random.default_rng(3)
    n, k = 30_000, len(R.RULES)
    bad = rng.random(n) < 0.1
    # two weak rules fault every twelfth good document; two others see one defect, so their votes agree
    wrong = np.asarray([0.08, 0.08, *[0.002] * (k - 2)])
    detect = np.asarray([0.2, 0.1, *np.linspace(0.5, 0.9, k - 2)])
    minus = rng.random((n, k)) < np.where(bad[:, None], detect, wrong)
    same = rng.random(n) < 0.8
    minus[same, 3] = minus[same, 2]
    votes = ["".join("-" if x else "+" for x in row) for row in minus]
    model = R.estimate(dict(Counter(votes)))
    chance = {v: plain_posterior(v, *model) for v in set(votes)}
    kept = np.asarray([chance[v] >= R.KEEP_FROM for v in votes])
    right, plain = (kept == ~bad).mean(), (~minus.any(axis=1) == ~bad).mean()
    assert right > 0.99 and plain < 0.87
    assert (kept[~bad].mean(), 1 - kept[bad].mean()) > (0.99, 0.95)


def test_forest_fits_and_agrees_with_walking_it():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    f = gbt.fit(x, y, trees=40)
    p = f.probability(x)
    assert ((p > 0.5) == y).mean() > 0.98

    def walk(row):
        total = f.base
        for node in f.roots:
            while f.feature[node] >= 0:
                node = f.left[node] if row[f.feature[node]] <= f.threshold[node] else f.right[node]
            total += f.value[node]
        return total

    assert f.margin(x[:50]) == pytest.approx([walk(r) for r in x[:50]])


@pytest.mark.parametrize("y", [[], [1.0] * 5, [0.0] * 5])
def test_one_class_or_no_rows(y):
    f = gbt.fit(np.zeros((len(y), 2)), y)
    assert f.probability(np.zeros((3, 2))) == pytest.approx([np.clip(np.mean(y), 1e-4, 1 - 1e-4) if y else 0.5] * 3)


def plain_features(text):
    """The document statistics, each by its definition."""
    words = text.split()
    if not words:
        return [0.0] * len(textstats.FEATURES)
    size, n, lengths, times = len(text), len(words), [len(w) for w in words], Counter(words)
    count = lambda chars: sum(c in chars for c in text)
    mean = sum(lengths) / n
    lines = text.count(b"\n") + 1
    counts = plain_counts(text.decode())
    return [
        np.log1p(n), np.log1p(size), mean, (sum((x - mean) ** 2 for x in lengths) / n) ** 0.5, len(times) / n,
        max(times.values()) / n, sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, counts[4] / n,
        counts[3] / lines, n / lines, sum(65 <= c <= 90 for c in text) / size, sum(48 <= c <= 57 for c in text) / size,
        sum(c >= 128 for c in text) / size, count(b" \t\n\r") / size, *(count(x) / n for x in (b"#*", b"$%&", b"|", b"<>", b"!", b"?", b",", b".", b"\"'", b"()[]{}", b"/:@")),
        sum(x <= 3 for x in lengths) / n, sum(x >= 12 for x in lengths) / n, np.log1p(len(times)),
    ]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["a", "the", " ", " ", "\n", "é", "Q7", "#", "$", "|", "<", "!", "?", ",", ".", "'", "(", "@", "longishwords", "\x0b", "a a a "]), max_size=50).map("".join))
def test_features_by_definition(text):
    assert textstats.features(text.encode()) == pytest.approx(plain_features(text.encode()))


def test_sample_is_bounded_and_the_same_in_any_order(spark):
    rows = [(1 + i % 40, f"w{i} " * (i % 17 + 1)) for i in range(1, 900)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 41)] + [(None, 1)], "doc_id long, quality int")
    a, b = (Q.sampled(spark.createDataFrame(x, "doc_id long, text string").repartition(p), labels, 5) for x, p in ((rows, 2), (rows[::-1], 5)))
    key = lambda t: sorted((r["label"], *r["x"]) for r in t.to_pylist())
    assert a.num_rows == 10 and key(a) == key(b)
    odd = spark.createDataFrame([(1, 1), (1, None), (2, 0), (2, 0), (3, 0), (3, 1), (None, 1), (4, None), (6, 1)], "doc_id long, quality int")
    kept = {r.doc_id for r in Q.training_labels(odd).collect()}
    assert kept == {i for i in (2, 6) if crc32(str(i).encode()) % 5}


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = Q.op1_quality_classifier(spark, sf).collect()
    assert len(got) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    assert np.mean([a == b for a, b in held]) > 0.95


def test_odd_rows_and_labels(spark):
    docs = spark.createDataFrame([(None, None, 1.0), (1, "", 2.0), (1, "", 2.0), (2, "x " * 100_000, 3.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(2, 1), (2, 0), (3, None), (None, 1)], "doc_id long, quality int")
    forest = Q.fit(docs, labels)
    assert [r.score for r in Q.score_documents(docs, forest).collect()] == [0.5] * 4
    assert Q.keep_documents(docs, forest).count() == 4 and Q.keep_documents(docs, forest, 0.6).dtypes == docs.dtypes
    assert Q.score_documents(docs.limit(0), forest).count() == 0
