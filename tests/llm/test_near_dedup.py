"""Near-dedup against all pairs of full sets."""

from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import near_dedup as N
from tidemark.llm.common import Scratch
from tidemark.llm.components import components

SPACE = " \t\n\x0b\x0c\r"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text):
    for c in SPACE:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def full_set(text):
    w = words(lower(text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def brute(rows, similarity=85):
    """{row number: (n_shingles, component, kept)} by all pairs."""
    sets = [full_set(t) for _, t in rows]
    of = list(range(len(rows)))

    def root(k):
        while of[k] != k:
            of[k] = of[of[k]]
            k = of[k]
        return k

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * min(len(a), len(b)) >= similarity * max(len(a), len(b)) and root(i) != root(j):
                shared = len(a & b)
                if 100 * shared >= similarity * (len(a) + len(b) - shared):
                    of[root(i)] = root(j)
    groups = {}
    for k, (doc_id, _) in enumerate(rows):
        groups.setdefault(root(k), []).append(doc_id)
    out = []
    for k, (doc_id, _) in enumerate(rows):
        ids = [x for x in groups[root(k)] if x is not None]
        name = doc_id if not sets[k] else min(ids) if ids else None
        out.append((str(doc_id), len(sets[k]), str(name), doc_id == name))
    return sorted(out)


def seen(frame):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in frame.collect())


def edited(rng, text, n):
    w = text.split(" ")
    for _ in range(n):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


def test_query_on_the_tables(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert seen(N.op9_near_dedup(spark, sf)) == brute(rows)


def corpus(seed):
    rng = random.Random(seed)
    text = lambda n: " ".join(f"w{rng.randrange(500)}" for _ in range(n))
    rows, base = [], text(160)
    chain = base
    for _ in range(60):  # a chain of near copies, few of which are like its beginning
        rows.append(chain)
        chain = edited(rng, chain, 2)
    rows += [edited(rng, base, rng.randrange(6)) for _ in range(40)] + [base.upper()] * 30
    for _ in range(40):
        t = text(rng.randrange(1, 200))
        rows += [t, edited(rng, t, rng.randrange(4)), t + " " + text(3)]
    shared = text(60)
    rows += [shared + " " + text(60) for _ in range(40)]
    rows += ["", None, " \n", "one", "ONE", "one two", "one two three four", "one two three four five", "é É", "é é"]
    ids = list(range(1000, 1000 + len(rows)))
    rng.shuffle(ids)
    return list(zip(ids, rows, strict=True))


@pytest.mark.parametrize("small,group,levels", [(N.SMALL, N.GROUP_CLASSES, N.LEVELS), (12, 20, 4), (12, 20, 1)])
def test_corpus_with_every_way_of_comparing(spark, monkeypatch, small, group, levels):
    monkeypatch.setattr(N, "SMALL", small)
    monkeypatch.setattr(N, "GROUP_CLASSES", group)
    monkeypatch.setattr(N, "LEVELS", levels)
    rows = corpus(levels)
    rows += [(None, rows[0][1]), (None, "no id at all, only here"), (rows[5][0], rows[5][1]), (rows[5][0], rows[5][1])]
    docs = spark.createDataFrame([(*r, "x", True) for r in rows], "doc_id long, text string, class string, kept boolean").repartition(3)
    assert seen(N.link(docs)) == brute(rows)


def test_documents_that_stay(spark):
    rows = [(3, "a b c d e f", "x"), (1, "A b c d e f", "y"), (1, "A b c d e f", "y"), (2, "", "z"), (4, None, None), (None, "q", "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, class string")
    got = sorted(map(str, N.keep_documents(docs).collect()))
    assert got == sorted(map(str, spark.createDataFrame([rows[1], rows[3], rows[4], rows[5]], docs.schema).collect()))


def test_similarity_is_a_parameter(spark):
    a = [f"w{k}" for k in range(204)]
    near = a[:182] + ["x"]
    far = a[:170] + ["y"]
    docs = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(far))], "doc_id long, text string")
    assert 80 <= 100 * len(full_set(" ".join(a)) & full_set(" ".join(far))) / len(full_set(" ".join(a)) | full_set(" ".join(far))) < 85
    assert [r.doc_id for r in N.keep_documents(docs, 80).collect()] == [1]
    assert sorted(r.doc_id for r in N.keep_documents(docs).collect()) == [1, 2]
    docs = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(near))], "doc_id long, text string")
    assert [r.doc_id for r in N.keep_documents(docs).collect()] == [1]


def test_margin_and_trees_follow_the_similarity():
    assert (N.margin(85), N.trees(85)) == (90, 2)
    assert (N.margin(80), N.trees(80)) == (82, 3)


def test_one_text_of_each_component_stays_without_ids(spark):
    base = [f"w{k}" for k in range(100)]
    a, b, c = " ".join(base), " ".join([*base[:-1], "x"]), " ".join(base).upper()
    other = " ".join(f"v{k}" for k in range(100))
    lone = " ".join(f"u{k}" for k in range(20))
    rows = [(None, ""), (None, a), (None, b), (None, c), (None, other), (7, other + " end"), (None, lone)]
    rows += [(9, "only nine here"), (9, other), (9, "only nine here"), (None, lone), (10, "p q r"), (10, "P q r")]
    got = [tuple(r) for r in N.keep_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    assert sum(t in (a, b, c) for _, t in got) == 1
    assert sum(t in ("p q r", "P q r") for _, t in got) == 1
    rest = [r for r in got if r[1] not in (a, b, c, "p q r", "P q r")]
    assert sorted(rest, key=str) == sorted([(None, ""), (7, other + " end"), (None, lone), (9, "only nine here")], key=str)


def test_empty_table(spark):
    assert N.link(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sets(st.integers(0, 30), min_size=1), min_size=1, max_size=12))
def test_linked_groups_like_all_pairs(sets):
    arrays = [np.asarray(sorted(s), np.uint64) for s in sets]
    got = N.linked_groups(arrays)
    want = list(range(len(sets)))
    for _ in sets:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if 100 * len(a & b) >= 85 * len(a | b):
                    want[i] = want[j] = min(want[i], want[j])
    assert got == want


def test_many_rows_of_no_id(spark):
    """A thousand rows of the null id, near copies among them, beside rows of one repeated id."""
    rng = random.Random(8)
    text = lambda n: " ".join(f"w{rng.randrange(900)}" for _ in range(n))
    rows = []
    for k in range(250):
        t = text(rng.randrange(20, 60))
        rows += [(None, t), (None, edited(rng, t, 1)), (None, t), (5 if k % 2 else 2000 + k, edited(rng, t, k % 3))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert seen(N.link(docs)) == brute(rows)


def test_long_near_copies_are_cut_by_volume(spark, monkeypatch):
    """A thousand near copies of a long text, and some that are linked with few of them."""
    rng = random.Random(9)
    base = " ".join(f"w{rng.randrange(50_000)}" for _ in range(1_500))
    rows = [(i, edited(rng, base, rng.randrange(1, 12))) for i in range(1_000)] + [(3000, base), (3001, base.upper())]
    far = base
    for k in range(40):  # ends far from the first
        far = edited(rng, far, 8)
        rows.append((4000 + k, far))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(N, "GROUP_SHINGLES", 100_000)
    assert {(r.component_id, r.kept) for r in N.link(docs).collect()} == {(0, True), (0, False)}


def test_components_of_a_path_a_star_and_a_ring(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, k) for k in range(101, 150)] + [(200 + i, 200 + (i + 1) % 7) for i in range(7)] + [(5, 5)]
    random.Random(1).shuffle(edges)
    got = components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t"))
    assert {(r.node, r.component) for r in got.collect()} == {(k, 1) for k in range(1, 61)} | {(k, 100) for k in range(100, 150)} | {(k, 200) for k in range(200, 207)}
