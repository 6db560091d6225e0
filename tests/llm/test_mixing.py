"""Mixing against a plain computation, and against its SQL."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import duckdb
import pytest

from tidemark.llm import mixing as M


def plain_targets(sizes, weights=M.WEIGHTS, cap=M.MAX_EPOCHS):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        if not free:
            return {s: float(cap * sizes[s]) for s in order}
        level = (total - sum(cap * sizes[s] for s in capped)) / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level >= cap * sizes[s]}
        if not over:
            return {s: float(cap * sizes[s]) if s in capped else weight[s] * level for s in order}
        capped |= over


def check(rows, got, near):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += size(t)
    want = plain_targets(sizes)
    by_key = sorted((str(i), size(t), sizes[s], round(want[s], 6)) for i, t, s in rows)
    assert by_key == sorted((str(r.doc_id), r.size, r.source_size, round(r.target, 6)) for r in got)
    source = {i: s for i, _, s in rows}
    taken = defaultdict(int)
    for r in got:
        assert r.taken <= M.MAX_EPOCHS * r.size and (not r.size or r.taken % r.size == 0)
        taken[source[r.doc_id]] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= near, s


def test_query_on_the_tables(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()]
    got = M.op7_mixing(spark, sf).collect()
    check(rows, got, max(r.size for r in got) / 2 + 1)
    assert sorted(got) == sorted(M.op7_mixing(spark, sf).collect())
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM '{sf}/documents.parquet'")
    key = lambda r: (r[0], r[1], r[2], round(r[3], 6), r[4])
    assert sorted(map(key, con.sql(M.OP7_SQL).fetchall())) == sorted(key(tuple(r)) for r in got)


def test_hot_source_nulls_and_empty_texts(spark):
    rows = [(i, "w " * (i % 7), "hot") for i in range(600)] + [(1000 + i, "a b\x0bc é", s) for i, s in enumerate(["", None, "z", "Z", "é", "😀"] * 20)]
    rows += [(2000, None, "none"), (2001, "", None), (2002, " \n", "hot")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sized = M.measured(docs, M.Scratch(spark, "t"))
    decided, few = M.plan(sized.select("source", "size", "ord"))
    for flag in (few, False):
        found = M.repeated(sized, decided, flag, ["doc_id", "size", "source_size", "target"], M.Scratch(spark, "t"))
        got = found.selectExpr("doc_id", "size", "source_size", "target", "times * size taken").collect()
        check(rows, got, 4)


def test_mix_repeats_rows_and_keeps_columns(spark):
    rows = [(i, "w " * 10, "a" if i % 4 else "b", i, "x", 1.5) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, whole string, target double")
    out = M.mix(docs)
    assert out.schema == docs.schema or out.dtypes == docs.dtypes
    got = out.groupBy("doc_id", "source").count().collect()
    taken = defaultdict(int)
    for r in got:
        assert r["count"] <= 3
        taken[r["source"]] += 10 * r["count"]
    want = plain_targets({"a": 3000, "b": 1000})
    assert all(abs(taken[s] - want[s]) <= 10 for s in want)


def test_repeated_rows_and_null_ids(spark):
    rows = [(None, "a b", "s"), (1, "a", "s"), (1, "a", "s"), (2, "c", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = M.mix(docs).collect()
    assert out and all(tuple(r) in rows for r in out)


def test_empty_table_and_sizes_of_zero(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert M.mix(docs).count() == 0
    docs = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert M.mix(docs).count() == 0


@pytest.mark.parametrize("doc_id,text", [(0, "a"), (17, None), (None, "é"), (None, None)])
def test_order_is_md5(spark, doc_id, text):
    got = spark.createDataFrame([(doc_id, text)], "doc_id long, text string").select(M.order_of()).first()[0]
    parts = ["mix-1", None if doc_id is None else str(doc_id), None if text is None else hashlib.md5(text.encode()).hexdigest()]
    assert got == hashlib.md5(":".join(p for p in parts if p is not None).encode()).hexdigest()


@pytest.mark.parametrize("case", ["null ids", "one id", "one row"])
def test_sources_of_one_id_come_near_their_target(spark, case):
    same = {"null ids": lambda i: (None, f"w{i} b c"), "one id": lambda i: (5, f"w{i} b c"), "one row": lambda i: (5, "a b c")}[case]
    rows = [(*same(i), "big", i) for i in range(900)] + [(1000 + i, "a b c d", "small", i) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n int").repartition(5)
    want = plain_targets({"big": 2700, "small": 400})
    for _ in range(2):
        taken = defaultdict(int)
        times = defaultdict(int)
        for r in M.mix(docs).collect():
            taken[r.source] += len(r.text.split())
            times[r.n, r.source] += 1
        assert all(abs(taken[s] - want[s]) <= 4 for s in want) and max(times.values()) <= 3


def test_repeats_like_the_sql(spark, tmp_path):
    rows = [(7 if i % 3 else None, "a b c" if i % 2 else "d e", "s" if i % 5 else None) for i in range(300)] + [(1000 + i, "x y " * i, "t") for i in range(9)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM '{tmp_path}/documents.parquet/*.parquet'")
    key = lambda r: (str(r[0]), r[1], r[2], round(r[3], 6), r[4])
    got = sorted(key(tuple(r)) for r in M.op7_mixing(spark, str(tmp_path)).collect())
    assert got == sorted(map(key, con.sql(M.OP7_SQL).fetchall()))
