"""Very long texts through whole queries: counted whole, and no harm to others."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.llm import queries

WORDS = 60_000


@pytest.fixture(scope="module")
def folder(spark, sf, tmp_path_factory):
    out = tmp_path_factory.mktemp("long")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    long = spark.createDataFrame([(10**9, "Word of the day, said again. " * (WORDS // 6), "en", "web", 0), (10**9 + 1, "z" * 50_000, "en", "web", 0)], docs.schema)
    docs.unionByName(long).write.parquet(str(out / "documents.parquet"))
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(str(out / f"{name}.parquet"))
    return str(out)


@pytest.mark.parametrize(
    ("name", "column", "values"),
    [
        ("op1_quality_classifier", None, None), ("op2_quality_rules", "n_words", (WORDS, 1)), ("op3_lm_scoring", "n_tokens", (WORDS + 1, 2)), ("op7_mixing", "size", (WORDS, 1)),
        ("op12_importance_resampling", "n_features", (WORDS, 1)), ("op13_bpe_roundtrip", "n_tokens", None),
    ],
)
def test_long_texts(spark, folder, name, column, values):
    found = queries.queries()[name](spark, folder)
    rows = {r.doc_id: r for r in found.where(F.col("doc_id") >= 10**9).collect()}
    assert sorted(rows) == [10**9, 10**9 + 1]
    if values:
        assert tuple(rows[10**9 + k][column] for k in (0, 1)) == values
    if name.startswith("op1_"):
        assert all(0 <= r.score <= 1 for r in rows.values())
    if name.startswith("op13"):
        assert rows[10**9].n_tokens > WORDS
