"""The filtering stages with columns of any name: dots, spaces, names that the operators use themselves."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from textloom.llm import pii, quality_rules

NAMES = ("a.b", "with space", "k0", "row", "absent", "n_words", "failed_bits", "redacted", "spans", "base", "found", "key", "task")


@pytest.fixture(scope="module")
def docs(spark):
    good = "write to someone.else@example.org about the many plain words that stand in this one line of text, which is long enough to be kept by all rules"
    rows = [(1, good, 140), (None, good, None), (None, good, 3), (2**60, "short", 5), (3, None, None), (4, "", 0), (5, good + " word" * 100_000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars int")
    for i, name in enumerate(NAMES):
        df = df.withColumn(name, F.lit(i))
    return df.withColumn("deep", F.struct(F.lit(1).alias("x.y"), F.array(F.lit("z")).alias("with space")))


def test_filter_documents(docs):
    got = quality_rules.filter_documents(docs)
    assert got.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in got.collect()) == [0, 0, 1]
    assert all(tuple(r)[3:-1] == tuple(range(len(NAMES))) and r["deep"]["x.y"] == 1 for r in got.collect())


def test_redact_documents(docs):
    got = pii.redact_documents(docs)
    assert got.columns == docs.columns
    rows = {(r["doc_id"], r["n_chars"]): r for r in got.collect()}
    assert len(rows) == 7 or len(got.collect()) == 7
    assert all("[EMAIL]" in r["text"] for r in got.collect() if r["text"] and len(r["text"]) > 5)
    assert [r["text"] for r in got.collect() if r["doc_id"] == 3] == [None]
    assert all(tuple(r)[3:-1] == tuple(range(len(NAMES))) for r in got.collect())


def test_empty_stages(docs):
    assert quality_rules.filter_documents(docs.limit(0)).count() == 0
    assert pii.redact_documents(docs.limit(0)).count() == 0
