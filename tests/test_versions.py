"""Versions by manifest and compaction, first bytes of files, calls by status, converters by name."""

from __future__ import annotations

import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from textloom import plugins
from textloom.operators import catalog as C
from textloom.operators import enrichment as N
from textloom.sources import storage as S
from textloom.sources.heads import scan_heads, write_files
from textloom.streaming import jobs as G


def files_below(path):
    return sum(f.endswith(".parquet") for _, _, files in os.walk(path) for f in files)


def test_newest_folders_only_are_read(spark, tmp_path):
    path = f"{tmp_path}/sets"
    docs = spark.range(6).selectExpr("concat('d', id) AS stem", "id AS doc_id", "0 AS chunk_index", "'x' AS content")
    S.save_chunk_set(docs, path, "r1", "token")
    S.save_chunk_set(docs.where("doc_id < 6"), path, "r2", "token")
    S.save_chunk_set(docs.where("doc_id < 2"), path, "r3", "token")
    latest = S.load_latest_chunk_set(spark, path)
    assert sorted((r["stem"], r["run_ts"]) for r in latest.collect()) == [(f"d{i}", "r3" if i < 2 else "r2") for i in range(6)]
    plan = latest._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("], ")[0]
    assert "run_ts" in filters and "r2" in filters and "r3" in filters and "r1" not in filters
    assert sorted(map(tuple, latest.select("stem", "run_ts").collect())) == sorted(map(tuple, C.latest_versions(S.load_chunk_sets(spark, path)).select("stem", "run_ts").collect()))


def test_upserts_are_compacted(spark, tmp_path):
    """A hundred batches leave few files; a batch that comes again, before or after its base, changes nothing."""
    path, want = f"{tmp_path}/upserts", {}
    for n in range(100):
        rows = [(f"d{n % 7}", f"r{n:03}", n), (f"e{n % 3}", f"r{n:03}", n)]
        batch = spark.createDataFrame(rows, "stem string, run_ts string, n long").coalesce(1)
        S.write_upsert(batch, path, n, every=8)
        want |= {s: v for s, _, v in rows}
        if n in (9, 15, 16):
            S.write_upsert(batch, path, n, every=8)
    assert {r["stem"]: r["n"] for r in S.load_upserts(spark, path).collect()} == want
    S.write_upsert(spark.createDataFrame([("d0", "r000", 0)], "stem string, run_ts string, n long"), path, 3, every=8)
    assert {r["stem"]: r["n"] for r in S.load_upserts(spark, path).collect()} == want
    assert files_below(path) <= 30


def test_upsert_stream_again(spark, tmp_path):
    def add(rows):
        spark.createDataFrame(rows, "stem string, run_ts string, n long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/v.parquet")

    def run():
        G.latest_upsert(G.stream_table(spark, str(tmp_path), "v", 1), f"{tmp_path}/out", f"{tmp_path}/state", every=2)
        return {r["stem"]: r["n"] for r in S.load_upserts(spark, f"{tmp_path}/out").collect()}

    add([("a", "r1", 1), ("b", "r1", 1)])
    assert run() == {"a": 1, "b": 1}
    add([("a", "r2", 2)])
    assert run() == run() == {"a": 2, "b": 1}
    add([("c", "r0", 0), ("a", "r1", 9)])
    assert run() == {"a": 2, "b": 1, "c": 0}


def test_first_bytes(spark, tmp_path):
    rows = [("a.pdf", b"%PDF-1.7 text"), ("b.PDF", b"no"), ("c.md", b""), ("d.exe", b"%PDF-"), ("e.Md", b"x" * 3_000)]
    write_files(spark.createDataFrame([(n, bytearray(b)) for n, b in rows], "name string, body binary"), f"file://{tmp_path}/in/deep/er")
    write_files(spark.createDataFrame([("f.pdf", bytearray(b"%PDF"))], "name string, body binary"), f"{tmp_path}/in")
    os.makedirs(f"{tmp_path}/in/empty")
    for path in (f"{tmp_path}/in", f"file://{tmp_path}/in"):
        got = {r["name"]: r for r in C.validated_files(scan_heads(spark, path, 5), 0.002).collect()}
        assert {n: r["reason"] for n, r in got.items()} == {"a.pdf": None, "b.PDF": "not a PDF", "c.md": None, "d.exe": "unsupported type", "e.Md": "too large", "f.pdf": "not a PDF"}
        assert all(len(r["head"]) <= 5 for r in got.values()) and got["e.Md"]["length"] == 3_000 and got["a.pdf"]["modified"] is not None
    assert sorted(r["name"] for r in scan_heads(spark, f"{tmp_path}/in", suffixes=(".md",)).collect()) == ["c.md", "e.Md"]
    assert scan_heads(spark, f"{tmp_path}/in/empty").count() == 0


class Refused(Exception):
    def __init__(self, status):
        super().__init__(f"status {status}")
        self.status_code = status


def test_calls_by_status(spark, tmp_path):
    """A fake endpoint answers by status; a task has several calls in flight and keeps the order of its chunks."""
    folder = str(tmp_path)

    def make():
        seen, lock, flying, most = {}, threading.Lock(), [0], [0]

        def call(text):
            with lock:
                seen[text] = seen.get(text, 0) + 1
                flying[0] += 1
                most[0] = max(most[0], flying[0])
                open(f"{folder}/most-{most[0]}", "w").close()
            time.sleep(0.05)
            with lock:
                flying[0] -= 1
            kind, _, status = text.partition(" ")
            if kind == "always" or (kind == "twice" and seen[text] < 3):
                raise Refused(int(status))
            if kind == "lost":
                raise ConnectionError("lost")
            return '{"title": "' + f"{text} {seen[text]}" + '"}'

        return call

    texts = ["fine 1", "twice 500", "twice 503", "twice 429", "always 500", "always 400", "always 404", "lost 0", *(f"fine {i}" for i in range(2, 20))]
    chunks = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc_id long, chunk_index int, content string").coalesce(1)
    rows = N.enrich_chunks(chunks, make, attempts=3, base_delay=0.0, calls=4).collect()
    assert [r["chunk_index"] for r in rows] == list(range(len(texts)))
    got = {texts[r["chunk_index"]]: (r["status"], r["title"], r["error"]) for r in rows}
    assert all(got[f"twice {s}"] == ("ok", f"twice {s} 3", None) for s in (500, 503, 429)) and got["fine 7"] == ("ok", "fine 7 1", None)
    assert got["always 500"][2] == "Refused: status 500" and got["always 400"][2] == "Refused: status 400" and got["lost 0"][2] == "ConnectionError: lost"
    assert "most-4" in os.listdir(folder) and "most-5" not in os.listdir(folder)
    asked = []

    def refuse(x, status):
        asked.append(status)
        raise Refused(status)

    for status, times in ((400, 1), (404, 1), (429, 3), (500, 3)):
        asked.clear()
        with pytest.raises(Refused):
            N.with_retries(lambda x, s=status: refuse(x, s), "x", 3, 1.0, lambda s: None)
        assert len(asked) == times


def test_converters_by_name(spark):
    plugins.register_converter("upper_test", "Upper")(str.upper)
    try:
        docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, content string")
        assert {r["doc_id"]: (r["ok"], r["content"]) for r in plugins.convert_with(docs, "upper_test").collect()} == {1: (True, "A"), 2: (False, None)}
        with pytest.raises(ValueError):
            plugins.convert_with(docs, "none")
    finally:
        plugins.REGISTRY.pop(("converter", "upper_test"))


def test_listing_is_in_order_of_name(spark):
    pdfs = spark.createDataFrame([(f"{n}.pdf", n) for n in ("b", "a", "Z")], "name string, stem string")
    mds = spark.createDataFrame([(f"{n}.md", n) for n in ("b", "c", "B", "_")], "name string, stem string")
    assert [r[0] for r in C.list_documents(pdfs, mds).collect()] == ["B.md", "Z.pdf", "_.md", "a.pdf", "b.pdf", "c.md"]
    assert C.list_documents(pdfs.limit(0), mds.limit(0)).collect() == []
