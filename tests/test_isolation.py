"""Errors as rows, offsets and merges in linear time, silences by timers."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from textloom import plugins
from textloom.functions.places import located, merged, overlap_length
from textloom.operators import chunking as K
from textloom.operators import editing as E
from textloom.streaming import jobs as G
from textloom.streaming.silences import stream_silences

DOCS = "doc_id long, content string"


def naive_overlap(a, b, cap=None):
    most = min(len(a), len(b)) if cap is None else min(len(a), len(b), cap)
    return next((n for n in range(most, 0, -1) if a.endswith(b[:n])), 0)


def test_overlaps_and_places_by_plain_search():
    draw = random.Random(7)
    word = lambda n: "".join(draw.choice("ab") for _ in range(draw.randint(0, n)))
    for _ in range(2_000):
        a, b, cap = word(12), word(12), draw.choice([None, 1, 3, 20])
        assert overlap_length(a, b, cap) == naive_overlap(a, b, cap)
    for _ in range(2_000):
        text, pieces, overlap = word(30), [word(4) for _ in range(draw.randint(0, 8))], draw.choice([0, 1, 2, None])
        used, at, want = (naive_overlap(*pieces[:2]) if len(pieces) > 1 else 0) if overlap is None else overlap, 0, []
        for x in pieces:
            start = text.find(x, at)
            start = at if start < 0 else start
            want.append(start)
            at = max(0, start + len(x) - used)
        assert located(text, pieces, overlap) == want
    for _ in range(500):
        pieces, cap, text = [word(9) or "a" for _ in range(draw.randint(1, 6))], draw.choice([2, 5]), None
        for x in pieces:
            n = 0 if text is None else naive_overlap(text[-cap:], x, cap)
            text = x if text is None else text + (x[n:] if n else "\n\n" + x)
        assert merged(pieces, cap) == text
    assert merged([], 3) is None and merged([None, "a", None], 3) == "a"


def test_offsets_take_linear_time(spark):
    """Also where half of the pieces are in no text."""
    n = 200_000
    words = [f"w{i}" for i in range(n)]
    splits = [w if i % 2 else w + "!" for i, w in enumerate(words)]
    df = spark.createDataFrame([(1, " ".join(words), splits), (2, None, ["x"]), (3, "abc", None), (4, "abc", [None, "c"])], DOCS + ", splits array<string>")
    K.locate_offsets(df.where("doc_id > 1")).collect()
    began = time.monotonic()
    rows = K.locate_offsets(df).where("doc_id = 1 AND chunk_index % 2 = 1").selectExpr("count(*) AS n", "count_if(content = concat('w', chunk_index)) AS same").first()
    assert tuple(rows) == (n // 2, n // 2) and time.monotonic() - began < 30
    assert [tuple(r) for r in K.locate_offsets(df.where("doc_id = 4")).collect()] == [(4, 0, "c", 2, 3)]


def test_merges_take_linear_time(spark):
    def seconds(n):
        rows = spark.range(n).selectExpr("1L AS doc_id", "cast(id AS int) AS chunk_index", "concat('piece ', id, ' of one text, and so on') AS content", "0 AS start", "1 AS end")
        began = time.monotonic()
        out = E.merge_chunks(rows, F.lit(True)).collect()
        spent = time.monotonic() - began
        assert len(out) == 1 and out[0]["content"].count("\n\n") == n - 1
        return spent

    seconds(100)
    once = max(1.0, seconds(10_000))
    assert seconds(40_000) < 6 * once


@pytest.fixture
def refusing():
    key = ("splitter", "refusing")

    @plugins.register_splitter("refusing", "Refusing")
    def split(text, mark="!", size="3"):
        if mark in text:
            raise RuntimeError("no " + "n" * 500)
        if text == "types":
            return [1, 2]
        return [text[i : i + int(size)] for i in range(0, len(text), int(size))]

    yield key
    plugins.REGISTRY.pop(key)


def test_a_failing_document_is_a_row(spark, refusing):
    docs = [(1, "abcdefg"), (2, "a!b"), (3, ""), (4, None), (5, "abc"), (6, "x" * 50), (7, "types"), (8, "a?c")]
    df = spark.createDataFrame(docs, DOCS).withColumn("mine", F.when(F.col("doc_id") == 8, F.create_map(F.lit("mark"), F.lit("?"))).when(F.col("doc_id") == 5, F.create_map(F.lit("size"), F.lit("1"))))
    rows = plugins.chunk_results(df, "refusing", 1, 20, options="mine").collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["chunk_index"] or 0)):
        got.setdefault(r["doc_id"], []).append(r["error"] or r["content"])
    assert got[1] == ["abc", "def", "g"] and got[5] == ["a", "b", "c"]
    assert got[2] == ["RuntimeError: " + ("no " + "n" * 500)[:200]] and got[8][0].startswith("RuntimeError")
    assert got[3] == got[4] == ["content is too short"] and got[6] == ["content is too long"] and got[7][0].startswith(("TypeError", "AttributeError"))
    outcomes = {r["doc_id"]: (r["success"], r["total_chunks"]) for r in plugins.outcomes_of(plugins.chunk_results(df, "refusing", 1, 20, options="mine")).collect()}
    assert outcomes == {1: (True, 3), 2: (False, 0), 3: (False, 0), 4: (False, 0), 5: (True, 3), 6: (False, 0), 7: (False, 0), 8: (False, 0)}
    with pytest.raises(ValueError):
        plugins.chunk_results(df, "token", options="mine")


@pytest.mark.parametrize("strategy", [n for k, n in plugins.REGISTRY if k == "strategy"])
def test_outcomes_come_with_the_chunks(spark, strategy):
    """Every strategy: one row at least for each document, chunks as the strategy makes them by itself, counts that agree."""
    texts = ["# A\n\nOne. Two three!\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\n", "plain words only", "", None, "   \n", "long " * 50]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    rows = plugins.chunk_results(df, strategy, 1, 200)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    if plugins.REGISTRY["strategy", strategy].arrays:
        assert plan.count("Generate ") == 1 and "Join" not in plan and "Aggregate" not in plan
    found = rows.collect()
    alone = plugins.REGISTRY["strategy", strategy].run(df.where("doc_id IN (0, 1, 4)")).select("doc_id", "chunk_index", "content").collect()
    assert sorted((r["doc_id"], r["chunk_index"], r["content"]) for r in found if r["chunk_index"] is not None) == sorted(map(tuple, alone))
    outcomes = {r["doc_id"]: r for r in plugins.outcomes_of(rows).collect()}
    assert sorted(outcomes) == list(range(6))
    for i in range(6):
        assert outcomes[i]["success"] == (i in (0, 1, 4)) and outcomes[i]["total_chunks"] == sum(r["doc_id"] == i for r in alone)
    assert outcomes[5]["error"] == "content is too long" and outcomes[2]["error"] == "content is too short"


def test_sentences_without_letters(spark):
    df = spark.createDataFrame([(1, "Abc abc. 1 2 3. Abc cab! zzz."), (2, "123")], DOCS)
    rows = [tuple(r) for r in K.chunk_semantic_text(df, threshold=0.9).select("doc_id", "content", "start").orderBy("doc_id", "start").collect()]
    assert rows == [(1, "Abc abc. ", 0), (1, "1 2 3. ", 9), (1, "Abc cab! ", 16), (1, "zzz.", 25), (2, "123", 0)]


def test_the_last_silence_needs_no_later_event(spark, tmp_path):
    """Two batches and a replay: each session comes once, the last of each key by its timer."""

    def add(events):
        rows = spark.createDataFrame([(u, 60 * m) for u, m in events], "user_id long, s long").selectExpr("user_id", "timestamp_seconds(s) AS ts")
        rows.coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")

    def run():
        stream_silences(G.stream_table(spark, str(tmp_path), "events", 1), "user_id", "ts", 3600.0, f"{tmp_path}/out", f"{tmp_path}/state", idle_s=1.0)
        made = spark.read.parquet(f"{tmp_path}/out").selectExpr("user_id", "unix_seconds(from_ts) DIV 60 AS a", "unix_seconds(stalled_at) DIV 60 - 60 AS b", "n_events")
        return sorted(tuple(r) for r in made.collect())

    add([(1, 0), (1, 10), (1, 100), (2, 5), (2, 65), (1, 130), (3, 1)])
    first = [(1, 0, 10, 2), (1, 100, 130, 2), (2, 5, 65, 2), (3, 1, 1, 1)]
    assert run() == first
    add([(1, 500), (4, 7)])
    second = sorted([*first, (1, 500, 500, 1), (4, 7, 7, 1)])
    assert run() == second
    assert run() == second  # nothing new: nothing is written again


def test_silences_after_empty_files_and_unfinished_batches(spark, tmp_path, monkeypatch):
    """Nothing is lost where the first files have no rows, or a batch without input is repeated; few groups hold many keys."""
    import json

    from textloom.streaming import silences

    monkeypatch.setattr(silences, "BUCKETS", 3)
    draw, events = random.Random(5), []
    for u in range(200):
        events += [(u, draw.randrange(0, 40_000)) for _ in range(draw.randint(1, 9))]
    rows = spark.createDataFrame(events, "user_id long, s long").selectExpr("user_id", "timestamp_seconds(s) AS ts")
    for _ in range(2):
        rows.limit(0).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    time.sleep(1.1)
    rows.repartition(3).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    silences.stream_silences(G.stream_table(spark, str(tmp_path), "events", 1), "user_id", "ts", 3600.0, f"{tmp_path}/out", f"{tmp_path}/state", late_s=1e9, idle_s=12.0)
    got, want = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").selectExpr("user_id", "unix_seconds(from_ts)", "unix_seconds(stalled_at) - 3600", "n_events").collect())), []
    for u in range(200):
        for t in sorted(t for v, t in events if v == u):
            if want and want[-1][0] == u and t - want[-1][2] <= 3600:
                want[-1] = (u, want[-1][1], t, want[-1][3] + 1)
            else:
                want.append((u, t, t, 1))
    assert got == sorted(want)
    repeated = {"durationMs": {"addBatch": 1}, "sources": [{"startOffset": 1, "endOffset": 1}], "numInputRows": 0, "stateOperators": [{"numRowsTotal": 0}]}
    listed = {**repeated, "durationMs": {"addBatch": 1, "latestOffset": 1}}
    state = lambda p: silences._open(type("Query", (), {"lastProgress": type("Progress", (dict,), {"json": json.dumps(p)})(p)}))
    assert state(repeated) and not state(listed)
