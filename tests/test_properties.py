"""Properties of chunkers and editors on edge texts."""

import time

import pytest

from textloom import plugins
from textloom.functions import answers as A
from textloom.functions import text as T
from textloom.operators import chunking as K
from textloom.operators import editing as E
from textloom.operators import enrichment as N
from textloom.sources import storage as S
from textloom.streaming import jobs as G

EDGES = [
    (1, ""), (2, "word"), (3, "a" * 1000), (4, "same\nsame\nsame"), (5, "é ñ ß ü"), (6, "   "), (7, "word   "), (8, "# A\n```\n# x\n```\n## B"), (9, "intro\n# A\nbody"),
    (10, "| h |\n| - |\n| 1 |"), (11, None), (12, "One. Two! Three?\n\nFour five six. Seven"), (13, "\n\n\n"), (14, "x\n\n" * 50),
]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, "doc_id long, content string").cache()


PLAIN = {
    "token": (K.chunk_token, {"size": 3, "overlap": 0}), "character": (K.chunk_character, {"size": 20, "overlap": 0}), "md": (K.chunk_recursive_md, {"size": 20, "overlap": 0}),
    "recursive": (K.chunk_recursive, {"size": 3}), "fast": (K.chunk_fast, {"size_bytes": 20}), "sentence": (K.chunk_sentence, {"size": 3, "overlap": 0}), "lines": (K.chunk_lines, {"max_tokens": 3}),
}


@pytest.mark.parametrize("name", sorted(PLAIN))
def test_offsets_and_limits(edges, name):
    run, parameters = PLAIN[name]
    texts = dict(EDGES)
    by_doc = {}
    for r in run(edges, **parameters).collect():
        assert texts[r["doc_id"]][r["start"] : r["end"]] == r["content"]
        by_doc.setdefault(r["doc_id"], []).append(r)
        limit = next(iter(parameters.values()))
        weight = len(r["content"].encode()) if name == "fast" else len(r["content"]) if name in ("character", "md") else len(r["content"].split())
        assert weight <= limit
    assert 11 not in by_doc
    for doc, rows in by_doc.items():
        rows.sort(key=lambda r: r["chunk_index"])
        assert [r["chunk_index"] for r in rows] == list(range(len(rows)))
        if name not in ("character", "lines"):
            assert "".join(r["content"] for r in rows) == texts[doc]


def test_overlap_repeats_the_tail(spark):
    df = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(50)))], "doc_id long, content string")
    rows = K.chunk_token(df, 10, 3).orderBy("chunk_index").collect()
    for a, b in zip(rows, rows[1:]):
        assert a["content"].split()[-3:] == b["content"].split()[:3]


def test_blocks_and_pages_round_trip(edges):
    texts = {k: v for k, v in EDGES if v is not None}
    assert {r["doc_id"]: r["content"] for r in K.join_blocks(K.split_blocks(edges)).collect()} == texts
    assert K.split_pages(edges).count() == 0


def test_hybrid_limits_and_headings(spark):
    text = "# A\n\n" + "one two three. " * 10 + "\n\n## B\n\n- x\n- y\n\ntail"
    rows = K.chunk_hybrid(spark.createDataFrame([(1, text)], "doc_id long, content string"), 12).orderBy("chunk_index").collect()
    assert all(r["token_count"] <= 12 for r in rows)
    assert rows[0]["headings"] == ["A"] and rows[-1]["headings"] == ["A", "B"]
    assert rows[-1]["contextualized"].startswith("A\nB\n")


@pytest.mark.parametrize("size, overlap", [(0, 0), (5, 5), (5, -1)])
def test_parameters_are_checked(edges, size, overlap):
    with pytest.raises(ValueError):
        K.chunk_token(edges, size, overlap)


def test_recovery_kinds(spark):
    good = '{"cleaned_chunk": "a\\"b", "title": "T", "keywords": ["k"], "questions": []}'
    cases = [("o", good, "ok"), ("o", f"```JSON\n{good}\n```", "ok"), ("o", good[:-30], "partial"), ("o", good + ' {"x', "repaired"), ("o", "no", "error"), ("o", None, "error"), ("o", "[1]", "error"), ("o", "", "error"), ("o", "{'title': 'T'}", "error")]
    rows = A.recovered(spark.createDataFrame([(i, *c[:2]) for i, c in enumerate(cases)], "i int, original string, raw_response string")).orderBy("i").collect()
    assert [r["status"] for r in rows] == [c[2] for c in cases]
    assert rows[0]["cleaned_chunk"] == 'a"b' and rows[0]["keywords"] == ["k"] and rows[4]["cleaned_chunk"] == "o"


def test_recovery_as_json_is_read(spark):
    """Two objects are no JSON, of equal keys the last counts, numbers keep their text, lists that are none are empty."""
    cases = ['{"title": "a"} {"title": "b"}', '{"title": "a", "title": "b"}', '{"title": NaN, "summary": 12}', '{"title": -Infinity, "keywords": "k", "questions": [1, null]}', '{"title": "NaN"}', '{"title": "x"', "{}", '{"title": tru}']
    rows = A.recovered(spark.createDataFrame([(i, "o", c) for i, c in enumerate(cases)], "i int, original string, raw_response string")).orderBy("i").collect()
    assert [r["status"] for r in rows] == ["partial", "ok", "ok", "ok", "ok", "partial", "ok", "error"]
    assert [r["title"] for r in rows] == ["a", "b", "NaN", "-Infinity", "NaN", "x", "", ""]
    assert rows[2]["summary"] == "12" and rows[3]["keywords"] == [] and rows[3]["questions"] == ["1", None]


def test_table_function(spark):
    """Options by row, errors as rows, and no rows for null content."""

    @plugins.register_splitter("by_mark")
    def by_mark(text, mark=" ", most="9"):
        if "!" in text:
            raise ValueError(text)
        return text.split(mark)[: int(most)]

    rows = [(1, "a b b", None), (2, "a-b c", {"mark": "-"}), (3, "x!", {}), (4, None, None), (5, "", None), (6, "a b", {"most": "1"}), (7, "a", {"none": "1"})]
    spark.createDataFrame(rows, "doc_id long, content string, own map<string,string>").createOrReplaceTempView("marked")
    name = plugins.table_function(spark, "by_mark", "split_by_mark")
    got = spark.sql(f"SELECT m.doc_id, s.* FROM marked m, LATERAL {name}(m.content, m.own) s ORDER BY doc_id, chunk_index").collect()
    found = [tuple(r) for r in got if r["error"] is None]
    assert found == [(1, 0, "a", 0, 1, None), (1, 1, "b", 2, 3, None), (1, 2, "b", 4, 5, None), (2, 0, "a", 0, 1, None), (2, 1, "b c", 2, 5, None), (6, 0, "a", 0, 1, None)]
    assert [(r["doc_id"], r["chunk_index"], r["error"].split(":")[0]) for r in got if r["error"]] == [(3, None, "ValueError"), (7, None, "TypeError")]
    with pytest.raises(ValueError):
        plugins.table_function(spark, "nobody's")


def test_retries():
    calls, waits = [], []

    def flaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise N.Transient("busy")
        return "done"

    assert N.with_retries(flaky, "x", 3, 1.0, waits.append) == "done" and waits == [1.0, 2.0]
    with pytest.raises(ValueError):
        N.with_retries(lambda x: (_ for _ in ()).throw(ValueError("no")), "x", 3, 1.0, waits.append)
    assert len(waits) == 2


def test_names(spark):
    names = ["../a.pdf", "a/b.pdf", ".", "..", ".hidden", "b.tar.gz", "..a", ""]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    import pyspark.sql.functions as F

    rows = df.select(T.is_safe_filename(F.col("n")), T.safe_stem(F.col("n")), T.sanitise(F.col("n"))).collect()
    assert [r[0] for r in rows] == [False, False, False, False, True, True, True, False]
    assert [r[1] for r in rows] == ["a", "b", ".", "..", ".hidden", "b.tar", ".", None]
    assert rows[2][2] == "doc" and rows[0][2] == "a-pdf"


def test_files_and_versions(spark, tmp_path):
    (tmp_path / "x.md").write_text("# hi\nthere")
    (tmp_path / "y.pdf").write_bytes(b"%PDF-1.4")
    (tmp_path / "z.pdf").write_bytes(b"nope")
    (tmp_path / "n.txt").write_text("no")
    assert [tuple(r) for r in S.scan_markdown(spark, str(tmp_path)).collect()] == [("x.md", "x", "# hi\nthere")]
    assert {r["name"] for r in S.scan_files(spark, str(tmp_path)).collect()} == {"x.md", "y.pdf", "z.pdf"}
    from textloom.operators import catalog as C

    files = spark.read.format("binaryFile").load(str(tmp_path))
    reasons = {r["path"].rsplit("/", 1)[1]: r["reason"] for r in C.validated_files(files).collect()}
    assert reasons == {"x.md": None, "y.pdf": None, "z.pdf": "not a PDF", "n.txt": "unsupported type"}


def test_registry(spark):
    @plugins.register_strategy("token")
    def other(df):
        raise AssertionError

    rows = plugins.capabilities(spark).where("name = 'token'").collect()
    assert len(rows) == 1 and rows[0]["label"] == "Token windows"
    chunks, outcomes = plugins.chunk_corpus(spark.createDataFrame([(1, "a b"), (2, ""), (3, None)], "doc_id long, content string"), "token")
    assert chunks.count() == 1
    assert {r["doc_id"]: r["success"] for r in outcomes.collect()} == {1: True, 2: False, 3: False}
    with pytest.raises(ValueError):
        plugins.chunk_corpus(chunks, "none")


def test_long_documents_take_linear_time(spark):
    def seconds(run, n):
        text = " ".join(f"w{i}" + "\n" * (i % 12 == 11) for i in range(n))
        df = spark.createDataFrame([(1, text)], "doc_id long, content string")
        began = time.monotonic()
        rows = run(df).select("content", "start", "end").collect()
        spent = time.monotonic() - began
        assert all(text[r["start"] : r["end"]] == r["content"] for r in rows)
        return spent

    for run in (K.chunk_token, K.chunk_lines, K.chunk_fast):
        seconds(run, 1_000)
        once = max(1.0, seconds(run, 100_000))
        assert seconds(run, 200_000) < 2.5 * once


def test_last_close(spark):
    import pyspark.sql.functions as F

    cases = {"": 0, "{}": 2, '{"a": "}"} tail': 10, '{"a": {"b": 1}': 0, "}{": 0, '{"a": "\\\\"} {"': 11, '{"a": "\\"}': 0, "{} x {} y": 7, '{"t": "' + "\\n {" * 100_000 + '"}{': 400_009}
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c string").select("i", A.last_close(F.col("c")).alias("n")).orderBy("i").collect()
    assert [r["n"] for r in rows] == list(cases.values())


def test_merge_joins_selected_chunks(spark):
    texts = {1: ["one two", "two three", "x", "y"], 2: ["a", "b"], 3: ["é" * 400, "é" * 350 + "z", "q"]}
    rows = [(d, i, t, 10 * i, 10 * i + 5, "title", ["k"]) for d, ts in texts.items() for i, t in enumerate(ts)]
    chunks = spark.createDataFrame(rows, "doc_id long, chunk_index int, content string, start int, end int, title string, keywords array<string>")
    chosen = chunks.where("chunk_index < 2 AND doc_id <> 2 OR doc_id = 2 AND chunk_index = 0")
    import pyspark.sql.functions as F

    want = {
        1: [("one two three", 0, 15, "", []), ("x", 20, 25, "title", ["k"]), ("y", 30, 35, "title", ["k"])],
        2: [("a", 0, 5, "title", ["k"]), ("b", 10, 15, "title", ["k"])],
        3: [("é" * 450 + "z", 0, 15, "", []), ("q", 20, 25, "title", ["k"])],
    }
    # The search of an overlap reaches 300 characters, so 50 of the second text's 350 come after it.
    for selection in (chosen, F.expr("chunk_index < 2 AND doc_id <> 2 OR doc_id = 2 AND chunk_index = 0")):
        got = E.merge_chunks(chunks, selection)
        assert got.columns == chunks.columns
        found = {}
        for r in got.orderBy("doc_id", "chunk_index").collect():
            found.setdefault(r["doc_id"], []).append((r["content"], r["start"], r["end"], r["title"], r["keywords"]))
        assert found == want


def test_conversion_keeps_failures_as_rows(spark):
    def convert(text):
        if text.startswith("The"):
            raise ValueError("n" * 500)
        return text.upper()

    out = N.convert_corpus(spark.createDataFrame([(1, "a"), (2, "The x"), (3, None), (4, "")], "doc_id long, content string"), convert)
    rows = {r["doc_id"]: r for r in out.collect()}
    assert [rows[i]["ok"] for i in (1, 2, 3, 4)] == [True, False, False, True]
    assert rows[1]["content"] == "A" and rows[4]["content"] == "" and rows[2]["content"] is None
    assert rows[2]["error"] == "ValueError: " + "n" * 120 and rows[3]["error"].startswith("AttributeError: ")
    assert tuple(N.conversion_summary(out).select("succeeded", "failed").first()) == (2, 2)


def test_enrichment_retries_and_error_rows(spark):
    def make():
        asked = {}

        def answer(text):
            asked[text] = asked.get(text, 0) + 1
            if text == "refused":
                raise RuntimeError("no")
            if text == "busy" or (text == "later" and asked[text] < 3):
                raise N.Transient("busy")
            return '{"title": "' + str(asked[text]) + '"}'

        return answer

    chunks = spark.createDataFrame([(1, i, t) for i, t in enumerate(("now", "later", "busy", "refused"))], "doc_id long, chunk_index int, content string")
    rows = N.enrich_chunks(chunks, make, attempts=3, base_delay=0.0).orderBy("chunk_index").collect()
    assert [(r["status"], r["title"], r["error"]) for r in rows] == [("ok", "1", None), ("ok", "3", None), ("error", "", "Transient: busy"), ("error", "", "RuntimeError: no")]
    assert rows[3]["cleaned_chunk"] == "refused"
    assert tuple(N.enrichment_summary(N.enrich_chunks(chunks, make, 3, 0.0)).first()) == (4, 2, 2)


def test_extractive_fields(spark):
    import math
    import re
    from collections import Counter

    texts = ["The cat sat.  Did the cat sleep? Yes", "dog dog cat\n\nA dog ran!", "   ", "the the the"]
    chunks = spark.createDataFrame([(1, i, t, ["H", None] if i == 0 else []) for i, t in enumerate(texts)], "doc_id long, chunk_index int, content string, headings array<string>")
    rows = N.enrich_extractive(chunks, 2).orderBy("chunk_index").collect()
    words = [Counter(re.findall("[a-z]{3,}", t.lower())) for t in texts]
    held = Counter(w for c in words for w in c)
    for r, c in zip(rows, words):
        score = {w: round(k * math.log(len(texts) / held[w]), 6) for w, k in c.items()}
        assert r["keywords"] == sorted(score, key=lambda w: (-score[w], w))[:2]
    assert [r["title"] for r in rows] == ["H", "dog dog cat", "", "the the the"]
    assert rows[0]["summary"] == "The cat sat." and rows[0]["questions"] == ["Did the cat sleep?"] and rows[2]["summary"] == ""


def test_stream_stalls_are_the_batch_gaps(spark, tmp_path):
    from textloom.operators import catalog as C

    events = [(u, 60 * m) for u, minutes in ((1, (0, 10, 100, 130, 400)), (2, (5, 50, 300)), (3, (390,))) for m in minutes]
    df = spark.createDataFrame(events, "user_id long, s long").selectExpr("user_id", "timestamp_seconds(s) AS ts")
    df.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    G.stream_stalls(G.stream_table(spark, str(tmp_path), "events"), "user_id", "ts", "1 hour", f"{tmp_path}/out", f"{tmp_path}/state")
    closed = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").selectExpr("user_id", "unix_seconds(stalled_at) DIV 60 - 60 AS last").collect()}
    gaps = {tuple(r) for r in C.stall_gaps(df, "user_id", "ts", 3600.0).selectExpr("user_id", "unix_seconds(from_ts) DIV 60 AS last").collect()}
    assert gaps == {(1, 10), (1, 130), (2, 50)}
    assert closed == gaps | {(2, 300)}  # the last one of user 2 is silent for an hour by the newest event; the others aren't yet


def test_streams_in_batches_and_again(spark, tmp_path):
    docs = [[(1, "a b c d"), (2, "e")], [(3, "f g h")], [(4, "i j k l m")]]

    def add(i):
        spark.createDataFrame(docs[i], "doc_id long, content string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/docs.parquet")

    def run():
        G.stream_chunks(G.stream_table(spark, str(tmp_path), "docs", 1), "token", f"{tmp_path}/out", f"{tmp_path}/state", size=2, overlap=0)
        return sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select("doc_id", "chunk_index", "content").collect())

    add(0), add(1)
    first = run()
    assert run() == first and len(first) == 5
    assert len(list(tmp_path.glob("out/batch=*"))) >= 2
    add(2)
    batch = K.chunk_token(spark.createDataFrame(sum(docs, []), "doc_id long, content string"), 2, 0)
    assert run() == sorted(tuple(r) for r in batch.select("doc_id", "chunk_index", "content").collect())


def test_keywords_of_rare_terms(spark, monkeypatch):
    """The same terms whether their df goes to all tasks or not, ties and keys in two rows included; nothing is shuffled term by term."""
    import math
    from collections import Counter

    rows = [(1, 0, "one two two İstanbul abc abd abe abf"), (1, 1, "two three"), (1, 1, "three four ONE"), (2, 0, ""), (2, 1, "ab 12"), (3, 0, "one four five six seven eight nine ten " * 3)]
    chunks, held = spark.createDataFrame(rows, "doc_id long, chunk_index int, content string"), {}
    for d, c, t in rows:
        held.setdefault((d, c), Counter()).update(x for x in "".join(x if "a" <= x <= "z" else " " for x in t.lower()).split() if len(x) > 2)
    df, want = Counter(t for x in held.values() for t in x), set()
    for key, x in held.items():
        best = sorted((-round(tf * math.log(len(rows) / df[t]), 6), t) for t, tf in x.items())[:3]
        want |= {(*key, t, -s, i) for i, (s, t) in enumerate(best, 1)}
    for most, size in ((N.HEAD_TERMS, N.SLICE_WORDS), (4, 2), (0, 2)):
        monkeypatch.setattr(N, "HEAD_TERMS", most)
        monkeypatch.setattr(N, "SLICE_WORDS", size)
        assert set(map(tuple, N.tfidf_keywords(chunks, 3).collect())) == want
    assert N.tfidf_keywords(chunks.limit(0), 3).count() == 0


def test_letters_lower_a_text_once(spark):
    import pyspark.sql.functions as F

    texts = ["Abc ABC zZ", "İé ß", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, content string").select("doc_id", K.letter_vector(F.col("content")).alias("v"))
    assert "replace(lower(" not in rows._jdf.queryExecution().optimizedPlan().toString()
    got = {r["doc_id"]: r["v"] for r in rows.collect()}
    assert got[0] == [2.0, 2.0, 2.0, *[0.0] * 22, 2.0] and got[2] == [0.0] * 26 and len(got[1]) == 26
