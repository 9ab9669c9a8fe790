"""Conversion and enrichment jobs: HTML to Markdown, user functions with failure isolation, extractive fields, keywords."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import answers as A
from textloom.functions import text as T
from textloom.operators import chunking as K
from textloom.operators import editing as E
from textloom.sources.storage import shared_folder

#: Terms whose document frequency goes to all tasks; those of all others meet their chunks in a join.
HEAD_TERMS = 1 << 18
#: Words of chunks that a task ranks at once.
SLICE_WORDS = 1 << 20
#: HTML to Markdown as pattern and replacement, in this order; the patterns mean the same to Java and RE2.
HTML_RULES = (
    (r"(?is)<!--.*?-->", ""),
    *((rf"(?is)<{t}\b.*?</{t}\s*>", "") for t in ("script", "style", "nav", "footer", "head")),
    *((rf"(?i)<h{k}\b[^>]*>", "\n\n" + "#" * k + " ") for k in range(1, 7)),
    (r"(?i)</h[1-6]\s*>", "\n\n"),
    (r"(?i)<li\b[^>]*>", "\n- "),
    (r"(?i)<br\s*/?>", "\n"),
    (r"(?i)</?(?:b|strong)(?:\s[^>]*)?>", "**"),
    (r"(?i)</?(?:p|div|ul|ol|table|tr|section|article|header|main|blockquote|pre)\b[^>]*>", "\n\n"),
    (r"<[^>]+>", ""),
    (r"&lt;", "<"),
    (r"&gt;", ">"),
    (r"&quot;", '"'),
    (r"&nbsp;", " "),
    (r"&amp;", "&"),
    (r"[ \t]+\n", "\n"),
    (r"\n{3,}", "\n\n"),
    (r"^[ \t\n\f\r]+|[ \t\n\f\r]+$", ""),
)


def html_to_markdown(html: Column) -> Column:
    out = F.coalesce(html, F.lit(""))
    for pattern, put in HTML_RULES:
        out = F.regexp_replace(out, pattern, put.replace("\\", "\\\\").replace("$", "\\$"))
    return out


def pages_to_markdown(pages: DataFrame) -> DataFrame:
    """pages(page_id, html) to doc_id, content."""
    return pages.select(F.col("page_id").alias("doc_id"), html_to_markdown(F.col("html")).alias("content"))


def convert_corpus(docs: DataFrame, fn: Callable[[str], str], source: str = "content") -> DataFrame:
    """doc_id, ok, content, error, duration_ms: fn per document; a failure is a row, never the end of the job."""
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, value in zip(b["doc_id"], b["value"]):
                began = time.perf_counter()
                try:
                    made, error = fn(value), None
                except Exception as e:
                    made, error = None, f"{type(e).__name__}: {str(e)[:120]}"
                rows.append((doc, error is None, made, error, int((time.perf_counter() - began) * 1000)))
            yield pd.DataFrame(rows, columns=["doc_id", "ok", "content", "error", "duration_ms"])

    return docs.select("doc_id", F.col(source).alias("value")).mapInPandas(run, f"doc_id {key}, ok boolean, content string, error string, duration_ms long")


def conversion_summary(outcomes: DataFrame) -> DataFrame:
    return outcomes.agg(F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"), F.sum("duration_ms").alias("duration_ms"))


def transcribe_pages(pages: DataFrame, fn: Callable[[str], str], concurrency: int = 8) -> DataFrame:
    """pages(doc_id, page, content) through fn, at most concurrency tasks at a time, joined in page order; a failed page is empty."""
    keyed = pages.select(F.struct("doc_id", "page").alias("doc_id"), "content").repartition(concurrency)
    done = convert_corpus(keyed, fn)
    return K.join_pages(done.select("doc_id.doc_id", "doc_id.page", "content"))


class Transient(Exception):
    """An error worth another attempt: time-out, lost connection, server error, too many requests."""


def status_of(error: BaseException) -> int | None:
    """The HTTP status that an error carries by itself or in its response, under the names that clients use."""
    for holder in (error, getattr(error, "response", None)):
        for name in ("status_code", "status", "code"):
            value = getattr(holder, name, None)
            if isinstance(value, int):
                return value
    return None


def worth_retrying(error: BaseException) -> bool:
    """Time-outs, lost connections, statuses of 500 and above, and 429; any other status or error is final."""
    if isinstance(error, (Transient, TimeoutError, ConnectionError)):
        return True
    status = status_of(error)
    return status is not None and (status >= 500 or status == 429)


def with_retries(fn: Callable[[str], str], value: str, attempts: int = 3, base_delay: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> str:
    for k in range(attempts):
        try:
            return fn(value)
        except Exception as e:
            if k + 1 == attempts or not worth_retrying(e):
                raise
            sleep(base_delay * 2**k)
    raise ValueError("attempts must be positive")


def enrich_chunks(chunks: DataFrame, make_fn: Callable[[], Callable[[str], str]], attempts: int = 3, base_delay: float = 1.0, calls: int = 1) -> DataFrame:
    """doc_id, chunk_index, the six fields, status, error: make_fn runs once per partition, its function once per chunk.

    A task has at most so many calls in flight; results stand in the order of its chunks. What worth_retrying names is tried again
    after base_delay, twice that, and so on, no wait after the last attempt; an error is a row and holds nothing else up.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fn = make_fn()

        def ask(value: str) -> tuple[str | None, str | None]:
            try:
                return with_retries(fn, value, attempts, base_delay), None
            except Exception as e:
                return None, f"{type(e).__name__}: {str(e)[:200]}"

        with ThreadPoolExecutor(calls) as pool:
            for b in batches:
                raw, errors = zip(*pool.map(ask, b["content"])) if len(b) else ((), ())
                yield pd.DataFrame({"doc_id": b["doc_id"], "chunk_index": b["chunk_index"], "original": b["content"], "raw_response": list(raw), "error": list(errors)})

    key = chunks.schema["doc_id"].dataType.simpleString()
    asked = chunks.select("doc_id", "chunk_index", "content").mapInPandas(run, f"doc_id {key}, chunk_index int, original string, raw_response string, error string")
    return A.recovered(asked).drop("original", "raw_response")


def enrich_markdown(docs: DataFrame, fn: Callable[[str], str]) -> DataFrame:
    """Each block of each document through fn; a failed block keeps its text; blocks joined again."""
    blocks = K.split_blocks(docs)
    keyed = blocks.select(F.struct("doc_id", "block").alias("doc_id"), "content")
    done = convert_corpus(keyed, fn).select("doc_id.doc_id", "doc_id.block", F.when(F.col("ok"), T.strip_fence(F.col("content"), "markdown")).alias("content"))
    return K.join_blocks(E.apply_block_enrichment(blocks, done))


def enrichment_summary(results: DataFrame) -> DataFrame:
    return results.agg(F.count("*").alias("total"), F.count_if(F.col("status") != "error").alias("succeeded"), F.count_if(F.col("status") == "error").alias("failed"))


def _frequent(df: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """The terms with the highest df, at most so many: whole levels of a histogram on a logarithmic scale; and whether they are all."""
    level = F.floor(8 * F.log2("df"))
    room, least, levels = most, None, df.groupBy(level.alias("level")).count().collect()  # 8 * 64 rows at most
    for at, size in sorted(((r["level"], r["count"]) for r in levels), reverse=True):
        if size > room:
            break
        room, least = room - size, at
    return df.where(level >= least) if least is not None else df.limit(0), most - room == sum(r["count"] for r in levels)


def _best_terms(shared, n: int, k: int):
    """doc_id, chunk_index, term, tf, df of the terms of each chunk that can be among its k best, and of those whose df isn't known here (null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, df = shared.value
        for b in batches:
            upto, first = b.column("words").offsets.to_numpy(), 0
            while first < b.num_rows:
                last = max(first + 1, int(np.searchsorted(upto, upto[first] + SLICE_WORDS, "right")) - 1)
                part, first = b.slice(first, last - first), last
                words = part.column("words")
                terms = words.flatten().dictionary_encode()
                size = max(1, len(terms.dictionary))
                owner = pc.list_parent_indices(words).to_numpy().astype(np.int64)
                pairs, tf = np.unique(owner * size + terms.indices.to_numpy(), return_counts=True)
                row, term = np.divmod(pairs, size)
                at = pc.index_in(terms.dictionary, value_set=known).fill_null(-1).to_numpy(zero_copy_only=False)[term]
                hit = at >= 0
                found = np.where(hit, df[at] if len(df) else 0, 0)
                score = np.where(hit, tf * np.log(n / np.maximum(found, 1)), -np.inf)
                order = np.lexsort((-score, row))
                # The k-th best score of each chunk; Spark rounds and breaks ties among what reaches it.
                begins = np.searchsorted(row, np.arange(part.num_rows))
                sizes = np.diff(np.append(begins, len(row)))
                least = np.full(part.num_rows, -np.inf)
                least[sizes >= k] = score[order[begins[sizes >= k] + k - 1]]
                keep = np.flatnonzero(~hit | (score >= least[row] - 2e-6))
                keys = [part.column(c).take(pa.array(row[keep])) for c in ("doc_id", "chunk_index")]
                frequency = pa.array(found[keep], pa.int64(), mask=~hit[keep])
                yield pa.RecordBatch.from_arrays([*keys, terms.dictionary.take(pa.array(term[keep])), pa.array(tf[keep], pa.int64()), frequency], names=["doc_id", "chunk_index", "term", "tf", "df"])

    return run


def tfidf_keywords(chunks: DataFrame, k: int = 5) -> DataFrame:
    """doc_id, chunk_index, term, score, rank: the k best terms of each chunk by tf * ln(N / df), ties by term.

    Texts are shuffled once by chunk, so rows with one key count as one chunk. Tasks count the terms of a chunk and send on only those that can be
    among its best, with the df of HEAD_TERMS frequent terms at hand; rarer terms meet their df in a join.
    """
    spark = chunks.sparkSession
    shared_folder(spark)
    texts = chunks.groupBy("doc_id", "chunk_index").agg(F.collect_list("content").alias("contents"), F.count("*").alias("rows"))
    words = texts.select("doc_id", "chunk_index", "rows", F.flatten(F.transform("contents", lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z]{3,}"), F.lit(0)))).alias("words"))
    # No term is empty: that row counts the chunks.
    once = words.select(F.explode(F.array_append(F.transform(F.array_distinct("words"), lambda t: F.struct(t.alias("term"), F.lit(1).cast("long").alias("n"))), F.struct(F.lit("").alias("term"), F.col("rows").alias("n")))).alias("t"))
    counts = once.groupBy("t.term").agg(F.sum("t.n").alias("df")).checkpoint()
    n = (counts.where("term = ''").first() or {"df": 0})["df"]
    df = counts.where("term <> ''")
    head, whole = _frequent(df, HEAD_TERMS)
    known = head.toArrow()  # HEAD_TERMS rows at most
    shared = spark.sparkContext.broadcast((known.column("term").combine_chunks(), known.column("df").to_numpy()))
    key, place = (chunks.schema[c].dataType.simpleString() for c in ("doc_id", "chunk_index"))
    made = words.select("doc_id", "chunk_index", "words").mapInArrow(_best_terms(shared, n, k), f"doc_id {key}, chunk_index {place}, term string, tf long, df long")
    if not whole:
        made = made.checkpoint()
        made = made.where("df IS NOT NULL").unionByName(made.where("df IS NULL").drop("df").join(df, "term").select(*made.columns))
    scored = made.withColumn("score", F.round(F.col("tf") * F.log(F.lit(n) / F.col("df")), 6))
    rank = F.row_number().over(Window.partitionBy("doc_id", "chunk_index").orderBy(F.desc("score"), "term"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("doc_id", "chunk_index", "term", "score", "rank")


def enrich_extractive(chunks: DataFrame, k: int = 5) -> DataFrame:
    """chunks(doc_id, chunk_index, content, headings) with the six fields filled without a model."""
    words = tfidf_keywords(chunks, k).groupBy("doc_id", "chunk_index").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("keywords"))
    space = r"^[ \t\n\f\r]+|[ \t\n\f\r]+$"
    sentences = F.filter(F.transform(F.regexp_extract_all("content", F.lit(T.SENTENCE), F.lit(0)), lambda s: F.regexp_replace(s, space, "")), lambda s: s != "")
    first_line = F.get(F.filter(F.split("content", "\n"), lambda s: F.trim(s) != ""), F.lit(0))
    rows = chunks.join(words, ["doc_id", "chunk_index"], "left").withColumn("_s", sentences)
    return rows.select(
        "doc_id", "chunk_index",
        F.trim(F.regexp_replace("content", r"[ \t\n\f\r]+", " ")).alias("cleaned_chunk"),
        F.coalesce(F.try_element_at(F.filter("headings", lambda h: h.isNotNull()), F.lit(-1)), F.trim(first_line), F.lit("")).alias("title"),
        F.array_join("headings", " > ").alias("context"),
        F.coalesce(F.get("_s", F.lit(0)), F.lit("")).alias("summary"),
        F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"),
        F.filter("_s", lambda s: F.endswith(s, F.lit("?"))).alias("questions"),
    )
