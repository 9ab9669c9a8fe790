"""Edits of chunk sets: replace, delete, merge, partial updates; every structural change numbers chunks densely again."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.places import merged

TAIL = 300
ENRICHMENT = ("cleaned_chunk", "title", "context", "summary")
ENRICHMENT_LISTS = ("keywords", "questions")


def reindex(chunks: DataFrame) -> DataFrame:
    """chunk_index dense from 0 within a document, in the old order."""
    order = Window.partitionBy("doc_id").orderBy("chunk_index")
    return chunks.withColumn("chunk_index", (F.row_number().over(order) - 1).cast("int"))


def edit_chunks(chunks: DataFrame, edits: DataFrame) -> DataFrame:
    """edits(doc_id, chunk_index, content) replace contents; offsets and enrichment stay."""
    new = edits.select("doc_id", "chunk_index", F.col("content").alias("_new"))
    return chunks.join(new, ["doc_id", "chunk_index"], "left").withColumn("content", F.coalesce("_new", "content")).select(*chunks.columns)


def delete_chunks(chunks: DataFrame, victims: DataFrame) -> DataFrame:
    """Without the victims(doc_id, chunk_index), numbered again."""
    return reindex(chunks.join(victims.select("doc_id", "chunk_index"), ["doc_id", "chunk_index"], "left_anti")).select(*chunks.columns)


def merged_text(contents: Column) -> Column:
    """Texts appended in turn: an overlap with the last TAIL characters is left out, else a blank line goes between. Linear in the texts."""
    return F.arrow_udf(_merged, "string")(contents)


def _merged(contents: pa.Array) -> pa.Array:
    return pa.array([None if x is None else merged(x, TAIL) for x in contents.to_pylist()], pa.string())


def merge_chunks(chunks: DataFrame, selection: DataFrame | Column) -> DataFrame:
    """Chunks of selection(doc_id, chunk_index), or where a condition on them holds, become one: the first one's place and start, the last one's end, enrichment cleared.

    A document with fewer than two selected chunks is unchanged. A condition saves computing the chunks again for the selection.
    """
    if isinstance(selection, Column):
        flagged = chunks.withColumn("_selected", F.coalesce(selection, F.lit(False)))
    else:
        known = selection.select("doc_id", "chunk_index").distinct().withColumn("_selected", F.lit(True))
        flagged = chunks.join(known, ["doc_id", "chunk_index"], "left").withColumn("_selected", F.coalesce("_selected", F.lit(False)))
    # One shuffle by document: its rows are gathered, merged, and dealt out again where they are.
    parts = F.sort_array(F.collect_list(F.when(F.col("_selected"), F.struct("chunk_index", "content", "start", "end"))))
    rows = F.collect_list(F.struct(*[c for c in flagged.columns if c != "doc_id"]))
    docs = flagged.groupBy("doc_id").agg(parts.alias("_parts"), rows.alias("_rows"))
    merges = F.size("_parts") > 1
    made = docs.select(
        "doc_id", "_rows", merges.alias("_merges"), F.get("_parts", F.lit(0))["chunk_index"].alias("_first"), F.get("_parts", F.size("_parts") - 1)["end"].alias("_end"),
        merged_text(F.when(merges, F.transform("_parts", lambda p: p["content"]))).alias("_text"),
    )
    first = F.col("_merges") & (F.col("chunk_index") == F.col("_first"))
    merged = F.struct("_end", "_text")
    # The merged text goes with the first selected chunk only.
    dealt = made.select("doc_id", F.explode(F.transform("_rows", lambda r: F.struct(r.alias("r"), F.when(r["chunk_index"] == F.col("_first"), merged).alias("m")))).alias("_x"), "_merges", "_first")
    kept = dealt.select("doc_id", "_x.r.*", "_x.m._text", "_x.m._end", "_merges", "_first").where(~F.col("_merges") | ~F.col("_selected") | first)
    out = kept.withColumn("content", F.when(first, F.col("_text")).otherwise(F.col("content"))).withColumn("end", F.when(first, F.col("_end")).otherwise(F.col("end")))
    for c in (*ENRICHMENT, *ENRICHMENT_LISTS):
        if c in chunks.columns:
            cleared = F.lit("") if c in ENRICHMENT else F.array().cast("array<string>")
            out = out.withColumn(c, F.when(first, cleared).otherwise(F.col(c)))
    return reindex(out).select(*chunks.columns)


def apply_enrichment(chunks: DataFrame, results: DataFrame) -> DataFrame:
    """results(doc_id, chunk_index, fields) update chunks by index; a null field keeps the old value."""
    fields = [c for c in (*ENRICHMENT, *ENRICHMENT_LISTS) if c in results.columns and c in chunks.columns]
    new = results.select("doc_id", "chunk_index", *[F.col(c).alias(f"_{c}") for c in fields])
    out = chunks.join(new, ["doc_id", "chunk_index"], "left")
    for c in fields:
        out = out.withColumn(c, F.coalesce(f"_{c}", c))
    return out.select(*chunks.columns)


def apply_block_enrichment(blocks: DataFrame, results: DataFrame) -> DataFrame:
    """results(doc_id, block, content) replace blocks; a failed one (null) keeps the original."""
    new = results.select("doc_id", "block", F.col("content").alias("_new"))
    return blocks.join(new, ["doc_id", "block"], "left").withColumn("content", F.coalesce("_new", "content")).select(*blocks.columns)


def is_enriched() -> Column:
    """True if any enrichment field of a chunk row isn't empty."""
    out = F.lit(False)
    for c in ENRICHMENT:
        out = out | (F.coalesce(F.col(c), F.lit("")) != "")
    for c in ENRICHMENT_LISTS:
        out = out | (F.coalesce(F.size(c), F.lit(0)) > 0)
    return out
