"""The document catalog: uploads, listings, deletions, chunk-set versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T


def upload_summary(files: DataFrame, ok: Column) -> DataFrame:
    """uploaded, failed: how many files pass the rule."""
    return files.agg(F.count_if(F.coalesce(ok, F.lit(False))).alias("uploaded"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("failed"))


def validated_files(files: DataFrame, max_mb: float = 100) -> DataFrame:
    """files (path, length, and head, their first bytes, or content) with ``reason``: null if accepted, else why not. max_mb 0 is no limit.

    scan_heads gives files with heads, so that no whole file is read.
    """
    first = "head" if "head" in files.columns else "content"
    name = F.substring_index("path", "/", -1)
    suffix = F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))
    too_large = F.lit(False) if max_mb == 0 else F.col("length") > max_mb * 1024 * 1024
    reason = (
        F.when(~suffix.isin(".pdf", ".md"), F.lit("unsupported type"))
        .when(too_large, F.lit("too large"))
        .when((suffix == ".pdf") & (F.substring(first, 1, 5) != F.lit(b"%PDF-")), F.lit("not a PDF"))
    )
    return files.withColumn("reason", reason)


def latest_by(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Of each key the last row by these columns; a later upload replaces an earlier one."""
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


def latest_versions(chunks: DataFrame, key: str = "stem", run: str = "run_ts") -> DataFrame:
    """All rows of each document's newest run. The newest run per key is a small aggregate that is joined back."""
    newest = chunks.groupBy(key).agg(F.max(run).alias(run))
    return chunks.join(newest, [key, run], "left_semi")


def catalog_metadata(pdfs: DataFrame, mds: DataFrame, key: str = "stem") -> DataFrame:
    """key, has_markdown, has_pdf, is_md_only: PDFs first, then documents that only have Markdown."""
    md_keys = mds.select(F.col(key)).distinct().withColumn("has_markdown", F.lit(True))
    with_pdf = pdfs.select(key).distinct().join(md_keys, key, "left").select(key, F.coalesce("has_markdown", F.lit(False)).alias("has_markdown"), F.lit(True).alias("has_pdf"))
    md_only = md_keys.join(pdfs.select(key), key, "left_anti").select(key, "has_markdown", F.lit(False).alias("has_pdf"))
    return with_pdf.unionByName(md_only).withColumn("is_md_only", ~F.col("has_pdf"))


def list_documents(pdfs: DataFrame, mds: DataFrame, name: str = "name", key: str = "stem") -> DataFrame:
    """All PDFs, and Markdown files whose stem has no PDF, in order of name; the sort is by ranges, so no task sees all."""
    return pdfs.select(name).unionByName(mds.join(pdfs.select(key), key, "left_anti").select(name)).orderBy(name)


def get_documents(wanted: DataFrame, pdfs: DataFrame, mds: DataFrame, key: str = "stem") -> DataFrame:
    """wanted(name, stem): a PDF with its Markdown or ''; a Markdown name has has_pdf false even if there is a PDF."""
    suffix = F.lower(F.regexp_extract("name", r"(\.[^.]+)$", 1))
    pdf_rows = wanted.where(suffix == ".pdf").join(pdfs.select(key), key, "left_semi").join(mds.select(key, "content"), key, "left")
    md_rows = wanted.where(suffix == ".md").join(mds.select(key, "content"), key)
    one = pdf_rows.select("name", key, F.coalesce("content", F.lit("")).alias("content"), F.col("content").isNotNull().alias("has_markdown"), F.lit(True).alias("has_pdf"))
    return one.unionByName(md_rows.select("name", key, "content", F.lit(True).alias("has_markdown"), F.lit(False).alias("has_pdf")))


def delete_cascade(pdfs: DataFrame, mds: DataFrame, sets: DataFrame, request: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """request(ordinal, filename) -> the remaining PDFs, Markdown files and chunk sets, and an outcome per request.

    A PDF takes its Markdown and chunks with it; a Markdown file takes its chunks and leaves the PDF. A name that an earlier
    request removed, or that never was, fails. Tables have a column stem.
    """
    suffix = F.lower(F.regexp_extract("filename", r"(\.[^.]+)$", 1))
    asked = request.select("ordinal", "filename", T.safe_stem(F.col("filename")).alias("stem"), suffix.alias("suffix"))
    known = (
        asked.join(pdfs.select("stem").distinct().withColumn("pdf_there", F.lit(True)), "stem", "left")
        .join(mds.select("stem").distinct().withColumn("md_there", F.lit(True)), "stem", "left")
    )
    earlier = Window.partitionBy("stem").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    pdf_before = F.coalesce(F.max(F.when((F.col("suffix") == ".pdf") & F.col("pdf_there"), True)).over(earlier), F.lit(False))
    md_before = F.coalesce(F.max(F.when(F.col("suffix") == ".md", True)).over(earlier), F.lit(False))
    done = known.select(
        "ordinal", "filename", "stem", "suffix",
        F.when(F.col("suffix") == ".pdf", F.coalesce("pdf_there", F.lit(False)) & ~pdf_before)
        .when(F.col("suffix") == ".md", F.coalesce("md_there", F.lit(False)) & ~pdf_before & ~md_before)
        .otherwise(False).alias("deleted"),
    )
    gone = done.where("deleted")
    pdf_gone, any_gone = gone.where("suffix = '.pdf'").select("stem"), gone.select("stem")
    outcome = done.select("ordinal", "filename", "deleted", F.when(~F.col("deleted"), F.lit("not found")).alias("error"))
    return pdfs.join(pdf_gone, "stem", "left_anti"), mds.join(any_gone, "stem", "left_anti"), sets.join(any_gone, "stem", "left_anti"), outcome


def content_bounds(docs: DataFrame, least: int = 1, most: int = 10_000_000, content: str = "content") -> DataFrame:
    """docs with ``error``: null if the content's length is within bounds, else why it isn't chunked."""
    n = F.length(content)
    return docs.withColumn("error", F.when(n.isNull() | (n < least), F.lit("content is too short")).when(n > most, F.lit("content is too long")))


def page_limit(docs: DataFrame, pages: DataFrame, most: int, key: str = "doc_id") -> DataFrame:
    """docs with n_pages (null if unknown) and within_limit; most 0 is no limit, an unknown number passes."""
    counts = pages.groupBy(key).agg(F.count("*").alias("n_pages"))
    return docs.join(counts, key, "left").withColumn("within_limit", F.lit(True) if most == 0 else F.coalesce(F.col("n_pages") <= most, F.lit(True)))


def search_documents(docs: DataFrame, text: str, name: str = "name") -> DataFrame:
    return docs.where(F.contains(F.lower(name), F.lit(text.lower())))


def chunkable(selection: DataFrame, catalog: DataFrame, key: str = "stem") -> DataFrame:
    """The selected documents that have Markdown."""
    return selection.join(catalog.where("has_markdown").select(key), key, "left_semi")


def batch_summary(outcomes: DataFrame, ok: str = "success") -> DataFrame:
    return outcomes.agg(F.count_if(ok).alias("succeeded"), F.count_if(~F.coalesce(F.col(ok), F.lit(False))).alias("failed"))


def corpus_metrics(pdfs: DataFrame, mds: DataFrame, sets: DataFrame, payload: str = "payload") -> DataFrame:
    """n_pdfs, n_mds, set_bytes: one row of three global aggregates."""
    one = pdfs.agg(F.count("*").alias("n_pdfs"))
    two = mds.agg(F.count("*").alias("n_mds"))
    three = sets.agg(F.coalesce(F.sum(F.octet_length(payload)), F.lit(0)).alias("set_bytes"))
    return one.join(two, F.lit(True)).join(three, F.lit(True))


def running_progress(outcomes: DataFrame, batch: str, *order: str) -> DataFrame:
    """After each completion of a batch: current, total and percent, rounded half to even."""
    w = Window.partitionBy(batch)
    current = F.row_number().over(w.orderBy(*order))
    total = F.count("*").over(w)
    return outcomes.withColumn("current", current).withColumn("total", total).withColumn("percent", F.bround(F.col("current") / F.col("total") * 100).cast("int"))


def stall_gaps(events: DataFrame, key: str, ts: str, timeout_s: float) -> DataFrame:
    """key, from_ts, to_ts, gap_s of silences longer than the timeout; 0 turns it off."""
    events = events.withColumn(ts, F.col(ts).cast("timestamp"))
    nxt = F.lead(ts).over(Window.partitionBy(key).orderBy(ts))
    gap = (F.unix_micros(nxt) - F.unix_micros(F.col(ts))) / 1_000_000
    rows = events.select(key, F.col(ts).alias("from_ts"), nxt.alias("to_ts"), gap.alias("gap_s"))
    return rows.where(F.lit(timeout_s > 0) & (F.col("gap_s") > timeout_s))
