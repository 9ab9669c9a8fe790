"""Catalog, naming and aggregate queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import catalog as C
from textloom.plans.registry import query, table
from textloom.sources.heads import scan_heads, write_files
from textloom.sources.storage import scan_markdown, shared_folder


@query("select count(*) filter (n_chars <= 2000) as uploaded, count(*) filter (not n_chars <= 2000) as failed from documents")
def s4_upload_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.upload_summary(table(spark, sf_dir, "documents"), F.col("n_chars") <= 2000)


def _uploads(spark: SparkSession, sf_dir: str) -> str:
    """A folder with a file of each document: PDFs with and without their mark, also with an upper-case suffix, Markdown, others."""
    folder = f"{shared_folder(spark)}/uploads-{uuid.uuid4().hex}"
    kind, text = F.col("doc_id") % 5, F.coalesce("text", F.lit(""))
    suffix = F.get(F.lit([".pdf", ".pdf", ".PDF", ".md", ".txt"]), kind.cast("int"))
    body = F.encode(F.when(kind.isin(0, 2), F.concat(F.lit("%PDF-"), text)).otherwise(text), "utf-8")
    files = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string"), suffix).alias("name"), body.alias("body"))
    write_files(files.where("doc_id % 2 = 1"), folder)
    write_files(files.where("doc_id % 2 = 0"), f"{folder}/even")
    return folder


@query("""with f as (select concat('d', doc_id, ['.pdf', '.pdf', '.PDF', '.md', '.txt'][1 + doc_id % 5]) as name, case when doc_id % 5 in (0, 2) then 5 else 0 end + strlen(coalesce(text, '')) as length, doc_id % 5 as kind, text from documents)
select name, cast(length as bigint) as length, case when kind = 4 then 'unsupported type' when length > 2097.152 then 'too large' when kind = 1 and not starts_with(coalesce(text, ''), '%PDF-') then 'not a PDF' end as reason from f""")
def s3_validate_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files written from the documents, judged by their sizes and first five bytes."""
    return C.validated_files(scan_heads(spark, _uploads(spark, sf_dir), head=5), 0.002).select("name", "length", "reason")


@query("select concat('d', doc_id, '.md') as name, concat('d', doc_id) as stem, coalesce(text, '') as content from documents where doc_id % 5 = 3")
def s1_scan_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_markdown(spark, _uploads(spark, sf_dir))


@query("""select concat('d', doc_id, ['.pdf', '.pdf', '.PDF', '.md'][1 + doc_id % 5]) as name, cast(case when doc_id % 5 in (0, 2) then 5 else 0 end + strlen(coalesce(text, '')) as bigint) as length
from documents where doc_id % 5 <> 4""")
def s2_scan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing of PDF and Markdown files alone; no byte of them is asked for."""
    return scan_heads(spark, _uploads(spark, sf_dir), head=0, suffixes=(".pdf", ".md")).select("name", "length")


@query("select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) where r = 1")
def s5_latest_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.latest_by(table(spark, sf_dir, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


@query("""
with runs as (select source as stem, doc_id, n_chars, 'r1' as run_ts from documents union all
              select source, doc_id, n_chars, 'r2' from documents where doc_id % 3 = 0)
select stem, doc_id, run_ts from runs r where run_ts = (select max(run_ts) from runs q where q.stem = r.stem)""")
def s7_load_latest_chunk_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("stem"), "doc_id")
    runs = docs.withColumn("run_ts", F.lit("r1")).unionByName(docs.where("doc_id % 3 = 0").withColumn("run_ts", F.lit("r2")))
    return C.latest_versions(runs).select("stem", "doc_id", "run_ts")


_CASCADE_SQL = """
with p as (select 'd' || doc_id as stem, doc_id from documents where doc_id % 2 = 0), m as (select 'd' || doc_id as stem, doc_id from labels),
r as (select doc_id as ordinal, 'd' || (doc_id // 2) || case when doc_id % 3 = 0 then '.pdf' when doc_id % 3 = 1 then '.md' else '.txt' end as filename from documents),
a as (select ordinal, filename, regexp_replace(filename, '^(.+)\\.[^.]+$', '\\1') as stem, regexp_extract(filename, '(\\.[^.]+)$', 1) as suffix from r),
k as (select a.*, p.stem is not null as pdf_there, m.stem is not null as md_there from a left join (select distinct stem from p) p using (stem) left join (select distinct stem from m) m using (stem)),
b as (select *, coalesce(bool_or(suffix = '.pdf' and pdf_there) over w, false) as pdf_before, coalesce(bool_or(suffix = '.md') over w, false) as md_before from k
      window w as (partition by stem order by ordinal rows between unbounded preceding and 1 preceding)),
o as (select *, case suffix when '.pdf' then pdf_there and not pdf_before when '.md' then md_there and not pdf_before and not md_before else false end as deleted from b)"""


@query(_CASCADE_SQL + " select ordinal, filename, deleted, case when not deleted then 'not found' end as error from o")
def s11_delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cascade(spark, sf_dir)[3]


@query(_CASCADE_SQL + """, gone as (select stem, bool_or(suffix = '.pdf') as pdf_gone from o where deleted group by 1)
select 'pdf' as kind, stem, doc_id from p where stem not in (select stem from gone where pdf_gone) union all
select kind, stem, doc_id from m, (select unnest(['md', 'set']) as kind) where stem not in (select stem from gone)""")
def s11_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a cascade leaves of the three tables."""
    pdfs, mds, sets, _ = _cascade(spark, sf_dir)
    left = [t.select(F.lit(kind).alias("kind"), "stem", "doc_id") for kind, t in (("pdf", pdfs), ("md", mds), ("set", sets))]
    return left[0].unionByName(left[1]).unionByName(left[2])


def _cascade(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents")
    stem = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    pdfs, mds = docs.where("doc_id % 2 = 0").select(stem.alias("stem"), "doc_id"), table(spark, sf_dir, "labels").select(stem.alias("stem"), "doc_id")
    suffix = F.when(F.col("doc_id") % 3 == 0, ".pdf").when(F.col("doc_id") % 3 == 1, ".md").otherwise(".txt")
    request = docs.select(F.col("doc_id").alias("ordinal"), F.concat(F.lit("d"), F.floor(F.col("doc_id") / 2).cast("string"), suffix).alias("filename"))
    return C.delete_cascade(pdfs, mds, mds, request)


@query("select * from documents")
def s12_scan_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query("""select page_id, piece, coalesce(piece not in ('', '.', '..') and not contains(piece, '/'), false) as safe
from (select page_id, unnest([url, string_split(url, '/')[-1], string_split(url, '/')[3], '..']) as piece from pages)""")
def p1_is_safe_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.split("url", "/")
    pieces = table(spark, sf_dir, "pages").select("page_id", F.explode(F.array("url", F.element_at(parts, -1), F.get(parts, F.lit(2)), F.lit(".."))).alias("piece"))
    return pieces.select("page_id", "piece", T.is_safe_filename(F.col("piece")).alias("safe"))


@query("select page_id, nullif(regexp_replace(string_split(url, '/')[-1], '^(.+)\\.[^.]+$', '\\1'), '') as stem from pages")
def p2_safe_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.safe_stem(F.col("url")).alias("stem"))


@query("""select 'd' || doc_id as id, coalesce(nullif(trim(regexp_replace(text, '[^a-zA-Z0-9]+', '-', 'g'), '-'), ''), 'doc') as name from documents
union all select 'p' || page_id, coalesce(nullif(trim(regexp_replace(url, '[^a-zA-Z0-9]+', '-', 'g'), '-'), ''), 'doc') from pages""")
def p3_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), T.sanitise(F.col("text")).alias("name"))
    return docs.unionByName(table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), "page_id").alias("id"), T.sanitise(F.col("url")).alias("name")))


@query("""select doc_id, source || '-' || doc_id || '_' || case doc_id % 3 when 0 then 'lib-token' when 1 then 'token' else 'chunks' end || '_2024-03-05_07-08-09-000010' as name from documents""")
def p4_chunk_set_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    library = F.when(F.col("doc_id") % 3 == 0, F.lit("lib"))
    strategy = F.when(F.col("doc_id") % 3 < 2, F.lit("token"))
    stem = F.concat_ws(" ", "source", F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", T.chunk_set_name(stem, library, strategy, F.lit("2024-03-05 07:08:09.00001").cast("timestamp")).alias("name"))


@query("select doc_id, case when length(text) < 100 or text is null then 'content is too short' when length(text) > 5000 then 'content is too long' end as error from documents")
def p6_content_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.content_bounds(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content")), 100, 5000).select("doc_id", "error")


@query("""select d.doc_id, n as n_pages, coalesce(n <= 3, true) as within_limit
from documents d left join (select conv_id, count(*) as n from conversations group by 1) on conv_id = d.doc_id""")
def p7_page_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"))
    return C.page_limit(table(spark, sf_dir, "documents").select("doc_id"), pages, 3)


@query("select page_id, url as name from pages where contains(lower(url), 'example.org')")
def p8_search_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.search_documents(table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("name")), "Example.ORG")


@query("select doc_id, cast(length(text) as bigint) as n_chars, cast(len(regexp_extract_all(text, '\\S+')) as bigint) as n_words from documents")
def p10_content_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("n_chars"), T.word_count(F.col("text")).cast("long").alias("n_words"))


@query("""select doc_id, array_to_string(list_filter(list_transform(string_split(text, ','), lambda x: trim(x)), lambda x: x <> ''), '|') as keywords,
len(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')) as n_questions from documents""")
def p11_parse_list_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.array_join(T.split_list(F.col("text"), ","), "|").alias("keywords"), F.size(T.split_list(F.col("text"), "\n")).alias("n_questions")
    )


@query("select doc_id, 'ValueError: ' || left(text, 200) as chunk_error, 'ValueError: ' || left(text, 120) as convert_error from documents")
def p12_truncate_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.lit("ValueError")
    return table(spark, sf_dir, "documents").select("doc_id", T.truncated_error(kind, F.col("text"), 200).alias("chunk_error"), T.truncated_error(kind, F.col("text"), 120).alias("convert_error"))


def _catalog(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    stem = F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("stem")
    pdfs = table(spark, sf_dir, "documents").where("doc_id % 4 <> 3").select(stem, F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("name"))
    mds = table(spark, sf_dir, "labels").select(stem, F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".md")).alias("name"), F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("content"))
    return pdfs, mds


_CATALOG_SQL = """with p as (select 'd' || doc_id as stem, 'd' || doc_id || '.pdf' as name from documents where doc_id % 4 <> 3),
m as (select 'd' || doc_id as stem, 'd' || doc_id || '.md' as name, 'quality ' || quality as content from labels)
"""


@query(_CATALOG_SQL + """select stem, stem in (select stem from m) as has_markdown, true as has_pdf, false as is_md_only from p
union all select stem, true, false, true from m where stem not in (select stem from p)""")
def j1_catalog_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.catalog_metadata(*_catalog(spark, sf_dir))


@query(_CATALOG_SQL + """, w as (select 'd' || doc_id || case when doc_id % 2 = 0 then '.pdf' else '.md' end as name, 'd' || doc_id as stem from documents)
select w.name, stem, coalesce(content, '') as content, content is not null as has_markdown, true as has_pdf from w left join m using (stem) where w.name like '%.pdf' and stem in (select stem from p)
union all select w.name, stem, content, true, false from w join m using (stem) where w.name like '%.md'""")
def j2_get_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    pdfs, mds = _catalog(spark, sf_dir)
    wanted = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, ".pdf").otherwise(".md")).alias("name"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("stem")
    )
    return C.get_documents(wanted, pdfs, mds)


@query("select 'd' || doc_id as stem from documents where doc_id % 4 <> 3 and doc_id in (select doc_id from labels)")
def j3_chunkable(spark: SparkSession, sf_dir: str) -> DataFrame:
    pdfs, mds = _catalog(spark, sf_dir)
    return C.chunkable(pdfs.select("stem"), C.catalog_metadata(pdfs, mds))


@query(_CATALOG_SQL + "select name from p union all select name from m where stem not in (select stem from p)")
def u1_list_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.list_documents(*_catalog(spark, sf_dir))


@query(_CATALOG_SQL + """, u as (select name, stem in (select stem from p) as has_pdf from m union all select name, true from p)
select cast(row_number() over (order by has_pdf desc, name) as bigint) as place, name from u""")
def t3_metadata_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with a PDF by name, then those with Markdown only: global order by a sort, numbered within range partitions."""
    pdfs, mds = _catalog(spark, sf_dir)
    known = pdfs.select("stem").distinct().withColumn("has_pdf", F.lit(True))
    rows = mds.join(known, "stem", "left").select("name", F.coalesce("has_pdf", F.lit(False)).alias("has_pdf")).unionByName(pdfs.select("name", F.lit(True).alias("has_pdf")))
    return globally_numbered(rows, "place", F.col("has_pdf").desc(), F.col("name").asc()).select("place", "name")


@query(_CATALOG_SQL + """, u as (select name from p union all select name from m where stem not in (select stem from p))
select cast(row_number() over (order by name) as bigint) as place, name from u""")
def t1_listing_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing with each file's place by name."""
    return globally_numbered(C.list_documents(*_catalog(spark, sf_dir)), "place", F.col("name").asc()).select("place", "name")


def globally_numbered(rows: DataFrame, place: str, *order) -> DataFrame:
    """Rows with their place in a global order, without one task seeing all: ranges are sorted, counted and shifted.

    The ranges are written to the shared folder, so both branches see the same ones.
    """
    from pyspark.sql import Window

    shared_folder(rows.sparkSession)
    ranged = rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    inner = ranged.withColumn("_in", F.row_number().over(Window.partitionBy("_part").orderBy(*order))).checkpoint()
    sizes = inner.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return inner.join(before, "_part").withColumn(place, F.col("_in") + F.col("_before")).drop("_part", "_in", "_before")


@query("select count(*) filter (toxic = 0) as succeeded, count(*) filter (toxic <> 0 or toxic is null) as failed from labels")
def a2_batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.batch_summary(table(spark, sf_dir, "labels").select((F.col("toxic") == 0).alias("success")))


@query("""select (select count(*) from documents where doc_id % 4 <> 3) as n_pdfs, (select count(*) from labels) as n_mds, (select cast(sum(strlen(text)) as bigint) from documents) as set_bytes""")
def a3_corpus_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    pdfs, mds = _catalog(spark, sf_dir)
    return C.corpus_metrics(pdfs, mds, table(spark, sf_dir, "documents").select(F.col("text").alias("payload")))


@query("""select event_id, current, total, cast(round_even(current / total * 100, 0) as int) as percent
from (select event_id, row_number() over (partition by user_id order by ts, event_id) as current, count(*) over (partition by user_id) as total from events)""")
def w2_running_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.running_progress(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), "user_id", "ts", "event_id").select("event_id", "current", "total", "percent")


@query("""select user_id, epoch_us(ts) as from_us, epoch_us(nxt) as to_us from (select user_id, ts, lead(ts) over (partition by user_id order by ts) as nxt from events)
where epoch_us(nxt) - epoch_us(ts) > 3600000000""")
def w5_stall_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = C.stall_gaps(table(spark, sf_dir, "events"), "user_id", "ts", 3600.0)
    return gaps.select("user_id", F.unix_micros("from_ts").alias("from_us"), F.unix_micros("to_ts").alias("to_us"))
