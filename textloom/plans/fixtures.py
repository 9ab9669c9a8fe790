"""Views derived from the driver's tables, in Spark and in DuckDB: Markdown documents, tables, pages and model answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.plans.registry import table

_MD_DOCS = """select doc_id, concat('# Document ', cast(doc_id as {string}), chr(10), chr(10),
  case when doc_id % 5 = 0 then concat('```', chr(10), '# not a heading', chr(10), '```', chr(10), chr(10)) else '' end,
  replace(text, chr(10), concat(chr(10), chr(10)))) as content from documents"""
_ESCAPED = "coalesce(text, '')"
for _code, _letter in ((92, "chr(92)"), (34, "chr(34)"), (10, "'n'"), (13, "'r'"), (9, "'t'")):
    _ESCAPED = f"replace({_ESCAPED}, chr({_code}), concat(chr(92), {_letter}))"
_RAW_LLM = f"""with b as (select doc_id, length(text) n, coalesce(text, '') t, {_ESCAPED} e from documents),
j as (select doc_id, t, concat('{{"cleaned_chunk": "', e, '", "title": "T', cast(doc_id as string),
        '", "context": "", "summary": "n=', cast(n as string), '", "keywords": ["a", "b"], "questions": []}}') g from b)
select doc_id, t as original, case doc_id % 6 when 0 then g when 1 then concat('```json', chr(10), g, chr(10), '```') when 2 then substring(g, 1, length(g) - 20)
  when 3 then concat(g, ' {{"title": "cut') when 4 then replace(g, '["a", "b"]', '"a"') else 'I cannot do that.' end as raw_response from j"""

MD_DOCS_SQL = _MD_DOCS.format(string="string")
RAW_LLM_SQL = _RAW_LLM
MD_CONV_SQL = """select conv_id as doc_id, concat('# Conversation ', cast(conv_id as string), chr(10), chr(10),
  string_agg(concat('## Turn ', cast(turn as string), chr(10), chr(10), '### ', role, chr(10), chr(10), text), chr(10) || chr(10) order by turn, role, text)) as content from conversations group by conv_id"""
MD_TABLE_SQL = """select n_regionkey as doc_id, concat('Region ', cast(n_regionkey as string), chr(10), chr(10), '| key | name |', chr(10), '| --- | --- |', chr(10),
  string_agg(concat('| ', cast(n_nationkey as string), ' | ', n_name, ' |'), chr(10) order by n_nationkey), chr(10), chr(10), 'End.') as content from nation group by n_regionkey"""
DOCS_SQL = "select doc_id, text as content from documents"


def _sql(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in tables})


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))


def md_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, MD_DOCS_SQL.replace("from documents", "from {documents}"), "documents")


def raw_llm(spark: SparkSession, sf_dir: str) -> DataFrame:
    escaped = RAW_LLM_SQL.replace("{", "{{").replace("}", "}}").replace("from documents", "from {documents}")
    return _sql(spark, sf_dir, escaped, "documents")


def md_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    part = lambda x: F.concat(F.lit("## Turn "), x["turn"].cast("string"), F.lit("\n\n### "), x["role"], F.lit("\n\n"), x["text"])
    grouped = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_join(F.transform(turns, part), "\n\n").alias("body"))
    return grouped.select("doc_id", F.concat(F.lit("# Conversation "), F.col("doc_id").cast("string"), F.lit("\n\n"), "body").alias("content"))


def md_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name")))
    part = lambda x: F.concat(F.lit("| "), x["n_nationkey"].cast("string"), F.lit(" | "), x["n_name"], F.lit(" |"))
    grouped = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("doc_id")).agg(F.array_join(F.transform(rows, part), "\n").alias("body"))
    return grouped.select("doc_id", F.concat(F.lit("Region "), F.col("doc_id").cast("string"), F.lit("\n\n| key | name |\n| --- | --- |\n"), "body", F.lit("\n\nEnd.")).alias("content"))
