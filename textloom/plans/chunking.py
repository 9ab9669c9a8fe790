"""Chunking queries. The SQL packs by joins over prefix sums and a recursion over chunks, independent of the Spark expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import chunking as K
from textloom.plans import fixtures as X
from textloom.plans.registry import query, table

TOKEN = r"\s*\S+(?:\s+$)?"
SENTENCE = r"[^.!?\n]*[.!?\n]+\s*|[^.!?\n]+$"
COLUMNS = ("doc_id", "chunk_index", "content", "start", "end")


def n_tokens(c: str) -> str:
    return f"len(regexp_extract_all({c}, '\\S+'))"


def token_windows_sql(source: str, size: int, overlap: int) -> str:
    return f"""with src as ({source}), t as (select doc_id, content, regexp_extract_all(content, '{TOKEN}') as ts from src),
w as (select *, unnest(case when len(ts) <= {size} then [0] else range(0, greatest(len(ts) - {overlap} - 1, 0) + 1, {size - overlap}) end) as s from t)
select doc_id, row_number() over (partition by doc_id order by s) - 1 as chunk_index,
  case when len(ts) = 0 then content else array_to_string(ts[s + 1 : s + {size}], '') end as content,
  length(array_to_string(ts[1 : s], '')) as start, length(array_to_string(ts[1 : s], '')) + length(case when len(ts) = 0 then content else array_to_string(ts[s + 1 : s + {size}], '') end) as "end",
  {n_tokens("array_to_string(ts[s + 1 : s + " + str(size) + "], '')")} as token_count from w"""


def pack_sql(source: str, atoms: str, weight: str, limit: int, overlap: int = 0, gap: int = 0, gap_weight: int = 0, cut: str | None = "char", reach: bool = True, columns: str = "") -> str:
    """weight has {c} for the text; reach: weights are at least 1, so a chunk has at most limit atoms."""
    near = f"and y.i <= x.i + {limit}" if reach else ""
    w = weight.format(c="t")
    step = (
        f"""select r.doc_id, r.k + 1, nx.s, nx.e from r join nx on nx.doc_id = r.doc_id and nx.s = r.e + 1"""
        if not overlap
        else """select r.doc_id, r.k + 1, nx.s, nx.e from r join back b on b.doc_id = r.doc_id and b.e = r.e join nx on nx.doc_id = r.doc_id and nx.s = greatest(b.j, r.s + 1) where r.e < b.n"""
    )
    back = f"""back as (select x.doc_id, x.i as e, x.n, coalesce(min(y.i), x.i + 1) as j from p x left join p z on z.doc_id = x.doc_id and z.i = x.i + 1
      left join p y on y.doc_id = x.doc_id and y.i <= x.i and y.i >= x.i - {overlap} and x.sw - y.sw + y.w + {gap_weight} * (x.i - y.i) <= {overlap}
        and x.sw - y.sw + y.w + {gap_weight} * (x.i - y.i) + {gap_weight} + z.w <= {limit} group by x.doc_id, x.i, x.n),"""
    big = weight.format(c="content")
    if cut == "char":
        last = f"""cutd as (select doc_id, k, o, case when {big} > {limit} then substr(content, cast(o + 1 as int), {limit}) else content end as content, start + o as start
          from (select *, unnest(case when {big} > {limit} then range(0, length(content), {limit}) else [0] end) as o from ch))"""
    elif cut == "byte":
        wide = max(1, limit // 4)
        last = f"""cutd as (select doc_id, k, o, case when {big} > {limit} then substr(content, cast(o + 1 as int), {wide}) else content end as content, start + o as start
          from (select *, unnest(case when {big} > {limit} then range(0, length(content), {wide}) else [0] end) as o from ch))"""
    elif cut == "token":
        last = f"""cutd as (select doc_id, k, o, case when {big} > {limit} then array_to_string(ts[o + 1 : o + {limit}], '') else content end as content,
          start + case when {big} > {limit} then length(array_to_string(ts[1 : o], '')) else 0 end as start
          from (select *, unnest(case when {big} > {limit} then range(0, len(ts), {limit}) else [0] end) as o from (select *, regexp_extract_all(content, '{TOKEN}') as ts from ch)))"""
    else:
        last = "cutd as (select doc_id, k, 0 as o, content, start from ch)"
    return f"""with recursive src as ({source}),
al as (select doc_id, content, {atoms} as atoms from src where content is not null),
atm as (select doc_id, unnest(atoms) as t, generate_subscripts(atoms, 1) as i from al),
p as (select doc_id, i, length(t) as len, {w} as w, sum({w}) over win as sw, sum(length(t)) over win as sl, count(*) over (partition by doc_id) as n from atm window win as (partition by doc_id order by i)),
nx as (select x.doc_id, x.i as s, coalesce(max(y.i), x.i) as e from p x left join p y on y.doc_id = x.doc_id and y.i >= x.i {near} and y.sw - x.sw + x.w + {gap_weight} * (y.i - x.i) <= {limit} group by x.doc_id, x.i),
{back if overlap else ""}
r as (select doc_id, 0 as k, s, e from nx where s = 1 union all {step}),
ch as (select r.doc_id, r.k, substr(al.content, cast(a.sl - a.len + {gap} * (r.s - 1) + 1 as int), cast(b.sl - a.sl + a.len + {gap} * (r.e - r.s) as int)) as content, cast(a.sl - a.len + {gap} * (r.s - 1) as int) as start
  from r join p a on a.doc_id = r.doc_id and a.i = r.s join p b on b.doc_id = r.doc_id and b.i = r.e join al on al.doc_id = r.doc_id),
{last}
select doc_id, row_number() over (partition by doc_id order by k, o) - 1 as chunk_index, content, start, start + length(content) as "end" from cutd"""


@query(token_windows_sql(X.DOCS_SQL, 512, 51))
def c1_chunk_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.chunk_token(X.docs(spark, sf_dir), 512, 51)


@query(token_windows_sql(X.DOCS_SQL, 128, 16))
def c2_chunk_token_counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.chunk_token(X.docs(spark, sf_dir), 128, 16)


@query(pack_sql(X.DOCS_SQL, "string_split(content, chr(10))", "length({c})", 500, 100, 1, 1, reach=False))
def c3_chunk_character(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.chunk_character(X.docs(spark, sf_dir), 500, 100, "\n").select(*COLUMNS)


@query(pack_sql(X.MD_DOCS_SQL, "string_split(content, chr(10) || chr(10))", "length({c})", 500, 50, 2, 2, reach=False))
def c3_chunk_paragraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.chunk_character(X.md_docs(spark, sf_dir), 500, 50).select(*COLUMNS)


def levels_sql(content: str, weight: str, size: int, splits: list[str]) -> str:
    """splits: list expressions of {p}."""
    out = f"case when {content} = '' then [] else [{content}] end"
    for s in splits:
        out = f"flatten(list_transform({out}, lambda p: case when {weight.format(c='p')} > {size} then {s.format(p='p')} else [p] end))"
    return out


def _before(pattern: str) -> str:
    return f"list_filter(string_split(regexp_replace({{p}}, '{pattern}', chr(1) || '\\1', 'g'), chr(1)), lambda x: x <> '')"


def md_atoms_sql(size: int) -> str:
    # Doubled braces survive one formatting.
    splits = [_before(r.replace("{1,6}", "{{1,6}}")) for r in K.MARKDOWN_LEVELS]
    return levels_sql("content", "length({c})", size, [*splits, f"list_transform(range(0, length({{p}}), {size}), lambda o: substr({{p}}, cast(o + 1 as int), {size}))"])


@query(pack_sql(X.MD_DOCS_SQL, md_atoms_sql(2000), "length({c})", 2000, 200))
def c4_chunk_recursive_md(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.chunk_recursive_md(X.md_docs(spark, sf_dir), 2000, 200).select(*COLUMNS)


@query(pack_sql(X.DOCS_SQL, levels_sql("content", "len(regexp_extract_all({c}, '\\S+'))", 64, [_before("(\\n\\n)"), f"regexp_extract_all({{p}}, '{SENTENCE}')", f"regexp_extract_all({{p}}, '{TOKEN}')"]), "len(regexp_extract_all({c}, '\\S+'))", 64, cut=None, reach=False))
def c5_chunk_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.chunk_recursive(X.docs(spark, sf_dir), 64).select(*COLUMNS)


SECTIONS_SQL = r"""li as (select doc_id, unnest(string_split(content, chr(10))) as line, generate_subscripts(string_split(content, chr(10)), 1) - 1 as n from src),
lf as (select *, sum(case when line like '```%' then 1 else 0 end) over (partition by doc_id order by n) as f,
         coalesce(sum(length(line) + 1) over (partition by doc_id order by n rows between unbounded preceding and 1 preceding), 0) as ls from li),
lv as (select *, case when line like '```%' or f % 2 = 1 then 0 else length(regexp_extract(line, '^(#{1,3}) ', 1)) end as lvl, trim(regexp_replace(line, '^#{1,3} ', '')) as title from lf),
lp as (select *, max(case when lvl = 1 then n end) over w as p1, max(case when lvl = 2 then n end) over w as p2, max(case when lvl = 3 then n end) over w as p3,
         sum(case when lvl > 0 then 1 else 0 end) over w as section from lv window w as (partition by doc_id order by n)),
lh as (select a.*, (select title from lv b where b.doc_id = a.doc_id and b.n = a.p1) as h1,
         case when p2 > coalesce(p1, -1) then (select title from lv b where b.doc_id = a.doc_id and b.n = a.p2) end as h2,
         case when p3 > greatest(coalesce(p1, -1), coalesce(p2, -1)) then (select title from lv b where b.doc_id = a.doc_id and b.n = a.p3) end as h3 from lp a)"""


@query(f"with src as ({X.MD_CONV_SQL}), {SECTIONS_SQL} select doc_id, n as line_no, lvl as level, h1, h2, h3 from lh")
def w3_heading_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.heading_path(K.lines_of(X.md_conv(spark, sf_dir))).select("doc_id", "line_no", "level", "h1", "h2", "h3")


_SECTION_ROWS = f"""with src as ({X.MD_CONV_SQL}), {SECTIONS_SQL},
sec as (select doc_id, section, string_agg(line, chr(10) order by n) as content, min(ls) as start, arg_min(h1, n) as h1, arg_min(h2, n) as h2, arg_min(h3, n) as h3 from lh group by 1, 2)
"""


@query(_SECTION_ROWS + """select doc_id, row_number() over (partition by doc_id order by section) - 1 as chunk_index, content, cast(start as int) as start, cast(start + length(content) as int) as "end", h1, h2, h3
from sec where section > 0 or trim(content) <> ''""")
def c6_chunk_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.chunk_markdown(X.md_conv(spark, sf_dir)).drop("token_count")


_SECTION_SOURCE = f"select doc_id * 100000 + section as doc_id, content from ({_SECTION_ROWS} select * from sec where section > 0 or trim(content) <> '')"


@query(f"""with c as ({pack_sql(_SECTION_SOURCE, md_atoms_sql(300), "length({c})", 300, 30)}), s as ({_SECTION_ROWS} select * from sec)
select s.doc_id, row_number() over (partition by s.doc_id order by section, chunk_index) - 1 as chunk_index, c.content, cast(s.start + c.start as int) as start, cast(s.start + c."end" as int) as "end", h1, h2, h3
from c join s on c.doc_id = s.doc_id * 100000 + s.section""")
def c7_chunk_markdown_sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.chunk_markdown(X.md_conv(spark, sf_dir), True, 300, 30).drop("token_count")


@query(pack_sql(X.DOCS_SQL, r"regexp_extract_all(content, '\s*\S+|\s+$')", "strlen({c})", 400, cut="byte"))
def c8_chunk_fast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.chunk_fast(X.docs(spark, sf_dir), 400).select(*COLUMNS)


@query(pack_sql(X.DOCS_SQL, f"regexp_extract_all(content, '{SENTENCE}')", "len(regexp_extract_all({c}, '\\S+'))", 64, 16, cut="token", reach=False))
def c9_chunk_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.chunk_sentence(X.docs(spark, sf_dir), 64, 16).select(*COLUMNS)


@query(f"""with src as ({X.MD_TABLE_SQL}), n as (select n_regionkey as doc_id, n_nationkey, concat('| ', n_nationkey, ' | ', n_name, ' |') as line, row_number() over (partition by n_regionkey order by n_nationkey) - 1 as k from nation),
g as (select doc_id, 1 + k // 3 as o, concat('| key | name |', chr(10), '| --- | --- |', chr(10), string_agg(line, chr(10) order by n_nationkey)) as content, string_agg(line, chr(10) order by n_nationkey) as own, true as is_table from n group by 1, 2),
a as (select * from g union all select doc_id, 0, concat('Region ', doc_id, chr(10)), concat('Region ', doc_id, chr(10)), false from src union all select doc_id, 100000, concat(chr(10), 'End.'), concat(chr(10), 'End.'), false from src)
select a.doc_id, row_number() over (partition by a.doc_id order by o) - 1 as chunk_index, a.content, cast(strpos(src.content, own) - 1 as int) as start, cast(strpos(src.content, own) - 1 + length(own) as int) as "end", is_table from a join src using (doc_id)""")
def c10_chunk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.chunk_table(X.md_table(spark, sf_dir)).drop("token_count")


@query("""with l as (select *, lag(embedding) over (partition by label order by vec_id) as b from embeddings)
select vec_id, label, cast(sum(case when b is not null and list_cosine_similarity(b::double[], embedding::double[]) < 0.0 then 1 else 0 end) over (partition by label order by vec_id) as int) as "group" from l""")
def w4_boundary_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.boundary_groups(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding", 0.0).select("vec_id", "label", "group")


@query("""with l as (select *, lag(embedding) over (partition by label order by vec_id) as b from embeddings),
g as (select vec_id, label, sum(case when b is not null and list_cosine_similarity(b::double[], embedding::double[]) < 0.0 then 1 else 0 end) over (partition by label order by vec_id) as grp from l),
c as (select *, row_number() over (partition by label, grp order by vec_id) - 1 as k from g)
select label as doc_id, cast(grp as int) as "group", k // 4 as part, string_agg('Vector ' || vec_id || '. ', '' order by vec_id) as content from c group by 1, 2, 3""")
def c11_chunk_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("doc_id"), F.col("vec_id").alias("place"), F.concat(F.lit("Vector "), F.col("vec_id").cast("string"), F.lit(". ")).alias("content"), "embedding"
    )
    return K.chunk_semantic(rows, 0.0, 8).drop("token_count")


@query(pack_sql(X.DOCS_SQL, "string_split(content, chr(10))", "len(regexp_extract_all({c}, '\\S+'))", 64, 0, 1, 0, "token", reach=False))
def c12_chunk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.chunk_lines(X.docs(spark, sf_dir), 64).select(*COLUMNS)


@query(f"""select doc_id, chunk_index, concat('Lines of one text: ', content) as content, start, "end" from ({pack_sql(X.DOCS_SQL, "string_split(content, chr(10))", "len(regexp_extract_all({c}, '\\S+'))", 60, 0, 1, 0, "token", reach=False)})""")
def c12_chunk_lines_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prefix of four words stands before every chunk and counts; places are those of the text behind it."""
    return K.chunk_lines(X.docs(spark, sf_dir), 64, "Lines of one text: ").select(*COLUMNS)


@query(f"""with recursive src as ({X.MD_CONV_SQL}), {SECTIONS_SQL},
ln as (select doc_id, n, line, concat(h1, chr(2), h2, chr(2), h3) as path, case when line like '```%' or f % 2 = 1 then 'code' when trim(line) = '' then 'blank'
  when regexp_matches(line, '^\\s*([-*+]|\\d+\\.) ') then 'list' when contains(line, '|') then 'table' else 'text' end as kind from lh where lvl = 0),
tn as (select *, case when lag(kind) over w is distinct from kind or lag(path) over w is distinct from path then 1 else 0 end as turn from ln window w as (partition by doc_id order by n)),
rn as (select *, sum(turn) over (partition by doc_id order by n) as run from tn),
el as (select doc_id, run, path, regexp_extract_all(string_agg(line, chr(10) order by n), '{TOKEN}') as ts, string_agg(line, chr(10) order by n) as whole from rn where kind <> 'blank' group by doc_id, run, path),
cu as (select *, unnest(case when len(ts) <= 64 then [0] else range(0, len(ts), 64) end) as o from el),
pc as (select doc_id, run, path, o, len(ts[o + 1 : o + 64]) as w, regexp_replace(case when len(ts) = 0 then whole else array_to_string(ts[o + 1 : o + 64], '') end, '^\\s+|\\s+$', '', 'g') as content from cu),
pt as (select *, case when lag(path) over (partition by doc_id order by run, o) is distinct from path then 1 else 0 end as turn from pc),
pe as (select *, sum(turn) over (partition by doc_id order by run, o) as peer from pt),
it as (select *, row_number() over v as i, sum(w) over v as sw from pe window v as (partition by doc_id, peer order by run, o)),
nx as (select x.doc_id, x.peer, x.i as s, coalesce(max(y.i), x.i) as e from it x left join it y on y.doc_id = x.doc_id and y.peer = x.peer and y.i >= x.i and y.sw - x.sw + x.w <= 64 group by x.doc_id, x.peer, x.i),
r as (select doc_id, peer, 0 as k, s, e from nx where s = 1 union all select r.doc_id, r.peer, r.k + 1, nx.s, nx.e from r join nx on nx.doc_id = r.doc_id and nx.peer = r.peer and nx.s = r.e + 1),
mg as (select r.doc_id, r.peer, r.k, any_value(path) as path, string_agg(it.content, chr(10) order by it.i) as content from r join it on it.doc_id = r.doc_id and it.peer = r.peer and it.i between r.s and r.e group by r.doc_id, r.peer, r.k),
hd as (select *, list_filter(string_split(path, chr(2)), lambda x: x <> '') as hs from mg)
select doc_id, row_number() over (partition by doc_id order by peer, k) - 1 as chunk_index, content, array_to_string(hs, ' > ') as headings, array_to_string(list_concat(hs, [content]), chr(10)) as contextualized from hd""".replace("\\\\", "\\"))
def c13_chunk_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL merges peers by a recursion over places, the query by array expressions."""
    made = K.chunk_hybrid(X.md_conv(spark, sf_dir), 64)
    return made.select("doc_id", "chunk_index", "content", F.array_join("headings", " > ").alias("headings"), "contextualized")


@query(f"""with src as ({X.MD_CONV_SQL}), li as (select doc_id, unnest(string_split(content, chr(10))) as line, generate_subscripts(string_split(content, chr(10)), 1) - 1 as n from src),
b as (select *, sum(case when regexp_matches(line, '^#{{1,6}} ') then 1 else 0 end) over (partition by doc_id order by n) as k from li)
select doc_id, row_number() over (partition by doc_id order by k) - 1 as block, case when k > 0 then trim(regexp_replace(arg_min(line, n), '^#{{1,6}} ', '')) end as heading,
  string_agg(line, chr(10) order by n) as content, min(n) as start_line, max(n) as end_line from b group by doc_id, k""")
def c14_split_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.split_blocks(X.md_conv(spark, sf_dir))


@query(X.MD_CONV_SQL)
def a5_join_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.join_blocks(K.split_blocks(X.md_conv(spark, sf_dir)))


_PAGES_SQL = "select conv_id as doc_id, row_number() over (partition by conv_id order by turn, role, text) as page, role, text from conversations"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.row_number().over(w).alias("page"), F.col("text").alias("content"))


@query(f"""select doc_id, string_agg('<!-- page-marker:' || page || ' -->' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by page) as content from ({_PAGES_SQL}) group by 1""")
def a4_join_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.join_pages(_pages(spark, sf_dir))


@query(f"""select doc_id, page, regexp_replace(text, '^\\s+|\\s+$', '', 'g') as content from ({_PAGES_SQL})""")
def c15_split_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.split_pages(K.join_pages(_pages(spark, sf_dir)))


@query(pack_sql(X.MD_DOCS_SQL, "string_split(content, chr(10) || chr(10))", "length({c})", 2500, 0, 2, 2, None, reach=False))
def c16_pack_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.pack_blocks(X.md_docs(spark, sf_dir), 2500).select(*COLUMNS)


@query(f"select lang, count(*) as total_chunks, cast(sum(length(content)) // count(*) as bigint) as avg_chunk_chars from ({token_windows_sql(X.DOCS_SQL, 512, 51)}) join documents using (doc_id) group by lang")
def a1_chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = K.chunk_token(table(spark, sf_dir, "documents").select(F.struct("doc_id", "lang").alias("doc_id"), F.col("text").alias("content")))
    return K.chunk_stats(chunks.withColumn("lang", F.col("doc_id.lang")), "lang")


@query(f"""with c as ({pack_sql(X.DOCS_SQL, "string_split(content, chr(10))", "length({c})", 500, 0, 1, 1, reach=False)}) select doc_id, chunk_index, content, start, "end" from c""")
def f2_locate_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets found again from the texts of chunks alone."""
    docs = X.docs(spark, sf_dir)
    chunks = K.chunk_character(docs, 500, 0, "\n")
    splits = chunks.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", "content"))), lambda x: x["content"]).alias("splits"))
    return K.locate_offsets(docs.join(splits, "doc_id")).select(*COLUMNS)


@query(f"""with recursive c as ({token_windows_sql(X.DOCS_SQL, 128, 16)}),
w as (select doc_id, chunk_index, case when chunk_index % 5 = 3 then concat(content, chr(7), '?') else content end as x from c),
o as (select a.doc_id, coalesce(list_max(list_filter(range(1, least(length(a.x), length(b.x)) + 1), lambda k: right(a.x, k) = left(b.x, k))), 0) as overlap
      from w a left join w b on b.doc_id = a.doc_id and b.chunk_index = 1 where a.chunk_index = 0),
s as (select w.*, content as t, overlap from w join ({X.DOCS_SQL}) d using (doc_id) join o using (doc_id)),
r as (select doc_id, 0 as k, x as content, greatest(instr(t, x) - 1, 0) as start, overlap, t from s where chunk_index = 0
      union all
      select r.doc_id, k + 1, s.x, case when instr(substr(r.t, f + 1), s.x) > 0 then instr(substr(r.t, f + 1), s.x) - 1 + f else f end, r.overlap, r.t
      from (select *, greatest(0, start + length(content) - overlap) as f from r) r join s on s.doc_id = r.doc_id and s.chunk_index = r.k + 1)
select doc_id, cast(k as int) as chunk_index, content, cast(start as int) as start, cast(start + length(content) as int) as end from r""")
def f2_located_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets of overlapping windows from their texts alone, one in five of which the document doesn't hold; the overlap is measured."""
    docs = X.docs(spark, sf_dir)
    chunks = K.chunk_token(docs, 128, 16).withColumn("content", F.when(F.col("chunk_index") % 5 == 3, F.concat("content", F.lit("\u0007?"))).otherwise(F.col("content")))
    splits = chunks.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", "content"))), lambda x: x["content"]).alias("splits"))
    return K.locate_offsets(docs.join(splits, "doc_id"), None)


@query(f"""with c as ({token_windows_sql(X.DOCS_SQL, 128, 16)}), n as (select doc_id, chunk_index, content as a, lead(content) over (partition by doc_id order by chunk_index) as b from c)
select doc_id, chunk_index, coalesce(list_max(list_filter(range(1, least(300, length(a), length(b)) + 1), lambda k: right(a, k) = left(b, k))), 0) as n from n where b is not null""")
def f1_suffix_prefix_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    chunks = K.chunk_token(X.docs(spark, sf_dir), 128, 16)
    after = F.lead("content").over(Window.partitionBy("doc_id").orderBy("chunk_index"))
    return chunks.withColumn("b", after).where("b IS NOT NULL").select("doc_id", "chunk_index", T.suffix_prefix_overlap(F.col("content"), F.col("b"), 300).alias("n"))


@query(f"with src as ({X.MD_CONV_SQL}), {SECTIONS_SQL} select doc_id, n as line_no, concat_ws(chr(10), h1, h2, h3, line) as contextualized from lh")
def f8_contextualize(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = K.heading_path(K.lines_of(X.md_conv(spark, sf_dir)))
    return lines.select("doc_id", "line_no", T.contextualized(F.array("h1", "h2", "h3"), F.col("line")).alias("contextualized"))


@query("select doc_id, cast(len(regexp_extract_all(text, '\\S+')) as bigint) as token_count from documents")
def f9_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.token_count(F.col("text")).cast("long").alias("token_count"))
