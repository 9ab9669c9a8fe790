"""The registered queries of the operators in this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import collocations, filter_audit, html_crf, kneser_ney, language_mixture, maxent_lm, media, mixing, ngram_join, packing, pii, quality_rules, toxicity

WORDS = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's measurements and verdicts from the rule ledger, under the base policy and policy v1."""
    ledger = quality_rules.rule_ledger(table(spark, sf_dir, "documents"))
    base = quality_rules.passes(quality_rules.BASE)
    return ledger.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~base).alias("base_failed"),
        (base & quality_rules.passes(quality_rules.POLICIES["v1"])).alias("kept"),
        "failed_bits",
    )


#: Documents with their words, then each measurement of the ledger by itself.
LEDGER_SQL = r"""
d as (select doc_id, coalesce(text, '') as t from {documents}),
w as (select row_number() over () as r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws from d),
win as (select r, i, list_aggregate(list_transform(range(i, i + 8), lambda j: ws[j]), 'string_agg', ' ') as g
        from (select r, ws, unnest(range(1, len(ws) - 6)) as i from w where len(ws) >= 8)),
dup as (select r, unnest(range(i, i + 8)) as p from (select r, i, count(*) over (partition by r, g) as n from win) where n > 1),
rep as (select r, count(distinct p) as n from dup group by r),
li as (select r, line from (select r, unnest(string_split(t, chr(10))) as line from w) where regexp_matches(line, '[^\x20\x09-\x0D]')),
lc as (select r, count(*) as n, count(*) - count(distinct line) as dups from li group by r),
m as (select w.r, doc_id, cast(len(ws) as bigint) as n_words,
        cast(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) as bigint) as word_chars,
        cast(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
        cast(coalesce(lc.n, 0) as bigint) as n_lines, cast(coalesce(lc.dups, 0) as bigint) as n_dup_lines,
        cast(coalesce(rep.n, 0) as bigint) as n_repeat_words,
        cast(len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) as bigint) as n_same_words,
        cast(length(regexp_replace(t, '[^A-Z]', '', 'g')) as bigint) as n_upper,
        cast(length(regexp_replace(t, '[^a-z]', '', 'g')) as bigint) as n_lower
      from w left join lc on lc.r = w.r left join rep on rep.r = w.r),
ledger as (select *,
        cast(case when n_words < 20 then 1 else 0 end + case when 100 * n_repeat_words > 30 * n_words then 2 else 0 end
        + case when 10 * n_symbols > 2 * n_words then 4 else 0 end + case when 100 * n_dup_lines > 30 * n_lines then 8 else 0 end
        + case when 100 * n_same_words > 20 * n_words then 16 else 0 end
        + case when n_upper > n_lower and n_upper >= 20 then 32 else 0 end
        + case when word_chars > 30 * n_words then 64 else 0 end + case when word_chars < 2 * n_words then 128 else 0 end as bigint) as failed_bits
      from m)
"""

OP3_SQL = f"""
with {LEDGER_SQL.format(documents="documents")}
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed_bits & 3) <> 0 as base_failed,
       (failed_bits & 119) = 0 as kept, failed_bits
from ledger
"""



def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text of documents."""
    return pii.pii_digest(table(spark, sf_dir, "documents"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to sources that weigh 1, 2, 3 in turn; taken counts words with repeats."""
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"), mixing.cycle_123())
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "source")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 5-word shingles have a Jaccard similarity of 0.8 or more."""
    return ngram_join.similarity_components(table(spark, sf_dir, "documents"))


def op10_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all documents under the hashed maximum-entropy model, learned from four folds of five."""
    return maxent_lm.lm_scores(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores and spans of all documents, learned from three folds of four of the labels."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), keep=~toxicity.held_out("doc_id"))
    return toxicity.toxicity_scores(docs, model)


def op9_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of all documents under trusted text, and whether their language's quantile keeps them."""
    return kneser_ney.perplexity_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_html_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    pages = table(spark, sf_dir, "pages")
    return html_crf.extract_main_text(pages, html_crf.fit(pages))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies among the pictures of all vectors, of which one in ten has an edited copy."""
    return media.media_copies(media.rendered(table(spark, sf_dir, "embeddings")))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 phrases of two and three words of each language that hold together best."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


#: Every n-gram of one to three words within pieces, counted by language, and every cut of those that occur ten times.
OP11_SQL = r"""
with d as (select row_number() over () as r, coalesce(lang, 'und') as lang,
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
p as (select lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') as ws from d),
n as (select lang, cast(sum(len(ws)) as bigint) as n from p group by lang),
g as (select lang, len, ws[i:i + len - 1] as g from (select lang, ws, len, unnest(range(1, len(ws) - len + 2)) as i from p, (values (1), (2), (3)) as k(len))),
f as (select lang, len, g, count(*) as a from g group by lang, len, g),
c as (select * from f where len > 1 and a >= 10),
k as (select lang, len, g, a, k, array_to_string(g[1:k], ' ') as x, array_to_string(g[k + 1:len], ' ') as y from (select *, unnest(range(1, len)) as k from c)),
s as (select lang, array_to_string(g, ' ') as s, a from f where len < 3 and a >= 10),
cut as (select k.*, x.a as l, y.a as r, cast(1000000 as hugeint) * k.a * k.a // (cast(x.a as hugeint) * y.a) as score
        from k join s x on x.lang = k.lang and x.s = k.x join s y on y.lang = k.lang and y.s = k.y),
worst as (select * from cut qualify row_number() over (partition by lang, g order by score, k) = 1),
longer as (select lang, h, max(a) as m from (select lang, unnest([g[1:2], g[2:3]]) as h, a from c where len = 3) group by lang, h),
kept as (select w.*, array_to_string(w.g, ' ') as phrase from worst w left join longer o on w.len = 2 and o.lang = w.lang and o.h = w.g
         where o.m is null or 100 * o.m < 50 * w.a),
best as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select lang, rank, phrase, a, l, r, n, cast(score as bigint) as score from best join n using (lang) where rank <= 2000
"""


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five text filters remove from each source in each of their 120 orders."""
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: Each document's failures, then every order of the filters over all documents' patterns.
OP12_SQL = r"""
with d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t from documents),
m as (select doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws, length(regexp_replace(t, '[^A-Z]', '', 'g')) as caps from d),
lo as (select t, min(doc_id) as first from d group by t),
lab as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by doc_id),
b as (select part, case when len(ws) < 200 then 1 else 0 end + case when 100 * len(list_distinct(ws)) < 50 * len(ws) then 2 else 0 end
        + case when 100 * caps > 2 * length(m.t) then 4 else 0 end + case when regexp_matches(m.t, '[#$%&*|]') then 8 else 0 end
        + case when lo.first < m.doc_id then 16 else 0 end as bits, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic
      from m join lo on lo.t = m.t left join lab on lab.doc_id = m.doc_id),
c as (select part, bits, count(*) as n, sum(good) as good, sum(toxic) as toxic from b group by part, bits),
l as (select 'A' as x, 1 as v union all select 'B', 2 union all select 'C', 4 union all select 'D', 8 union all select 'E', 16),
o as (select row_number() over () as o, a.x || b.x || c.x || d.x || e.x as filter_order, [a.v, b.v, c.v, d.v, e.v] as vs from l a, l b, l c, l d, l e
      where a.v + b.v + c.v + d.v + e.v = 31 and len(list_distinct([a.v, b.v, c.v, d.v, e.v])) = 5),
s as (select filter_order, step, vs[step] as own, coalesce(list_sum(vs[1:step - 1]), 0) as before from o, (select unnest(range(1, 6)) as step)),
x as (select part, filter_order, step, own, n, good, toxic, bits, bits & own <> 0 as fails, bits & cast(before as integer) <> 0 as gone from c, s),
y as (select part, filter_order, step, own, sum(n) filter (not fails and not gone) as kept, sum(n) filter (fails and not gone) as removed,
        sum(n) filter (fails and gone) as redundant, sum(n) filter (bits = own) as unique_fails,
        sum(good) filter (fails and not gone) as good_lost, sum(toxic) filter (fails and not gone) as toxic_lost
      from x group by part, filter_order, step, own)
select part, filter_order, cast(step as integer) as step, cast(coalesce(kept, 0) as bigint) as kept, cast(coalesce(removed, 0) as bigint) as removed,
       cast(coalesce(redundant, 0) as bigint) as redundant, cast(coalesce(unique_fails, 0) as bigint) as unique_fails,
       cast(coalesce(good_lost, 0) as bigint) as good_lost, cast(coalesce(toxic_lost, 0) as bigint) as toxic_lost,
       cast(coalesce(sum(removed) over (partition by part, own), 0) as bigint) as shapley
from y
"""


def op13_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main language of all documents, learned from four folds of five."""
    docs = table(spark, sf_dir, "documents")
    found = language_mixture.language_mixtures(docs, language_mixture.fit(docs, language_mixture.learns()))
    return found.select("doc_id", language_mixture.held_out().alias("held_out"), "lang_pred", "score", F.size("languages").cast("long").alias("n_languages"))


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_pii": op2_pii,
    "op3_quality_rules": op3_quality_rules,
    "op4_packing": op4_packing,
    "op5_ngram_join": op5_ngram_join,
    "op6_media": op6_media,
    "op7_html_crf": op7_html_crf,
    "op8_toxicity": op8_toxicity,
    "op9_kneser_ney": op9_kneser_ney,
    "op10_maxent_lm": op10_maxent_lm,
    "op11_collocations": op11_collocations,
    "op12_filter_audit": op12_filter_audit,
    "op13_language_mixture": op13_language_mixture,
}
ORACLES = {"op3_quality_rules": OP3_SQL, "op11_collocations": OP11_SQL, "op12_filter_audit": OP12_SQL}
