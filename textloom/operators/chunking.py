"""Chunking: a table (doc_id, content) to rows of chunks, with 0-based half-open code-point offsets.

Splitting and packing are array expressions over one document, so those strategies need no shuffle. The structure strategies
work on lines and shuffle once, by document. Null content gives no chunks; extra columns of the input are not carried along.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType, _parse_datatype_string

from textloom.functions import text as T
from textloom.functions.places import located

CHUNK = "array<struct<content:string,start:int>>"
MARKER = "\u0001"
#: Atoms of one step of packing; a step's state is copied for each of its atoms.
STEP_ATOMS = 512


def _check(size: int, overlap: int = 0) -> None:
    if size <= 0 or overlap < 0 or overlap >= size:
        raise ValueError("size must be positive and overlap must be at least 0 and below size")


def _total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0), lambda acc, x: acc + x)


def _part(values: Column | str, first: Column, last: Column) -> Column:
    """The values at places first to last (from 0), in falling order if last is lower; slice would copy the whole array each time."""
    return F.transform(F.sequence(first, last), lambda k: F.get(values, k))


def _before(lengths: Column) -> Column:
    """For each length the sum of those before it, in one pass."""
    state = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("at"))
    step = lambda acc, x: F.struct(F.array_append(acc["out"], acc["at"]).alias("out"), (acc["at"] + x).alias("at"))
    return F.aggregate(lengths, state, step, lambda acc: acc["out"])


def _runs(value: Column, width: int) -> Column:
    """The value cut into runs of width characters; the last may be shorter."""
    return F.regexp_extract_all(value, F.lit(f"(?s).{{1,{width}}}"), F.lit(0))


def _chunks_at(contents: Column, starts: Column) -> Column:
    return F.zip_with(contents, starts, lambda c, s: F.struct(c.alias("content"), s.alias("start")))


def _exploded(df: DataFrame, chunks: str = "_chunks") -> DataFrame:
    """Rows of the chunks of each document. Where df has ``_keep_error``, every document has a row: those with an error, or
    without chunks, one whose chunk_index is null; all rows then carry error and total_chunks."""
    outcomes = "_keep_error" in df.columns
    if outcomes:
        df = df.withColumn(chunks, F.when(F.col("_keep_error").isNull(), F.col(chunks)))
        df = df.withColumn("_keep_total_chunks", F.greatest(F.coalesce(F.size(chunks), F.lit(0)), F.lit(0)))
    rows = df.select("doc_id", *[c for c in df.columns if c.startswith("_keep_")], F.posexplode_outer(chunks).alias("chunk_index", "_c"))
    # The outer form, as the inner one makes the optimizer repeat the whole expression in a filter below.
    if not outcomes:
        rows = rows.where("chunk_index IS NOT NULL")
    rest = [F.col(c).alias(c.removeprefix("_keep_")) for c in df.columns if c.startswith("_keep_")]
    end = F.col("_c.start") + F.length("_c.content")
    return rows.select("doc_id", *rest, "chunk_index", F.col("_c.content").alias("content"), F.col("_c.start").alias("start"), end.alias("end"), T.token_count(F.col("_c.content")).alias("token_count"))


def chunk_token(df: DataFrame, size: int = 512, overlap: int = 51) -> DataFrame:
    """Windows of size tokens, each beginning overlap tokens before the last one's end; the last window is the first to reach the end."""
    _check(size, overlap)
    step = size - overlap
    base = df.select("doc_id", "content", *[c for c in df.columns if c.startswith("_keep_")], T.tokens(F.col("content")).alias("_tokens")).where("content IS NOT NULL")
    n = F.size("_tokens")
    starts = F.when(n <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(step)))
    placed = base.withColumn("_starts", starts).withColumn("_lengths", F.transform("_tokens", F.length))
    content = lambda s: F.when(n == 0, F.col("content")).otherwise(F.array_join(_part("_tokens", s, F.least(s + size, n) - 1), ""))
    placed = placed.withColumn("_steps", _before(F.transform("_starts", lambda s: _total(_part("_lengths", s, F.greatest(s, F.least(s + step, n) - 1))))))
    return _exploded(placed.withColumn("_chunks", _chunks_at(F.transform("_starts", content), F.col("_steps"))))


def greedy_spans(weights: Column, limit: int, separator: int = 0, overlap: int = 0) -> Column:
    """Spans (first, last; from 1) of atoms packed from the left.

    An atom joins the open span if the weights and separators stay within limit. With overlap, a span begins with the longest run
    of atoms at the end of the one before that weighs at most overlap and leaves room for the next atom.
    """
    state = F.struct(F.array().cast("array<struct<s:int,e:int>>").alias("done"), F.lit(0).alias("s"), F.lit(0).alias("w"))
    count = F.size(weights)

    def step(acc: Column, x: Column) -> Column:
        fits = (acc["s"] > 0) & (acc["w"] + separator + x["w"] <= limit)
        closed = F.when(acc["s"] > 0, F.array_append(acc["done"], F.struct(acc["s"].alias("s"), (x["i"] - 1).alias("e")))).otherwise(acc["done"])
        if not overlap:
            fresh = F.struct(closed.alias("done"), x["i"].alias("s"), x["w"].alias("w"))
        else:
            tail = _part(weights, x["i"] - 2, acc["s"])
            run = F.aggregate(
                F.when((acc["s"] > 0) & (acc["s"] < x["i"] - 1), tail).otherwise(F.array().cast("array<int>")),
                F.struct(F.lit(0).alias("k"), F.lit(0).alias("t"), F.lit(False).alias("over")),
                lambda a, w: F.when(
                    ~a["over"] & (a["t"] + F.when(a["k"] > 0, separator).otherwise(0) + w <= overlap) & (a["t"] + F.when(a["k"] > 0, separator).otherwise(0) + w + separator + x["w"] <= limit),
                    F.struct((a["k"] + 1).alias("k"), (a["t"] + F.when(a["k"] > 0, separator).otherwise(0) + w).alias("t"), F.lit(False).alias("over")),
                ).otherwise(F.struct(a["k"].alias("k"), a["t"].alias("t"), F.lit(True).alias("over"))),
            )
            one = F.transform(F.array(run), lambda r: F.struct((x["i"] - r["k"]).alias("s"), (F.when(r["k"] > 0, r["t"] + separator).otherwise(0) + x["w"]).alias("w")))
            fresh = F.get(F.transform(one, lambda o: F.struct(closed.alias("done"), o["s"].alias("s"), o["w"].alias("w"))), F.lit(0))
        return F.when(fits, F.struct(acc["done"].alias("done"), acc["s"].alias("s"), (acc["w"] + separator + x["w"]).alias("w"))).otherwise(fresh)

    def leap(acc: Column, first: Column) -> Column:
        atoms = F.transform(F.sequence(first, F.least(first + STEP_ATOMS, count) - 1), lambda k: F.struct(F.get(weights, k).cast("int").alias("w"), (k + 1).alias("i")))
        packed_on = F.aggregate(atoms, F.struct(state["done"].alias("done"), acc["s"].alias("s"), acc["w"].alias("w")), step)
        return F.get(F.transform(F.array(packed_on), lambda r: F.struct(F.concat(acc["done"], r["done"]).alias("done"), r["s"].alias("s"), r["w"].alias("w"))), F.lit(0))

    last = F.struct(F.lit(0).alias("s"), count.alias("e"))
    finish = lambda acc: F.when(acc["s"] > 0, F.array_append(acc["done"], F.struct(acc["s"].alias("s"), last["e"].alias("e")))).otherwise(acc["done"])
    firsts = F.when(count > 0, F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0)), F.lit(STEP_ATOMS))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(firsts, state, leap, finish)


def _hard_cut(chunks: Column, weight: Callable[[Column], Column], limit: int, unit: str) -> Column:
    """Chunks heavier than limit, which are single atoms, cut into pieces of limit units."""

    def pieces(c: Column) -> Column:
        if unit == "token":
            starts = lambda t: F.sequence(F.lit(0), F.size(t) - 1, F.lit(limit))
            cut_up = lambda t: F.transform(starts(t), lambda s: F.array_join(_part(t, s, F.least(s + limit, F.size(t)) - 1), ""))
            # An array of one value binds what would else be computed again for each piece.
            cuts = F.get(F.transform(F.array(T.tokens(c["content"])), cut_up), F.lit(0))
            return _chunks_at(cuts, F.transform(_before(F.transform(cuts, F.length)), lambda k: c["start"] + k))
        width = limit if unit == "char" else max(1, limit // 4)
        return F.transform(_runs(c["content"], width), lambda x, i: F.struct(x.alias("content"), (c["start"] + i * width).alias("start")))

    return F.flatten(F.transform(chunks, lambda c: F.when(weight(c["content"]) > limit, pieces(c)).otherwise(F.array(c))))


def packed(df: DataFrame, atoms: Column, weight: Callable[[Column], Column], limit: int, overlap: int = 0, separator: str = "", separator_weight: int = 0, cut: str | None = "char") -> DataFrame:
    """Rows of chunks of df(doc_id, content, ...): atoms packed by weight; chunks are stretches of the content."""
    base = df.where("content IS NOT NULL").withColumn("_atoms", atoms)
    weighed = base.withColumn("_weights", F.transform("_atoms", lambda a: weight(a).cast("int"))).withColumn("_lengths", F.transform("_atoms", F.length))
    spans = weighed.withColumn("_spans", greedy_spans(F.col("_weights"), limit, separator_weight, overlap))
    gap = len(separator)
    # A span begins as far behind the start of the one before as the atoms between them are long, so all sums together pass the atoms once.
    reach = lambda x, i: F.get("_spans", i + 1)["s"] - x["s"]
    moved = lambda x, i: F.coalesce(_total(_part("_lengths", x["s"] - 1, x["s"] + reach(x, i) - 2)) + reach(x, i) * gap, F.lit(0))
    placed = spans.withColumn("_begins", _before(F.transform("_spans", moved)))
    contents = F.transform("_spans", lambda x: F.array_join(_part("_atoms", x["s"] - 1, x["e"] - 1), separator))
    made = placed.withColumn("_chunks", _chunks_at(contents, F.col("_begins")))
    if cut:
        made = made.withColumn("_chunks", _hard_cut(F.col("_chunks"), weight, limit, cut))
    return _exploded(made)


def _tokens_of(c: Column) -> Column:
    return T.token_count(c)


def chunk_character(df: DataFrame, size: int = 512, overlap: int = 51, separator: str = "\n\n") -> DataFrame:
    """Paragraphs between separators, packed by characters."""
    _check(size, overlap)
    return packed(df, F.split("content", separator), F.length, size, overlap, separator, len(separator))


def chunk_lines(df: DataFrame, max_tokens: int = 512, prefix: str = "") -> DataFrame:
    """Whole lines packed by tokens; the prefix is repeated in every chunk and counts."""
    _check(max_tokens)
    room = max(1, max_tokens - len(prefix.split()))
    rows = packed(df, F.split("content", "\n"), _tokens_of, room, 0, "\n", 0, "token")
    return rows.withColumn("content", F.concat(F.lit(prefix), "content")) if prefix else rows


def chunk_fast(df: DataFrame, size_bytes: int = 512) -> DataFrame:
    """Words packed by bytes; a word over the limit is cut so that no piece exceeds it."""
    _check(size_bytes)
    return packed(df, F.regexp_extract_all("content", F.lit(T.WORD), F.lit(0)), F.octet_length, size_bytes, cut="byte")


def chunk_sentence(df: DataFrame, size: int = 512, overlap: int = 51) -> DataFrame:
    _check(size, overlap)
    return packed(df, F.regexp_extract_all("content", F.lit(T.SENTENCE), F.lit(0)), _tokens_of, size, overlap, cut="token")


def pack_blocks(df: DataFrame, target: int = 2500) -> DataFrame:
    """Blocks between blank lines in buckets of about target characters; a larger block stays whole."""
    _check(target)
    return packed(df, F.split("content", "\n\n"), F.length, target, 0, "\n\n", 2, None)


#: Where a too long piece is cut, in order; the separator stays with what follows it.
MARKDOWN_LEVELS = (r"(\n#{1,6} )", r"(\n```)", r"(\n(?:---|\*\*\*|___)\n)", r"(\n\n)", r"(\n)", r"( )")


def _split_before(piece: Column, pattern: str) -> Column:
    return F.filter(F.split(F.regexp_replace(piece, pattern, MARKER + "$1"), MARKER), lambda x: x != "")


def _levels(weight: Callable[[Column], Column], size: int, splits: tuple[Callable[[Column], Column], ...]) -> list[Callable[[Column], Column]]:
    return [lambda pieces, s=s: F.flatten(F.transform(pieces, lambda p: F.when(weight(p) > size, s(p)).otherwise(F.array(p)))) for s in splits]


def _leveled(df: DataFrame, weight: Callable[[Column], Column], size: int, splits: tuple[Callable[[Column], Column], ...]) -> DataFrame:
    rows = df.where("content IS NOT NULL").withColumn("_pieces0", F.when(F.col("content") != "", F.array("content")).otherwise(F.array().cast("array<string>")))
    for k, level in enumerate(_levels(weight, size, splits)):
        rows = rows.withColumn(f"_pieces{k + 1}", level(F.col(f"_pieces{k}"))).drop(f"_pieces{k}")
    return rows.withColumnRenamed(f"_pieces{len(splits)}", "_pieces")


def chunk_recursive_md(df: DataFrame, size: int = 512, overlap: int = 51) -> DataFrame:
    """Cut at headings, fences, rules, blank lines, lines, spaces, characters in turn as far as needed, then pack by characters."""
    _check(size, overlap)
    chars = lambda p: _runs(p, size)
    splits = (*(lambda p, r=r: _split_before(p, r) for r in MARKDOWN_LEVELS), chars)
    return packed(_leveled(df, F.length, size, splits), F.col("_pieces"), F.length, size, overlap)


def chunk_recursive(df: DataFrame, size: int = 512) -> DataFrame:
    """Cut at paragraphs, sentences, words in turn as far as needed, then pack by tokens."""
    _check(size)
    splits = (lambda p: _split_before(p, r"(\n\n)"), lambda p: F.regexp_extract_all(p, F.lit(T.SENTENCE), F.lit(0)), T.tokens)
    return packed(_leveled(df, _tokens_of, size, splits), F.col("_pieces"), _tokens_of, size, cut=None)


def lines_of(df: DataFrame) -> DataFrame:
    """doc_id, line_no, line, line_start (offset of the line in the content)."""
    rows = df.where("content IS NOT NULL").select("doc_id", F.posexplode(F.split("content", "\n")).alias("line_no", "line"))
    upto = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("line_start", F.coalesce(F.sum(F.length("line") + 1).over(upto), F.lit(0)).cast("int"))


def heading_path(lines: DataFrame) -> DataFrame:
    """Lines with in_fence, level (0: no heading; 1 to 3 outside fences) and h1, h2, h3 in force; a heading resets deeper ones."""
    upto = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    fence = F.startswith(F.col("line"), F.lit("```"))
    rows = lines.withColumn("_fences", F.sum(fence.cast("int")).over(upto)).withColumn("in_fence", fence | (F.col("_fences") % 2 == 1))
    marks = F.length(F.regexp_extract("line", r"^(#{1,3}) ", 1))
    rows = rows.withColumn("level", F.when(F.col("in_fence"), 0).otherwise(marks))
    title = F.trim(F.regexp_replace("line", r"^#{1,3} ", ""))
    for k in (1, 2, 3):
        rows = rows.withColumn(f"_p{k}", F.max(F.when(F.col("level") == k, F.col("line_no"))).over(upto)).withColumn(f"_t{k}", F.last(F.when(F.col("level") == k, title), ignorenulls=True).over(upto))
    none = F.lit(-1)
    p1, p2, p3 = (F.coalesce(f"_p{k}", none) for k in (1, 2, 3))
    return rows.select(
        "doc_id", "line_no", "line", "line_start", "in_fence", "level",
        F.col("_t1").alias("h1"), F.when(p2 > p1, F.col("_t2")).alias("h2"), F.when(p3 > F.greatest(p1, p2), F.col("_t3")).alias("h3"),
    )


def _joined(rows: DataFrame, *keys: str) -> DataFrame:
    """Lines of each key in order, joined again, with their start and, for every heading level, the value of the first line."""
    ordered = F.sort_array(F.collect_list(F.struct("line_no", "line", "line_start", "h1", "h2", "h3")))
    made = rows.groupBy(*keys).agg(ordered.alias("_lines"))
    first = F.get("_lines", F.lit(0))
    return made.select(
        *keys, F.array_join(F.transform("_lines", lambda x: x["line"]), "\n").alias("content"), first["line_start"].alias("start"),
        first["h1"].alias("h1"), first["h2"].alias("h2"), first["h3"].alias("h3"),
    )


def chunk_markdown(df: DataFrame, sizing: bool = False, size: int = 512, overlap: int = 51) -> DataFrame:
    """Sections at H1 to H3 outside fences, headings kept in the content, with h1, h2, h3 in force; sizing cuts sections further."""
    upto = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = heading_path(lines_of(df)).withColumn("section", F.sum((F.col("level") > 0).cast("int")).over(upto))
    sections = _joined(rows, "doc_id", "section").where((F.col("section") > 0) | (F.trim("content") != ""))
    order = Window.partitionBy("doc_id").orderBy("section")
    if not sizing:
        return sections.select("doc_id", (F.row_number().over(order) - 1).alias("chunk_index"), "content", "start", (F.col("start") + F.length("content")).alias("end"), T.token_count(F.col("content")).alias("token_count"), "h1", "h2", "h3")
    parts = sections.select("doc_id", "content", *[F.col(c).alias(f"_keep_{c}") for c in ("section", "h1", "h2", "h3")], F.col("start").alias("_keep_section_start"))
    chunks = chunk_recursive_md(parts, size, overlap)
    order = Window.partitionBy("doc_id").orderBy("section", "chunk_index")
    return chunks.select(
        "doc_id", (F.row_number().over(order) - 1).alias("chunk_index"), "content", (F.col("section_start") + F.col("start")).alias("start"), (F.col("section_start") + F.col("end")).alias("end"), "token_count", "h1", "h2", "h3"
    )


def split_blocks(df: DataFrame) -> DataFrame:
    """Blocks at H1 to H6 lines, fences or not: doc_id, block, heading, content, start_line, end_line. Leading text has no heading."""
    lines = df.where("content IS NOT NULL").select("doc_id", F.posexplode(F.split("content", "\n")).alias("line_no", "line"))
    upto = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    is_heading = F.regexp_like("line", F.lit(r"^#{1,6} "))
    numbered = lines.withColumn("_n", F.sum(is_heading.cast("int")).over(upto))
    ordered = F.sort_array(F.collect_list(F.struct("line_no", "line")))
    made = numbered.groupBy("doc_id", "_n").agg(ordered.alias("_lines"), F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"))
    order = Window.partitionBy("doc_id").orderBy("_n")
    return made.select(
        "doc_id", (F.row_number().over(order) - 1).alias("block"), F.when(F.col("_n") > 0, F.trim(F.regexp_replace(F.get("_lines", F.lit(0))["line"], r"^#{1,6} ", ""))).alias("heading"),
        F.array_join(F.transform("_lines", lambda x: x["line"]), "\n").alias("content"), "start_line", "end_line",
    )


def join_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks of each document in order, one a line: the inverse of split_blocks."""
    ordered = F.sort_array(F.collect_list(F.struct("block", "content")))
    return blocks.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["content"]), "\n").alias("content"))


PAGE_GAP = "\n\n---\n\n"


def join_pages(pages: DataFrame) -> DataFrame:
    """pages(doc_id, page, content) to doc_id, content with page markers, in page order."""
    ordered = F.sort_array(F.collect_list(F.struct("page", "content")))
    parts = F.transform(ordered, lambda x: F.concat(F.lit("<!-- page-marker:"), x["page"].cast("string"), F.lit(" -->\n"), F.coalesce(x["content"], F.lit(""))))
    return pages.groupBy("doc_id").agg(F.array_join(parts, PAGE_GAP).alias("content"))


def split_pages(df: DataFrame) -> DataFrame:
    """doc_id, page, content between page markers; text before the first marker goes, as does the rule that ends a page."""
    marker = r"<!-- page-marker:(\d+) -->"
    numbers = F.regexp_extract_all("content", F.lit(marker), F.lit(1))
    parts = F.slice(F.split("content", r"<!-- page-marker:\d+ -->"), F.lit(2), F.lit(2**31 - 1))
    rows = df.where("content IS NOT NULL").select("doc_id", numbers.alias("_n"), parts.alias("_p")).where(F.size("_n") > 0)
    pages = rows.select("doc_id", F.explode(F.arrays_zip("_n", "_p")).alias("x"))
    space = r"^[ \t\n\f\r]+|[ \t\n\f\r]+$"
    body = F.regexp_replace(F.regexp_replace(F.regexp_replace("x._p", space, ""), r"\n---$", ""), space, "")
    return pages.select("doc_id", F.col("x._n").cast("int").alias("page"), body.alias("content"))


def chunk_table(df: DataFrame, rows: int = 3) -> DataFrame:
    """Markdown tables by groups of rows, header and delimiter repeated; every other run of lines is one chunk.

    start and end cover the group's own rows.
    """
    _check(rows)
    lines = lines_of(df)
    by_line = Window.partitionBy("doc_id").orderBy("line_no")
    upto = by_line.rowsBetween(Window.unboundedPreceding, 0)
    bar = F.contains("line", F.lit("|"))
    delimiter = F.regexp_like("line", F.lit(r"^\s*\|?[\s:|-]+\|?\s*$")) & F.contains("line", F.lit("-")) & bar
    marked = lines.withColumn("_head", bar & F.coalesce(F.lead(delimiter).over(by_line), F.lit(False))).withColumn("_bar", bar)
    # A run changes at a header line and where bars end or text begins.
    run = marked.withColumn("_table", F.last(F.when(F.col("_head"), F.lit(1)).when(~F.col("_bar"), F.lit(0)), ignorenulls=True).over(upto)).withColumn("_table", F.coalesce("_table", F.lit(0)))
    turn = F.col("_head") | (F.col("_table") != F.coalesce(F.lag("_table").over(by_line), F.col("_table")))
    runs = run.withColumn("_run", F.sum(turn.cast("int")).over(upto))
    inner = Window.partitionBy("doc_id", "_run").orderBy("line_no")
    placed = runs.withColumn("_k", F.row_number().over(inner) - 1)
    header = placed.where("_table = 1 AND _k < 2").groupBy("doc_id", "_run").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("_header"))
    body = placed.where("_table = 0 OR _k >= 2").withColumn("_group", F.when(F.col("_table") == 1, F.floor((F.col("_k") - 2) / rows)).otherwise(0).cast("int"))
    ordered = F.sort_array(F.collect_list(F.struct("line_no", "line", "line_start")))
    groups = body.groupBy("doc_id", "_run", "_table", "_group").agg(ordered.alias("_lines")).join(header, ["doc_id", "_run"], "left")
    text = F.array_join(F.transform("_lines", lambda x: x["line"]), "\n")
    last = F.element_at("_lines", -1)
    made = groups.select(
        "doc_id", "_run", "_group", F.when(F.col("_table") == 1, F.concat_ws("\n", "_header", text)).otherwise(text).alias("content"),
        F.get("_lines", F.lit(0))["line_start"].alias("start"), (last["line_start"] + F.length(last["line"])).alias("end"), (F.col("_table") == 1).alias("is_table"),
    ).where(F.col("is_table") | (F.trim(F.regexp_replace("content", "\n", "")) != ""))
    order = Window.partitionBy("doc_id").orderBy("_run", "_group")
    return made.select("doc_id", (F.row_number().over(order) - 1).alias("chunk_index"), "content", "start", "end", T.token_count(F.col("content")).alias("token_count"), "is_table")


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is null or all zeros."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda acc, v: acc + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def boundary_groups(rows: DataFrame, key: str, order: str, vector: str, threshold: float = 0.5) -> DataFrame:
    """rows with ``group`` (from 0 within a key): a new one where the likeness to the row before falls below the threshold."""
    w = Window.partitionBy(key).orderBy(order)
    before = F.lag(vector).over(w)
    flagged = rows.withColumn("_new", F.when(before.isNotNull() & (F.coalesce(cosine(before, F.col(vector)), F.lit(0.0)) < threshold), 1).otherwise(0))
    return flagged.withColumn("group", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_new")


def letter_vector(c: Column) -> Column:
    """How often each of the letters a to z stands in a text: a plain vector for chunk_semantic where there is no model."""
    letters = F.array(*[F.lit(x) for x in "abcdefghijklmnopqrstuvwxyz"])
    # The text is put in lower case once for all letters.
    counts = lambda low: F.transform(letters, lambda x: (F.length(c) - F.length(F.replace(low, x, F.lit("")))).cast("double"))
    return F.get(F.transform(F.array(F.lower(c)), counts), F.lit(0))


def chunk_semantic_text(df: DataFrame, embed: Callable[[Column], Column] = letter_vector, threshold: float = 0.5, size: int = 512) -> DataFrame:
    """Sentences of a text grouped by the likeness of neighbours; embed makes a vector column of the sentences' column."""
    parts = df.where("content IS NOT NULL").select("doc_id", F.posexplode(F.regexp_extract_all("content", F.lit(T.SENTENCE), F.lit(0))).alias("place", "content"))
    chunks = chunk_semantic(parts.withColumn("embedding", embed(F.col("content"))), threshold, size)
    order = Window.partitionBy("doc_id").orderBy("group", "part")
    placed = chunks.withColumn("chunk_index", F.row_number().over(order) - 1)
    # Chunks are consecutive stretches, so a chunk starts where the ones before it end.
    before = F.coalesce(F.sum(F.length("content")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    return placed.select("doc_id", "chunk_index", "content", before.alias("start"), (before + F.length("content")).cast("int").alias("end"), "token_count")


def chunk_semantic(sentences: DataFrame, threshold: float = 0.5, size: int = 512) -> DataFrame:
    """sentences(doc_id, place, content, embedding): likely neighbours grouped; groups over size tokens are packed by sentences."""
    _check(size)
    grouped = boundary_groups(sentences, "doc_id", "place", "embedding", threshold)
    ordered = F.sort_array(F.collect_list(F.struct("place", "content")))
    groups = grouped.groupBy("doc_id", "group").agg(F.transform(ordered, lambda x: x["content"]).alias("_sentences"))
    parts = groups.select("doc_id", F.array_join("_sentences", "").alias("content"), F.col("group").alias("_keep_group"), "_sentences")
    chunks = packed(parts, F.col("_sentences"), _tokens_of, size, cut="token")
    return chunks.select("doc_id", "group", F.col("chunk_index").alias("part"), "content", "token_count")


def chunk_hybrid(df: DataFrame, max_tokens: int = 512) -> DataFrame:
    """Blocks of lines below one heading path; too large ones cut by tokens; neighbours with equal paths merged while they fit.

    content is the text, contextualized the headings and the text.
    """
    _check(max_tokens)
    by_line = Window.partitionBy("doc_id").orderBy("line_no")
    upto = by_line.rowsBetween(Window.unboundedPreceding, 0)
    rows = heading_path(lines_of(df)).where("level = 0")
    kind = F.when(F.col("in_fence"), "code").when(F.trim("line") == "", "blank").when(F.regexp_like("line", F.lit(r"^\s*([-*+]|\d+\.) ")), "list").when(F.contains("line", F.lit("|")), "table").otherwise("text")
    path = F.concat_ws("\u0002", F.coalesce("h1", F.lit("")), F.coalesce("h2", F.lit("")), F.coalesce("h3", F.lit("")))
    rows = rows.withColumn("_kind", kind).withColumn("_path", path)
    new = F.coalesce((F.lag("_kind").over(by_line) != F.col("_kind")) | (F.lag("_path").over(by_line) != F.col("_path")), F.lit(True))
    runs = rows.withColumn("_run", F.sum(new.cast("int")).over(upto)).where("_kind <> 'blank'")
    elements = _joined(runs, "doc_id", "_run")
    key = F.concat_ws("\u0002", F.coalesce("h1", F.lit("")), F.coalesce("h2", F.lit("")), F.coalesce("h3", F.lit("")))
    parts = elements.select("doc_id", "content", F.col("_run").alias("_keep_run"), key.alias("_keep_path"))
    pieces = chunk_token(parts.select("doc_id", "content", F.col("_keep_run").alias("_k"), F.col("_keep_path").alias("_p")).select(F.struct("doc_id", "_k", "_p").alias("doc_id"), "content"), max_tokens, 0)
    flat = pieces.select("doc_id.doc_id", F.col("doc_id._k").alias("run"), F.col("doc_id._p").alias("path"), "chunk_index", F.regexp_replace("content", r"^\s+|\s+$", "").alias("content"), "token_count")
    order = Window.partitionBy("doc_id").orderBy("run", "chunk_index")
    peers = flat.withColumn("_peer", F.sum(F.coalesce((F.lag("path").over(order) != F.col("path")).cast("int"), F.lit(1))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    groups = peers.groupBy("doc_id", "_peer", "path").agg(F.sort_array(F.collect_list(F.struct("run", "chunk_index", "content", "token_count"))).alias("_x"))
    spans = groups.withColumn("_spans", greedy_spans(F.transform("_x", lambda x: x["token_count"]), max_tokens))
    merged = spans.select("doc_id", "_peer", "path", F.posexplode(F.transform("_spans", lambda s: F.array_join(F.transform(F.slice("_x", s["s"], s["e"] - s["s"] + 1), lambda x: x["content"]), "\n"))).alias("_i", "content"))
    headings = F.filter(F.split("path", "\u0002"), lambda h: h != "")
    order = Window.partitionBy("doc_id").orderBy("_peer", "_i")
    return merged.select(
        "doc_id", (F.row_number().over(order) - 1).alias("chunk_index"), "content", T.token_count(F.col("content")).alias("token_count"), headings.alias("headings"), T.contextualized(headings, F.col("content")).alias("contextualized")
    )


def chunk_stats(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, total_chunks, avg_chunk_chars (rounded down)."""
    return chunks.groupBy(key).agg(F.count("*").alias("total_chunks"), F.expr("coalesce(sum(length(content)), 0) div count(*)").alias("avg_chunk_chars"))


def locate_offsets(df: DataFrame, overlap: int | None = 0) -> DataFrame:
    """df(doc_id, content, splits): (doc_id, chunk_index, content, start, end) found one after another.

    A search begins overlap characters before the last end; a split that isn't found starts there. overlap None takes the overlap of
    a document's first two splits. Null contents and null splits give no rows. A document takes time in proportion to its text and splits.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for doc, content, splits in zip(b.column("doc_id"), b.column("content").to_pylist(), b.column("splits").to_pylist()):
                if content is not None:
                    own = [x for x in splits or [] if x is not None]
                    for k, (x, start) in enumerate(zip(own, located(content, own, overlap))):
                        yield doc, k, x, start, start + len(x)

    return rows_by_task(df.select("doc_id", "content", "splits"), found, "chunk_index int, content string, start int, end int")


#: Rows of one Arrow batch that a task hands on.
BATCH_ROWS = 16_384


def rows_by_task(df: DataFrame, made: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]], columns: str) -> DataFrame:
    """doc_id and the given columns from tuples that made yields of a task's batches, whose first value is a cell of doc_id."""
    schema = StructType([df.schema["doc_id"], *_parse_datatype_string(columns).fields])
    types = [to_arrow_type(f.dataType) for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = made(batches)
        while held := list(islice(rows, BATCH_ROWS)):
            first, *rest = zip(*held)
            cells = [pa.array([x.as_py() for x in first], types[0]), *(pa.array(c, t) for c, t in zip(rest, types[1:]))]
            yield pa.RecordBatch.from_arrays(cells, names=schema.names)

    return df.mapInArrow(run, schema)
