"""Plug-in surface: strategies (DataFrame -> DataFrame), converters (text -> text), and the table of both."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions.places import located
from textloom.operators import catalog as C
from textloom.operators import chunking as K
from textloom.operators import enrichment as N


@dataclass(frozen=True)
class Entry:
    """arrays: a strategy made of array expressions over one document, whose single Generate also carries outcomes."""

    kind: str
    name: str
    label: str
    description: str
    run: Callable
    arrays: bool = False


#: Characters of an exception's message that an error keeps.
ERROR_LENGTH = 200

REGISTRY: dict[tuple[str, str], Entry] = {}


def _register(kind: str, name: str, label: str, description: str, arrays: bool = False):
    def add(f: Callable) -> Callable:
        REGISTRY.setdefault((kind, name), Entry(kind, name, label or name, description, f, arrays))  # the first of a name stays
        return f

    return add


def register_strategy(name: str, label: str = "", description: str = ""):
    """A function (df, **parameters) -> chunks, for chunk_corpus."""
    return _register("strategy", name, label, description)


def register_splitter(name: str, label: str = "", description: str = ""):
    """A function (text, **options) -> list of texts, run in Python for one document at a time; offsets are found again.

    What it raises for a document becomes that document's error in chunk_results.
    """
    return _register("splitter", name, label, description)


def register_converter(name: str, label: str = "", description: str = ""):
    """A function of one text, for convert_corpus."""
    return _register("converter", name, label, description)


for _name, _run, _label in (
    ("token", K.chunk_token, "Token windows"), ("character", K.chunk_character, "Paragraphs by characters"), ("recursive_md", K.chunk_recursive_md, "Markdown separators by characters"),
    ("recursive", K.chunk_recursive, "Paragraphs, sentences, words by tokens"), ("markdown", K.chunk_markdown, "Markdown headers"), ("fast", K.chunk_fast, "Words by bytes"),
    ("sentence", K.chunk_sentence, "Sentences by tokens"), ("table", K.chunk_table, "Table rows"), ("line", K.chunk_lines, "Lines by tokens"), ("hybrid", K.chunk_hybrid, "Structure with merged peers"),
    ("semantic", K.chunk_semantic_text, "Sentences by likeness"),
):
    _register("strategy", _name, _label, (_run.__doc__ or "").split("\n")[0], _name in ("token", "character", "recursive_md", "recursive", "fast", "sentence", "line"))(_run)


def capabilities(spark: SparkSession) -> DataFrame:
    rows = [(e.kind, e.name, e.label, e.description) for e in REGISTRY.values()]
    return spark.createDataFrame(rows, "kind string, name string, label string, description string")


RESULT = ("doc_id", "chunk_index", "content", "start", "end", "token_count", "total_chunks", "error")


def chunk_results(df: DataFrame, strategy: str, least: int = 1, most: int = 10_000_000, options: str | None = None, split_overlap: int | None = 0, **parameters) -> DataFrame:
    """doc_id, chunk_index, content, start, end, token_count, total_chunks, error, from one run of a strategy or splitter.

    Columns that a strategy has beside these, as headings, follow. A document has a row for each chunk, all with its number of chunks. One that is out of bounds, gives no chunks or makes a
    splitter raise has one row without a chunk, with its error if any; the others are not held up. options names a column of df,
    a map from text to text, whose entries go to a splitter as further arguments of that document's call; split_overlap is
    the overlap of a splitter's texts, as in locate_offsets.
    """
    entry = REGISTRY.get(("strategy", strategy)) or REGISTRY.get(("splitter", strategy))
    if entry is None:
        raise ValueError(f"unknown strategy {strategy}")
    checked = C.content_bounds(df, least, most)
    if entry.kind == "splitter":
        return _split_results(checked, entry.run, options, split_overlap, parameters)
    if options:
        raise ValueError("only splitters take options by document")
    if entry.arrays:
        rows = entry.run(checked.select("doc_id", F.when(F.col("error").isNull(), F.col("content")).otherwise("").alias("content"), F.col("error").alias("_keep_error")), **parameters)
        return rows.select(*RESULT)
    chunks = entry.run(checked.where("error IS NULL").drop("error"), **parameters).withColumn("error", F.lit(None).cast("string"))
    # Every document also has an empty row, which stays only where the strategy made no chunk of it.
    rows = chunks.unionByName(checked.select("doc_id", "error"), allowMissingColumns=True)
    counted = rows.withColumn("total_chunks", F.count("chunk_index").over(Window.partitionBy("doc_id")).cast("int"))
    found = counted.where("chunk_index IS NOT NULL OR total_chunks = 0")
    for c in {"start", "end"} - set(found.columns):  # of strategies whose chunks are no stretches of the text
        found = found.withColumn(c, F.lit(None).cast("int"))
    return found.select(*RESULT, *[c for c in chunks.columns if c not in RESULT])


def _split_results(checked: DataFrame, splitter: Callable, options: str | None, overlap: int | None, parameters: dict) -> DataFrame:
    own = F.col(options) if options else F.lit(None)
    source = checked.select("doc_id", F.when(F.col("error").isNull(), F.col("content")).alias("content"), "error", own.cast("map<string,string>").alias("options"))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for doc, content, error, more in zip(b.column("doc_id"), *(b.column(c).to_pylist() for c in ("content", "error", "options"))):
                splits = []
                if error is None:
                    try:
                        splits = [s for s in splitter(content, **parameters, **dict(more or [])) if s]
                        starts = located(content, splits, overlap)
                    except Exception as e:  # of one document; the rest goes on
                        splits, error = [], f"{type(e).__name__}: {str(e)[:ERROR_LENGTH]}"
                for k, (x, start) in enumerate(zip(splits, starts if splits else [])):
                    yield doc, k, x, start, start + len(x), len(splits), None
                if not splits:
                    yield doc, None, None, None, None, 0, error

    rows = K.rows_by_task(source, made, "chunk_index int, content string, start int, end int, total_chunks int, error string")
    return rows.withColumn("token_count", F.when(F.col("content").isNotNull(), T.token_count(F.col("content")))).select(*RESULT)


def chunks_of(results: DataFrame) -> DataFrame:
    """The chunks among the rows of chunk_results."""
    return results.where("chunk_index IS NOT NULL").drop("total_chunks", "error")


def outcomes_of(results: DataFrame) -> DataFrame:
    """doc_id, success, total_chunks, error of every document, from the rows of chunk_results: a filter, no shuffle."""
    return results.where("chunk_index IS NULL OR chunk_index = 0").select("doc_id", F.col("error").isNull().alias("success"), "total_chunks", "error")


def chunk_corpus(df: DataFrame, strategy: str, least: int = 1, most: int = 10_000_000, **parameters) -> tuple[DataFrame, DataFrame]:
    """(chunks, outcomes), two views of chunk_results. To use both and run the strategy once, save chunk_results and take its views."""
    results = chunk_results(df, strategy, least, most, **parameters)
    return chunks_of(results), outcomes_of(results)


def convert_with(docs: DataFrame, converter: str, source: str = "content") -> DataFrame:
    """convert_corpus by a registered converter's name."""
    entry = REGISTRY.get(("converter", converter))
    if entry is None:
        raise ValueError(f"unknown converter {converter}")
    return N.convert_corpus(docs, entry.run, source)


def table_function(spark: SparkSession, splitter: str, name: str | None = None, overlap: int | None = 0) -> str:
    """A registered splitter as a table function of SQL, for FROM t, LATERAL name(t.content, options): its name.

    name(content string, options map<string,string>) gives chunk_index, content, start, end, error, whose second argument can differ from
    row to row. What the splitter raises is one row with an error; null content and content without chunks give no rows, and null
    options are none. Batches go to Python by Arrow; nothing is shuffled. overlap as in locate_offsets.
    """
    entry = REGISTRY.get(("splitter", splitter))
    if entry is None:
        raise ValueError(f"unknown splitter {splitter}")
    run = entry.run

    class Split:
        def eval(self, content, options):
            if content is None:
                return
            try:
                splits = [s for s in run(content, **dict(options or {})) if s]
                starts = located(content, splits, overlap)
            except Exception as e:  # of one row; the rest goes on
                yield None, None, None, None, f"{type(e).__name__}: {str(e)[:ERROR_LENGTH]}"
                return
            for k, (x, start) in enumerate(zip(splits, starts)):
                yield k, x, start, start + len(x), None

    made = F.udtf(Split, returnType="chunk_index int, content string, start int, end int, error string", useArrow=True)
    spark.udtf.register(name or splitter, made)
    return name or splitter


def split_with(df: DataFrame, splitter: Callable[[str], list[str]], overlap: int | None = 0) -> DataFrame:
    """Chunks of a user's splitter, with offsets found again; overlap as in locate_offsets."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for doc, content in zip(b.column("doc_id"), b.column("content").to_pylist()):
                splits = [s for s in splitter(content) if s] if content is not None else []
                for k, (x, start) in enumerate(zip(splits, located(content or "", splits, overlap))):
                    yield doc, k, x, start, start + len(x)

    return K.rows_by_task(df.select("doc_id", "content"), made, "chunk_index int, content string, start int, end int")
