"""How text filters overlap, in every order, by a sparse document-term matrix.

Words get global codes (``dictionary``); the matrix lies in compressed sparse rows, a shard of documents in each row of a
table. Its row sums are the documents' words and its nonzero counts their distinct words, which decide the first two of five filters:

A fewer than 200 words; B fewer distinct words than half of the words; C more than 2 % capitals A-Z among code points;
D any of ``#$%&*|``; E a text that equals the text of a smaller doc_id, anywhere in the table.

Null texts are empty: no words, so A fails, and E if another empty text has a smaller id. Null ids are neither smaller nor
larger than others: E never fails for them or because of them. Rows that share an id are judged one by one, and none of
them is smaller than another. Long texts are read whole. An empty table gives no rows. Only the named columns are read, so others can have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from textloom.llm import dictionary as D
from textloom.llm import textscan as ts

LETTERS = "ABCDE"
BIT = {letter: 1 << i for i, letter in enumerate(LETTERS)}
MIN_WORDS = 200
#: Bytes of text in one shard of the matrix, in slices that share the shard's dictionary; a longer text is a shard by itself.
SHARD_BYTES = 16 << 20
_SLICE_BYTES = 2 << 20
_MARKS = ts.byte_table("#$%&*|")
_CAPITALS = ts.byte_table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def document_shards(docs: DataFrame, key: str = "doc_id", part: str = "source", text: str = "text") -> DataFrame:
    """Rows of documents in shards: sparse rows over each shard's own words, with what else the filters need. Stored.

    keys, parts and digests are arrays with an entry for each document; indptr, columns, counts and flags (bits of C and D)
    are binary arrays of long, int, int and byte.
    """
    source = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), F.col(f"`{text}`").cast("string").alias("text"))
    source = source.withColumn("task", F.spark_partition_id())
    kind = source.schema["key"].dataType
    lists = [("words", T.BinaryType()), ("counts", T.LongType()), ("keys", kind), ("parts", T.StringType()), ("digests", T.BinaryType())]
    arrow = [to_arrow_type(t) for _, t in lists]
    schema = T.StructType([T.StructField("shard", T.LongType()), *(T.StructField(n, T.ArrayType(t)) for n, t in lists)] + [T.StructField(n, T.BinaryType()) for n in ("flags", "indptr", "columns", "values")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, held, size, words = 0, [], 0, D.Words()

        def shard(task: int) -> pa.RecordBatch:
            """What is held, as one row; nothing stays held while it is sent."""
            nonlocal made, held, size, words
            columns = [np.concatenate(x) for x in zip(*(h[3:] for h in held))]
            columns[1] = np.concatenate([[0], np.cumsum(columns[1])])
            lists = [words.words, pa.array(words.counts), *(pa.concat_arrays([h[k] for h in held]) for k in range(3))]
            made, held, size, words = made + 1, [], 0, D.Words()
            cells = [D.one_row(x, kind_) for x, kind_ in zip(lists, arrow)]
            return pa.RecordBatch.from_arrays([pa.array([(task << D._PARTITION_BITS) + made - 1], pa.int64()), *cells, *(pa.array([x.tobytes()], pa.binary()) for x in columns)], names=schema.names)

        for b in ts.slices(batches, "text", _SLICE_BYTES):
            texts = ts.Texts(b.column("text"))
            distinct, codes, starts, _ = D.coded(texts)
            codes = words.add(distinct, codes)
            rows, wide = np.repeat(np.arange(texts.n, dtype=np.int64), texts.word_counts(starts)), max(1, len(words.words))
            cells, values = np.unique(rows * wide + codes, return_counts=True)
            per_text = np.bincount(cells // wide, minlength=texts.n).astype(np.int64)
            flags = np.where(100 * texts.count(_CAPITALS) > 2 * texts.code_points(), BIT["C"], 0) + np.where(texts.count(_MARKS) > 0, BIT["D"], 0)
            data, at = texts.bytes, texts.offsets
            digests = pa.array([hashlib.sha256(data[at[i] : at[i + 1]]).digest() for i in range(texts.n)], pa.binary())
            own = [b.column(c).take(pa.array(np.arange(texts.n))) for c in ("key", "part")]  # copies, which don't keep the batch's texts
            held.append((*own, digests, flags.astype(np.uint8), per_text, (cells % wide).astype(np.int32), values.astype(np.int32)))
            size += len(data)
            if size >= SHARD_BYTES:
                yield shard(b.column("task")[0].as_py())
            task = b.column("task")[0].as_py()
        if held:
            yield shard(task)

    return D.stored(source.mapInArrow(run, schema))


def mapped_shards(docs: DataFrame, key: str = "doc_id", part: str = "source", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The dictionary, and document_shards with the ids of their words."""
    local = document_shards(docs, key, part, text)
    words = D.dictionary(local)
    return words, D.with_ids(local, words)


def global_columns(shard: pa.RecordBatch) -> np.ndarray:
    """The columns of a mapped shard (a batch of one row) in the matrix of all shards: dictionary ids less one."""
    codes = np.frombuffer(shard.column("columns")[0].as_buffer(), dtype=np.int32)
    return D.id_table(shard.column("ids")[0], int(codes.max(initial=-1)) + 1)[codes] - 1


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1)


def document_term_matrix(docs: DataFrame, key: str = "doc_id", part: str = "source", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The dictionary (word, f, id from 1) and the shards of the matrix, whose columns are those ids less one.

    A shard has keys, parts, digests and flags of its documents, and indptr, columns, values as binary arrays of long,
    long and int: row i has values[indptr[i]:indptr[i+1]] in columns[indptr[i]:indptr[i+1]].
    """
    words, mapped = mapped_shards(docs, key, part, text)
    kept = ("shard", "keys", "parts", "digests", "flags", "indptr", "values")
    schema = T.StructType([*(mapped.schema[n] for n in kept), T.StructField("columns", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _shards(batches):
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in kept), pa.array([global_columns(b).tobytes()], pa.binary())], names=schema.names)

    return words, mapped.mapInArrow(run, schema)


def measured(mapped: DataFrame) -> DataFrame:
    """Per document of mapped shards: key, part, digest, n_words (row sum), n_distinct (nonzero count), bits of A to D.

    A task builds the rows of the matrix and adds them up at once, so that the matrix needn't be written.
    """
    kind = mapped.schema["keys"].dataType.elementType
    names = ("key", "part", "digest", "n_words", "n_distinct", "bits")
    kinds = (kind, T.StringType(), T.BinaryType(), T.LongType(), T.LongType(), T.IntegerType())
    schema = T.StructType([T.StructField(n, t) for n, t in zip(names, kinds)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _shards(batches):
            indptr, values, flags = (np.frombuffer(b.column(n)[0].as_buffer(), dtype=t) for n, t in (("indptr", np.int64), ("values", np.int32), ("flags", np.uint8)))
            sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
            nonzero = np.concatenate([[0], np.cumsum(global_columns(b) >= 0)])
            n_words, n_distinct = sums[indptr[1:]] - sums[indptr[:-1]], nonzero[indptr[1:]] - nonzero[indptr[:-1]]
            bits = flags + np.where(n_words < MIN_WORDS, BIT["A"], 0) + np.where(100 * n_distinct < 50 * n_words, BIT["B"], 0)
            made = [b.column("keys")[0].values, b.column("parts")[0].values, b.column("digests")[0].values, pa.array(n_words, pa.int64()), pa.array(n_distinct, pa.int64()), pa.array(bits, pa.int32())]
            yield pa.RecordBatch.from_arrays(made, names=names)

    return mapped.select("keys", "parts", "digests", "flags", "indptr", "columns", "values", "ids").mapInArrow(run, schema)


def failures(measures: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """part, bits of A to E, n, good, toxic: how many documents of a part fail exactly these filters, and how many of them are labelled so.

    Documents meet their labels by id; the rows of a text are counted in tasks before they meet the smallest id of that
    text, so a text that many documents share moves as a few rows for each part.
    """
    marks = labels.where(F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`").alias("key")).agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    spread = F.when(F.col("key").isNull(), F.xxhash64("digest", "part", F.monotonically_increasing_id()))  # null ids, which have no label, shouldn't meet in one task
    rows = measures.withColumn("spread", F.coalesce(spread, F.lit(0))).join(marks.withColumn("spread", F.lit(0).cast("long")), ["key", "spread"], "left")
    each = rows.groupBy("digest", "part", "bits", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"), "key").agg(F.count("*").alias("n"))
    counted = D.stored(
        each.groupBy("digest", "part", "bits", "good", "toxic").agg(F.sum("n").alias("n"), F.min("key").alias("least"), F.coalesce(F.min_by("n", "key"), F.lit(0)).alias("n_least"), F.sum(F.when(F.col("key").isNull(), F.col("n")).otherwise(0)).alias("n_null"))
    )
    first = counted.groupBy("digest").agg(F.min("least").alias("first"))
    fine = F.col("n_null") + F.when(F.col("least") == F.col("first"), F.col("n_least")).otherwise(0)
    split = counted.join(first, "digest").select("part", "bits", "good", "toxic", F.explode(F.array(F.struct(F.lit(0).alias("e"), fine.alias("m")), F.struct(F.lit(BIT["E"]).alias("e"), (F.col("n") - fine).alias("m")))).alias("x"))
    return split.where("x.m > 0").groupBy("part", (F.col("bits") + F.col("x.e")).alias("bits")).agg(
        F.sum("x.m").alias("n"), F.sum(F.col("x.m") * F.col("good")).alias("good"), F.sum(F.col("x.m") * F.col("toxic")).alias("toxic")
    )


def interactions(patterns: DataFrame) -> DataFrame:
    """part, filter_order, step and what each step of each order keeps, removes and loses; patterns as failures() gives them.

    A part has 32 patterns at most, so each of its 600 rows is a sum over one small array. shapley adds a filter's removals over
    all orders: of the orders, 120 / k have it first among the k filters that a document fails.
    """
    orders = ["".join(p) for p in permutations(LETTERS)]
    bits = [BIT[o[s]] for o in orders for s in range(len(LETTERS))]
    before = [sum(BIT[x] for x in o[:s]) for o in orders for s in range(len(LETTERS))]
    shares = [0, *(len(orders) // bin(p).count("1") for p in range(1, 1 << len(LETTERS)))]
    parts = patterns.groupBy("part").agg(F.collect_list(F.struct("bits", "n", "good", "toxic")).alias("p"))
    steps = parts.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(len(orders) - 1)))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))))
    place = F.col("o") * len(LETTERS) + F.col("step") - 1
    steps = steps.withColumn("own", F.get(F.lit(bits), place)).withColumn("before", F.get(F.lit(before), place)).withColumn("filter_order", F.get(F.lit(orders), F.col("o")))

    def total(value, where) -> Column:
        return F.aggregate("p", F.lit(0).cast("long"), lambda sum_, x: sum_ + F.when(where(x["bits"]), value(x)).otherwise(F.lit(0).cast("long")))

    fails, gone = (lambda b: b.bitwiseAND(F.col("own")) != 0), (lambda b: b.bitwiseAND(F.col("before")) != 0)
    removed = lambda b: fails(b) & ~gone(b)
    return steps.select(
        "part", "filter_order", "step",
        total(lambda x: x["n"], lambda b: ~fails(b) & ~gone(b)).alias("kept"),
        total(lambda x: x["n"], removed).alias("removed"),
        total(lambda x: x["n"], lambda b: fails(b) & gone(b)).alias("redundant"),
        total(lambda x: x["n"], lambda b: b == F.col("own")).alias("unique_fails"),
        total(lambda x: x["good"], removed).alias("good_lost"),
        total(lambda x: x["toxic"], removed).alias("toxic_lost"),
        total(lambda x: x["n"] * F.get(F.lit(shares), x["bits"]), fails).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", part: str = "source", text: str = "text") -> DataFrame:
    """The interactions of the five filters over docs, within each part."""
    _, mapped = mapped_shards(docs, key, part, text)
    return interactions(failures(measured(mapped), labels, key))
