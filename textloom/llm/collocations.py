"""The phrases of two and three words that hold together best, per language, by best-first branch and bound.

A phrase grows from its prefix. With f(x) for the number of times that x stands in pieces of text, a phrase of count a that
is cut into parts of counts l and r scores floor(10^6 a a / (l r)), at its worst cut. As a is at most l and at most r, a
three-word phrase ``u v w`` cannot score above 10^6 f(u v) / f(u), which its prefix tells, nor above 10^6 f(v w) / f(w), and
where it scores as much as that, its count is at most f(u v), or f(v w). These pairs (score, count) are admissible bounds.

Words and two-word phrases are counted in full, in shards of word codes. Then the best two-word phrases of a language give
a first limit, and the frontier, all phrases whose bound reaches the limit, is expanded by one pass over the shards. A
language is settled once as many phrases that nothing displaces reach the limit as are asked for: what isn't expanded lies
strictly below, ties included. For other languages the limit goes down and the next phrases, best bounds first, are
expanded; each phrase is counted in one round only.

A two-word phrase is displaced by a three-word one that holds it and has at least half its count. Three-word phrases that
hold a two-word phrase above the limit are therefore always expanded, whatever their own bound.

Null texts are empty, null languages are ``und``. Ties beyond score and count go by the phrase's UTF-8 bytes. Repeated rows
count again. Texts are read whole. An empty table gives no rows. Only the named columns are read, so others can have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from textloom.llm import dictionary as D
from textloom.llm import textscan as ts

LEAST = 10
MOST = 2_000
#: The first limit is the score of the so many times MOST-th two-word phrase; each further round takes GROWTH times as many.
FIRST = 2
GROWTH = 8
#: A frontier of at most this many phrases goes to all tasks (9 bytes each); a larger one meets the phrases in a join.
FRONTIER_ROWS = 1 << 20
#: A task merges the counts of this many phrases, if its shards have so many, before it hands them on.
MERGED = 1 << 18

#: Lower case for A-Z; the ends of pieces become line feeds, white space inside them spaces.
_BYTES = np.arange(256, dtype=np.uint8)
_BYTES[65:91] += 32
_BYTES[[*b".,;:!?\x0a\x0b\x0c\x0d"]] = 10
_BYTES[9] = 32

#: Bits of a frontier phrase, now and in the round before: its extensions, its extensions to the left, itself reach the limit.
PREFIX, SUFFIX, SELF = 1, 2, 4


def piece_shards(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """Shards of one language each: n (all its words) and codes, a binary array of int with a 0 after each piece. Stored."""
    source = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text}`").cast("string").alias("text")).withColumn("task", F.spark_partition_id())
    schema = T.StructType([
        T.StructField("shard", T.LongType()), T.StructField("lang", T.StringType()), T.StructField("n", T.LongType()),
        T.StructField("words", T.ArrayType(T.BinaryType())), T.StructField("counts", T.ArrayType(T.LongType())), T.StructField("codes", T.BinaryType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = 0
        for batch in batches:
            langs = batch.column("lang").dictionary_encode()
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                for b in ts.slices(iter([batch.filter(pc.equal(langs.indices, k))]), "text", D.SHARD_BYTES):
                    texts = ts.Texts(b.column("text"))
                    texts.bytes = _BYTES[texts.bytes]
                    words, codes, starts, _ = D.coded(texts)
                    if not len(codes):
                        continue
                    piece = np.cumsum(texts.bytes == 10)[starts] + np.repeat(np.arange(texts.n), texts.word_counts(starts))
                    breaks = np.flatnonzero(np.diff(piece)) + 1
                    shard = (b.column("task")[0].as_py() << D._PARTITION_BITS) + made
                    made += 1
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([shard], pa.int64()), pa.array([lang]), pa.array([len(codes)], pa.int64()), D.one_row(words, pa.binary()), D.one_row(pa.array(np.bincount(codes)), pa.int64()), pa.array([np.insert(codes + 1, breaks, 0).astype(np.int32).tobytes()], pa.binary())],
                        names=schema.names,
                    )

    return D.stored(source.mapInArrow(run, schema))


def numbered_shards(shards: DataFrame, words: DataFrame) -> DataFrame:
    """shard, ids: the shards with global codes (binary array of int), 0 for rare words and ends of pieces. Stored."""
    mapped = D.with_ids(shards.drop("n"), words, ("lang",)).select("shard", "codes", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                codes = np.frombuffer(batch.column("codes")[i].as_buffer(), dtype=np.int32)
                ids = np.concatenate([[0], D.id_table(batch.column("ids")[i], int(codes.max(initial=0)))])[codes]
                if len(ids) and ids.max() >> 31:
                    raise ValueError("more than 2^31 frequent words")
                # runs of zeros say no more than one
                keep = np.ones(len(ids), dtype=bool)
                keep[1:] = (ids[1:] > 0) | (ids[:-1] > 0)
                yield pa.RecordBatch.from_arrays([batch.column("shard").slice(i, 1), pa.array([ids[keep].astype(np.int32).tobytes()], pa.binary())], names=["shard", "ids"])

    return D.stored(mapped.mapInArrow(run, "shard long, ids binary"))


def _merged(found: Iterator[tuple[np.ndarray, ...]]) -> Iterator[tuple[np.ndarray, ...]]:
    """Rows (columns of keys, then counts) with the counts of equal keys added, over about MERGED rows at a time."""
    held: list[tuple[np.ndarray, ...]] = []
    for rows in found:
        held.append(rows)
        if sum(len(r[0]) for r in held) > MERGED:
            held = [_added(held)]
            if len(held[0][0]) > MERGED // 2:
                yield from _cut(held.pop())
    if held:
        yield from _cut(_added(held))


def _cut(rows: tuple[np.ndarray, ...], size: int = 1 << 16) -> Iterator[tuple[np.ndarray, ...]]:
    for at in range(0, len(rows[0]), size):
        yield tuple(r[at : at + size] for r in rows)


def _added(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    *keys, counts = (np.concatenate(c) for c in zip(*held))
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    keys = [k[order] for k in keys]
    first = np.ones(len(order), dtype=bool)
    first[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys]) if len(order) > 1 else first[1:]
    at = np.flatnonzero(first)
    return (*(k[at] for k in keys), np.add.reduceat(counts[order], at) if len(at) else counts)


def _pairs(ids: np.ndarray) -> np.ndarray:
    """The two-word phrase at each place, as one number; 0 where there is none."""
    wide = ids.astype(np.int64)
    return np.where((wide[:-1] > 0) & (wide[1:] > 0), (wide[:-1] << 32) | wide[1:], 0)


def counted_pairs(shards: DataFrame) -> DataFrame:
    """pair, a: every two-word phrase of frequent words that occurs LEAST times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple[np.ndarray, ...]]:
            for b in batches:
                for cell in b.column("ids"):
                    pairs = _pairs(np.frombuffer(cell.as_buffer(), dtype=np.int32))
                    yield np.unique(pairs[pairs > 0], return_counts=True)

        for pairs, counts in _merged(found()):
            yield pa.RecordBatch.from_arrays([pa.array(pairs, pa.int64()), pa.array(counts, pa.int64())], names=["pair", "a"])

    return shards.select("ids").mapInArrow(run, "pair long, a long").groupBy("pair").agg(F.sum("a").alias("a")).where(F.col("a") >= LEAST)


def _score(a: str, left: str, right: str) -> Column:
    """floor(10^6 a a / (left right)), exactly: counts up to 10^16 fit decimals of 38 digits."""
    square = f"cast(cast({a} as decimal(16,0)) * cast({a} as decimal(16,0)) as decimal(32,0))"
    return F.expr(f"({square} * cast(1000000 as decimal(7,0))) div (cast({left} as decimal(16,0)) * cast({right} as decimal(16,0)))")


def _bound(a: str, part: str) -> Column:
    return F.expr(f"(cast({a} as decimal(16,0)) * cast(1000000 as decimal(7,0))) div cast({part} as decimal(16,0))")


def bounded_pairs(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """lang, pair, a, l, r (counts of its words), score, and the score bounds of its extensions to the right and left. Stored."""
    first = words.select("lang", F.col("id").alias("u"), F.col("f").alias("l"))
    second = words.select(F.col("id").alias("v"), F.col("f").alias("r"))
    ids = pairs.select("pair", "a", F.shiftright("pair", 32).alias("u"), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("v"))
    known = ids.join(first, "u").join(second, "v")
    return D.stored(known.select("lang", "pair", "a", "l", "r", _score("a", "l", "r").alias("score"), _bound("a", "l").alias("prefix_bound"), _bound("a", "r").alias("suffix_bound")))


def limits(pairs: DataFrame, place: int) -> DataFrame:
    """lang, limit (score and count): of the place-th best two-word phrase, or below all where a language has fewer."""
    w = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    best = pairs.select("lang", "score", "a").withColumn("place", F.row_number().over(w)).where(F.col("place") <= place)
    least = best.groupBy("lang").agg(F.min(F.struct("score", "a")).alias("least"), F.max("place").alias("n"))
    none = F.struct(F.lit(-1).cast("long").alias("score"), F.lit(-1).cast("long").alias("a"))
    return least.select("lang", F.when(F.col("n") < place, none).otherwise(F.col("least")).alias("limit"))


def frontier(pairs: DataFrame, now: DataFrame, before: DataFrame | None) -> DataFrame:
    """pair, flags (now and, three bits up, before) of the two-word phrases whose extensions this round may have to count."""

    def reach(limit: str) -> Column:
        sides = (("prefix_bound", PREFIX), ("suffix_bound", SUFFIX), ("score", SELF))
        return sum((F.when(F.struct(F.col(c).alias("score"), F.col("a").alias("a")) >= F.col(limit), F.lit(bit)).otherwise(F.lit(0)) for c, bit in sides), F.lit(0))

    both = pairs.join(F.broadcast(now.select("lang", "limit")), "lang")
    if before is None:
        return both.select("pair", reach("limit").alias("flags")).where("flags > 0")
    both = both.join(F.broadcast(before.select("lang", F.col("limit").alias("old"))), "lang").where("limit <> old")
    return both.select("pair", (reach("limit") + 8 * reach("old")).alias("flags")).where("flags > 0")


def _to_count(left, right):
    """Whether a phrase with these flags of its prefix and its suffix is due now and wasn't before; for numpy arrays of int."""

    def due(x, y):
        return ((x & PREFIX > 0) & (y & SUFFIX > 0)) | (x & SELF > 0) | (y & SELF > 0)

    return due(left, right) & ~due(left >> 3, right >> 3)


def expanded(shards: DataFrame, front: DataFrame) -> DataFrame:
    """pair (the prefix), suffix (the last two words as a pair), a: the three-word phrases due now that occur LEAST times.

    A frontier of FRONTIER_ROWS phrases at most goes to all tasks; with a larger one, phrases are counted first and meet
    their prefixes and suffixes in two joins.
    """
    sparse = front.limit(FRONTIER_ROWS + 1).count() > FRONTIER_ROWS
    table = None
    if not sparse:
        rows = front.orderBy("pair").toPandas()
        table = shards.sparkSession.sparkContext.broadcast((rows["pair"].to_numpy(np.int64), rows["flags"].to_numpy(np.int8)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flags(pairs: np.ndarray) -> np.ndarray:
            keys, values = table.value
            at = np.minimum(np.searchsorted(keys, pairs), len(keys) - 1)
            return np.where(keys[at] == pairs, values[at], 0)

        def found() -> Iterator[tuple[np.ndarray, ...]]:
            for b in batches:
                for cell in b.column("ids"):
                    pairs = _pairs(np.frombuffer(cell.as_buffer(), dtype=np.int32))
                    if table is not None:
                        own = flags(pairs)
                        use = (pairs[:-1] > 0) & (pairs[1:] > 0) & _to_count(own[:-1], own[1:])
                    else:
                        use = (pairs[:-1] > 0) & (pairs[1:] > 0)
                    yield pairs[:-1][use], pairs[1:][use], np.ones(np.count_nonzero(use), dtype=np.int64)

        for left, right, counts in _merged(found()):
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64()), pa.array(counts, pa.int64())], names=["pair", "suffix", "a"])

    if table is not None and not len(table.value[0]):
        return shards.sparkSession.createDataFrame([], "pair long, suffix long, a long")
    triples = shards.select("ids").mapInArrow(run, "pair long, suffix long, a long").groupBy("pair", "suffix").agg(F.sum("a").alias("a")).where(F.col("a") >= LEAST)
    if not sparse:
        return triples
    left, right = front.withColumnRenamed("flags", "x"), front.select(F.col("pair").alias("suffix"), F.col("flags").alias("y"))
    x, y = F.coalesce("x", F.lit(0)), F.coalesce("y", F.lit(0))

    def due(p: Column, q: Column) -> Column:
        return ((p.bitwiseAND(PREFIX) > 0) & (q.bitwiseAND(SUFFIX) > 0)) | (p.bitwiseAND(SELF) > 0) | (q.bitwiseAND(SELF) > 0)

    met = triples.join(left, "pair", "left").join(right, "suffix", "left")
    return met.where(due(x, y) & ~due(F.shiftright(x, 3), F.shiftright(y, 3))).select("pair", "suffix", "a")


def scored_triples(triples: DataFrame, pairs: DataFrame) -> DataFrame:
    """lang, pair, suffix, a, l, r, score of three-word phrases, by the cut with the lowest score, the earlier of equal ones."""
    left = pairs.select("lang", "pair", F.col("a").alias("p"), F.col("l").alias("first"))
    right = pairs.select(F.col("pair").alias("suffix"), F.col("a").alias("q"), F.col("r").alias("last"))
    both = triples.join(left, "pair").join(right, "suffix").withColumn("one", _score("a", "first", "q")).withColumn("two", _score("a", "p", "last"))
    early = F.col("one") <= F.col("two")
    return both.select(
        "lang", "pair", "suffix", "a",
        F.when(early, F.col("first")).otherwise(F.col("p")).alias("l"), F.when(early, F.col("q")).otherwise(F.col("last")).alias("r"), F.least("one", "two").alias("score"),
    )


def survivors(pairs: DataFrame, triples: DataFrame, limit: DataFrame) -> DataFrame:
    """lang, pair, suffix (null for two words), a, l, r, score of what reaches its language's limit and isn't displaced."""
    reached = F.struct("score", "a") >= F.col("limit")
    holders = triples.select(F.explode(F.array("pair", "suffix")).alias("pair"), F.col("a").alias("longer")).groupBy("pair").agg(F.max("longer").alias("longer"))
    two = pairs.join(F.broadcast(limit), "lang").where(reached).join(holders, "pair", "left").where(F.coalesce("longer", F.lit(0)) * 2 < F.col("a"))
    three = triples.join(F.broadcast(limit), "lang").where(reached)
    columns = ("lang", "pair", "suffix", "a", "l", "r", "score")
    return two.withColumn("suffix", F.lit(None).cast("long")).select(*columns).unionByName(three.select(*columns))


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", most: int = MOST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n (words of the language), score: each language's first phrases."""
    shards = piece_shards(docs, lang, text)
    sizes = shards.groupBy("lang").agg(F.sum("n").alias("n"))
    words = D.stored(D.dictionary(shards, ("lang",), LEAST))
    numbers = numbered_shards(shards, words)
    pairs = bounded_pairs(counted_pairs(numbers), words)
    quota, limit, triples, open_ = FIRST * most, None, None, 1
    while open_:
        before, limit = limit, D.stored(limits(pairs, quota) if limit is None else _lowered(limit, limits(pairs, quota), settled))
        new = D.stored(scored_triples(expanded(numbers, frontier(pairs, limit, before)), pairs))
        triples = new if triples is None else triples.unionByName(new)
        kept = D.stored(survivors(pairs, triples, limit))
        enough = kept.groupBy("lang").agg(F.count("*").alias("kept"))
        settled = D.stored(limit.join(enough, "lang", "left").select("lang", ((F.coalesce("kept", F.lit(0)) >= most) | (F.col("limit.score") < 0)).alias("settled")))
        open_ = settled.where("not settled").limit(1).count()
        quota *= GROWTH
    return _ranked(kept, words, sizes, most)


def _lowered(limit: DataFrame, new: DataFrame, settled: DataFrame) -> DataFrame:
    """Settled languages keep their limit."""
    both = limit.join(settled, "lang").join(new.select("lang", F.col("limit").alias("lower")), "lang")
    return both.select("lang", F.when(F.col("settled"), F.col("limit")).otherwise(F.col("lower")).alias("limit"))


def _ranked(kept: DataFrame, words: DataFrame, sizes: DataFrame, most: int) -> DataFrame:
    low = F.lit(0xFFFFFFFF)
    parts = kept.withColumn("u", F.shiftright("pair", 32)).withColumn("v", F.col("pair").bitwiseAND(low)).withColumn("w", F.col("suffix").bitwiseAND(low))
    for c in "uvw":
        parts = parts.join(words.select(F.col("id").alias(c), F.col("word").cast("string").alias(f"word_{c}")), c, "left")
    phrase = F.concat_ws(" ", "word_u", "word_v", "word_w")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = parts.withColumn("phrase", phrase).select("lang", "phrase", "a", "l", "r", "score").withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= most)
    return best.join(F.broadcast(sizes), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
