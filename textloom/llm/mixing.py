"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a target of words; each of its documents is wanted ``target / source size`` times, at most ``most`` times. The
whole part is taken at once. The fractions are rounded in pairs: two open documents of a source exchange words, the one losing
what the other gains, until one of them is taken or dropped. The exchange is a fair game, so each document keeps its expected
number of copies, while the source's number of words never changes; only the very last open document of a source is rounded alone, to the nearer
number, and keeps no exact chance. What that rounding of the larger documents lacks is first spread over the chances of the smaller ones, as far as these stay between 0 and 1.

Open documents meet first inside salted buckets of a source, then the one left over by each bucket goes up a reduction tree, so
no task sees more than a bucket, or FAN_IN residuals, however large the source. All draws come from hashes of ids and texts, so
reruns agree.

Null sources form one source, ordered last. Null or empty texts have size 0; their copies are rounded alone as they hold no
words. A long text counts whole. Documents that share an id, or have none, are separate rows with draws of their own; repeated rows are told apart by a
number. Sources of equal size over weight are ordered by name. An empty table gives an empty result. Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.shared import saved

BUCKET_ROWS = 20_000
FAN_IN = 64
BROADCAST_SOURCES = 50_000
NULL_ID = -(1 << 63)  # stands for null ids while rows are rounded; rows that share it are told apart by their ordinal
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
STATE = "source_key string, bucket long, doc_id long, seed long, ordinal long, size long, p double, copies long, open boolean, missing double"


def word_sizes(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", *more: str) -> DataFrame:
    """doc_id, source, size, seed (hash of id and text) and the columns named in more: one row per document, texts read once."""
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    return docs.select(F.col(key).alias("doc_id"), F.col(source).cast("string").alias("source"), size.alias("size"), F.xxhash64(F.col(key), F.col(text)).alias("seed"), *more)


def targets(sizes: DataFrame, weight: Column, most: float = 3.0) -> DataFrame:
    """source, source_size, target, wanted (copies of each document).

    weight is a column over ``place`` (from 1, sources by code point, null last). Sources share all words by weight, none above most
    times its size. With sources ordered by size / weight, the capped ones come first, and each order has one share per weight
    at which what is left is spent exactly: the least consistent one is the answer. One row per source; the window
    spans the table of sources, which is the mixture's recipe and not the corpus.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = by_source.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weighted = placed.withColumn("weight", weight.cast("double")).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy((F.col("cap") / F.col("weight")).asc(), "place")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    shares = (
        weighted.withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("share", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
        .withColumn("free", F.col("share") * F.col("weight") <= F.col("cap"))
        .withColumn("level", F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("weight"), F.col("place"), F.col("share")))).over(everything)["share"])
    )
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level") * F.col("weight")))
    return shares.select("source", "source_size", target.alias("target"), F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0).alias("wanted"))


def _draws(ids: np.ndarray, salt: int) -> np.ndarray:
    """Uniform numbers in [0, 1) from ids."""
    with np.errstate(over="ignore"):
        h = (ids.astype(np.uint64) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((h ^ (h >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def pivot(ids: np.ndarray, sizes: np.ndarray, p: np.ndarray, salt: int) -> tuple[np.ndarray, int]:
    """Round p to 0 or 1 in pairs, keeping sum(p * sizes); returns the new p and the index still open, or -1."""
    p, draws, open_at = p.copy(), _draws(ids, salt), -1
    for i in range(len(p)):
        if not 0.0 < p[i] < 1.0:
            continue
        if open_at < 0:
            open_at = i
            continue
        a, b, sa, sb = p[open_at], p[i], float(sizes[open_at]), float(sizes[i])
        up = min((1 - a) * sa, b * sb)  # words that can move from i to the open one
        down = min(a * sa, (1 - b) * sb)
        if draws[i] * (up + down) < down:
            moved, a_ends, b_ends = up, (1 - a) * sa <= b * sb, (1 - a) * sa >= b * sb
            a, b = (1.0 if a_ends else a + moved / sa), (0.0 if b_ends else b - moved / sb)
        else:
            moved, a_ends, b_ends = down, a * sa <= (1 - b) * sb, a * sa >= (1 - b) * sb
            a, b = (0.0 if a_ends else a - moved / sa), (1.0 if b_ends else b + moved / sb)
        p[open_at], p[i] = a, b
        if 0.0 < b < 1.0:
            open_at = i
        elif not 0.0 < a < 1.0:
            open_at = -1
    return p, open_at


def _round_group(level: int, last: bool):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "doc_id", "seed", "ordinal"], kind="stable").reset_index(drop=True)
        with np.errstate(over="ignore"):
            ids, sizes = rows["seed"].to_numpy() + 31 * rows["ordinal"].to_numpy(), rows["size"].to_numpy()
        p, left = pivot(ids, sizes, rows["p"].to_numpy(), 1_000_003 * (level + 1))
        if last and left >= 0:
            wanted, p[left] = p[left], float(p[left] >= 0.5)
            rows.loc[left, "missing"] = (wanted - p[left]) * sizes[left]
            left = -1
        rows["open"] = np.arange(len(rows)) == left
        rows["p"] = p
        rows["copies"] += np.where(rows["open"], 0, np.rint(p)).astype(np.int64)
        return rows

    return run


def _reduced(state: DataFrame, buckets: int) -> DataFrame:
    """All rows settled: buckets first, then FAN_IN residuals at a time. missing: words that the last rounding of a source lacks."""
    settled, level = None, 0
    while True:
        last = buckets == 1
        done = saved(state.groupBy("source_key", "bucket").applyInPandas(_round_group(level, last), STATE))
        part = done.where(~F.col("open"))
        settled = part if settled is None else settled.unionByName(part)
        if last:
            return settled
        state = done.where("open").withColumn("bucket", F.floor(F.col("bucket") / FAN_IN))
        buckets, level = -(-buckets // FAN_IN), level + 1


def mix_sources(docs: DataFrame, weight: Column, most: float = 3.0, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, copies.

    weight is a column over ``place``; see targets(). Shuffles carry ids and sizes, never texts.
    """
    return _mixed(docs, weight, most, text, source, key).withColumn("doc_id", F.when(F.col("doc_id") != NULL_ID, F.col("doc_id"))).drop("ordinal", "seed")


def _numbered(sizes: DataFrame) -> DataFrame:
    """Rows with the same id, source, size and text told apart by their number among equals, whichever comes first."""
    known = sizes.withColumn("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)))
    return known.withColumn("ordinal", F.row_number().over(Window.partitionBy("doc_id", "source", "size", "seed").orderBy(F.lit(1))).cast("long"))


def _mixed(docs: DataFrame, weight: Column, most: float, text: str, source: str, key: str) -> DataFrame:
    sizes = saved(word_sizes(docs, text, source, key))
    rows = sizes.count()
    buckets = max(1, -(-rows // BUCKET_ROWS))
    plan = saved(targets(sizes, weight, most))
    means = sizes.groupBy("source").agg(F.avg("size").alias("mean_size"))
    # One row per source: broadcast while there are few, which also keeps a source with a third of all rows spread over tasks.
    few = plan.count() <= BROADCAST_SOURCES
    recipe = plan.join(means, plan["source"].eqNullSafe(means["source"])).select(plan["source"], "wanted", "mean_size")
    numbered = _numbered(sizes)
    recipe = F.broadcast(recipe) if few else recipe
    joined = numbered.join(recipe, numbered["source"].eqNullSafe(recipe["source"])).drop(recipe["source"])
    whole = F.floor("wanted")
    fraction = F.col("wanted") - whole
    alone = F.col("size") == 0
    draw = F.pmod(F.xxhash64("doc_id", "seed", "ordinal"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    state = joined.select(
        _source_key(), F.pmod(F.xxhash64("doc_id", "seed", "ordinal"), F.lit(buckets)).alias("bucket"), F.col("doc_id").cast("long"), "seed", "ordinal", "size",
        F.when(alone, F.lit(0.0)).otherwise(fraction).alias("p"),
        (whole + F.when(alone & (draw < fraction), 1).otherwise(0)).cast("long").alias("copies"),
        F.lit(True).alias("open"), F.lit(0.0).alias("missing"), (F.col("size") <= F.col("mean_size")).alias("late"),
    )
    # Small documents come last: their chances first make up for what rounding the last large one missed, which is 0 on average.
    early = _reduced(state.where(~F.col("late")).drop("late"), buckets)
    waiting = state.where("late")
    room = waiting.groupBy("source_key").agg(F.sum(F.when((F.col("p") > 0) & (F.col("p") < 1), F.col("size"))).alias("room"))
    lack = early.groupBy("source_key").agg(F.sum("missing").alias("lack"))
    shift = saved(room.join(lack, "source_key").select("source_key", F.coalesce(F.col("lack") / F.col("room"), F.lit(0.0)).alias("shift")))
    shifted = waiting.join(F.broadcast(shift) if few else shift, "source_key", "left").withColumn(
        "p", F.when((F.col("p") > 0) & (F.col("p") < 1), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("p") + F.coalesce("shift", F.lit(0.0))))).otherwise(F.col("p"))
    )
    late = _reduced(shifted.select(*[f.split()[0] for f in STATE.split(", ")]), buckets)
    settled = early.unionByName(late).select("source_key", "doc_id", "seed", "ordinal", "size", "copies")
    back = plan.select(_source_key(), "source", "source_size", "target")
    return settled.join(F.broadcast(back) if few else back, "source_key").select("doc_id", "source", "size", "source_size", "target", "copies", "seed", "ordinal")


def _source_key() -> Column:
    return F.when(F.col("source").isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), F.col("source"))).alias("source_key")


def mixed_documents(docs: DataFrame, weight: Column, most: float = 3.0, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """The rows of docs, each as often as the mix takes it; ids may be null or shared, as rows of one id, source and text are numbered."""
    copies = _mixed(docs, weight, most, text, source, key).where("copies > 0").select(
        F.col("doc_id").alias("mix_id"), F.col("source").alias("mix_source"), F.col("size").alias("mix_size"), F.col("seed").alias("mix_seed"), F.col("ordinal").alias("mix_ordinal"), F.sequence(F.lit(1), F.col("copies")).alias("mix_copies")
    )
    rows = _numbered(word_sizes(docs.select(F.struct("*").alias("mix_row"), *[F.col(f"`{c}`") for c in dict.fromkeys((text, source, key))]), text, source, key, "mix_row"))
    same = (rows["doc_id"] == copies["mix_id"]) & rows["source"].eqNullSafe(copies["mix_source"]) & (rows["size"] == copies["mix_size"]) & (rows["seed"] == copies["mix_seed"]) & (rows["ordinal"] == copies["mix_ordinal"])
    return rows.join(copies, same).withColumn("mix_copy", F.explode("mix_copies")).select("mix_row.*")


def cycle_123() -> Column:
    """Sources by place weigh 1, 2, 3, and again."""
    return F.pmod(F.col("place") - 1, F.lit(3)) + 1
