"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The n-grams are of UTF-8 bytes, ORDER long, so all languages and unseen words are covered. Everything is keyed by the packed n-gram and
sharded by it: counts, continuation counts, context totals, discounted shares and back-off weights are tables, and groupings and joins build
each order from the one above.

Scoring joins counts too. The chance of a byte depends on its n-gram alone, so the distinct n-grams of all documents, with their counts,
meet the share and back-off tables order by order, which gives one exact log probability each. A document's log probability is the
sum over its n-grams: the most frequent of the corpus, at most HEAD_GRAMS, are broadcast with their keys, and every other n-gram of a
document meets its probability in a join. No n-gram is taken for another and none is left out.

A document's perplexity per byte, drawn towards its language's mean by PRIOR_BYTES so that short texts aren't judged by chance, is held
against MARGIN times a quantile of the trusted documents of its language; one trusted document in CALIBRATION is kept from training
for that, as a model flatters the texts that it has seen. Languages with fewer than LEAST_TRUSTED documents, and null, use all.

Training and calibration use all trusted documents; their ids go to all tasks up to BROADCAST_IDS of them, beyond that a shuffle joins them
with the documents that a bitmap of their hashes lets through.
Quantiles are exact. Null and empty texts score 0 with the perplexity of their
language's mean. Long texts are scored whole, and equal texts score alike. Rows with equal or null ids and repeated rows are scored one by
one. An empty table gives an empty result; without trusted text everything is kept. Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm import textscan as ts
from textloom.llm.shared import saved

ORDER = 5
HEAD_GRAMS = 1 << 19
HEAD_BITS = 20  # log2 of the places of the head's table
BROADCAST_IDS = 65_536
FILTER_BITS = 1 << 28  # of the bitmap that goes to all tasks, at most: 32 MB
BITMAP_BITS = 1 << 15  # of one row of Spark's bitmap functions
LEAST_TRUSTED = 20
PRIOR_BYTES = 200
QUANTILE = 0.995
MARGIN = 1.05
CALIBRATION = 5
BINS = 4_096  # of a tenfold perplexity
SLICE = 1 << 20


def packed(texts: ts.Texts, n: int) -> np.ndarray:
    """For every byte of a batch, it and the n - 1 before it in its text as one number, the last byte lowest; 0 before the start."""
    lengths = np.diff(texts.offsets)
    place = np.arange(len(texts.bytes)) - np.repeat(texts.offsets[:-1], lengths)
    out = texts.bytes.astype(np.uint64)
    for k in range(1, n):
        shifted = np.zeros_like(out)
        shifted[k:] = texts.bytes[: len(out) - k] if len(out) > k else 0
        shifted[place < k] = 0
        out |= shifted << np.uint64(8 * k)
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        grams, inverse = np.unique(np.concatenate([g for g, _ in held]), return_inverse=True)
        return grams, np.bincount(inverse, weights=np.concatenate([c for _, c in held])).astype(np.int64)

    for b in ts.slices(batches, "text", SLICE):
        held.append(np.unique(packed(ts.Texts(b.column("text")), ORDER), return_counts=True))
        if len(held) >= 16:
            held[:] = [merged()]
            if len(held[0][0]) > 1 << 21:
                yield pa.RecordBatch.from_arrays([pa.array(held[0][0].view(np.int64)), pa.array(held[0][1])], names=["gram", "c"])
                held.clear()
    if held:
        grams, counts = merged()
        yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(counts)], names=["gram", "c"])


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """The three discounts of modified Kneser-Ney from how many n-grams occur once to four times."""
    n = {r["c"]: r["count"] for r in counts.where("c <= 4").groupBy("c").count().collect()}  # 4 rows
    n1, n2, n3, n4 = (float(n.get(i, 0)) for i in (1, 2, 3, 4))
    if not n1 or not n2:
        return (0.5, 0.5, 0.5)
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(min(max(d, 0.05), k + 0.95) for k, d in enumerate(raw))


def shares(counts: DataFrame, d: tuple[float, float, float]) -> tuple[DataFrame, DataFrame]:
    """(gram, value: discounted share of its context) and (gram of the context, value: back-off weight)."""
    context = F.shiftrightunsigned("gram", 8)
    cut = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
    table = counts.withColumn("context", context).withColumn("cut", cut)
    totals = table.groupBy("context").agg(F.sum("c").alias("total"), F.sum("cut").alias("freed"))
    share = table.join(totals, "context").select("gram", ((F.col("c") - F.col("cut")) / F.col("total")).alias("value"))
    return saved(share), saved(totals.select(F.col("context").alias("gram"), (F.col("freed") / F.col("total")).alias("value")))


def _lower(grams: DataFrame, order: int) -> DataFrame:
    """The last bytes of each n-gram, order long."""
    return grams.select(F.col("gram").bitwiseAND(F.lit((1 << (8 * order)) - 1)).alias("gram"))


def fit(trusted: DataFrame, text: str = "text") -> list[tuple[DataFrame, DataFrame]]:
    """(shares, back-off weights) for the orders from 1, as tables of gram and value; the weights of order k are keyed by its contexts."""
    source = trusted.select(F.col(text).cast("string").alias("text"))
    counts = saved(source.mapInArrow(_count, "gram long, c long").groupBy("gram").agg(F.sum("c").alias("c")))
    model: list[tuple[DataFrame, DataFrame]] = []
    for order in range(ORDER, 0, -1):
        model.append(shares(counts, discounts(counts)))
        if order > 1:
            # One order down, an n-gram counts as often as different bytes stand before it.
            counts = saved(_lower(counts, order - 1).groupBy("gram").agg(F.count("*").alias("c")))
    return model[::-1]


def gram_probabilities(grams: DataFrame, model: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """gram, p of distinct n-grams of ORDER bytes: each order joins its share, its context's back-off weight and the chance one order down."""
    p = None
    for order, (share, weight) in enumerate(model, 1):
        rows = grams.select("gram") if order == ORDER else _lower(grams, order).distinct()
        keyed = rows.withColumn("context", F.shiftrightunsigned("gram", 8)).withColumn("rest", F.col("gram").bitwiseAND(F.lit((1 << (8 * (order - 1))) - 1)))
        joined = keyed.join(share.withColumnRenamed("value", "share"), "gram", "left").join(weight.select(F.col("gram").alias("context"), F.col("value").alias("back")), "context", "left")
        below = F.lit(1 / 256)
        if p is not None:
            joined, below = joined.join(p.select(F.col("gram").alias("rest"), F.col("p").alias("below")), "rest"), F.col("below")
        p = saved(joined.select("gram", (F.coalesce("share", F.lit(0.0)) + F.coalesce("back", F.lit(1.0)) * below).alias("p")))
    return p


class Head:
    """Values of n-grams by exact key. Each has two places in a table; the few that find both taken, the rarer ones, are in a sorted list."""

    def __init__(self, grams: np.ndarray, values: np.ndarray):
        self.keys = np.zeros(1 << HEAD_BITS, dtype=np.uint64)
        self.values = np.full(1 << HEAD_BITS, np.nan, dtype=np.float32)
        left = np.arange(len(grams))
        for which in (0, 1):
            at = self._places(grams[left], which)
            free = np.isnan(self.values[at])
            at, first = np.unique(at[free], return_index=True)
            chosen = left[free][first]
            self.keys[at], self.values[at] = grams[chosen], values[chosen]
            left = np.setdiff1d(left, chosen, assume_unique=True)
        left = left[np.argsort(grams[left])]
        self.more, self.more_values = grams[left], values[left].astype(np.float32)

    @staticmethod
    def _places(grams: np.ndarray, which: int) -> np.ndarray:
        h = ts.mix(grams)
        return (h >> np.uint64(64 - HEAD_BITS) if which == 0 else h & np.uint64((1 << HEAD_BITS) - 1)).astype(np.int64)

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        """The value of each n-gram, NaN for those that aren't in the head."""
        at = self._places(grams, 0)
        out = np.where(self.keys[at] == grams, self.values[at], np.float32(np.nan))
        open_ = np.flatnonzero(np.isnan(out))
        at = self._places(grams[open_], 1)
        out[open_] = np.where(self.keys[at] == grams[open_], self.values[at], np.float32(np.nan))
        if len(self.more):
            open_ = open_[np.isnan(out[open_])]
            at = np.minimum(np.searchsorted(self.more, grams[open_]), len(self.more) - 1)
            out[open_] = np.where(self.more[at] == grams[open_], self.more_values[at], np.float32(np.nan))
        return out


def frequent(table: DataFrame, count: str, most: int) -> DataFrame:
    """The rows with the highest counts, at most so many: whole levels of a histogram on a logarithmic scale."""
    level = F.floor(8 * F.log2(F.col(count).cast("double")))
    room, least = most, None
    for at, size in sorted(((r["level"], r["count"]) for r in table.groupBy(level.alias("level")).count().collect()), reverse=True):  # 8 * 64 rows at most
        if size > room:
            break
        room, least = room - size, at
    return table.where(level >= least) if least is not None else table.limit(0)


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = shared.value
        for b in ts.slices(batches, "text", SLICE):
            texts = ts.Texts(b.column("text"))
            grams = packed(texts, ORDER)
            values = head(grams)
            rest = np.flatnonzero(np.isnan(values))
            values[rest] = 0
            sums = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
            # What the head lacks, once for each text, with how often it occurs there.
            owner = np.searchsorted(texts.offsets, rest, "right") - 1
            order = np.lexsort((grams[rest], owner))
            owner, grams = owner[order], grams[rest][order]
            new = np.ones(len(owner), dtype=bool)
            new[1:] = (owner[1:] != owner[:-1]) | (grams[1:] != grams[:-1])
            first = np.flatnonzero(new)
            times = np.diff(np.append(first, len(owner)))
            offsets = pa.array(np.searchsorted(owner[first], np.arange(texts.n + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (grams[first].view(np.int64), times.astype(np.int64))]
            names = [*b.schema.names[:-1], "n_bytes", "log10_prob", "rest", "times"]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(np.diff(texts.offsets)), pa.array(sums[texts.offsets[1:]] - sums[texts.offsets[:-1]]), *lists], names=names)

    return run


def log_probabilities(docs: DataFrame, model: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """The columns of docs but the last, text; n_bytes, log10_prob: sums over the n-grams of each text, by joins with their counts."""
    counts = saved(docs.select("text").mapInArrow(_count, "gram long, c long").groupBy("gram").agg(F.least(F.sum("c"), F.lit(2**31 - 1)).alias("c")))
    values = saved(counts.join(gram_probabilities(counts, model), "gram").select("gram", "c", F.log10(F.greatest("p", F.lit(1e-12))).alias("value")))
    rows = frequent(values, "c", HEAD_GRAMS).select("gram", F.col("c").cast("int").alias("c"), F.col("value").cast("float").alias("value")).toArrow()  # HEAD_GRAMS rows at most
    gram, c, value = (rows.column(i).to_numpy() for i in range(3))
    order = np.lexsort((gram, -c))
    head = docs.sparkSession.sparkContext.broadcast(Head(gram[order].view(np.uint64), value[order]))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema.fields[:-1])
    scored = docs.mapInArrow(_score(head), f"{kinds}, n_bytes long, log10_prob double, rest array<long>, times array<long>")
    scored = saved(scored.withColumn("row", F.monotonically_increasing_id()))
    rest = scored.where(F.size("rest") > 0).select("row", F.explode(F.arrays_zip("rest", "times")).alias("x")).select("row", F.col("x.rest").alias("gram"), F.col("x.times").alias("times"))
    more = rest.join(values.select("gram", "value"), "gram").groupBy("row").agg(F.sum(F.col("times") * F.col("value")).alias("more"))
    return scored.join(more, "row", "left").select(*docs.columns[:-1], "n_bytes", (F.col("log10_prob") + F.coalesce("more", F.lit(0.0))).alias("log10_prob"))


def held_out(key: str, fold: int = 4, part: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % fold == part, F.lit(False))


def exact_quantiles(rows: DataFrame, by: str, quantile: float) -> DataFrame:
    """by, limit: the perplexity of rank ceil(quantile * n) of each group. Counts of bins tell which bin holds it; only that bin is ranked."""
    binned = rows.select(by, "perplexity", F.floor(BINS * F.log10("perplexity")).alias("bin"))
    bins = binned.groupBy(by, "bin").agg(F.count("*").alias("n"))
    upto, total = F.sum("n").over(Window.partitionBy(by).orderBy("bin")), F.sum("n").over(Window.partitionBy(by))
    placed = bins.select(by, "bin", (F.greatest(F.ceil(total * quantile), F.lit(1)) - upto + F.col("n")).alias("place"), "n").where("place BETWEEN 1 AND n")
    values = binned.join(F.broadcast(placed.drop("n")), [by, "bin"]).groupBy(by, "place", "perplexity").agg(F.count("*").alias("n"))  # a row a group
    reached = values.withColumn("upto", F.sum("n").over(Window.partitionBy(by).orderBy("perplexity"))).where("upto >= place")
    return reached.groupBy(by).agg(F.min("perplexity").alias("limit"))


def likely_among(rows: DataFrame, key: str, ids: DataFrame, n: int) -> DataFrame:
    """All rows whose key is among the n ids (one column), and up to one in 16 of the others while FILTER_BITS suffice: an exact join may follow.

    A bitmap of hashes, of 16 bits an id, goes to all tasks, so that a shuffle needn't move the texts of rows that have no partner. Keys of
    another type than the ids, or of one in which equal values can have different hashes, all pass.
    """
    kinds = {rows.schema[key].dataType.simpleString(), ids.schema[0].dataType.simpleString()}
    if len(kinds) > 1 or kinds - {"tinyint", "smallint", "int", "bigint", "string", "date", "timestamp"}:
        return rows
    pieces = max(1, min(16 * n, FILTER_BITS) // BITMAP_BITS)

    def place(c: str) -> tuple[Column, Column]:
        h = F.xxhash64(F.col(c))
        return F.pmod(F.shiftrightunsigned(h, 15), F.lit(pieces)), h.bitwiseAND(F.lit(BITMAP_BITS - 1))

    (own, bit), (piece, at) = place(ids.columns[0]), place(key)
    maps = ids.groupBy(own.alias("piece_")).agg(F.bitmap_construct_agg(bit).alias("bits_"))
    byte = F.conv(F.hex(F.substring("bits_", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = rows.join(F.broadcast(maps), piece == F.col("piece_"))  # rows without a key go, as in an inner join
    return found.where(F.col(f"`{key}`").isNotNull() & (F.getbit(byte, (at % 8).cast("int")) == 1)).drop("piece_", "bits_")


def perplexity_quality(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", lang: str = "lang", label: str = "quality", quantile: float = QUANTILE) -> DataFrame:
    """Per document: doc_id, lang, held_out, n_bytes, log10_prob, perplexity, threshold, kept.

    Trusted are labelled rows of value 1 outside the held-out fold.
    """
    ids = saved(labels.where((F.col(label) == 1) & ~held_out(key)).select(F.col(key).alias("trusted_id")).distinct())
    n = ids.count()
    trusted_ids = F.broadcast(ids) if n <= BROADCAST_IDS else ids
    apart = F.pmod(F.xxhash64("trusted_id", F.lit(1)), F.lit(CALIBRATION)) == 0
    source = docs.select(F.col(key).alias("doc_id"), F.col(lang).alias("lang"), held_out(key).alias("held_out"), F.col(text).cast("string").alias("text"))
    candidates = source.select("doc_id", "text") if n <= BROADCAST_IDS else likely_among(source.select("doc_id", "text"), "doc_id", ids.where(~apart), n)
    trusted = candidates.join(trusted_ids.where(~apart), F.col("doc_id") == F.col("trusted_id")).select("text")
    scored = saved(log_probabilities(source, fit(trusted)))
    known = scored.join(trusted_ids.where(apart), F.col("doc_id") == F.col("trusted_id"), "left_semi").where("n_bytes > 0")
    mean = (F.sum("log10_prob") / F.sum("n_bytes")).alias("mean")
    overall = known.agg(F.coalesce(mean, F.lit(0.0)).alias("all_mean"))
    means = known.groupBy("lang").agg(mean, F.count("*").alias("n")).where(F.col("n") >= LEAST_TRUSTED).select(F.col("lang").alias("m_lang"), "mean")

    def with_perplexity(rows: DataFrame) -> DataFrame:
        joined = rows.join(F.broadcast(overall)).join(means, F.col("lang") == F.col("m_lang"), "left")
        drawn = (F.col("log10_prob") + PRIOR_BYTES * F.coalesce("mean", "all_mean")) / (F.col("n_bytes") + PRIOR_BYTES)
        return joined.withColumn("perplexity", F.pow(F.lit(10.0), -drawn)).withColumn("own", F.col("mean").isNotNull())

    reached = saved(with_perplexity(known).select("lang", "own", "perplexity"))
    any_limit = exact_quantiles(reached.withColumn("any", F.lit(0)), "any", quantile).agg(F.min("limit").alias("any_limit"))  # one row, null without text
    limits = exact_quantiles(reached.where("own"), "lang", quantile).select(F.col("lang").alias("l_lang"), "limit")
    judged = with_perplexity(scored).join(F.broadcast(any_limit)).join(limits, F.col("lang") == F.col("l_lang"), "left")
    threshold = MARGIN * F.coalesce("limit", "any_limit")
    return judged.select(
        "doc_id", "lang", "held_out", "n_bytes", "log10_prob", "perplexity", threshold.alias("threshold"), F.coalesce(F.col("perplexity") <= threshold, F.lit(True)).alias("kept")
    )
