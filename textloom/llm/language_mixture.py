"""Languages of documents as mixtures, by expectation-maximisation over n-gram likelihoods.

Training counts byte n-grams inside words (lower case, with marks for both ends), hashed into BUCKETS buckets, over all
labelled documents. A word's likelihood in a language is the product of its n-grams' shares there, to the power of 1 / ORDER
since n-grams overlap. A document's words are drawn from its languages in unknown proportions, which
expectation-maximisation estimates. Languages are taken in by proportion, as long as each raises the log-likelihood by more than a
language costs (half the logarithm of the number of words for the proportion, and the logarithm of the number of languages for the name).
The language of the largest proportion in the chosen set is the prediction, its proportion the score.

Null texts and texts without a letter are ``und`` with score 0, as are all where nothing is learned. Ties go to the smaller
language value. Repeated rows are judged one by one; texts are read whole, in pieces of bounded size. Null languages teach
nothing. Of more than LANGUAGES values the ones with the most n-grams are learned. Only the named columns are read, so others can have any names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm import textscan as ts

ORDER = 4
BUCKETS = 1 << 18
LANGUAGES = 256
#: Counts of the shares of all languages together that are added to each language's own.
SMOOTHING = 2_000.0
#: One word's worth of prior proportions, so that a single word isn't certain.
PRIOR_WORDS = 1.0
ROUNDS = 20
CLOSE = 1e-3
#: N-grams whose likelihoods are held at once, times the number of languages.
CELLS = 1 << 22

_LETTER = re.compile(r"[^\W\d_]")
_SPACES = bytes(b if chr(b).isalpha() or b > 127 else 32 for b in range(256))
_OPEN, _CLOSE = 1, 2


def learns(key: str = "doc_id") -> Column:
    """Documents whose label may be used: four folds of five by the checksum of the id."""
    return ~held_out(key)


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string")), F.lit(5)) == 0, F.lit(False))


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each n-gram of the texts, the place of each word's first n-gram, and each text's number of words.

    A word is a run of letters, as far as bytes tell; the n-gram at a byte holds up to ORDER bytes of the word that end there.
    """
    split = [t.lower().encode("utf-8", "replace").translate(_SPACES).split() for t in texts]
    n_words = np.array([len(w) for w in split], dtype=np.int64)
    data = np.frombuffer(b"".join(b"\x01" + w + b"\x02" for words in split for w in words), dtype=np.uint8)
    first = np.flatnonzero(data == _OPEN)
    place = np.arange(len(data), dtype=np.int64) - np.repeat(first, np.diff(np.append(first, len(data))))
    keys = data.astype(np.uint32)
    for back in range(1, ORDER):
        keys[back:] |= np.where(place[back:] >= back, data[:-back].astype(np.uint32) << np.uint32(8 * back), np.uint32(0))
    shift = 32 - (BUCKETS.bit_length() - 1)
    keys ^= keys >> np.uint32(15)
    return ((keys * np.uint32(0x9E3779B1)) >> np.uint32(shift)).astype(np.int32), first, n_words


@dataclass(frozen=True)
class Model:
    """languages in order of value, the logarithm of each n-gram's share (buckets by languages), and prior proportions."""

    languages: list[str]
    shares: np.ndarray
    priors: np.ndarray


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], names=["lang", "bucket", "n"])
        held.clear()

    for b in ts.slices(batches, "text"):
        langs = b.column("lang").to_pylist()
        buckets, first, n_words = grams([x or "" for x in b.column("text").to_pylist()])
        ends = np.append(first, len(buckets))[np.cumsum(n_words)]
        for lang, begin, end in zip(langs, np.concatenate([[0], ends[:-1]]), ends):
            if end > begin:
                if lang not in held and len(held) >= LANGUAGES:
                    yield from rows()
                if lang not in held:
                    held[lang] = np.zeros(BUCKETS, dtype=np.int64)
                np.add.at(held[lang], buckets[begin:end], 1) if end - begin < 4096 else held[lang].__iadd__(np.bincount(buckets[begin:end], minlength=BUCKETS))
    yield from rows()


def fit(docs: DataFrame, keep: Column, lang: str = "lang", text: str = "text") -> Model:
    """The model of the rows of docs with a language for which keep holds; counts cover them all.

    Counts are summed by task, then by language and bucket; the driver gets at most BUCKETS numbers a language, for LANGUAGES languages.
    """
    known = docs.where(keep & F.col(f"`{lang}`").isNotNull()).select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").cast("string").alias("text"))
    counts = known.mapInArrow(_counted, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).persist()
    largest = counts.groupBy("lang").agg(F.sum("n").alias("all")).orderBy(F.desc("all"), "lang").limit(LANGUAGES)
    rows = counts.join(F.broadcast(largest.select("lang")), "lang", "left_semi").toArrow()
    counts.unpersist()
    languages = sorted(set(rows.column("lang").unique().to_pylist()))
    table = np.zeros((BUCKETS, len(languages)), dtype=np.float64)
    if languages:
        number = {x: i for i, x in enumerate(languages)}
        table[rows.column("bucket").to_numpy(), np.array([number[x] for x in rows.column("lang").to_pylist()])] = rows.column("n").to_numpy()
    totals = table.sum(axis=0)
    overall = (table.sum(axis=1) + 0.5) / (totals.sum() + 0.5 * BUCKETS)
    shares = (table + SMOOTHING * overall[:, None]) / (totals + SMOOTHING)
    return Model(languages, np.log(shares).astype(np.float32), totals / max(1.0, totals.sum()))


def word_likelihoods(model: Model, buckets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per language and word, the log-likelihood; n-grams are looked up in pieces that end with a word."""
    out = np.empty((len(model.languages), len(first)), dtype=np.float32)
    step, at = max(1, CELLS // max(1, len(model.languages))), 0
    while at < len(first):
        stop = max(at + 1, int(np.searchsorted(first, first[at] + step, "right")) - 1) if first[-1] > first[at] + step else len(first)
        begin, end = first[at], first[stop] if stop < len(first) else len(buckets)
        out[:, at:stop] = np.add.reduceat(model.shares[buckets[begin:end]], first[at:stop] - begin, axis=0).T
        at = stop
    return out / ORDER


def proportions(likelihoods: np.ndarray, n_words: np.ndarray, priors: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text its languages' proportions (texts by languages) among the allowed ones, and the log-likelihood under them.

    likelihoods are by language and word; each text has a word at least. Texts that no longer change leave the rounds.
    """
    peak = likelihoods.max(axis=0)
    weights = np.exp(likelihoods - peak)
    prior = np.where(allowed, priors, 0.0) + 1e-12 * allowed
    prior /= prior.sum(axis=1, keepdims=True)
    shares, total = prior.copy(), np.zeros(len(n_words))
    active, own, counts = np.arange(len(n_words)), weights, n_words
    for _ in range(ROUNDS):
        first = np.cumsum(counts) - counts
        joint = own * np.repeat(shares[active].T.astype(np.float32), counts, axis=1)
        joint /= joint.sum(axis=0) + np.float32(1e-30)
        new = (np.add.reduceat(joint, first, axis=1).T + PRIOR_WORDS * prior[active]) / (counts + PRIOR_WORDS)[:, None]
        moved = np.abs(new - shares[active]).max(axis=1) > CLOSE
        shares[active] = new
        if not moved.any():
            break
        if not moved.all():
            own, active, counts = own[:, np.repeat(moved, counts)], active[moved], counts[moved]
    first = np.cumsum(n_words) - n_words
    mixed = np.log((weights * np.repeat(shares.T.astype(np.float32), n_words, axis=1)).sum(axis=0) + np.float32(1e-30)) + peak
    total = np.add.reduceat(mixed.astype(np.float64), first)
    return shares, total


def languages_of(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Per text the proportions of its chosen languages (texts by languages) and the number of those; 0 for texts without a word."""
    buckets, first, n_words = grams(texts)
    shares, size = np.zeros((len(texts), len(model.languages))), np.zeros(len(texts), dtype=np.int64)
    open_ = np.flatnonzero(n_words > 0)
    if not len(open_) or not model.languages:
        return shares, size
    words, counts = word_likelihoods(model, buckets, first), n_words[open_]
    full, _ = proportions(words, counts, model.priors, np.ones((len(open_), len(model.languages)), dtype=bool))
    ranking = np.argsort(-full, axis=1, kind="stable")
    best = np.full(len(open_), -np.inf)
    for k in range(1, len(model.languages) + 1):
        allowed = np.zeros((len(open_), len(model.languages)), dtype=bool)
        np.put_along_axis(allowed, ranking[:, :k], True, axis=1)
        found, total = proportions(words, counts, model.priors, allowed)
        total -= (k - 1) * (0.5 * np.log(counts) + np.log(len(model.languages)))
        better = total > best
        shares[open_[better]], size[open_[better]], best[better] = found[better], k, total[better]
        # a text goes on while its next language has a word's worth of it
        more = better & (np.take_along_axis(full, ranking[:, min(k, full.shape[1] - 1)][:, None], axis=1)[:, 0] * counts >= 1.0)
        if k == full.shape[1] or not more.any():
            break
        words = words[:, np.repeat(more, counts)]
        open_, counts, full, ranking, best = open_[more], counts[more], full[more], ranking[more], best[more]
    return shares, size


def language_mixtures(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keep, lang_pred, score and ``languages`` (array of lang and proportion, largest first): one scan, no shuffle."""
    source = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{text}`").cast("string").alias("text"))
    mixture = T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("proportion", T.DoubleType())]))
    made = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("languages", mixture)]
    schema = T.StructType([*source.schema.fields[:-1], *made])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    arrow = pa.list_(pa.struct([("lang", pa.string()), ("proportion", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in ts.slices(batches, "text", max(1, ts.SLICE_BYTES * 4 // max(4, len(model.languages)))):
            texts = [x if x and _LETTER.search(x) else "" for x in b.column("text").to_pylist()]
            shares, size = languages_of(model, texts)
            order = np.argsort(-shares, axis=1, kind="stable")
            mixtures = [[{"lang": model.languages[j], "proportion": float(shares[i, j])} for j in order[i, :n]] for i, n in enumerate(size)]
            predicted = [m[0]["lang"] if m else "und" for m in mixtures]
            scores = [min(1.0, m[0]["proportion"]) if m else 0.0 for m in mixtures]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(predicted, pa.string()), pa.array(scores, pa.float64()), pa.array(mixtures, arrow)], names=schema.names)

    found = source.mapInArrow(run, schema)
    return found.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "lang_pred", "score", "languages")
