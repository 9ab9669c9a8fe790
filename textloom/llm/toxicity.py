"""Toxic spans by a linear-chain conditional random field, trained from document labels.

1. Labelled tokens: over a bounded sample of labelled documents, Spark counts in how many toxic and clean texts each word and word
   beginning occurs. Tokens of toxic documents that carry a clearly toxic feature are labelled toxic, all others clean.
2. A chain with two labels is fitted on windows of those tokens, of every text of the sample; its features are the counted ones.
3. Scoring runs over whole texts. Tokens without a feature share one emission, so a run of them is a power of one 2 by 2 matrix and
   forward-backward stays exact while it visits only tokens with features. The chance that any token is toxic, calibrated on the
   sample, is the score; tokens with a marginal of MARK or more are the offending spans.

Only words decide: labels, language, source and id are no inputs of a score. Null and empty texts have no tokens and get the score of
a text without toxic tokens. Long texts are scored whole, and equal texts score alike. Rows with equal or null ids and repeated rows are scored one by one;
of labels that share an id one is used. An empty table gives an empty result. Without labels of both classes, the score is the base rate. Spans are
places of the text as given. Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm import crf
from textloom.llm import textscan as ts
from textloom.llm.shared import hash_sample

SAMPLE = {1: 4_000, 0: 8_000}  # labelled documents of each class that the chain is fitted on, at most; all windows of these are used
MAX_FEATURES = 4_096
WINDOW = 24
TEXT_WINDOWS = 4  # around three toxic tokens at most, and a plain one: so the windows are bounded by class with SAMPLE
PREFIXES = (4, 5, 6)
K = 1 + len(PREFIXES)
MARK = 0.5
MEMO_ENTRIES = 300_000
CUT = 0.3

_WORD = re.compile(r"[^\W_]+")


def token_features(word: str) -> list[str]:
    """The word itself and its beginnings."""
    return [f"={word}", *(word[:n] for n in PREFIXES if len(word) > n)]


@dataclass
class Model:
    features: dict[str, int]
    chain: crf.Chain
    slope: float
    offset: float

    def __post_init__(self):
        self._steps: dict[int, np.ndarray] = {}
        self.gain = self.chain.weights[:, 1] - self.chain.weights[:, 0]
        self._bias = np.exp(np.array([0.0, self.gain[0]]))
        self._first = np.exp(self.chain.first - self.chain.first[0])
        self._moves = np.exp(self.chain.moves - self.chain.moves[0, 0])  # the all-clean path weighs 1

    def word_gain(self, word: str) -> float | None:
        """Log odds that the word's features add; None without any."""
        found = [self.features[f] for f in token_features(word) if f in self.features]
        return float(self.gain[found].sum()) if found else None

    def run(self, n: int) -> tuple[np.ndarray, float]:
        """The product over n plain tokens as a scaled matrix and its log scale."""
        if n not in self._steps:
            if len(self._steps) > 100_000:
                self._steps.clear()
            out, scale, base, base_scale, k = np.eye(2), 0.0, self._moves * self._bias, 0.0, n
            while k:
                if k & 1:
                    out, scale = out @ base, scale + base_scale
                    top = out.max()
                    out, scale = out / top, scale + np.log(top)
                base, base_scale = base @ base, 2 * base_scale
                top = base.max()
                base, base_scale = base / top, base_scale + np.log(top)
                k >>= 1
            self._steps[n] = (out, scale)
        return self._steps[n]

    def document(self, n: int, marked: list[tuple[int, float]]) -> tuple[float, list[float]]:
        """Calibrated score of n tokens, of which those in marked (place, gain) have features; and the marginals of these."""
        if not n:
            return self.calibrated(-30.0), []
        vector, scale, at = None, 0.0, 0
        before: list[np.ndarray] = []
        for place, gain in marked:
            if vector is None and place:
                vector = self._first * self._bias
                at = 1
            if vector is not None:
                power, more = self.run(place - at)
                vector = vector @ power
                scale += more
                vector = vector @ self._moves
            else:
                vector = self._first.copy()
            vector = vector * np.array([1.0, np.exp(min(self.gain[0] + gain, 50.0))])
            top = vector.max()
            vector, scale, at = vector / top, scale + np.log(top), place + 1
            before.append(vector)
        if vector is None:
            vector, at = self._first * self._bias, 1
        power, more = self.run(n - at)
        total = np.log((vector @ power).sum()) + scale + more
        behind = power.sum(axis=1)
        marginals: list[float] = []
        for i in range(len(marked) - 1, -1, -1):
            both = before[i] * behind
            marginals.append(float(both[1] / both.sum()))
            if i:
                place, gain = marked[i]
                here = np.array([1.0, np.exp(min(self.gain[0] + gain, 50.0))])
                step = self.run(place - marked[i - 1][0] - 1)[0] @ self._moves
                behind = step @ (here * behind)
                behind = behind / behind.max()
        clean = min(-total, -1e-12)  # log chance of no toxic token
        odds = np.log(-np.expm1(clean)) - clean
        return self.calibrated(float(np.clip(odds, -30, 30))), marginals[::-1]

    def calibrated(self, odds: float) -> float:
        return float(1 / (1 + np.exp(-(self.slope * odds + self.offset))))


def held_out(key: str, fold: int = 4, part: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % fold == part, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, text: str, key: str, label: str, keep: Column) -> DataFrame:
    """text, label of at most SAMPLE documents per class, chosen by hash; exact copies count once."""
    known = labels.where(keep).where(F.col(label).isin(0, 1)).select(F.col(key).alias("sample_id"), F.col(label).cast("int").alias("label")).dropDuplicates(["sample_id"])
    parts = [hash_sample(known.where(F.col("label") == c), "sample_id", n) for c, n in SAMPLE.items()]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))  # sum(SAMPLE.values()) rows at most
    texts = docs.select(F.col(key).alias("text_id"), F.col(text).cast("string").alias("text")).where("text IS NOT NULL")
    return texts.join(chosen, F.col("text_id") == F.col("sample_id")).select("text", "label", "sample_id").dropDuplicates(["text", "label"])


def _feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    toxic, clean = Counter(), Counter()
    for b in batches:
        for text, label in zip(b.column("text").to_pylist(), b.column("label").to_pylist()):
            own = {f for w in set(_WORD.findall(text.lower())) for f in token_features(w)}
            (toxic if label else clean).update(own)
    # Only what a toxic text of this task carries, or what occurs in its clean texts, is counted; nothing is cut.
    keys = list(toxic.keys() | clean.keys())
    if keys:
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([toxic[k] for k in keys], pa.int64()), pa.array([clean[k] for k in keys], pa.int64())], names=["feature", "toxic", "clean"])


def toxic_features(sample: DataFrame, totals: tuple[int, int]) -> list[str]:
    """The features whose lower bound of log odds between toxic and clean texts is clear, at most MAX_FEATURES."""
    counts = sample.mapInArrow(_feature_counts, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b")).where("a >= 3")
    odds = F.log((F.col("a") + 0.5) / F.lit(totals[0] + 1.0)) - F.log((F.col("b") + 0.5) / F.lit(totals[1] + 1.0))
    bound = odds - 1.96 * F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    chosen = counts.withColumn("bound", bound).where("bound > 0.8").orderBy(F.desc("bound"), "feature").limit(MAX_FEATURES)
    return sorted(r["feature"] for r in chosen.collect())


def _windows(text: str, label: int, draw: int, index: dict[str, int]) -> tuple[list, list]:
    """Feature windows and labels of one text: around toxic tokens, and a plain one where draw says."""
    words = _WORD.findall(text.lower())
    found = [[index[f] for f in token_features(w) if f in index] for w in words]
    hits, most = [i for i, f in enumerate(found) if f], TEXT_WINDOWS - 1
    starts = {max(0, i - WINDOW // 2) for i in hits[:: max(1, len(hits) // most)][:most]} | ({draw % max(1, len(words) - WINDOW)} if words else set())
    sequences = [found[s : s + WINDOW] for s in sorted(starts)]
    return sequences, [[int(bool(label and f)) for f in own] for own in sequences]


def _cut_windows(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for b in ts.slices(batches, "text"):
            rows = [
                (draw, label, crf.padded([own], K)[0].astype("<i4").tobytes(), bytes(gold))
                for text, label, draw in zip(b.column("text").to_pylist(), b.column("label").to_pylist(), b.column("draw").to_pylist())
                for own, gold in zip(*_windows(text, label, draw, index))
            ]
            types = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["draw", "label", "features", "gold"])

    return run


def training_windows(sample: DataFrame, index: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features, lengths, token labels and text labels of all windows of the sample, which are cut beside its texts."""
    drawn = sample.select("label", F.xxhash64("text", "label").alias("draw"), "text")
    cut = drawn.mapInArrow(_cut_windows(sample.sparkSession.sparkContext.broadcast(index)), "draw long, label int, features binary, gold binary")
    rows = sorted(tuple(r) for r in cut.collect())  # TEXT_WINDOWS * sum(SAMPLE.values()) rows at most
    features, y = np.zeros((len(rows), WINDOW, K), dtype=np.int32), np.zeros((len(rows), WINDOW), dtype=np.int64)
    for i, (_, _, own, gold) in enumerate(rows):
        features[i, : len(gold)] = np.frombuffer(bytes(own), dtype="<i4").reshape(-1, K)[: len(gold)]
        y[i, : len(gold)] = np.frombuffer(bytes(gold), dtype=np.uint8)
    return features, np.array([len(r[3]) for r in rows], dtype=np.int64), y, np.array([r[1] for r in rows], dtype=np.int64)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", keep: Column | None = None) -> Model:
    """A model from the labelled rows for which keep holds; the sample's bound is SAMPLE."""
    sample = labelled_sample(docs, labels, text, key, label, F.lit(True) if keep is None else keep).persist()
    try:
        sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
        totals = (sizes.get(1, 0), sizes.get(0, 0))
        empty = crf.Chain(np.zeros((1, 2)), np.array([[0.0, -20.0], [-20.0, -20.0]]), np.array([0.0, -20.0]))
        rate = np.log((totals[0] + 0.5) / (totals[1] + 0.5))
        if not all(totals):
            return Model({}, empty, 0.0, float(rate))
        names = toxic_features(sample, totals)
        if not names:
            return Model({}, empty, 0.0, float(rate))
        index = {f: i + 1 for i, f in enumerate(names)}
        features, lengths, y, _ = training_windows(sample, index)
        used = lengths > 0
        chain = crf.fit(features[used], lengths[used], y[used], len(names))
        model = Model(index, chain, 1.0, 0.0)
        points = sample.select("label", "text").mapInArrow(_odds(docs.sparkSession.sparkContext.broadcast(model)), "label int, odds double").collect()  # sum(SAMPLE.values()) rows at most
        model.slope, model.offset = platt(np.array([p["odds"] for p in points]), np.array([p["label"] for p in points]))
        return model
    finally:
        sample.unpersist()


def platt(odds: np.ndarray, labels: np.ndarray, steps: int = 40) -> tuple[float, float]:
    """Logistic calibration by Newton steps with a small ridge."""
    x = np.stack([odds / 10, np.ones(len(odds))], axis=1)
    w = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - labels) + 0.05 * w
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(2)
        w -= np.clip(np.linalg.solve(h, g), -2, 2)
    return float(max(w[0], 0.0) / 10), float(w[1])


class Scanner:
    """Scores texts of one task, with a bounded memo of words."""

    def __init__(self, model: Model):
        self.model = model
        self._memo: dict[str, float | None] = {}

    def __call__(self, text: str | None) -> tuple[float, list[tuple[int, int]], int]:
        lower = (text or "").lower()
        words = _WORD.findall(lower)
        memo = self._memo
        hot: dict[str, float] = {}
        for w in set(words):
            if w in memo:
                gain = memo[w]
            else:
                if len(memo) >= MEMO_ENTRIES:
                    memo.clear()
                gain = memo[w] = self.model.word_gain(w)
            if gain is not None:
                hot[w] = gain
        if not hot:
            return self.model.document(len(words), [])[0], [], len(words)
        same = len(lower) == len(text)  # else lower-casing moved places
        marked, places = [], []
        for i, m in enumerate(_WORD.finditer(text if same else lower)):
            gain = hot.get(m.group().lower())
            if gain is not None:
                marked.append((i, gain))
                places.append(m.span())
        if not same:
            ends = np.cumsum([len(c.lower()) for c in text])  # where each character of the text ends in its lower-cased form
            places = [(int(np.searchsorted(ends, s, "right")), int(np.searchsorted(ends, e - 1, "right")) + 1) for s, e in places]
        score, marginals = self.model.document(len(words), marked)
        return score, [s for s, p in zip(places, marginals) if p >= MARK], len(words)


def _odds(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        scan = Scanner(Model(model.features, model.chain, 1.0, 0.0))
        for b in ts.slices(batches, "text"):
            p = np.clip([scan(t)[0] for t in b.column("text").to_pylist()], 1e-13, 1 - 1e-13)
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.array(np.log(p / (1 - p)))], names=["label", "odds"])

    return run


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scanner(shared.value)
        for b in ts.slices(batches, "text"):
            found = [scan(t) for t in b.column("text").to_pylist()]
            spans = [",".join(f"{s}:{e}" for s, e in f[1]) for f in found]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([f[0] for f in found]), pa.array(spans), pa.array([f[2] for f in found], pa.int64())], names=[*b.schema.names[:-1], "score", "spans", "n_tokens"])

    return run


def toxicity_scores(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document: doc_id, held_out, score, predicted, spans (start:end in code points, comma-joined), n_tokens. One scan, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.col(key).alias("doc_id"), held_out(key).alias("held_out"), F.col(text).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    found = source.mapInArrow(_scan(shared), f"doc_id {kind}, held_out boolean, score double, spans string, n_tokens long")
    return found.select("doc_id", "held_out", "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "spans", "n_tokens")
