"""Quality rules as a bitmask ledger.

Each rule is evaluated once per document; the ledger keeps its measurements and one failure bit per rule. Policies are
versioned sets of bits applied afterwards without reading texts again, and ablations come from bitwise aggregation over
the few distinct bit patterns.

Null and empty texts have no words: every measurement is 0 and rule ``few_words`` fails. Repeated rows are judged one by
one. An empty table gives an empty ledger. Only the named columns are read, so other columns can have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm import textscan as ts

WINDOW = 8
SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_same_words", "n_upper", "n_lower")

_SPACES = ts.byte_table(" \t\n\x0b\x0c\r")
_UPPER = ts.byte_table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LOWER = ts.byte_table("abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class Rule:
    """fails: SQL over the measurements, in whole numbers."""

    name: str
    fails: str


#: A rule's place is its bit; append new ones at the end so that stored ledgers stay valid.
RULES = (
    Rule("few_words", "n_words < 20"),
    Rule("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule("symbols", "10 * n_symbols > 2 * n_words"),
    Rule("duplicate_lines", "100 * n_dup_lines > 30 * n_lines"),
    Rule("same_word_runs", "100 * n_same_words > 20 * n_words"),
    Rule("capitals", "n_upper > n_lower AND n_upper >= 20"),
    Rule("long_words", "word_chars > 30 * n_words"),
    Rule("short_words", "word_chars < 2 * n_words"),
)


@dataclass(frozen=True)
class Policy:
    """A document goes if it fails one of these rules."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        names = [r.name for r in RULES]
        return sum(1 << names.index(r) for r in self.rules)


BASE = Policy("base", ("few_words", "repeated_windows"))
POLICIES = {
    "base": BASE,
    "v1": Policy("v1", (*BASE.rules, "symbols", "same_word_runs", "capitals", "long_words")),
    "v2": Policy("v2", (*BASE.rules, "symbols", "duplicate_lines", "same_word_runs", "capitals", "long_words", "short_words")),
}


def measure(texts: ts.Texts, strings: list[str | None]) -> dict[str, np.ndarray]:
    """The measurements of a batch."""
    starts, ends = texts.words()
    counts = texts.word_counts(starts)
    hashes = texts.word_hashes(starts, ends)
    found, per_text = ts.windows(hashes, counts, WINDOW)
    first_window = np.cumsum(per_text) - per_text
    first_word = np.cumsum(counts) - counts
    same = np.zeros(len(hashes), dtype=np.int64)
    same[1:] = hashes[1:] == hashes[:-1]
    same[first_word[counts > 0]] = 0
    sums = np.concatenate([[0], np.cumsum(same)])
    repeats, lines, copies = (np.zeros(texts.n, dtype=np.int64) for _ in range(3))
    for i, text in enumerate(strings):
        if per_text[i] > 1:
            own = found[first_window[i] : first_window[i] + per_text[i]]
            order = np.argsort(own, kind="stable")
            equal = own[order[1:]] == own[order[:-1]]
            if equal.any():
                twice = np.zeros(len(own), dtype=bool)
                twice[order[1:][equal]] = True
                twice[order[:-1][equal]] = True
                edges = np.zeros(counts[i] + 1, dtype=np.int64)
                at = np.flatnonzero(twice)
                np.add.at(edges, at, 1)
                np.add.at(edges, at + WINDOW, -1)
                repeats[i] = np.count_nonzero(np.cumsum(edges)[:-1])
        if text:
            own_lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
            lines[i] = len(own_lines)
            copies[i] = len(own_lines) - len(set(own_lines))
    return {
        "n_words": counts,
        "word_chars": texts.code_points() - texts.count(_SPACES),
        "n_symbols": texts.count(ts.byte_table(SYMBOLS)),
        "n_lines": lines,
        "n_dup_lines": copies,
        "n_repeat_words": repeats,
        "n_same_words": sums[first_word + counts] - sums[first_word],
        "n_upper": texts.count(_UPPER),
        "n_lower": texts.count(_LOWER),
    }


def bits(rules: tuple[Rule, ...] = RULES) -> Column:
    """One failure bit per rule over the measurement columns."""
    parts = [F.when(F.expr(r.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, r in enumerate(rules)]
    out = parts[0]
    for p in parts[1:]:
        out = out.bitwiseOR(p)
    return out


def rule_ledger(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per document: the keep columns, all measurements (long) and ``failed_bits`` (long). One scan, no shuffle."""
    source = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{text}`").cast("string").alias("text"))
    schema = T.StructType([*source.schema.fields[:-1], *(T.StructField(m, T.LongType()) for m in MEASURES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in ts.slices(batches, "text"):
            column = b.column("text")
            m = measure(ts.Texts(column), column.to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(m[k], pa.int64()) for k in MEASURES)], names=[*b.schema.names[:-1], *MEASURES])

    measured = source.mapInArrow(run, schema)
    return measured.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *MEASURES, bits().alias("failed_bits"))


def passes(policy: Policy, column: str = "failed_bits") -> Column:
    return F.col(column).bitwiseAND(F.lit(policy.mask)) == 0


def ablation(ledger: DataFrame, policy: Policy) -> DataFrame:
    """Per rule of a policy: documents that fail it, that fail it alone, and that would be kept without it.

    The ledger shrinks to one row per bit pattern before anything is exploded; there are at most 2^rules patterns.
    """
    patterns = ledger.groupBy(F.col("failed_bits").bitwiseAND(F.lit(policy.mask)).alias("pattern")).agg(F.count("*").alias("n"))
    names = [r.name for r in RULES]
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << names.index(r)).cast("long").alias("bit")) for r in policy.rules])
    exploded = patterns.select("pattern", "n", F.explode(rules).alias("r")).select("pattern", "n", "r.rule", "r.bit")
    fails = F.col("pattern").bitwiseAND(F.col("bit")) != 0
    without = F.col("pattern").bitwiseAND(F.lit(policy.mask).cast("long") - F.col("bit"))
    return exploded.groupBy("rule").agg(
        F.sum(F.when(fails, F.col("n")).otherwise(0)).alias("failed"),
        F.sum(F.when(F.col("pattern") == F.col("bit"), F.col("n")).otherwise(0)).alias("failed_alone"),
        F.sum(F.when(without == 0, F.col("n")).otherwise(0)).alias("kept_without"),
    )


def filter_documents(docs: DataFrame, policy: Policy = POLICIES["v1"], text: str = "text") -> DataFrame:
    """The rows of docs that pass the policy, unchanged; repeated rows are judged one by one.

    The verdict is computed beside each row's own text, so no join on an id is needed.
    """
    names = docs.columns
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{text}`").alias("text"))
    ledger = rule_ledger(row, keep=("row",))
    return ledger.where(passes(policy)).select(*[F.col("row").getField(c).alias(c) for c in names])
