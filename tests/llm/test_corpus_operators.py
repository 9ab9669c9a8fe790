"""Collocations, filter interactions and language mixtures: against SQL, plain Python and held-out labels."""

from __future__ import annotations

import random
import re
import tracemalloc
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.oracle import DATA, same
from textloom.llm import collocations, dictionary, filter_audit, language_mixture
from textloom.llm.queries import ORACLES, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.mark.parametrize("name", ["op11_collocations", "op12_filter_audit"])
def test_sql(spark, name):
    same(spark, QUERIES[name], ORACLES[name], DATA)


def plain_collocations(rows, most):
    """Every phrase counted and scored by itself."""
    counts, words = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")):
            own = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(own)
            for k in (1, 2, 3):
                for i in range(len(own) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(own[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        found = []
        for g, a in f.items():
            if len(g) > 1 and a >= 10:
                cuts = [(10**6 * a * a // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g))]
                score, k = min(cuts)
                longer = max((b for h, b in f.items() if len(h) == 3 and b >= 10 and g in (h[:2], h[1:])), default=0) if len(g) == 2 else 0
                if 100 * longer < 50 * a:
                    found.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, words[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:most])]
    return sorted(out)


@pytest.fixture(scope="module")
def phrases():
    draw = random.Random(5)
    words = [*"abcdefgh", "Über", "x\x01y", "ß", "a\x01"]
    fixed = ["new york city", "of the", "the one of", "a a a", "x\x01y ß", "a\x01 b", "a b"]
    rows = []
    for i in range(300):
        parts = [draw.choice(fixed) if draw.random() < 0.4 else draw.choice(words) for _ in range(draw.randint(0, 60))]
        rows.append((i, "".join(p + draw.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"]) for p in parts).replace("of", draw.choice(["of", "OF"])), draw.choice(["en", "de", None, "en"]), "s"))
    rows += [(None, None, "en", None), (7, "", "fr", ""), (8, " \t\n.,", "es", "s"), (9, "a b " * 3_000, "de", "s"), (9, "one of the " * 40, None, "s"), (9, "one of the " * 40, None, "s")]
    return rows


@pytest.mark.parametrize(("most", "frontier"), [(2_000, 1 << 20), (3, 1 << 20), (3, 0), (12, 2)])
def test_collocations(spark, phrases, most, frontier, monkeypatch):
    """Also where a language settles early, and where the frontier is too large to go to all tasks."""
    monkeypatch.setattr(collocations, "FRONTIER_ROWS", frontier)
    monkeypatch.setattr(collocations, "FIRST", 1)
    monkeypatch.setattr(collocations, "GROWTH", 2)
    docs = spark.createDataFrame(phrases, SCHEMA).withColumn("a.b", F.lit(1)).withColumn("pair", F.lit("x"))
    got = sorted(tuple(r) for r in collocations.collocations(docs, most=most).collect())
    assert got == plain_collocations([(r[1], r[2]) for r in phrases], most)


def test_collocations_displaced_below_the_limit(spark):
    """The one best pair falls to a longer phrase with a low bound of its own, so the limit has to go down."""
    text = "q r s. " * 20 + "s s s s s. " * 400 + "u v. " * 15 + "u w. " * 6
    docs = spark.createDataFrame([(1, text, "en", None)], SCHEMA)
    assert [tuple(r) for r in collocations.collocations(docs, most=2).collect()] == plain_collocations([(text, "en")], 2)


def test_scores_are_exact(spark):
    rows = spark.createDataFrame([(10**15 - 1, 10**15, 10**15 + 7), (3, 3, 3), (10, 10**12, 10**12)], "a long, l long, r long")
    assert [r[0] for r in rows.select(collocations._score("a", "l", "r")).collect()] == [10**6 * a * a // (x * y) for a, x, y in ((10**15 - 1, 10**15, 10**15 + 7), (3, 3, 3), (10, 10**12, 10**12))]


def plain_audit(docs, labels):
    """Every order applied to every document in turn."""
    first, marks = {}, {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    for i, q, t in labels:
        if i is not None:
            good, toxic = marks.get(i, (0, 0))
            marks[i] = (max(good, int(q == 1)), max(toxic, int(t == 1)))
    parts = {}
    for i, t, source in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and t in first and first[t] < i,
        }
        parts.setdefault(source or "", []).append(({x for x in fails if fails[x]}, *marks.get(i, (0, 0))))
    rows = []
    for part, own in parts.items():
        shapley = Counter()
        made = []
        for order in map("".join, permutations("ABCDE")):
            for s, x in enumerate(order):
                before = set(order[:s])
                removed = [d for d in own if x in d[0] and not d[0] & before]
                shapley[x] += len(removed)
                made.append((order, s + 1, x, sum(not d[0] & (before | {x}) for d in own), len(removed), sum(x in d[0] and bool(d[0] & before) for d in own), sum(d[0] == {x} for d in own), sum(d[1] for d in removed), sum(d[2] for d in removed)))
        rows += [(part, o, s, *rest, shapley[x]) for o, s, x, *rest in made]
    return sorted(rows)


def test_filter_audit(spark, monkeypatch):
    from textloom.llm import dictionary

    draw = random.Random(3)
    texts = [" ".join(draw.choice(["alpha", "beta", "Gamma", "delta", "é", "x"] + [f"w{k}" for k in range(300)]) for _ in range(draw.choice([3, 150, 199, 200, 260, 500]))) for _ in range(40)]
    texts += [t + " $5" for t in texts[:5]] + [t.upper() for t in texts[:5]] + ["same same same\x0bword " * 70, "", None, " \n\t ", "ABC"]
    docs = [(i if i % 17 else None, draw.choice(texts), draw.choice(["s1", "s2", "", None])) for i in range(400)]
    docs += [(5, texts[0], "s1"), (5, texts[0], "s1"), (2**60, texts[0], "s2"), (399, "long " * 200_000, "s3")]
    labels = [(i, draw.choice([0, 1, None]), draw.choice([0, 1, None])) for i in range(0, 400, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    table = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("a.b", F.lit(1)).withColumn("bits", F.lit(2)).repartition(5)
    got = filter_audit.filter_audit(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert sorted(tuple(r) for r in got.collect()) == plain_audit(docs, labels)
    words, matrix = filter_audit.document_term_matrix(table)
    counts = Counter(w for _, t, _ in docs for w in re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert {r["word"].decode(): r["f"] for r in words.collect()} == counts
    assert sorted(r["id"] for r in words.collect()) == list(range(1, len(counts) + 1))
    by_id = {r["id"] - 1: r["word"].decode() for r in words.collect()}
    sums = Counter()
    for shard in matrix.collect():
        columns, values = np.frombuffer(shard["columns"], np.int64), np.frombuffer(shard["values"], np.int32)
        for c, v in zip(columns, values):
            sums[by_id[c]] += int(v)
    assert sums == counts


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert collocations.collocations(docs).count() == 0
    assert filter_audit.filter_audit(docs, labels).count() == 0
    model = language_mixture.fit(docs, language_mixture.learns())
    assert language_mixture.language_mixtures(docs, model).count() == 0
    unknown = spark.createDataFrame([(1, "some words", None, None)], SCHEMA)
    assert [tuple(r) for r in language_mixture.language_mixtures(unknown, model).collect()] == [(1, "und", 0.0, [])]


@pytest.fixture(scope="module")
def languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return docs, language_mixture.fit(docs, language_mixture.learns())


def test_held_out_languages(spark, languages):
    docs, model = languages
    found = language_mixture.language_mixtures(docs.where(language_mixture.held_out()), model, ("doc_id", "lang"))
    right, n = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 150 and right >= 0.98


def test_training_counts(spark, languages):
    """The model's shares against counts by plain slices of words."""
    _, model = languages
    rows = [(1, "Ab cé", "x"), (2, "ab", "x"), (3, None, "x"), (4, "1, 2", "y"), (5, "zz", None), (6, "abb", "y")]
    small = language_mixture.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert small.languages == ["x", "y"] and abs(small.priors.sum() - 1) < 1e-9

    def slices(text):
        return [w[max(0, i - 3) : i + 1] for word in re.findall(rb"[a-z\x80-\xff]+", text.lower().encode()) for w in [b"\x01" + word + b"\x02"] for i in range(len(w))]

    buckets, first, n_words = language_mixture.grams(["Ab cé", "ab"])
    assert n_words.tolist() == [2, 1] and first.tolist() == [0, 4, 9] and len(buckets) == len(slices("Ab cé") + slices("ab"))
    assert len(set(buckets.tolist())) == len(set(slices("Ab cé") + slices("ab")))


def test_mixtures(spark, languages):
    """Documents put together from two languages in known parts, whole ones, and texts without a language."""
    docs, model = languages
    texts = {lang: [r[0] for r in docs.where((F.col("lang") == lang) & (F.length("text") > 2_000)).orderBy("doc_id").select("text").limit(4).collect()] for lang in ("en", "de")}
    clean = {k: [" ".join(re.findall(r"[^\W\d_]{3,}", x)[:300]) for x in v] for k, v in texts.items()}
    rows = [(i, f"{' '.join(a.split()[:225])} {' '.join(b.split()[:75])}") for i, (a, b) in enumerate(zip(clean["de"], clean["en"]))]
    rows += [(10, None), (11, ""), (12, "123 -- 4"), (13, "中文"), (14, clean["en"][0] * 400)]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("a.b", F.lit(1)).withColumn("languages", F.lit("x"))
    got = {r["doc_id"]: r for r in language_mixture.language_mixtures(table, model).collect()}
    for i in range(4):
        assert got[i]["lang_pred"] == "de" and 0.6 < got[i]["score"] < 0.9
        assert [x["lang"] for x in got[i]["languages"]] == ["de", "en"]
    assert all((got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0) for i in (10, 11, 12))
    assert got[13]["lang_pred"] in model.languages and got[14]["lang_pred"] == "en" and got[14]["score"] > 0.95


def test_expectation_maximisation():
    """Against plain loops, one text at a time."""
    draw = np.random.default_rng(1)
    counts, priors = np.array([1, 5, 40]), np.array([0.2, 0.5, 0.3])
    logs = draw.normal(0, 2, (3, counts.sum())).astype(np.float32)
    allowed = np.array([[True] * 3, [True, False, True], [True] * 3])
    got, total = language_mixture.proportions(logs, counts, priors, allowed)
    at = 0
    for i, n in enumerate(counts):
        own, at = np.exp(logs[:, at : at + n].astype(float)), at + n
        prior = priors * allowed[i] / (priors * allowed[i]).sum()
        shares = prior.copy()
        for _ in range(language_mixture.ROUNDS):
            joint = own * shares[:, None]
            new = ((joint / joint.sum(axis=0)).sum(axis=1) + prior) / (n + 1)
            moved, shares = abs(new - shares).max(), new
            if moved <= language_mixture.CLOSE:
                break
        assert np.allclose(got[i], shares, atol=1e-4) and np.isclose(total[i], np.log((own * shares[:, None]).sum(axis=0)).sum(), rtol=1e-4)


def test_words_of_a_shard_take_little_memory():
    """The dictionary of a shard codes words as they come, and holds no Python object a word."""
    words, seen, n = dictionary.Words(), {}, 100_000
    batches = [[b"word-%d" % (i * k) for i in range(n)] for k in (2, 3)]
    arrays = [pa.array(b, pa.binary()) for b in batches]
    tracemalloc.start()
    before = pa.total_allocated_bytes()
    got = [words.add(a, np.arange(n, dtype=np.int32)) for a in arrays]
    held = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - before
    tracemalloc.stop()
    assert [g.tolist() for g in got] == [[seen.setdefault(w, len(seen)) for w in b] for b in batches]
    assert words.words.to_pylist() == list(seen)
    assert words.counts.sum() == 2 * n and words.counts[seen[b"word-6"]] == 2
    assert held < 40 * len(seen)
