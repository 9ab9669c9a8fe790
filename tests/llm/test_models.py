"""The trained operators and the pictures: exact inference against enumeration, held-out accuracy, known copies, edge tables."""

import itertools
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.llm import crf, html_crf, kneser_ney, media, toxicity
from textloom.llm import textscan as ts
from textloom.llm.queries import QUERIES

DATA, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def random_chain(rng, features=3):
    return crf.Chain(rng.normal(size=(features + 1, 2)), rng.normal(size=(2, 2)), rng.normal(size=2))


def test_chain_matches_enumeration():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5):
        chain, e = random_chain(rng), rng.normal(size=(1, n, 2))
        paths = {y: chain.first[y[0]] + sum(e[0, t, y[t]] for t in range(n)) + sum(chain.moves[y[t], y[t + 1]] for t in range(n - 1)) for y in itertools.product((0, 1), repeat=n)}
        weights = {y: np.exp(v) for y, v in paths.items()}
        marginals = chain.marginals(e, np.array([n]))[0]
        for t in range(n):
            assert marginals[t, 1] == pytest.approx(sum(w for y, w in weights.items() if y[t]) / sum(weights.values()))
        assert tuple(chain.decode(e[0])) == max(paths, key=paths.get)


def test_fit_learns_runs():
    rng = np.random.default_rng(1)
    sequences = [[[1] if 5 <= t < 9 else [2] for t in range(15)] for _ in range(60)]
    features, lengths = crf.padded(sequences, 1)
    labels = np.array([[int(5 <= t < 9) for t in range(15)] for _ in range(60)])
    chain = crf.fit(features, lengths, labels, 2)
    assert (np.array([chain.decode(e) for e in chain.emissions(features)]) == labels).all() and rng is not None


def test_runs_of_plain_tokens_are_exact():
    rng = np.random.default_rng(2)
    for _ in range(100):
        chain = random_chain(rng)
        model = toxicity.Model({"a": 1, "b": 2, "c": 3}, chain, 1.0, 0.0)
        n = int(rng.integers(1, 40))
        marked = [(i, float(model.gain[int(rng.integers(1, 4))])) for i in range(n) if rng.random() < 0.3]
        e = np.zeros((1, n, 2))
        e[0, :, 1] = model.gain[0]
        for i, g in marked:
            e[0, i, 1] += g
        plain = crf.Chain(chain.weights, chain.moves - chain.moves[0, 0], chain.first - chain.first[0])
        total = np.log(np.exp(plain.forward(e)[0, -1]).sum())
        score, marginals = model.document(n, marked)
        assert score == pytest.approx(1 - np.exp(-total), abs=1e-6)
        assert np.allclose(marginals, [plain.marginals(e, np.array([n]))[0, i, 1] for i, _ in marked])


def test_toxicity_on_held_out(spark):
    got = QUERIES["op8_toxicity"](spark, LARGER)
    labels = spark.read.parquet(f"{LARGER}/labels.parquet").join(got, "doc_id").where("held_out").select("toxic", "predicted", "score").toPandas()
    hit = ((labels.toxic == 1) & (labels.predicted == 1)).sum()
    assert hit / max((labels.predicted == 1).sum(), 1) >= 0.85 and hit / (labels.toxic == 1).sum() >= 0.6
    assert labels.score.between(0, 1).all()


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "IDIOT!! " * 5), (3, "IDIOT!! " * 5), (None, "x")], "doc_id long, text string").withColumn("score", F.lit(1))
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(docs, none)
    assert toxicity.toxicity_scores(docs, model).count() == 5 and toxicity.toxicity_scores(docs.limit(0), model).count() == 0
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    more = spark.createDataFrame([(i, f"some plain words {i} and {'idiot ' if i % 2 else 'more '} end") for i in range(40)], "doc_id long, text string")
    trained = toxicity.fit(more, labels)
    rows = {r["doc_id"]: r for r in toxicity.toxicity_scores(docs, trained).collect()}
    assert rows[3]["predicted"] == 1 and rows[3]["spans"].startswith("0:5,8:13") and rows[1]["predicted"] == 0


def test_toxicity_trains_on_both_classes(spark):
    """More toxic texts than any bound on rows leaves room for: the clean ones still keep a word of both classes from being a mark."""
    n, clean = 3_800, 5_000
    texts = [(i, "plain words with filler and idiot and maybe there " * 3 + str(i), 1) for i in range(n)]
    texts += [(n + i, f"plain words with filler and {'maybe' if i % 3 == 0 else 'other'} there {n + i}", 0) for i in range(clean)]
    sample = spark.createDataFrame(texts, "sample_id long, text string, label int")
    docs, labels = sample.select(F.col("sample_id").alias("doc_id"), "text"), sample.select(F.col("sample_id").alias("doc_id"), F.col("label").alias("toxic"))
    fitted = {}
    inner, crf.fit = crf.fit, lambda *rows, **more: fitted.update(y=rows[2], n=len(rows[1])) or inner(*rows, **more)
    try:
        model = toxicity.fit(docs, labels)
    finally:
        crf.fit = inner
    assert (fitted["y"].sum(axis=1) == 0).sum() >= clean  # every clean text gives a window or more
    got = toxicity.toxicity_scores(spark.createDataFrame([(1, "plain words with filler and maybe there"), (2, "you idiot " * 3)], "doc_id long, text string"), model)
    assert {r["doc_id"]: r["predicted"] for r in got.collect()} == {1: 0, 2: 1}


def plain_kneser_ney(trusted, order=5):
    """log10 probability of a text by the textbook: counts of padded n-grams, continuation counts, three discounts, interpolation."""
    grams = {order: Counter((bytes(order) + t.encode())[i : i + order] for t in trusted for i in range(1, len(t.encode()) + 1))}
    for k in range(order - 1, 0, -1):
        grams[k] = Counter(g[1:] for g in grams[k + 1])
    cut, total, freed = {}, {}, {}
    for k, counts in grams.items():
        n = Counter(counts.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else None
        raw = (1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3] if n[3] else 1.5) if y else (0.5,) * 3
        cut[k] = [min(max(d, 0.05), i + 0.95) for i, d in enumerate(raw)] if y else raw
        total[k], freed[k] = Counter(), Counter()
        for g, c in counts.items():
            total[k][g[:-1]] += c
            freed[k][g[:-1]] += cut[k][min(c, 3) - 1]

    def chance(g):
        if not g:
            return 1 / 256
        k, below = len(g), chance(g[1:])
        if not total[k][g[:-1]]:
            return below
        c = grams[k][g]
        return (max(c - cut[k][min(c, 3) - 1], 0) if c else 0) / total[k][g[:-1]] + freed[k][g[:-1]] / total[k][g[:-1]] * below

    return chance, lambda t: sum(np.log10(chance((bytes(order) + t.encode())[i : i + order])) for i in range(1, len(t.encode()) + 1))


def test_perplexity_matches_plain_model(spark, monkeypatch):
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("abcé d"), 60)) for _ in range(30)] + ["same words here"] * 3
    others = ["", "abca", "zzzz zz", "é d" * 40, "日本 ab", "a", "a", None]
    chance, plain = plain_kneser_ney(texts)
    for context in (b"abca", b"zzzz", b"\0\0\0a", bytes(4)):
        assert sum(chance(context + bytes([b])) for b in range(256)) == pytest.approx(1)
    model = kneser_ney.fit(spark.createDataFrame([(t,) for t in texts], "text string"))
    docs = spark.createDataFrame(list(enumerate(texts + others)), "doc_id long, text string")
    for head in (kneser_ney.HEAD_GRAMS, 40, 0):  # all in the head, some, none
        monkeypatch.setattr(kneser_ney, "HEAD_GRAMS", head)
        got = {r["doc_id"]: r["log10_prob"] for r in kneser_ney.log_probabilities(docs, model).collect()}
        assert all(got[i] == pytest.approx(plain(t or ""), abs=1e-4) for i, t in enumerate(texts + others))


def test_head_finds_exactly_its_keys(monkeypatch):
    monkeypatch.setattr(kneser_ney, "HEAD_BITS", 6)  # crowded: both places are often taken
    grams = np.unique(np.random.default_rng(5).integers(0, 1 << 40, 300, dtype=np.uint64))
    head = kneser_ney.Head(grams[:150], np.arange(150.0))
    assert (head(grams[:150]) == np.arange(150)).all() and np.isnan(head(np.append(grams[150:], np.uint64(0)))).all()


def test_perplexity_separates_quality(spark):
    got = QUERIES["op9_kneser_ney"](spark, LARGER)
    labels = spark.read.parquet(f"{LARGER}/labels.parquet").join(got, "doc_id").where("held_out").select("quality", "kept").toPandas()
    assert labels[labels.quality == 1].kept.mean() >= 0.97 and labels[labels.quality == 0].kept.mean() <= 0.3
    docs = spark.createDataFrame([(1, None, None), (2, "", "en"), (2, "", "en"), (3, "é" * 50_000, "fr")], "doc_id long, text string, lang string").withColumn("perplexity", F.lit(1))
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert kneser_ney.perplexity_quality(docs, none).where("kept").count() == 4
    assert kneser_ney.perplexity_quality(docs.limit(0), none).count() == 0


def test_all_trusted_documents_train(spark, monkeypatch):
    """More of them than go to all tasks, with the same result as by broadcast; quantiles of all values."""
    docs = spark.range(100_000).selectExpr("id AS doc_id", "concat('w', id) AS text", "'en' AS lang")
    labels, seen = docs.selectExpr("doc_id", "1 AS quality"), []

    class Stop(Exception):
        pass

    def fit(trusted):
        seen.append(trusted.count())
        raise Stop

    wanted = labels.where(~kneser_ney.held_out("doc_id") & (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(kneser_ney.CALIBRATION)) != 0)).count()
    with monkeypatch.context() as m, pytest.raises(Stop):
        m.setattr(kneser_ney, "fit", fit)
        kneser_ney.perplexity_quality(docs, labels)
    assert seen == [wanted]
    few = docs.limit(200)
    once = sorted(map(tuple, kneser_ney.perplexity_quality(few, labels).collect()))
    monkeypatch.setattr(kneser_ney, "BROADCAST_IDS", 10)
    assert sorted(map(tuple, kneser_ney.perplexity_quality(few, labels).collect())) == once
    values = np.random.default_rng(8).lognormal(2, 1, 30_000).round(3)
    rows = spark.createDataFrame(list(zip(["a", "b", "b"] * 10_000, values.tolist())), "lang string, perplexity double")
    for q in (0.0, 0.5, 0.995, 1.0):
        got = {r["lang"]: r["limit"] for r in kneser_ney.exact_quantiles(rows, "lang", q).collect()}
        assert got == {k: np.sort(x)[max(int(np.ceil(q * len(x))), 1) - 1] for k, x in (("a", values[::3]), ("b", np.delete(values, np.s_[::3])))}


def test_texts_without_a_partner_are_not_shuffled(spark):
    ids = spark.range(0, 60_000, 3).select(F.col("id").alias("trusted_id"))
    rows = spark.range(60_000).select(F.when(F.col("id") % 1000 != 1, F.col("id")).alias("doc_id"), F.col("id").cast("string").alias("text"))
    passed = kneser_ney.likely_among(rows, "doc_id", ids, 20_000)
    assert passed.columns == rows.columns and passed.join(ids, F.col("doc_id") == F.col("trusted_id")).count() == 20_000 - 20
    assert passed.count() < 20_000 + 0.1 * 40_000
    as_int = kneser_ney.likely_among(rows.withColumn("doc_id", F.col("doc_id").cast("int")), "doc_id", ids, 20_000)
    assert as_int.join(ids, F.col("doc_id") == F.col("trusted_id")).count() == 20_000 - 20  # equal values of another type have another hash


PAGE = """<html><head><title>T</title><script>var x="</p><p>no";</script><style>p{}</style></head><body><div class="cookie-notice"><p>We use cookies</p></div>
<nav><ul><li><a href="/">Home</a><li><a href=/x>More</a></ul></nav><article><h1>Caf&eacute;  news</h1><p>First &amp; second
 line, with <b>bold</b> text.<p>Next<br>part here.<div class="ad">Buy now</div><p>Last part of it.</p></article>
<section class="comments"><p>Nice article, thank you for it.</p></section><footer>&copy; me</footer><p"""


def test_leaf_blocks():
    blocks = html_crf.leaf_blocks(PAGE)
    texts = [b.text for b in blocks]
    assert "Café news" in texts and "First & second line, with bold text." in texts and "Next part here." in texts and "var" not in " ".join(texts)
    assert [b.text for b, y in zip(blocks, html_crf.structural_labels(blocks)) if y] == ["Café news", "First & second line, with bold text.", "Next part here.", "Last part of it."]
    assert html_crf.leaf_blocks("") == [] and html_crf.leaf_blocks("a < b & c")[0].text == "a < b & c"


def test_main_text(spark):
    import re

    got = QUERIES["op7_html_crf"](spark, DATA).collect()
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    assert len(got) == len(pages)
    for r in got:
        body = re.sub(r"(?s)^.*?<article>|</article>.*$", "", pages[r["page_id"]])
        import html

        inner = " ".join(html.unescape(re.sub(r"<[^>]*>?", " ", body)).split())
        assert " ".join(r["text"].split()) == inner and r["n_chars"] == len(r["text"])


def test_main_text_in_other_templates(spark):
    pages = [r["html"] for r in spark.read.parquet(f"{LARGER}/pages.parquet").collect()]
    model = html_crf.fit_pages(pages[:60])
    rng, wrong, total = np.random.default_rng(9), 0, 0
    spare = [b.text for p in pages[60:90] for b in html_crf.leaf_blocks(p)]
    for p in pages[100:140]:
        blocks = html_crf.leaf_blocks(p)
        y = html_crf.structural_labels(blocks)
        made = html_crf.leaf_blocks(html_crf.restyled([b for b, k in zip(blocks, y) if k], [b for b, k in zip(blocks, y) if not k], spare, rng))
        wrong += sum(int(k) != b.marked for k, b in zip(model.labels(made), made))
        total += len(made)
    assert wrong <= 0.02 * total
    text, _, _ = html_crf.main_text(PAGE, model)
    assert text.split("\n") == ["Café news", "First & second line, with bold text.", "Next part here.", "Last part of it."]
    odd = spark.createDataFrame([(1, "u", None), (2, None, ""), (2, None, ""), (3, "u", "<p>" * 3_000)], "page_id long, url string, html string").withColumn("text", F.lit(1))
    assert [r["text"] for r in html_crf.extract_main_text(odd, model).collect()] == [""] * 4


def test_deep_pages_take_linear_time():
    import time

    def seconds(depth, unit="<div>a"):
        began = time.process_time()
        blocks = html_crf.leaf_blocks(unit * depth)
        html_crf.block_features(blocks)
        assert len(blocks) == depth
        return time.process_time() - began

    seconds(1_000)
    assert seconds(40_000) <= 12 * seconds(5_000) + 0.5
    assert seconds(20_000, "<section class=menu><blockquote></x>b") < 10


def test_all_ancestors_are_features():
    outer = "".join(f"<{t}>" for t in ("article", "blockquote", "dl", "dd", "figure", "footer", "main", "nav", "section", "ul", "li"))
    names = html_crf.block_features(html_crf.leaf_blocks(outer + "text"))[0]
    assert {"in=article", "in=footer", "in=main", "in=nav", "in=section", "in=li"} <= set(names)


def test_main_text_without_known_words(spark):
    """Templates with class words that the model has never seen, and neither article nor main."""
    pages = [r["html"] for r in spark.read.parquet(f"{LARGER}/pages.parquet").collect()]
    model = html_crf.fit_pages(pages[:100])
    lost = kept = boiler = wrong = 0
    for p in pages[100:160]:
        blocks = html_crf.leaf_blocks(p)
        y = html_crf.structural_labels(blocks)
        content = [b for b, k in zip(blocks, y) if k]
        menu = "".join(f'<li><a href="/q">{w}</a></li>' for w in ("Home", "World", "Sport", "Contact"))
        inner = "".join(f"<{b.tag if b.tag in html_crf.HEADINGS else 'p'} {html_crf.MARK}>{b.text.replace('<', '&lt;')}</p>" for b in content)
        page = f'<body><div class="zq1"><ul class="zq2">{menu}</ul></div><div class="zq3">{inner}</div><div class="zq4"><p>© 2020 Acme</p></div></body>'
        made = html_crf.leaf_blocks(page)
        for b, k in zip(made, model.labels(made)):
            kept, lost, boiler, wrong = kept + b.marked, lost + (b.marked and not k), boiler + (not b.marked), wrong + (not b.marked and k)
    assert lost <= 0.05 * kept and wrong <= 0.3 * boiler


def test_clashing_columns(spark):
    """Extra columns named like the operators' own."""
    pages = spark.createDataFrame([(1, "u", "<article><p>Some text here.</p></article>", 3)], "page_id long, url string, html string, sample_id int")
    assert html_crf.extract_main_text(pages, html_crf.fit(pages)).first()["text"] == "Some text here."
    docs = spark.createDataFrame([(i, f"plain {i} {'idiot' if i % 2 else 'kind'} words", "en", 1, 2, 3, 4) for i in range(40)] + [(None, None, None, None, None, None, None)], "doc_id long, text string, lang string, label int, sample_id int, trusted_id int, `a.b` int")
    labels = spark.createDataFrame([(i, i % 2, 1) for i in range(40)], "doc_id long, toxic int, quality int")
    assert toxicity.toxicity_scores(docs, toxicity.fit(docs, labels)).count() == 41
    assert kneser_ney.perplexity_quality(docs, labels).count() == 41


def test_spans_are_places_of_the_text_as_given():
    model = toxicity.Model({"=bad": 1}, crf.Chain(np.array([[0.0, -6.0], [0.0, 12.0]]), np.zeros((2, 2)), np.zeros(2)), 1.0, 0.0)
    scan = toxicity.Scanner(model)
    for text, span in (("İ bad", (2, 5)), ("bad", (0, 3)), ("İİ x BAD İ", (5, 8))):
        assert scan(text)[1] == [span]


def test_copies_of_pictures(spark):
    rows = QUERIES["op6_media"](spark, DATA).collect()
    root = {r["media_id"]: r["component_id"] for r in rows}
    copies = [m for m in root if m % 2]
    assert sum(root[m] == root[m - 1] for m in copies) >= 0.95 * len(copies)
    assert sum(root[m] != m for m in root) <= 1.05 * len(copies)


def test_picture_edges(spark):
    one = media.picture(np.random.default_rng(4).normal(size=64))
    cut = np.ascontiguousarray(one[10:86, 6:90])
    rows = [(1, one.tobytes(), 96, 96), (2, one.tobytes(), 96, 96), (3, cut.tobytes(), 84, 76), (4, None, 96, 96), (5, b"", 0, 0), (6, b"abc", 96, 96), (7, bytes(9216), 96, 96)]
    schema = "media_id long, image binary, width int, height int"
    got = {r["media_id"]: r["component_id"] for r in media.media_copies(spark.createDataFrame(rows, schema).withColumn("word", F.lit(1))).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 7}
    assert media.media_copies(spark.createDataFrame([], schema)).count() == 0


def plain_links(pictures):
    """Votes of every pair of pictures by plain loops over their descriptors."""
    described, found = {k: media.describe(p.astype(np.float64)) for k, p in pictures.items()}, {}
    for a, b in itertools.combinations(sorted(pictures), 2):
        (pa_, wa), (pb, wb) = described[a], described[b]
        pa_, pb = ([((k >> 36) & 0xFFFFF, (k >> 16) & 0xFFFFF, ((k >> 4) & 0xFFF) * 2 * np.pi / media.ANGLES, media.SCALE_CODES[k & 15]) for k in media.packed_points(x).tolist()] for x in (pa_, pb))
        cells = {}
        for (i, j) in {(i, j) for i in range(len(wa)) for j in range(len(wb)) if (wa[i] == wb[j]).any()}:
            turn, ratio = (pb[j][2] - pa_[i][2]) % (2 * np.pi), pa_[i][3] / pb[j][3]
            tx = pb[j][0] - ratio * (pa_[i][0] * np.cos(turn) - pa_[i][1] * np.sin(turn))
            ty = pb[j][1] - ratio * (pa_[i][0] * np.sin(turn) + pa_[i][1] * np.cos(turn))
            for grid in (0.0, 0.5):
                cells.setdefault((int(np.floor(turn * 16 / (2 * np.pi) + 0.5)) % 16, round(4 * np.log2(ratio)), grid, np.floor(tx / 8 + grid), np.floor(ty / 8 + grid)), set()).add(i)
        votes = max((len(v) for v in cells.values()), default=0)
        if votes >= media.MIN_VOTES:
            found[a, b] = votes
    return found


def test_copies_match_brute_force(spark, monkeypatch):
    """Crops of three pictures, ids far apart: all links where nothing is crowded, the same components where every word is."""
    rng, pictures = np.random.default_rng(11), {}
    for k in range(3):
        base = media.picture(rng.normal(size=64))
        for i, (y, x) in enumerate(((0, 0), (4, 8), (8, 4), (12, 12), (16, 2))):
            pictures[1_000 * (i + 1) + k] = np.ascontiguousarray(base[y : y + 80, x : x + 80])
    rows = [(k, p.tobytes(), 80, 80) for k, p in pictures.items()]
    docs = spark.createDataFrame(rows, "media_id long, image binary, width int, height int")
    plain = plain_links(pictures)
    assert {(r["a"], r["b"]): r["votes"] for r in media.copy_links(docs)[1].collect()} == plain
    root = {k: k for k in pictures}
    for _ in pictures:
        for a, b in plain:
            root[a] = root[b] = min(root[a], root[b])
    for crowd, block in ((1, 2), (3, 1_000)):
        monkeypatch.setattr(media, "CROWD", crowd)
        monkeypatch.setattr(media, "BLOCK_ROWS", block)
        assert {r["media_id"]: r["component_id"] for r in media.media_copies(docs).collect()} == root


def test_crowded_words_lose_no_link(spark, monkeypatch):
    """Twenty crops of one picture, more than once met a pivot only: every link with its votes, whatever the blocks, and all counted."""
    base, pictures = media.picture(np.random.default_rng(21).normal(size=64)), {}
    for k in range(20):
        y, x = k % 5 * 2, k // 5 * 2
        pictures[k] = np.ascontiguousarray(base[y : y + 84, x : x + 84])
    docs = spark.createDataFrame([(k, p.tobytes(), 84, 84) for k, p in pictures.items()], "media_id long, image binary, width int, height int")
    plain = plain_links(pictures)
    assert len(plain) > 150
    for block in (media.BLOCK_ROWS, 7):
        monkeypatch.setattr(media, "BLOCK_ROWS", block)
        monkeypatch.setattr(media, "CROWD", block)
        assert {(r["a"], r["b"]): r["votes"] for r in media.copy_links(docs)[1].collect()} == plain
    assert {r["media_id"]: r["n_links"] for r in media.media_copies(docs).collect()} == {k: sum(k in ab for ab in plain) for k in pictures}


def most_rows(spark, since):
    """The most rows that a join or Generate of the queries after execution since has made."""
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    store, most = spark._jsparkSession.sharedState().statusStore(), 0
    runs = store.executionsList()
    for run in (runs.apply(i).executionId() for i in range(runs.size())):
        nodes, values = store.planGraph(run).allNodes(), store.executionMetrics(run)
        for node in (nodes.apply(i) for i in range(nodes.size() if run > since else 0)):
            metrics = node.metrics()
            for m in (metrics.apply(i) for i in range(metrics.size())):
                if m.name() == "number of output rows" and ("Join" in node.name() or node.name() == "Generate") and values.contains(m.accumulatorId()):
                    most = max(most, int(values.apply(m.accumulatorId()).replace(",", "")))
    return most


def test_a_corner_meets_a_block_as_one_row(spark):
    """Crops of one picture: no join or Generate makes more rows than there are words of corners, though these have more matches."""
    base, rows = media.picture(np.random.default_rng(33).normal(size=64)), []
    for k in range(25):
        y, x = k % 5 * 2, k // 5 * 2
        rows.append((k, np.ascontiguousarray(base[y : y + 84, x : x + 84])))
    words = [media.describe(p.astype(np.float64))[1] for _, p in rows]
    matches = sum(int((w[:, None] == v[None]).sum()) for w, v in itertools.combinations(words, 2))
    docs = spark.createDataFrame([(k, p.tobytes(), 84, 84) for k, p in rows], "media_id long, image binary, width int, height int")
    runs = spark._jsparkSession.sharedState().statusStore().executionsList()
    since = max((runs.apply(i).executionId() for i in range(runs.size())), default=-1)
    assert media.copy_links(docs)[1].count() > 250
    assert 0 < most_rows(spark, since) <= sum(w.size for w in words) < matches


def test_matches_in_slices_keep_their_groups(spark, monkeypatch):
    """Slices of few matches and Arrow batches of few rows cut no group."""
    links = [(a, b, [b - 1, b], [a * 10 + b] * 2) for a in range(30) for b in range(1, 8)]
    table = pa.table({"a": [r[0] for r in links], "block": [r[1] // 4 for r in links], "ids": [r[2] for r in links], "ka": [r[3][0] for r in links]})
    for most, size in ((1, 1), (5, 3), (9, 50), (1 << 20, 1000)):
        monkeypatch.setattr(media, "SLICE_MATCHES", most)
        got = list(media._whole_groups(iter(table.to_batches(max_chunksize=size))))
        assert pa.concat_tables(got).combine_chunks().equals(table.combine_chunks())
        keys = [set(zip(t["a"].to_pylist(), t["block"].to_pylist())) for t in got]
        assert all(not (x & y) for x, y in itertools.combinations(keys, 2))
        assert all(len(k) == 1 or sum(map(len, t["ids"].to_pylist())) <= most for k, t in zip(keys, got))


def test_corners_grow_with_area():
    small, large = (media.picture(np.random.default_rng(12).normal(size=64), side) for side in (media.SIDE, 4 * media.SIDE))
    found, most = len(media.describe(large.astype(np.float64))[0]), sum(media.SCALES.values())
    assert len(media.describe(small.astype(np.float64))[0]) <= most < found <= 16 * most + len(media.SCALES)
    far = np.array([[9_000.0, 12_000.0, 0.0, 1.0]])
    at = int(media.packed_points(far)[0])
    assert (at >> 36 & 0xFFFFF, at >> 16 & 0xFFFFF) == (9_000, 12_000)
