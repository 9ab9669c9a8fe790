"""Rules, personal data, n-gram join, packing and mixing against brute force, on edge tables."""

import random
import re
import time
import types
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from textloom.llm import maxent_lm, mixing, ngram_join, packing, pii, quality_rules
from textloom.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
EDGES = [
    (1, None, "en", "a", 0, 1), (2, "", "en", "a", 0, 1), (3, " \n\t ", None, None, 3, 1), (4, "one two three four", "en", "b", 5, 1), (5, "ONE two three four", "en", "b", 5, 1),
    (6, "x " * 40_000, "en", "b", 5, 1), (7, "mail a.b@c.de, 10.0.0.1, +1 (555) 010-9999 and 4111 1111 1111 1111", "fr", "b", 5, 1), (8, "é ß x " * 30, "fr", "c", 5, 1),
    (9, "repeat me now please again\n" * 12, "fr", "c", 5, 1), (9, "repeat me now please again\n" * 12, "fr", "c", 5, 1), (None, "no id here at all", "fr", "c", 5, 1), (11, "🙂 <|endoftext|> \x1c odd", "de", "a", 5, 1),
]


def frame(spark, rows=EDGES):
    """Extra columns have names that operators use for their own."""
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words int, row int")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def brute_rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    spots = defaultdict(list)
    for i in range(len(words) - 7):
        spots[tuple(words[i : i + 8])].append(i)
    covered = {p + k for own in spots.values() if len(own) > 1 for p in own for k in range(8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_rules_match_brute_force(spark, documents):
    docs = frame(spark).select("doc_id", "text", "n_words").unionByName(documents.select("doc_id", "text", F.lit(1).alias("n_words")))
    got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in quality_rules.rule_ledger(docs).collect())
    assert got == Counter((r["doc_id"], *brute_rules(r["text"])) for r in docs.collect())


def test_ablation_counts(spark, documents):
    ledger = quality_rules.rule_ledger(documents).cache()
    policy = quality_rules.POLICIES["v1"]
    bits = [r["failed_bits"] & policy.mask for r in ledger.select("failed_bits").collect()]
    names = [r.name for r in quality_rules.RULES]
    for r in quality_rules.ablation(ledger, policy).collect():
        bit = 1 << names.index(r["rule"])
        assert r["failed"] == sum(b & bit != 0 for b in bits) and r["failed_alone"] == sum(b == bit for b in bits) and r["kept_without"] == sum(b & ~bit == 0 for b in bits)


def test_filter_keeps_columns_and_clean_rows(spark, documents):
    kept = quality_rules.filter_documents(frame(spark).unionByName(documents.withColumns({"n_words": F.lit(1), "row": F.lit(2)}).drop("n_chars")))
    assert kept.columns == frame(spark).columns
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    good = labels.where("quality = 1").join(documents, "doc_id").where(F.regexp_count("text", F.lit(r"\S+")) >= 20)
    assert good.join(kept.select("doc_id"), "doc_id", "left_anti").count() <= 0.02 * good.count()


def brute_pii(t):
    t = t or ""
    card = lambda d: 13 <= len(d) <= 19 and pii.luhn(d)
    return {
        "email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)],
        "ip": [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))],
        "card": [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if card(re.sub("[^0-9]", "", m.group()))],
        "phone": [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15],
    }


def test_pii_base_spans_match_patterns():
    rng, automaton = random.Random(5), pii.anchors()
    for _ in range(5_000):
        letters = rng.choice(["0123456789 -", "0123456789.+ ()-", "ab.@-_%+0", "01. +@a-", " 4-1+.(@a"])
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(60)))
        found = pii.spans_of(text, automaton)
        assert {k: found[k] for k in pii.BASE_KINDS} == brute_pii(text), text


def test_pii_query_and_redaction(spark):
    docs = frame(spark)
    import hashlib

    for r in pii.pii_digest(docs.where("doc_id IS NOT NULL")).join(docs.select("doc_id", "text").dropDuplicates(["doc_id"]), "doc_id").collect():
        base = ",".join(f"{k}:{a}:{b}" for k, own in brute_pii(r["text"]).items() for a, b in own)
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
    clean = {r["doc_id"]: r["text"] for r in pii.redact_documents(docs, length="n_words").collect()}
    assert clean[7] == "mail [EMAIL], [IP], [PHONE] and [CARD]" and clean[1] is None and clean[4] == EDGES[3][1]
    assert pii.redact_documents(docs).columns == docs.columns
    spans = pii.spans_of('password=15959ad9338a8dac1d see @some_one and http://u:p@h.io/x token = "0641917ea4"', pii.anchors())
    assert len(spans["account"]) == 2 and len(spans["handle"]) == 1 and len(spans["url"]) == 1


def test_long_names_and_values_are_redacted_whole(spark):
    automaton, name, value = pii.anchors(), "n" * 40, "a1b2c3d4" * 50
    texts = {1: f"ask @{name} now", 2: f"secret: {value} end", 3: f'Mot de passe = "{value}"', 4: "Passwort: a1b2c3d4", 5: "contraseña: a1b2c3d4", 6: "NÚMERO DE CUENTA: 12345678", 7: "the token was never given"}
    wanted = {1: "ask [HANDLE] now", 2: "secret: [ACCOUNT] end", 3: 'Mot de passe = "[ACCOUNT]"', 4: "Passwort: [ACCOUNT]", 5: "contraseña: [ACCOUNT]", 6: "NÚMERO DE CUENTA: [ACCOUNT]", 7: texts[7]}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in pii.redact_documents(docs).collect()} == wanted
    for cue in pii.CUES:
        for form in (cue, cue.upper(), cue.title(), cue.capitalize()):
            assert pii.spans_of(f"x {form}: zz9zzz", automaton)["account"] == [(len(form) + 4, len(form) + 10)], form


def test_account_values_equal_plain_search_and_take_linear_time():
    rng, automaton = random.Random(12), pii.anchors()
    cue = re.compile("(?<![^\\W_])(?:token|secret)(?![^\\W_])")
    for _ in range(5_000):
        text = "".join(rng.choice(["token", "secret", "=", " ", ": ", "ab", "7", "12345", "/", "!"]) for _ in range(rng.randrange(14)))
        wanted, free = [], 0
        for m in cue.finditer(text):
            gap = re.compile("[ \\t]*[:=#]?[ \\t]*[\"']?").match(text, m.end())
            value = re.compile("[A-Za-z0-9_./+=-]+").match(text, gap.end())
            if m.start() >= free and 0 < gap.end() - m.end() <= pii.MAX_GAP and value and len(value[0]) >= 6 and re.search("[0-9]", value[0]):
                wanted.append(value.span())
                free = value.end()
        assert pii.spans_of(text, automaton)["account"] == wanted, text
    began = time.perf_counter()
    assert not pii.spans_of("token=" * 200_000, automaton)["account"]
    assert len(pii.spans_of("token=" * 200_000 + "x12345", automaton)["account"]) == 1
    assert time.perf_counter() - began < 10


def brute_components(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, text in rows:
        w = (text or "").translate(low).encode().split()
        sets.append(frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[k : k + 5]) for k in range(len(w) - 4)]))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)):
                k = len(a & b)
                if 100 * k >= 80 * (len(a) + len(b) - k):
                    root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return Counter((doc, len(sets[i]), least.get(find(i)) if sets[i] else doc) for i, (doc, _) in enumerate(rows))


def near_copies(seed, n):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(400)}" for _ in range(60)]
    out = []
    for i in range(n):
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(60)] = f"z{rng.randrange(9_999)}"
        out.append((1_000 * seed + i, " ".join(words)))
    return out


def test_join_matches_brute_force(spark, documents, monkeypatch):
    rows = [(r[0], r[1]) for r in EDGES] + near_copies(1, 60) + near_copies(2, 25) + [(5_000 + i, f"a shared passage of words that many texts hold {i} own {i * 7} end {i * 3}") for i in range(40)]
    rows += [(10_000 + r["doc_id"], r["text"]) for r in documents.collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("set_id", F.lit("x")).withColumn("n", F.lit(1))
    expected = brute_components(rows)
    for settings in ({}, {"BLOCK_SETS": 16, "SMALL_FAMILY": 4, "PIVOTS": 2, "CELL_SETS": 8}, {"SMALL_FAMILY": 10, "BROADCAST_ROWS": 0, "FRAGMENTS": 7}):
        with monkeypatch.context() as set_to:
            for name, value in settings.items():
                set_to.setattr(ngram_join, name, value)
            got = Counter(tuple(r) for r in ngram_join.similarity_components(docs).select("doc_id", "n_shingles", "component_id").collect())
        assert got == expected, settings
    kept = ngram_join.without_near_copies(docs.withColumn("a.b", F.lit(1)).withColumn("near_row", F.lit(2)))
    assert kept.columns == [*docs.columns, "a.b", "near_row"]
    assert {r["doc_id"] for r in kept.collect()} >= {k[2] for k in expected}


def random_texts(path, texts, words):
    rng = np.random.default_rng(8)
    rows = [" ".join(map(str, rng.integers(0, 1 << 30, words).tolist())) for _ in range(texts)]
    rows.append(rows[0] + " end")
    pq.write_table(pa.table({"doc_id": range(len(rows)), "text": rows}), path, row_group_size=50)
    return str(path)


def test_join_moves_shared_grams_only(spark, monkeypatch, tmp_path):
    """Of 5,000,000 n-grams, more than the sketch has slots, only those move that two prefixes hold."""
    docs = spark.read.parquet(random_texts(tmp_path / "docs.parquet", 250, 20_000))
    links, moved = ngram_join.family_links, []
    monkeypatch.setattr(ngram_join, "family_links", lambda rows, percent: moved.append(rows.count()) or links(rows, percent))
    found = {r["doc_id"]: r["component_id"] for r in ngram_join.similarity_components(docs).collect()}
    assert found == {i: i % 250 for i in range(251)}
    assert 7_900 < moved[0] < 12_000  # the prefixes of the two copies


def test_sightings_of_prefixes():
    """The bits of the n-grams that two sets have in common, also where one task's texts fill several rows of a shard; copies of a text count once."""
    texts = [" ".join(f"{t}x{k}" for k in range(400)) for t in (1, 2, 1, 3)] + [" ".join(f"2x{k}" for k in range(390)) + " y"]
    order = types.SimpleNamespace(value=(np.full(1 << ngram_join.SLOT_BITS, 9, np.uint32), None))
    batches = [pa.RecordBatch.from_arrays([pa.array([x])], names=["text"]) for x in texts]
    rows = pa.Table.from_batches(ngram_join._sightings(5, 80, order, 4)(iter(batches)))
    bits, field = 16, np.zeros((16, 1 << 9), np.uint8)
    for shard in set(rows["shard"].to_pylist()):
        made = ngram_join._shared_places(bits - 4)(rows.filter(pc.equal(rows["shard"], shard)))
        field[shard] = ngram_join._unpacked(made["field"][0].as_py(), np.uint8, 1 << 9)
    prefixes = [ngram_join._prefix(s, 80, order.value[0]) for s in ngram_join.gram_sets(pa.array(texts))[0]]
    shared = np.intersect1d(prefixes[1], prefixes[4])
    assert len(shared) > 40
    places = np.unique((ngram_join.ts.mix(shared) >> np.uint64(64 - bits)).astype(np.int64))
    assert (np.flatnonzero(np.unpackbits(field)) == places).all()


def test_overlap_kernels():
    import numpy as np

    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 40))).astype(np.uint64) for _ in range(30)]
    plain = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    assert (ngram_join.dense_overlaps(sets[:12], sets) == plain[:12]).all()
    families = np.arange(30) % 4
    found = {(i, j): k for i, j, k in zip(*(x.tolist() for x in ngram_join.sparse_overlaps(families, sets)))}
    assert found == {(i, j): plain[i, j] for i in range(30) for j in range(i + 1, 30) if families[i] == families[j] and plain[i, j]}


def test_join_groups_over_batches():
    """Every pair of a gram whose sizes allow a match is joined by pairs or a chain, however rows fall into batches."""
    rng = random.Random(3)
    for turn in range(60):
        rows = sorted({(g, 10 + i % 7 if turn % 2 else 100, i) for g in range(rng.randrange(1, 9)) for i in (rng.randrange(60) for _ in range(rng.choice([1, 2, 5, 17, 40])))})
        step = rng.choice([1, 3, 50])
        batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in ([r[0] for r in rows[a : a + step]], [r[2] for r in rows[a : a + step]], [r[1] for r in rows[a : a + step]])], names=["gram", "set_id", "n"]) for a in range(0, len(rows), step)]
        pairs = [t for b in ngram_join._meetings(80)(iter(batches)) for t in zip(*[c.to_pylist() for c in b.columns])]
        for g in {r[0] for r in rows}:
            own = [(n, i) for h, n, i in rows if h == g]
            root = {i: i for _, i in own}

            def find(x):
                while root[x] != x:
                    x = root[x]
                return x

            for a, b, *_ in pairs:
                if a in root and b in root:
                    root[find(a)] = find(b)
            assert all(find(x[1]) == find(y[1]) for x in own for y in own if x < y and 100 * x[0] >= 80 * y[0])


def check_packing(spark, docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    rows = packing.pack_documents(docs, path).collect()
    expected = Counter()
    for r in docs.collect():
        ids = whole.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        for start in range(0, len(ids), 2048):
            part = ids[start : start + 2048]
            expected[(r["doc_id"], start // 2048, start, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part)))] += 1
    assert Counter(tuple(r)[:5] for r in rows) == expected
    places = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in places.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(n for _, n in own) <= 2048
    return len(places), sum(n for own in places.values() for _, n in own)


def test_packing_round_trip(spark, documents, monkeypatch):
    sequences, tokens = check_packing(spark, documents)
    assert sequences <= 1.02 * -(-tokens // 2048)
    check_packing(spark, frame(spark))
    monkeypatch.setattr(packing, "GROUP_ITEMS", 25)  # a tree of many small groups
    monkeypatch.setattr(packing, "FAN_IN", 3)
    sequences, tokens = check_packing(spark, documents)
    assert sequences <= 1.05 * -(-tokens // 2048)


def test_packing_of_null_ids(spark):
    check_packing(spark, frame(spark))
    check_packing(spark, frame(spark, [*EDGES, (None, "no id here at all", "fr", "c", 5, 1), (None, None, None, None, None, None), (0, "zero", "en", "a", 1, 1)]))


def test_plain_words_match_the_whole_tokenizer():
    from tokenizers import Tokenizer

    from textloom.llm import tokens

    path, rng = public_tokenizers.path("word_bpe_49k.json"), random.Random(8)
    quick, whole = tokens.PieceTokenizer(path, memo_entries=50), Tokenizer.from_file(path)
    kinds = ["abcXYZ 's'tI'LL", "0123²¼½ab ", "éßÀÖÿ ñ", "İıſÅΩ é x", "¡¿—“”…€'s\"'t!?,.#", "\t\n\x0b\x0c\r\x85\xa0  a", "\x1c\x1f a🙂日本 ", "<|endoftext|> a", "ǅǈẞȺȾ aªº", "\x00\x7f\xad b", "e\u0301 a\u0308"]
    for _ in range(4_000):
        text = "".join(rng.choice(rng.choice(kinds)) for _ in range(rng.randrange(1, 24)))
        assert quick.packed_ids(text) == b"".join(i.to_bytes(4, "little") for i in whole.encode(text, add_special_tokens=False).ids), repr(text)


def tiny_model(seed=0):
    """A model with random weights over a small vocabulary, and the counts behind it."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(seed)
    counts = Counter({f"w{i}x{'abc'[i % 3]}": 1 + 400 // (i + 1) for i in range(300)})
    t = maxent_lm.Tokens(pa.array([" ".join(counts)]))
    classes = np.append(rng.integers(0, maxent_lm.CLASSES - 1, maxent_lm.GROUPS - 1), maxent_lm.CLASSES - 1)
    rows = pd.DataFrame({"word": t.hashes[:-1].view("int64"), "ending": t.groups[:-1], "n": list(counts.values())})
    by_ending = [{"ending": e, "n": int(g["n"].sum()), "types": len(g)} for e, g in rows.groupby("ending")]
    bias, out_bias, rest, words, outputs = maxent_lm.biases(classes, by_ending, rows[rows["n"] > 2])
    weights = rng.normal(size=(2, 1 << 13, maxent_lm.CLASSES)).astype("float32")
    return maxent_lm.Model(weights, bias, out_bias, classes, words, outputs, rest), counts


def test_lm_chances_sum_to_one():
    import numpy as np

    model, counts = tiny_model()
    for history in ("", "w1xb w2xc", "never seen w0xa"):
        t = maxent_lm.Tokens(pa.array([f"{history} {w}" for w in counts] + [history]))
        lp, out = model.log_probs(t)
        last = np.append(np.flatnonzero(t.place == len(history.split()))[: len(counts)], len(t.place) - 1)
        assert len(last) == len(counts) + 1
        n = np.array([*counts.values(), 0])
        own = model.classes[t.groups[last]]
        others = np.where(out[last] < maxent_lm.OUTPUTS - 1, 1.0, (n + 0.5) / 10 ** model.rest[own])
        known = (np.exp(lp[last]) * others)[:-1].sum()
        # An unseen word of each class: half a count of what its others share; the end is the only word of the last class, and unseen here.
        by_class, _ = model.features(t, model.classes[t.groups])
        i = last[-1:]
        softmax = lambda *of: (lambda x, e, total: np.log(e / total[:, None]))(*maxent_lm.exponentials(*of))
        class_lp = softmax(model.weights[0], model.bias, [f[i] for f in by_class])[0]
        unseen = 0.0
        for c in range(maxent_lm.CLASSES):
            fake = model.classes[t.groups].copy()
            fake[i] = c
            _, by_word = model.features(t, fake)
            inner = softmax(model.weights[1], model.out_bias[c][None, :], [f[i] for f in by_word])[0, -1]
            unseen += np.exp(class_lp[c] + inner) * 0.5 / 10 ** model.rest[c]
        assert known + unseen == pytest.approx(1, abs=1e-4)


def test_lm_steps_follow_the_gradient():
    """One step from no weights is the plain gradient of the log loss by feature."""
    import numpy as np

    rng = np.random.default_rng(1)
    n, size = 50, 16
    buckets = [rng.integers(0, size, n).astype(np.uint16)]
    targets, bias = rng.integers(0, maxent_lm.CLASSES, n), rng.normal(size=maxent_lm.CLASSES).astype(np.float32)
    weights, squares, used = np.zeros((size, maxent_lm.CLASSES), np.float32), np.zeros(size, np.float32), np.zeros(size, np.int64)
    maxent_lm.train_batch(weights, squares, used, bias, buckets, targets)
    p = np.exp(bias) / np.exp(bias).sum()
    for b in range(size):
        mine = targets[buckets[0] == b]
        g = len(mine) * p - np.bincount(mine, minlength=maxent_lm.CLASSES)
        assert used[b] == len(mine) and np.allclose(weights[b], -maxent_lm.RATE / np.sqrt((g * g).mean() + 1) * g, atol=1e-4)


def test_segment_sums():
    import numpy as np

    rng = np.random.default_rng(4)
    keys = np.sort(np.concatenate([rng.integers(0, 200, 300), np.full(100, 7), [500]]))
    values = rng.normal(size=(len(keys), 3))
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    assert np.allclose(maxent_lm.segment_sums(values, first), np.add.reduceat(values, first, axis=0))


def test_gradients_see_every_position(monkeypatch):
    seen, inner = Counter(), maxent_lm.train_batch
    monkeypatch.setattr(maxent_lm, "train_batch", lambda w, s, u, bias, buckets, targets: seen.update(n=len(targets)) or inner(w, s, u, bias, buckets, targets))
    model, _ = tiny_model()
    texts = ["one two three four five six", "", None, "seven " * 5_000]
    run = maxent_lm._gradient_round(type("Shared", (), {"value": model}))
    assert len(list(run(iter([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])])))) and seen["n"] == 2 * (6 + 5_000 + len(texts))  # both factors


def test_lm_without_training_text(spark):
    docs = spark.createDataFrame([(i, "some words") for i in range(50) if zlib.crc32(str(i).encode()) % 5 == 1] + [(None, None)][:0], "doc_id long, text string")
    got = maxent_lm.lm_scores(docs).collect()
    assert got and all(r["held_out"] and r["train_tokens"] == 0 and r["n_known"] == 0 and r["base_score"] == pytest.approx(0) and r["score"] < 0 for r in got)


def test_best_fit_is_valid():
    rng = random.Random(2)
    sizes = [rng.randrange(1, 100) for _ in range(500)]
    bins = packing.best_fit(sizes, 100)
    assert sorted(i for b in bins for i in b) == list(range(500)) and max(sum(sizes[i] for i in b) for b in bins) <= 100
    assert len(bins) <= 1.05 * sum(sizes) / 100 + 1


def water_fill(sizes, weights, most=3):
    """Shares by weight; what is above a cap goes to the others, again and again."""
    total, capped = sum(sizes.values()), {}
    while True:
        left = total - sum(capped.values())
        open_weight = sum(w for s, w in weights.items() if s not in capped)
        shares = {s: left * w / open_weight for s, w in weights.items() if s not in capped}
        over = {s: most * sizes[s] for s, v in shares.items() if v > most * sizes[s] * (1 + 1e-12)}
        if not over:
            return shares | capped
        capped |= over


@pytest.mark.parametrize("bucket_rows", [20_000, 7])
def test_mixing(spark, documents, monkeypatch, bucket_rows):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket_rows)
    monkeypatch.setattr(mixing, "FAN_IN", 3)
    rows = [(r["doc_id"], r["text"], r["source"]) for r in documents.collect()] + [(10_000, "one two", "tiny"), (10_001, None, "src1"), (10_002, "x y z", None), (10_003, "x y z", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("x"))
    got = mixing.mix_sources(docs, mixing.cycle_123()).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    order = sorted(sizes, key=lambda s: (s is None, s))
    wanted = water_fill(sizes, {s: i % 3 + 1 for i, s in enumerate(order)})
    taken, largest = Counter(), Counter()
    for r in got:
        largest[r["source"]] = max(largest[r["source"]], r["size"])
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(wanted[r["source"]]) and 0 <= r["copies"] <= 3
        taken[r["source"]] += r["size"] * r["copies"]
    for s in order:
        assert abs(taken[s] - wanted[s]) <= largest[s], s  # sources of ten documents: no nearer than one document
    again = mixing.mix_sources(docs, mixing.cycle_123()).collect()
    assert {(r["doc_id"], r["copies"]) for r in again} == {(r["doc_id"], r["copies"]) for r in got}


def test_mixing_comes_near_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sums = mixing.mix_sources(docs, mixing.cycle_123()).groupBy("source").agg(F.first("target").alias("target"), F.sum(F.col("size") * F.col("copies")).alias("taken"))
    assert all(abs(r["taken"] - r["target"]) <= 0.05 * r["target"] for r in sums.collect())


def test_pivot_keeps_words_and_chances():
    import numpy as np

    ids, sizes = np.arange(200), np.random.default_rng(0).integers(1, 50, 200)
    total = np.zeros(200)
    for salt in range(300):
        p, left = mixing.pivot(ids, sizes, np.full(200, 0.3), salt)
        assert (p * sizes).sum() == pytest.approx(0.3 * sizes.sum()) and ((p == 0) | (p == 1) | (np.arange(200) == left)).all()
        total += p
    assert abs(total / 300 - 0.3).max() < 0.12


def test_outputs_come_from_all_words(spark, documents, monkeypatch):
    """Also where the words of a class are too rare to go to all tasks."""
    found = []
    for most in (maxent_lm.HEAD_WORDS, 50):
        monkeypatch.setattr(maxent_lm, "HEAD_WORDS", most)
        model = maxent_lm.fit(documents.select("text"))[0]
        found.append((model.words.tolist(), model.outputs.tolist(), model.out_bias.round(4).tolist()))
    assert found[0] == found[1] and len(found[0][0]) > 200


def test_lm_base_scores(spark, documents):
    import math

    rows = [(r[0], r[1]) for r in EDGES if r[0] is not None] + [(10_000 + r["doc_id"], r["text"]) for r in documents.collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit(0))
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = [(d, (t or "").translate(low).encode().split() + [b"\n"]) for d, t in rows]
    counts = Counter(w for d, ws in tokens if zlib.crc32(str(d).encode()) % 5 != 1 for w in ws)
    n, total = sum(counts.values()), math.log10(sum(counts.values()) + 0.5 * (len(counts) + 1))
    expected = Counter((d, len(ws), sum(w in counts for w in ws), n, round(sum(math.log10(counts[w] + 0.5) - total for w in ws), 4)) for d, ws in tokens)
    for head in (maxent_lm.HEAD_WORDS, 50):
        maxent_lm.HEAD_WORDS, kept = head, maxent_lm.HEAD_WORDS
        got = maxent_lm.lm_scores(docs).collect()
        maxent_lm.HEAD_WORDS = kept
        assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == expected
    held = [r for r in got if r["held_out"] and r["doc_id"] >= 10_000]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    from tests.oracle import same

    same(spark, QUERIES[name], ORACLES[name])


def test_empty_tables(spark):
    empty = frame(spark, [])
    path = public_tokenizers.path("word_bpe_49k.json")
    for made in (
        quality_rules.rule_ledger(empty), pii.pii_digest(empty), ngram_join.similarity_components(empty), packing.pack_documents(empty, path),
        mixing.mix_sources(empty, mixing.cycle_123()), maxent_lm.lm_scores(empty), quality_rules.filter_documents(empty), pii.redact_documents(empty),
    ):
        assert made.count() == 0
