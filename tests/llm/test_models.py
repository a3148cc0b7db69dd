"""The language model, language ID and toxicity."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.llm import kneser_ney, language_id, toxicity
from sluice.llm.common import load
from tests.conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain_model(texts):
    """The same model in dictionaries: a function of (word before, word) and the counts."""
    seqs = [["<s>", *WORD.findall((t or "").translate(LOWER)), "</s>"] for t in texts]
    words, pairs = Counter(), Counter()
    for s in seqs:
        words.update(s[1:])
        pairs.update(zip(s, s[1:], strict=False))
    before, of = Counter(w for _, w in pairs), defaultdict(lambda: [0, 0, 0, 0])
    for (u, _), c in pairs.items():
        of[u][0] += c
        of[u][min(c, 3)] += 1
    times = lambda values: [sum(v == k for v in values) for k in (1, 2, 3, 4)]
    high, low = kneser_ney.discounts(times(list(pairs.values()))), kneser_ney.discounts(times(list(before.values())))
    spare = sum(low[min(c, 3)] for c in before.values())

    def p(u, w):
        cont = ((before[w] - low[min(before[w], 3)]) if before[w] else 0) / len(pairs) + spare / len(pairs) / (len(words) + 1)
        if u not in of:
            return cont
        c, x = pairs[u, w], of[u]
        return (c - high[min(c, 3)] + (high[1] * x[1] + high[2] * x[2] + high[3] * x[3]) * cont) / x[0]

    return p, words


def check_scores(rows, texts, train):
    p, words = plain_model(train)
    n, v = sum(words.values()), len(words)
    for r, text in zip(rows, texts, strict=True):
        s = ["<s>", *WORD.findall((text or "").translate(LOWER)), "</s>"]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(s) - 1, sum(words[w] > 0 for w in s[1:]), n)
        base = sum(math.log10((words[w] + 0.1) / (n + 0.1 * (v + 1))) for w in s[1:])
        assert math.isclose(r["base_score"], base, rel_tol=1e-9, abs_tol=1e-9)
        assert math.isclose(r["score"], sum(math.log10(p(u, w)) for u, w in zip(s, s[1:], strict=False)), rel_tol=1e-9, abs_tol=1e-9)
    for u in ("<s>", "the", "not there"):
        assert math.isclose(sum(p(u, w) for w in words) + p(u, "not there either"), 1, rel_tol=1e-9)


@pytest.mark.parametrize("shard", [4_000_000, 2000])
def test_kneser_ney_by_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(kneser_ney, "SHARD_PAIRS", shard)
    docs = load(spark, SF, "documents").select("doc_id", "text")
    rows = sorted(kneser_ney.op3_kneser_ney(spark, SF).collect(), key=lambda r: r["doc_id"])
    texts = [r["text"] for r in docs.orderBy("doc_id").collect()]
    held = [zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0 for r in rows]
    assert held == [r["held_out"] for r in rows]
    check_scores(rows, texts, [t for t, h in zip(texts, held, strict=True) if not h])
    assert sum(r["score"] for r in rows if r["held_out"]) > sum(r["base_score"] for r in rows if r["held_out"])


def test_counts_over_255(spark):
    texts = ["a b"] * 700 + ["a c", "b a"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string").repartition(3)
    rows = sorted(kneser_ney.score_texts(df, kneser_ney.train(df)).collect(), key=lambda r: r["doc_id"])
    check_scores(rows, texts, texts)


def test_kneser_ney_on_odd_rows(odd, empty):
    texts = [r["text"] for r in odd.collect()]
    scored = kneser_ney.score_texts(odd, kneser_ney.train(odd), keep=("doc_id", "text")).collect()
    check_scores(scored, [r["text"] for r in scored], texts)
    nothing = kneser_ney.train(empty)
    assert kneser_ney.score_texts(empty, nothing).count() == 0
    assert all(r["n_known"] == 0 and r["base_score"] == 0.0 for r in kneser_ney.score_texts(odd, nothing).collect())


def plain_model_of(order, texts):
    """A model of any order in dictionaries: a function of the words before a word and the word."""
    grams = {order: Counter()}
    for t in texts:
        s = ["<s>"] * (order - 1) + [*WORD.findall((t or "").translate(LOWER)), "</s>"]
        grams[order].update(tuple(s[i : i + order]) for i in range(len(s) - order + 1))
    for n in range(order - 1, 0, -1):
        grams[n] = Counter(g[1:] for g in grams[n + 1])
    cuts = {n: kneser_ney.discounts([sum(c == k for c in grams[n].values()) for k in (1, 2, 3, 4)]) for n in grams}
    follow = {n: defaultdict(list) for n in grams}
    for n in grams:
        for g, c in grams[n].items():
            follow[n][g[:-1]].append(c)

    def p(n, before, w):
        lower = p(n - 1, before[1:], w) if n > 1 else 1 / (len(grams[1]) + 1)
        counts = follow[n][before]
        if not counts:
            return lower
        c = grams[n][(*before, w)]
        return (c - cuts[n][min(c, 3)] + sum(cuts[n][min(k, 3)] for k in counts) * lower) / sum(counts)

    return lambda before, w: p(order, before, w)


def check_order(rows, order, train):
    p, words = plain_model_of(order, train), Counter(w for t in train for w in [*WORD.findall((t or "").translate(LOWER)), "</s>"])
    for r in rows:
        s = ["<s>"] * (order - 1) + [*WORD.findall((r["text"] or "").translate(LOWER)), "</s>"]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(s) - order + 1, sum(words[w] > 0 for w in s[order - 1 :]), sum(words.values()))
        want = sum(math.log10(p(tuple(s[i : i + order - 1]), s[i + order - 1])) for i in range(len(s) - order + 1))
        assert math.isclose(r["score"], want, rel_tol=1e-9, abs_tol=1e-9)


@pytest.mark.parametrize(("order", "shard"), [(3, 4_000_000), (3, 300), (4, 300)])
def test_higher_orders_by_brute_force(spark, monkeypatch, order, shard):
    monkeypatch.setattr(kneser_ney, "SHARD_PAIRS", shard)
    docs = load(spark, SF, "documents").select("doc_id", "text").where("doc_id % 5 = 0")
    texts = [r["text"] for r in docs.collect()] + ["a b c"] * 700 + [None, "", "a b d", "b c"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3)
    learned = kneser_ney.train(df.where("doc_id % 3 > 0"), order=order)
    rows = kneser_ney.score_texts(df, learned, keep=("doc_id", "text")).collect()
    check_order([r for r in rows if r["doc_id"] % 7 == 0], order, [t for i, t in enumerate(texts) if i % 3])


def test_registered_order_3_uses_two_words_before(spark):
    query = kneser_ney.QUERIES["op3_kneser_ney_3"]
    texts = {r["doc_id"]: r["text"] for r in load(spark, SF, "documents").collect()}
    rows = [r.asDict() | {"text": texts[r["doc_id"]]} for r in query(spark, SF).collect()]
    check_order([r for r in rows if r["doc_id"] % 9 == 0], 3, [r["text"] for r in rows if not r["held_out"]])


def test_orders_on_odd_rows(odd, empty):
    learned = kneser_ney.train(odd, order=3)
    check_order(kneser_ney.score_texts(odd, learned, keep=("doc_id", "text")).collect(), 3, [r["text"] for r in odd.collect()])
    nothing = kneser_ney.train(empty, order=3)
    assert all(r["n_known"] == 0 and r["base_score"] == 0.0 for r in kneser_ney.score_texts(odd, nothing).collect())


def test_rows_that_do_not_fit_one_number():
    rng = np.random.default_rng(0)
    columns = [rng.integers(0, 5, 500) for _ in range(3)]
    few, many = kneser_ney.distinct(columns, 5), kneser_ney.distinct(columns, 1 << 22)
    assert all((a == b).all() for a, b in zip([*few[0], few[1]], [*many[0], many[1]], strict=True))


def test_language_id_held_out(spark):
    found = language_id.op10_language_id(spark, SF).join(load(spark, SF, "documents").select("doc_id", "lang"), "doc_id").where("held_out")
    right, n = found.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert n > 30 and right / n >= 0.95


def test_bundle_is_the_sum_of_bound_grams():
    rows, codes, counts, has = language_id.grams(["abca", "É", "", "1 2"])
    assert has.tolist() == [True, True, False, False]
    text = np.array([0, *map(ord, "abca"), 0])
    vectors = language_id.letter_vectors(text).astype(int)
    want = sum(np.prod([np.roll(vectors[i + k], 2 - k) for k in range(3)], axis=0) for i in range(len(text) - 2))
    assert (language_id.bundle(rows, codes, counts, 4)[0] == want).all()


def test_letters_have_vectors_of_their_own():
    # code points that agree in their lower bits, and the whole of a script
    points = np.array([97, 97 + 1023, 97 + 1024, *range(0x4E00, 0x4F00)])
    vectors = language_id.letter_vectors(points).astype(int)
    cosines = vectors @ vectors.T / vectors.shape[1] - np.eye(len(points))
    assert np.abs(cosines).max() < 0.25


def test_language_id_on_odd_rows(odd, empty):
    learned = language_id.collect_prototypes(language_id.language_prototypes(odd))
    rows = {r["doc_id"]: r for r in language_id.identify_language(odd, learned).collect()}
    assert all(rows[i]["lang_pred"] == "und" and rows[i]["score"] == 0 for i in (2, 3, 4))
    assert rows[6]["lang_pred"] == "de" and rows[7]["lang_pred"] == "ja" and rows[1]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in rows.values())
    none = language_id.collect_prototypes(language_id.language_prototypes(empty))
    assert none[0] == [] and {r["lang_pred"] for r in language_id.identify_language(odd, none).collect()} == {"und"}
    assert language_id.identify_language(empty, learned).count() == 0


def made(n, seed):
    """Documents of invented words; a tenth of them hold one to three words with a nasty stem."""
    rng = random.Random(seed)
    syllables = ["ba", "lo", "mi", "ter", "son", "du", "ka", "re"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randint(5, 80))]
        toxic = int(rng.random() < 0.1)
        for _ in range(rng.randint(1, 3) * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(["zorg", "grix", "moron"]) + rng.choice(["", "ka", "son", "du"]))
        docs.append((i, " ".join(words)))
        labels.append((i, toxic))
    return docs, labels


def test_toxicity_learns_stems(spark):
    docs, labels = made(3000, 1)
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    learned = toxicity.train(d, lab.where("doc_id < 2400"))
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(d.where("doc_id >= 2400"), learned).collect()}
    truth = dict(labels[2400:])
    hit = sum(got[i] and truth[i] for i in got)
    assert hit >= 0.9 * sum(truth.values()) and sum(got.values()) - hit <= 0.02 * len(got)


def test_toxicity_without_labels_trains_on_posteriors(spark):
    docs, labels = made(600, 2)
    harsh = ["you pathetic idiot scum", "stupid worthless vermin jerk", "moron you disgusting garbage bitch"]
    texts = [t for (_, t), (_, toxic) in zip(docs, labels, strict=True) if not toxic]
    texts = [f"{t} {harsh[i % 3]}" if i % 12 == 0 else f"{t} {['kill', 'garbage', 'ugly'][i % 3]}" if i % 12 == 1 else t for i, t in enumerate(texts)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    absent = spark.createDataFrame([(10_000 + i, 1) for i in range(20)], "doc_id long, toxic int")
    for given in (absent.where("false"), absent):
        got = {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(d, toxicity.train(d, given)).collect()}
        assert not any(got[i] for i in got if i % 12)
        assert sum(got[i] for i in got if i % 12 == 0) >= 0.9 * len([i for i in got if i % 12 == 0])


def test_toxicity_mines_and_counts_all_labels(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE", 60)
    docs, labels = made(1500, 3)
    toxic = [i for i, y in labels if y]
    docs = [(i, f"{t} qwyxel" if i in toxic[:12] else t) for i, t in docs]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    # labels of documents that are not there take no room
    lab = spark.createDataFrame(labels + [(100_000 + i, 0) for i in range(5000)], "doc_id long, toxic int")
    told = []
    model = toxicity.label_model
    monkeypatch.setattr(toxicity, "label_model", lambda counts, gold, n: told.append(gold) or model(counts, gold, n))
    placed = []
    fit = toxicity.fit_linear
    monkeypatch.setattr(toxicity, "fit_linear", lambda rows, at, target, weight, width: placed.append((toxic_rows(weight), len(target))) or fit(rows, at, target, weight, width))
    toxic_rows = lambda weight: int((weight == 1).sum())
    learned = toxicity.train(d, lab)
    # the word or how it begins
    assert np.isin(toxicity.features(["qwyxel"])[1], learned.keys).any()
    assert sum(told[0].values()) == 1500 and sum(n for (_, y), n in told[0].items() if y) == len(toxic)
    assert placed == [(60, 120)]


def test_label_model_discounts_voters_that_agree():
    rng = np.random.default_rng(0)
    y = rng.random(20_000) < 0.3
    one = np.where(y, rng.random(len(y)) < 0.8, rng.random(len(y)) < 0.05)
    votes = np.stack([one, one, one, np.where(y, rng.random(len(y)) < 0.7, rng.random(len(y)) < 0.05), np.where(y, rng.random(len(y)) < 0.6, rng.random(len(y)) < 0.1)], axis=1)
    masks = votes @ (1 << np.arange(5))
    counts = {int(m): int(c) for m, c in zip(*np.unique(masks, return_counts=True), strict=True)}
    gold = Counter(zip(masks[:500].tolist(), y[:500].astype(int).tolist(), strict=True))
    posterior, told = toxicity.label_model(counts, gold, 5)
    assert told["discount"][0] < 0.5 < told["discount"][3]
    predicted = np.array([posterior[int(m), -1] for m in masks]) > 0.5
    assert (predicted == y).mean() > 0.85


def test_labels_meet_their_texts(spark, monkeypatch):
    texts = spark.range(3000).selectExpr("id % 2500 as doc_id", "concat('t', id) as text").unionByName(spark.createDataFrame([(None, "x")], "doc_id long, text string"))
    known = spark.range(0, 9000, 3).selectExpr("id as doc_id", "id % 2 as toxic")
    for slots in (64, 1 << 12, 1 << 23):
        monkeypatch.setattr(toxicity, "SLOTS", slots)
        got = sorted(map(tuple, toxicity.with_labels(texts, known).collect()))
        assert got == sorted((i % 2500, f"t{i}", i % 2500 % 2) for i in range(3000) if i % 2500 % 3 == 0)


def test_human_accuracy_is_estimated():
    rng = np.random.default_rng(1)
    y = rng.random(20_000) < 0.3
    votes = np.stack([np.where(y, rng.random(len(y)) < p, rng.random(len(y)) < 0.03) for p in (0.9, 0.85, 0.8, 0.8)], axis=1)
    masks = votes @ (1 << np.arange(4))
    counts = {int(m): int(c) for m, c in zip(*np.unique(masks, return_counts=True), strict=True)}
    said = np.where(rng.random(len(y)) < 0.015, 1 - y, y).astype(int)
    _, told = toxicity.label_model(counts, Counter(zip(masks[:9000].tolist(), said[:9000].tolist(), strict=True)), 4)
    assert all(abs(h - 0.985) < 0.006 for h in told["human"]) and abs(told["prior"] - 0.3) < 0.02


def test_held_out_toxicity(spark):
    """Of the labelled table, and beside it what the voters' list alone would do."""
    from sluice.llm.common import load, remainder

    labels = load(spark, "/root/testdata/sf0.01", "labels")
    rows = toxicity.op1_toxicity(spark, "/root/testdata/sf0.01").where("held_out").join(labels, "doc_id").collect()
    hit = sum(r["predicted"] and r["toxic"] for r in rows)
    assert len(rows) == labels.where(remainder("doc_id", 5) == 0).count()
    assert 2 * hit >= 0.8 * (sum(r["predicted"] for r in rows) + sum(r["toxic"] for r in rows))


def test_toxicity_on_odd_rows(odd, empty, spark):
    labels = spark.createDataFrame([(1, 0), (6, 1), (6, 0), (None, 1), (7, None), (99, 1)], "doc_id long, toxic int")
    learned = toxicity.train(odd, labels)
    rows = toxicity.score_toxicity(odd, learned).collect()
    assert len(rows) == 12 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    alone = toxicity.train(empty, labels.where("false"))
    seeds = spark.createDataFrame([(1, "you pathetic idiot"), (2, "a fine day")], "doc_id long, text string")
    assert [r["predicted"] for r in toxicity.score_toxicity(seeds, alone).orderBy("doc_id").collect()] == [1, 0]
    assert toxicity.score_toxicity(empty, learned).count() == 0
