import base64
import hashlib
import random
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.llm import minhash_dedup, topk_search, warc_index, words


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    """doc_id to (size, component), linking all pairs."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def check(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash_dedup.near_duplicates(df, **options).collect()}
    assert got == brute(rows)


def test_hashes_are_those_of_the_words():
    texts = [b"The cat  THE cat\tsat on the cat sat on the", b"", b"  ", b"a b", b"one two three four five"]
    hashes, counts = words.shingles(texts)
    assert counts.tolist() == [len(shingles(t.decode())) for t in texts]
    w, n = words.word_hashes([b"The cat", b"cat THE the"])
    assert n.tolist() == [2, 3] and w[0] == w[3] == w[4] and w[1] == w[2] and w[0] != w[1]
    assert set(words.word_hashes([b"b a"])[0].tolist()) == set(words.word_hashes([b"a b"])[0].tolist())


def test_chains_of_near_copies(spark):
    rng = random.Random(3)
    rows, n = [], 0
    for _ in range(12):
        text = [str(rng.randrange(5000)) for _ in range(120)]
        for _ in range(8):
            rows.append((n, " ".join(text)))
            n += 1
            text = list(text)
            for _ in range(rng.randint(0, 4)):
                text[rng.randrange(len(text))] = str(rng.randrange(5000))
    rows += [(n, rows[0][1].upper()), (n + 1, "two words"), (n + 2, "Two  Words"), (n + 3, ""), (n + 4, None), (n + 5, " ")]
    check(spark, rows)


def test_a_passage_shared_by_many_is_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "BLOCK_NODES", 8)
    monkeypatch.setattr(minhash_dedup, "CHUNK", 4)
    monkeypatch.setattr(minhash_dedup, "LEADER_ROUNDS", 1)
    rng = random.Random(4)
    passage = [str(rng.randrange(9000)) for _ in range(60)]
    rows = [(i, " ".join(passage + [str(rng.randrange(9000)) for _ in range(rng.randint(2, 30))])) for i in range(60)]
    check(spark, rows)


def test_compare_blocks_alone_finds_all(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "BLOCK_NODES", 4)
    rng = random.Random(5)
    base = [str(rng.randrange(9000)) for _ in range(80)]
    rows = []
    for i in range(30):
        text = list(base)
        for _ in range(i % 4):
            text[rng.randrange(80)] = f"x{i}"
        rows.append((i, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    docs = minhash_dedup.signatures(df, "doc_id", "text")
    bands = docs.select(F.col("doc_id").alias("node"), F.explode("bands").alias("band"), F.col("doc_id").alias("component"))
    got = {(r["a"], r["b"]) for r in minhash_dedup.compare_blocks(bands, docs, df, 75).collect()}
    sets = {i: shingles(t) for i, t in rows}
    want = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert got == want


def test_components_of_a_path(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 105), (105, 103), (7, 7)]
    got = {r["node"]: r["component"] for r in minhash_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 105: 100, 103: 100}


def test_dedup_on_odd_rows(odd, empty):
    rows = minhash_dedup.near_duplicates(odd).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == 12 and by[5]["component_id"] == 1 and not by[5]["kept"] and by[1]["kept"]
    assert by[None]["component_id"] is None and by[None]["kept"] and by[2]["n_shingles"] == 0
    assert minhash_dedup.near_duplicates(empty).count() == 0


def plain_top(vectors, queries, k):
    out = []
    for q, v in queries:
        scored = sorted((-int(np.dot(v, w)), i) for i, w in vectors if i != q)
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("size, block, part", [(300, 16, 4), (7, 1024, 32)])
def test_top_k_by_brute_force(spark, monkeypatch, size, block, part):
    monkeypatch.setattr(topk_search, "BLOCK", block)
    monkeypatch.setattr(topk_search, "PART", part)
    rng = np.random.default_rng(2)
    # few values, so that scores tie
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 6) / 64 + 0.001]) for i in range(size)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in topk_search.top_k_search(df, df.where("vec_id % 20 = 0"), 9).collect())
    whole = [(i, np.floor(64 * np.array(v, np.float32).astype(np.float64)).astype(int)) for i, v in rows]
    assert got == plain_top(whole, [w for w in whole if w[0] % 20 == 0], 9)


def test_blocks_are_pruned_and_large_numbers_exact():
    rng = np.random.default_rng(3)
    vectors = np.sort(rng.integers(-100, 100, (4096, 4)), axis=0)
    ids = np.arange(4096)
    rows, names, scores, scored = topk_search.search_part(np.array([-1]), np.array([[5, 3, 1, 2]]), ids, vectors, 5, 64)
    want = sorted((-int(s), i) for i, s in enumerate(vectors @ np.array([5, 3, 1, 2])))[:5]
    assert [(-s, i) for s, i in zip(scores.tolist(), names.tolist(), strict=True)] == want and scored < 20
    big = np.array([[2**30, 1], [2**30, 2], [2**30, 2]])
    _, names, scores, _ = topk_search.search_part(np.array([9]), np.array([[2**30, 1]]), np.array([3, 2, 1]), big, 2, 1)
    assert names.tolist() == [1, 2] and scores.tolist() == [2**60 + 2] * 2


def test_products_beyond_64_bits_are_an_error():
    with pytest.raises(OverflowError):
        topk_search.search_part(np.array([1]), np.array([[2**40]]), np.array([2]), np.array([[2**40]]), 1)


def test_rounds_start_from_known_scores(spark, monkeypatch):
    """Many parts: later rounds return few rows, and ties across parts still go to smaller ids."""
    monkeypatch.setattr(topk_search, "BLOCK", 8)
    monkeypatch.setattr(topk_search, "PART", 1)
    monkeypatch.setattr(topk_search, "BATCH", 4)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-1, 2, 3)]) for i in range(240)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in topk_search.top_k_search(df, df.where("vec_id % 20 = 0"), 5).collect())
    whole = [(i, 64 * np.array(v, int)) for i, v in rows]
    assert got == plain_top(whole, [w for w in whole if w[0] % 20 == 0], 5)


def test_several_blocks_in_several_parts(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "BLOCK", 32)
    monkeypatch.setattr(topk_search, "PART", 5)
    monkeypatch.setattr(topk_search, "BATCH", 16)
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=8) * (1 + i % 9))]) for i in range(1500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = sorted(tuple(r) for r in topk_search.top_k_search(df, df.where("vec_id % 20 = 0"), 20).collect())
    whole = [(i, np.floor(64 * np.array(v, np.float32).astype(np.float64)).astype(int)) for i, v in rows]
    assert got == plain_top(whole, [w for w in whole if w[0] % 20 == 0], 20)


def test_parts_out_of_reach_are_not_sent(spark):
    rng = np.random.default_rng(9)
    # ever smaller vectors, so that only the first parts can hold high scores
    rows = [(i, (rng.integers(1, 10, 4) + (40 if i < 100 else 0)).tolist()) for i in range(1000)]
    vectors = spark.createDataFrame(rows, "id long, v array<long>").coalesce(1).sortWithinPartitions("id")
    index = topk_search._packed(vectors, 50, 10)
    asked = topk_search._batches(vectors.where("id < 8"), 1)
    floors = spark.createDataFrame([(0, list(range(8)), [4 * 40 * 40] * 8)], "batch int, known array<long>, least array<long>")
    pairs = index.select("part").withColumn("batch", F.lit(0))
    kept = {r["part"] for r in topk_search.promising(pairs, index, asked, floors).collect()}
    reach = {i // 50 for i, v in rows if any(np.dot(v, q) >= 4 * 40 * 40 for _, q in rows[:8])}
    assert len(kept) == 2 and reach <= kept
    # one query without a known score needs every part
    unknown = spark.createDataFrame([(0, [0], [10**9])], floors.schema)
    assert topk_search.promising(pairs, index, asked, unknown).count() == 20


def test_search_bears_odd_vectors(spark):
    rows = [(0, [1.0, 0.5]), (1, None), (2, [float("nan"), 1.0]), (3, [1.0, None]), (4, [float("inf"), 0.0]), (5, [1.0]), (6, [0.5, 0.5, 0.5]), (6, [0.25, 0.5, 0.5]), (None, [1.0, 1.0]), (7, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk_search.top_k_search(df, df.where("vec_id % 20 = 0")).orderBy("rank").collect()]
    assert got == [(0, 1, 5, 4096), (0, 2, 6, 3072), (0, 3, 6, 2048), (0, 4, 7, 0)]
    assert topk_search.top_k_search(df.where("false"), df).count() == 0


def test_loser_tree_merges():
    rng = random.Random(6)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(20))) for _ in range(k)]
        assert list(warc_index.LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def test_url_keys():
    assert warc_index.url_key("https://WWW.Example.com:8080/A/b?x=1#top") == "com,example:8080)/A/b?x=1"
    assert warc_index.url_key(None) == "" and warc_index.url_key("http://[bad") == "http://[bad"


def shuffled_rows(df):
    """Rows that exchanges of a plan that has run have written."""
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kids = node.children()
        todo += [kids.apply(i) for i in range(kids.size())]
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif "QueryStage" in name:
            todo.append(node.plan())
        elif name == "Exchange":
            total += node.metrics().apply("shuffleRecordsWritten").value()
    return total


@pytest.mark.parametrize("slots", [64, 1 << 23])
def test_only_copies_are_shuffled(spark, monkeypatch, slots):
    monkeypatch.setattr(warc_index, "SLOTS", slots)
    rows = [(i, f"http://x/{i}", f"page {i if i % 10 else 'same'} of some", i) for i in range(400)] + [(None, None, "page same of some", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, ts long").repartition(4)
    found = warc_index.with_first(df)
    got = {r["page_id"]: r["__first"] for r in found.collect()}
    assert got == {i: 0 if i is None or i % 10 == 0 else None for i, *_ in rows}
    # of 401 rows 41 have copies; a bitmap of 64 slots marks a few more, and each side of the join counts
    assert 41 <= shuffled_rows(found) - 401 <= 120


def test_archives_round_trip(spark, monkeypatch):
    pages = [(1, "http://b.org/x", "same"), (2, "http://a.org/y", "same"), (3, None, None), (4, "http://a.org/y", ""), (5, "http://a.org/y", "é" * 50_000), (5, "http://a.org/y", "é" * 50_000), (6, "u v", "same"), (None, "http://n.org", "same"), (7, "http://a.org/", "other\r\n\r\nWARC/1.1")]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, urlkey string").repartition(4)
    records, index = warc_index.archive_pages(df)
    got = sorted((r["page_id"] or 0, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in records.collect())
    first = {1: None, 2: 1, 3: None, 4: 3, 5: None, 6: 1, 7: None, None: None}
    want = []
    for i, _, html in pages:
        raw = (html or "").encode()
        want.append((i or 0, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if first[i] is not None else "response", first[i]))
    assert got == sorted(want, key=lambda w: w[:4])
    rows = index.orderBy("range_no", "place").collect()
    order = [(r["urlkey"], r["ts"], r["page_id"] is not None, r["page_id"] or 0) for r in rows]
    assert order == sorted(order) and len(rows) == len(pages)


def test_the_index_is_in_order_as_it_is_read(spark, monkeypatch):
    monkeypatch.setattr(warc_index, "RANGE_ROWS", 20)
    monkeypatch.setattr(warc_index, "READ_BYTES", 2000)
    monkeypatch.setattr(warc_index, "merge_runs", partial(warc_index.merge_runs, range_rows=20))
    rng = random.Random(8)
    rows = [(i, rng.choice(["http://a.org/", "http://b.org/", f"http://c.org/{rng.randrange(30)}"]), f"page {i % 90} " * rng.randrange(1, 40)) for i in range(400)]
    records, index = warc_index.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5))
    got = index.orderBy("range_no", "place").collect()
    order = [(r["urlkey"], r["ts"], r["page_id"]) for r in got]
    assert order == sorted(order) and len(got) == 400 and len({r["range_no"] for r in got}) > 10
    assert sorted(r["page_id"] for r in records.collect()) == list(range(400))


def test_small_payloads_are_responses(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    records, _ = warc_index.archive_pages(df, min_bytes=3)
    assert {r["page_id"]: r["refers_to"] for r in records.collect()} == {1: None, 2: None, 3: None, 4: 3}
    assert warc_index.archive_pages(df.where("false"))[0].count() == 0


def test_recall_at_the_threshold(spark):
    """Thousands of pairs of similarity 0.75 to 0.80, each alone in the table."""
    rng = np.random.default_rng(11)
    texts, want = [], []
    for i in range(3000):
        n = int(rng.integers(60, 160))
        words = [f"w{i}x{j}" for j in range(n + 4)]
        # the first of two texts has n shingles; the second lacks the last ones, of which 0.75 to 0.80 stay
        keep = int(rng.integers(-(-75 * n // 100), 80 * n // 100 + 1))
        texts += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[: keep + 4]))]
        assert 100 * keep >= 75 * n
        want.append(2 * i)
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    found = {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_duplicates(df).collect()}
    recall = sum(found[i + 1] == i for i in want) / len(want)
    assert recall >= 0.998, recall
