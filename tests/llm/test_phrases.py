import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from sluice.llm import phrases


def brute(rows, least, top):
    """The contract in plain Python; rows: (text, lang)."""
    counts, sizes, out = Counter(), Counter(), []
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang or "und"] += len(words)
            for n in range(1, 6):
                for i in range(len(words) - n + 1):
                    counts[lang or "und", tuple(words[i : i + n])] += 1
    found = {key: a for key, a in counts.items() if len(key[1]) > 1 and a >= least}
    for (lang, words), a in found.items():
        cuts = [(1000 * a * sizes[lang] // (counts[lang, words[:k]] * counts[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        inside = lambda long: any(long[i : i + len(words)] == words for i in range(len(long) - len(words) + 1))  # noqa: B023, E731
        if any(x == lang and len(long) > len(words) and 100 * b >= 100 * a and inside(long) for (x, long), b in found.items()):
            continue
        out.append((lang, " ".join(words), a, counts[lang, words[:k]], counts[lang, words[k:]], sizes[lang], score))
    best = []
    for lang in {r[0] for r in out}:
        own = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        best += [(r[0], i, *r[1:]) for i, r in enumerate(own[:top], 1)]
    return sorted(best)


def found(df, least, top):
    out = phrases.collocations(df, least=least, top=top)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in out.collect())


@pytest.mark.parametrize("least, top", [(2, 2000), (5, 3)])
def test_by_brute_force(spark, least, top):
    rng = random.Random(5)
    words = ["a", "B", "c", "ç", "日", "dd", "e f"]
    rows = []
    for _ in range(150):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ", ", "\n", "!"]) for _ in range(rng.randrange(12)))
        rows += [(text, rng.choice(["x", "x", "y", None]))] * rng.choice([1, 1, 3])
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    assert found(df, least, top) == brute(rows, least, top)


def test_odd_rows(spark, odd, empty):
    rows = [(r["text"], r["lang"]) for r in odd.collect()]
    assert found(odd, 2, 50) == brute(rows, 2, 50)
    assert found(empty, 2, 50) == []
    assert found(spark.createDataFrame([(None, None), ("", "x"), (" ,\t", "x")], "text string, lang string"), 1, 9) == []


def test_products_past_64_bits(spark):
    """Equal pieces become one, so counts may be large; here they are made so by hand."""
    n = 4 * 10**12
    row = spark.sql(f"SELECT (cast(1000 as decimal(38, 0)) * {n}L * {n}L) div (cast({n // 7}L as decimal(38, 0)) * {n // 9}L) AS score").first()
    assert row["score"] == 1000 * n * n // ((n // 7) * (n // 9))


def test_sums_spill_and_stay_whole(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(phrases, "MEMORY", "48MB")

    def batches():
        for k in range(60):
            texts = [f"phrase number {(k * 7919 + i * 31) % 400_000} of many" for i in range(20_000)]
            yield pa.RecordBatch.from_arrays([pa.array(["x"] * len(texts)), pa.array(texts), pa.array([3] * len(texts))], names=["lang", "phrase", "f"])

    want = Counter((k * 7919 + i * 31) % 400_000 for k in range(60) for i in range(20_000))
    got = {}
    for batch in phrases.summed(batches(), str(tmp_path)):
        for phrase, f in zip(batch.column("phrase").to_pylist(), batch.column("f").to_pylist(), strict=True):
            assert got.setdefault(int(phrase.split()[2]), f) == f
    assert got == {k: 3 * n for k, n in want.items()}
    assert not list(tmp_path.iterdir())


def test_a_full_bitmap_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SLOTS", 64)
    rows = [(" ".join(f"w{(i * k) % 40}" for k in range(12)), "x") for i in range(60)]
    assert found(spark.createDataFrame(rows, "text string, lang string"), 3, 500) == brute(rows, 3, 500)
