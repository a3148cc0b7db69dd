"""Phrase collocation mining.

Texts are cut into pieces at punctuation, and equal pieces of a language become one
with a multiplicity. Each level counts weighted n-grams of the pieces: tasks cut
them out, duckdb sums them in each task and again in each hash bucket, where it
spills what does not fit its memory. Level by level only n-grams whose shorter runs
are all frequent are cut out, by a bitmap of hashes that never loses one.

The counts of the two parts of each cut of a phrase lie in other buckets. Each cut
sends two lookup requests, which are shuffled to the buckets of the parts; the
answers meet again by phrase.
"""

from __future__ import annotations

import contextlib
import shutil
import tempfile
import zlib
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluice.llm.common import LOWER, UPPER, file_system, few_rows, load, shared_dir, slices, written
from sluice.llm.words import BASE, SLICE, _power, _tables, gram_hashes, mix
from sluice.operators.windows import numbered_in_buckets

PIECE_END = r"[.,;:!?\x0A-\x0D]"
LEAST, LONGEST, TOP = 100, 5, 2000
UNKNOWN = "und"
#: Levels: the orders that are counted, and the order whose frequent n-grams they must be made of.
LEVELS = (((1,), 0), ((2,), 1), ((3,), 2), (tuple(range(4, LONGEST + 1)), 3))
#: Bits of the bitmap of frequent n-grams, which bounds what is broadcast to 2 MB. Where it fills up, more is counted than need be, nothing is lost.
SLOTS = 1 << 24
#: What duckdb may hold in a task; the rest spills.
MEMORY = "160MB"
COUNTED = "lang string, phrase string, f long"


def pieces(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, piece and n, how often it occurs: words with one space between them, A-Z in lower case. Pieces without words are left out."""
    lower = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    cut = df.select(F.coalesce(F.col(lang), F.lit(UNKNOWN)).alias("lang"), F.explode(F.split(lower, PIECE_END, -1)).alias("piece"))
    plain = cut.withColumn("piece", F.trim(F.regexp_replace("piece", r"[\x20\x09]+", " "))).where("piece <> ''")
    return plain.groupBy("lang", "piece").agg(F.count("*").alias("n"))


@contextlib.contextmanager
def _spill(shared: str) -> Iterator[str]:
    """A folder of this task for what duckdb spills: in the shared folder where that is mounted, else the worker's own; gone afterwards."""
    from pyarrow import fs

    system, path = file_system(shared)
    folder = tempfile.mkdtemp(prefix="phrases-", dir=path if isinstance(system, fs.LocalFileSystem) else None)
    try:
        yield folder
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def summed(batches: Iterable[pa.RecordBatch], shared: str, least: int = 1) -> Iterator[pa.RecordBatch]:
    """Batches of lang, phrase and f as sums by phrase of at least least, by duckdb, which reads and returns them as streams."""
    import duckdb

    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())])
    with _spill(shared) as folder, contextlib.closing(duckdb.connect(config={"memory_limit": MEMORY, "threads": 1, "temp_directory": folder})) as con:
        con.register("grams", pa.RecordBatchReader.from_batches(schema, batches))
        for batch in con.sql(f"SELECT lang, phrase, CAST(sum(f) AS BIGINT) AS f FROM grams GROUP BY lang, phrase HAVING sum(f) >= {least}").to_arrow_reader(1 << 15):
            yield batch.cast(schema)


class _Words:
    """The words of pieces, each with its hash, place and piece."""

    def __init__(self, texts: list[bytes], langs: list[str]) -> None:
        self.raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        gap = (self.raw == 0x20) | (self.raw == 0x0A)
        self.ends = np.flatnonzero(gap)
        self.starts = np.concatenate([[0], self.ends[:-1] + 1])
        line = self.raw[self.ends] == 0x0A
        self.piece = np.concatenate([[0], np.cumsum(line)[:-1]])
        values, _ = _tables()
        power, inverse = _power(len(self.raw) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values[self.raw] * power[: len(self.raw)], dtype=np.uint64)])
        self.hashes = mix((sums[self.ends] - sums[self.starts]) * inverse[self.starts] + (self.ends - self.starts).astype(np.uint64))
        self.of_lang = np.array([zlib.crc32(x.encode()) for x in langs], np.uint64) * np.uint64(BASE)

    def starts_of(self, n: int) -> np.ndarray:
        """The first words of runs of n words in one piece."""
        last = len(self.piece) - n + 1
        return np.flatnonzero(self.piece[:last] == self.piece[n - 1 :]) if last > 0 else np.zeros(0, np.int64)

    def slots(self, n: int, at: np.ndarray, of: int) -> np.ndarray:
        """The bits, in a bitmap of so many, a power of two, of the runs of n words that start at at."""
        return (mix(gram_hashes(self.hashes, n)[at] + self.of_lang[self.piece[at]]) & np.uint64(of - 1)).astype(np.int64)

    def texts(self, n: int, at: np.ndarray) -> pa.Array:
        """The runs of n words that start at at."""
        first, size = self.starts[at], self.ends[at + n - 1] - self.starts[at]
        cuts = np.concatenate([[0], np.cumsum(size)])
        data = self.raw[np.repeat(first - cuts[:-1], size) + np.arange(cuts[-1])]
        return pa.StringArray.from_buffers(len(at), pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(data))


def _words(batch: pa.RecordBatch, text: str) -> _Words:
    return _Words(batch.column(text).cast(pa.binary()).to_pylist(), batch.column("lang").to_pylist())


def grams(batch: pa.RecordBatch, orders: tuple[int, ...], base: int, frequent: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """lang, phrase and f of the n-grams of pieces (lang, piece, n) whose runs of base words are all marked as frequent."""
    words = _words(batch, "piece")
    marked = np.ones(len(words.piece), np.int64)
    if frequent is not None:
        at = words.starts_of(base)
        slots = words.slots(base, at, 64 * len(frequent))
        marked[:] = 0
        marked[at] = (frequent[slots >> 6] >> (slots & 63).astype(np.uint64)) & np.uint64(1)
    missing = np.concatenate([[0], np.cumsum(1 - marked)])
    weights = batch.column("n").to_numpy()
    for n in orders:
        at = words.starts_of(n)
        runs = n - max(base, 1) + 1
        at = at[missing[at + runs] == missing[at]]
        # in slices: a gram is up to n times as long as its first word
        for k in range(0, len(at), 1 << 16):
            own = at[k : k + (1 << 16)]
            piece = words.piece[own]
            yield pa.RecordBatch.from_arrays([batch.column("lang").take(pa.array(piece)), words.texts(n, own), pa.array(weights[piece])], names=["lang", "phrase", "f"])


def bitmap(counted: DataFrame, of: int) -> np.ndarray:
    """A bit for each phrase (lang, phrase) of one order: so many bits, whatever the number of phrases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "phrase", SLICE):
            words = _words(batch, "phrase")
            n = int(batch.column("words")[0].as_py())
            at = words.starts_of(n)
            slots = np.unique(words.slots(n, at, of))
            yield pa.RecordBatch.from_arrays([pa.array((slots >> 6).astype(np.int32)), pa.array((np.uint64(1) << (slots & 63).astype(np.uint64)).view(np.int64))], names=["word", "bits"])

    found = counted.select("lang", "phrase", "words").mapInArrow(run, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(of // 64, np.uint64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def count_grams(unique: DataFrame, orders: tuple[int, ...], base: int, frequent: np.ndarray | None, least: int) -> DataFrame:
    """lang, phrase, words and f of the n-grams of pieces that occur least times or more."""
    shared = shared_dir(unique.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return summed((g for batch in slices(batches, "piece", SLICE, 1 << 16) for g in grams(batch, orders, base, frequent)), shared)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return summed((b.select(["lang", "phrase", "f"]) for b in batches), shared, least)

    dealt = unique.mapInArrow(cut, COUNTED).repartition("lang", "phrase")
    return dealt.mapInArrow(count, COUNTED).select("lang", "phrase", _words_in("phrase").alias("words"), "f")


def _words_in(column: str) -> Column:
    return (F.length(column) - F.length(F.replace(F.col(column), F.lit(" "))) + 1).cast("int")


def _part(count: Column) -> Column:
    """The first words of a phrase, or with a negative count its last."""
    return F.call_function("substring_index", F.col("phrase"), F.lit(" "), count)


def collocations(df: DataFrame, *, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score: each language's first top phrases of 2 to LONGEST words.

    A null text is empty, a null lang is UNKNOWN. Phrases are compared by their
    words, whatever spaces and tabs stand between them; equal scores and counts go
    by the UTF-8 bytes of the phrase, so ranks have no ties. Repeated rows count
    each. Without a phrase that occurs least times there are no rows, as with an
    empty table. Further columns are left out, whatever their names.
    """
    unique = written(pieces(few_rows(df, 4096), text, lang), "phrase-pieces")
    sizes = unique.groupBy("lang").agg(F.sum(F.col("n") * _words_in("piece")).alias("n"))
    levels, frequent = [], None
    for orders, base in LEVELS:
        counted = written(count_grams(unique, orders, base, frequent, least), f"phrase-counts-{orders[0]}")
        frequent = bitmap(counted, SLOTS) if len(orders) == 1 else None
        levels.append(counted)
    counts = reduce(DataFrame.unionByName, levels)
    found = counts.where("words > 1").withColumnRenamed("f", "a")

    # two requests for each cut go to the buckets of the parts, and the answers back to the phrase
    cuts = found.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    sides = F.array(F.struct(F.lit(True).alias("first"), _part(F.col("k")).alias("part")), F.struct(F.lit(False).alias("first"), _part(F.col("k") - F.col("words")).alias("part")))
    requests = cuts.select("lang", "phrase", "a", "k", F.inline(sides))
    answers = requests.join(counts.select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"])
    side = lambda first: F.max(F.when(F.col("first") == first, F.col("f")))
    scored = answers.groupBy("lang", "phrase", "a", "k").agg(side(True).alias("l"), side(False).alias("r")).join(sizes, "lang")
    # decimals of 38 digits hold the products, and div cuts off exactly
    scored = scored.withColumn("score", F.expr("(cast(1000 as decimal(38, 0)) * a * n) div (cast(l as decimal(38, 0)) * r)"))
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "n", "cut.*")

    # what a longer phrase holds as often is only part of it; one word longer is enough, since counts fall along the way
    longer = found.where("words > 2").select("lang", F.explode(F.array(_part(F.col("words") - 1), _part(1 - F.col("words")))).alias("phrase"), F.col("a").alias("of"))
    swallowed = longer.groupBy("lang", "phrase").agg(F.max("of").alias("of"))
    kept = best.join(swallowed, ["lang", "phrase"], "left").where("of is null or 100 * of < 100 * a")

    # ranks are numbered by ranges of scores, so no language is one task's
    order = [F.desc("score"), F.desc("a"), "phrase"]
    ranked = numbered_in_buckets(kept, ["lang"], -F.floor(8 * F.log2(F.col("score") + F.lit(1.0))), order, "rank").where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(load(spark, sf_dir, "documents"))


QUERIES = {"op12_phrases": op12_phrases}
ORACLE_SQL = {
    "op12_phrases": r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p
), s AS (
  SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang
), g AS (
  SELECT lang, unnest(flatten(list_transform(range(1, 6), lambda k: list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(list_slice(ws, i, i + k - 1), ' '))))) AS phrase FROM w
), c AS (
  SELECT lang, phrase, string_split(phrase, ' ') AS ws, count(*) AS f FROM g GROUP BY lang, phrase HAVING count(*) >= 100
), d AS (
  SELECT lang, phrase, ws, f, unnest(range(1, len(ws))) AS k FROM c WHERE len(ws) > 1
), e AS (
  SELECT d.lang, d.phrase, d.f AS a, d.k, x.f AS l, y.f AS r, s.n,
         (CAST(1000 AS HUGEINT) * d.f * s.n) // (CAST(x.f AS HUGEINT) * y.f) AS score
  FROM d JOIN s USING (lang)
  JOIN c x ON x.lang = d.lang AND x.phrase = array_to_string(list_slice(d.ws, 1, d.k), ' ')
  JOIN c y ON y.lang = d.lang AND y.phrase = array_to_string(list_slice(d.ws, d.k + 1, len(d.ws)), ' ')
), b AS (
  SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), t AS (
  SELECT * FROM b WHERE NOT EXISTS (
    SELECT 1 FROM c z WHERE z.lang = b.lang AND length(z.phrase) > length(b.phrase) AND 100 * z.f >= 100 * b.a AND contains(' ' || z.phrase || ' ', ' ' || b.phrase || ' ')
  )
), o AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM t
)
SELECT * FROM o WHERE rank <= 2000
"""
}
