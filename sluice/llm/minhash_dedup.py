"""Near-duplicate detection with min-max hashing.

Every permutation of a document's shingles gives two signature values, its minimum
and its maximum. Bands of values put documents in buckets. Documents with equal
shingle sets are one node. In a bucket, nodes are compared with one leader, on
their full sets; only what is then still in other components is compared further,
until every pair of a bucket is linked, connected or refuted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import few_rows, load, perhaps_among, slices, written
from sluice.llm.words import SLICE, mix, shingles

SHINGLE = 5
#: Similarity in hundredths from which documents are linked.
SIMILAR = 75
#: A pair of large sets of similarity 0.75 shares no band with probability (1 - 0.75 ** 6) ** 48, under 1 in 10,000.
#: Of m in n nested shingles both extremes agree with m (m - 1) / (n (n - 1)): 1 in 608 at 3 of 4, 3,019 at 6 of 8, 6,214 at 12 of 16.
BANDS, VALUES = 48, 6
PERMUTATIONS = BANDS * VALUES // 2
SEED = 75_000
#: 64-bit words of four bits for each value.
SKETCH = BANDS * VALUES * 4 // 64
#: Parts of a bucket, or of a group of copies, that what holds for all of it is sent to.
SALTS = 64
#: Rounds in which each bucket is compared with a leader, before all that is left of it is compared.
LEADER_ROUNDS = 3
#: Comparisons of one leader that a task makes one after the other.
CHUNK = 1024
#: Nodes, and shingles, of a bucket's block; what is left of a bucket is compared block by block.
BLOCK_NODES, BLOCK_SHINGLES = 1024, 200_000


def signature(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """document x band: a key for each band; document x word: four bits of each value. Documents without shingles have zeros."""
    some = np.flatnonzero(counts)
    out, bits = np.zeros((len(counts), BANDS), np.uint64), np.zeros((len(counts), SKETCH), np.uint64)
    if not len(some):
        return out, bits
    starts = (np.cumsum(counts) - counts)[some]
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    rng = np.random.default_rng(SEED)
    factors = rng.integers(0, 1 << 32, PERMUTATIONS, np.uint32) | np.uint32(1)
    shifts = rng.integers(0, 1 << 32, PERMUTATIONS, np.uint32)
    places = rng.integers(0, 1 << 63, (BANDS, VALUES), np.uint64) | np.uint64(1)
    for band in range(BANDS):
        key = np.full(len(some), band + 1, np.uint64)
        for i in range(VALUES // 2):
            p = band * VALUES // 2 + i
            permuted = short * factors[p] + shifts[p]
            permuted ^= permuted >> np.uint32(16)
            permuted *= np.uint32(0x85EBCA6B)
            for k, extreme in enumerate((np.minimum, np.maximum)):
                value = extreme.reduceat(permuted, starts).astype(np.uint64)
                key += value * places[band, 2 * i + k]
                # bits that do not decide which value is extreme, equal where the values are
                at = 4 * (2 * p + k)
                bits[some, at // 64] |= (mix(value) & np.uint64(15)) << np.uint64(at % 64)
        out[some, band] = mix(key)
    return out, bits


def signatures(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, n_shingles, h1, h2, bands, sketch: h1 and h2 together stand for the whole shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            hashes, counts = shingles(batch.column("text").cast(pa.binary()).to_pylist(), SHINGLE)
            bands, bits = signature(hashes, counts)
            ends = np.concatenate([[0], np.cumsum(counts)])
            sums = [np.diff(np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes + np.uint64(k)), dtype=np.uint64)])[ends]).view(np.int64) for k in (1, 2)]
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.view(np.int64).ravel())) for m in (bands, bits)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts.astype(np.int64)), *map(pa.array, sums), *lists], names=["doc_id", "n_shingles", "h1", "h2", "bands", "sketch"])

    source = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return source.mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>, sketch array<long>")


def confirm(pairs: DataFrame, texts: DataFrame, similar: int) -> DataFrame:
    """Those of pairs (a, b) whose full shingle sets have the similarity.

    A leader a is sent with each CHUNK of its partners, and a task streams
    through partners holding one leader's set: no group is collected, however large.
    """
    sized = pairs.groupBy("a").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    members = pairs.join(sized, "a").select("a", F.expr("pmod(xxhash64(b), chunks)").alias("chunk"), F.col("b").alias("node"), F.lit(False).alias("leads"))
    leaders = sized.select("a", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.col("a").alias("node"), F.lit(True).alias("leads"))
    asked = members.unionByName(leaders)
    # documents whose id repeats have one row for each text
    met = asked.join(texts, asked.node == texts.doc_id).select("a", "chunk", "leads", "node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, own = None, []
        for batch in slices(batches, "text", SLICE):
            hashes, counts = shingles(batch.column("text").cast(pa.binary()).to_pylist(), SHINGLE)
            ends = np.cumsum(counts)
            found = []
            for i, (a, chunk, leads, node) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:4]), strict=True)):
                one = hashes[ends[i] - counts[i] : ends[i]]
                if (a, chunk) != place:
                    place, own = (a, chunk), []
                if leads:
                    own.append(one.copy())
                    continue
                for leader in own:
                    small, large = (one, leader) if len(one) <= len(leader) else (leader, one)
                    at = np.searchsorted(large, small)
                    both = int((large[np.minimum(at, len(large) - 1)] == small).sum()) if len(large) else 0
                    if both and 100 * both >= similar * (len(one) + len(leader) - both):
                        found.append((a, node))
                        break
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])

    return met.repartition("a", "chunk").sortWithinPartitions("a", "chunk", F.desc("leads")).mapInArrow(run, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component: the smallest node that each linked node reaches, by large and small stars until nothing changes."""

    state = [F.count("*").alias("n"), F.sum(F.expr("xxhash64(a, b) >> 8")).alias("h")]
    # a > b throughout
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    before = edges.agg(*state).first().asDict()
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        seen = Observation()
        edges = written(small.observe(seen, *state), "stars")
        if seen.get == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = seen.get


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", *, similar: int = SIMILAR) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of df.

    Texts are linked from similar hundredths of Jaccard similarity of their sets
    of 5-word shingles; component_id is the smallest id reachable over links. A
    null text, or one without words, has no shingles and is linked with nothing.
    A text of fewer than five words is one shingle. Rows that share an id count
    as one document in links. A row without id is linked with nothing either:
    its component_id is null and it is kept. Columns other than these two are
    not read.
    """
    plain = few_rows(df).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    docs = written(signatures(plain, "doc_id", "text"), "signatures")
    full = docs.where("n_shingles > 0 and doc_id is not null")
    sets = full.groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("node"))
    copies = _with_group(full.select("doc_id", "n_shingles", "h1", "h2"), ["h1", "h2", "n_shingles"], "doc_id", [F.min("doc_id").alias("node")], [F.min("node").alias("node")])
    whole = written(copies.select("doc_id", "n_shingles", "node"), "members")
    nodes = full.join(sets.select("h1", "h2", F.col("node").alias("doc_id")), ["h1", "h2", "doc_id"]).select(F.col("doc_id").alias("node"), F.explode("bands").alias("band"))
    shared = nodes.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    # rows that repeat an id may repeat here; pairs are made distinct. So a large bucket's rows can be split over tasks
    buckets = written(nodes.join(shared.select("band", "low"), "band").select("band", "node", "low"), "buckets")

    # the texts of all that is compared, and of few others, where they are read: no text is shuffled before it is asked for
    texts = written(perhaps_among(plain, "doc_id", buckets.select(F.col("node").alias("doc_id"))).where("__perhaps").drop("__perhaps"), "texts")
    pairs = written(buckets.where("node > low").select(F.col("low").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    checked = pairs
    reached, left = components(written(confirm(pairs, texts, similar), "confirmed")), buckets
    for step in range(1, LEADER_ROUNDS + 1):
        left = written(_divided(left, reached), "divided")
        if left.isEmpty():
            break
        if step < LEADER_ROUNDS:
            pairs = written(_led(left, step).join(checked, ["a", "b"], "left_anti"), "pairs")
            found = written(confirm(pairs, texts, similar), "confirmed")
            checked = checked.unionByName(pairs)
        else:
            found = written(compare_blocks(left, full, texts, similar), "confirmed")
        if not found.isEmpty():
            # from the stars there are, which take fewer rounds than all links anew
            reached = components(found.unionByName(reached.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    placed = whole.join(reached, "node", "left").select("doc_id", "n_shingles", F.coalesce("component", "node").alias("component_id"))
    alone = docs.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return placed.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _with_group(rows: DataFrame, key: list[str], member: str, each: list[Column], over: list[Column], keep: str = "true") -> DataFrame:
    """rows with what is aggregated over their group: over of each. Groups are dealt by key and SALTS parts of their members, so that a large one is in no single task."""
    salted = rows.withColumn("salt", F.expr(f"pmod(xxhash64({member}), {SALTS})"))
    parts = salted.groupBy(*key, "salt").agg(*each)
    whole = parts.groupBy(*key).agg(*over).where(keep)
    return salted.join(parts.select(*key, "salt").join(whole, key), [*key, "salt"]).drop("salt")


def _divided(buckets: DataFrame, reached: DataFrame) -> DataFrame:
    """Rows of the buckets that hold more than one component, with the component."""
    named = buckets.select("band", "node").join(reached, "node", "left").select("band", "node", F.coalesce("component", "node").alias("component"))
    extremes = [F.min("component").alias("low"), F.max("component").alias("high")]
    return _with_group(named, ["band"], "node", extremes, [F.min("low").alias("low"), F.max("high").alias("high")], "low < high").select("band", "node", "component")


def _ordered(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _led(rows: DataFrame, step: int) -> DataFrame:
    """Each node of a bucket with the bucket's leader of this round, where their components differ."""
    first = F.min(F.struct(F.xxhash64("node", "band", F.lit(step)).alias("h"), F.col("node").alias("leader"), F.col("component").alias("of"))).alias("l")
    led = _with_group(rows, ["band"], "node", [first], [F.min("l").alias("l")]).select("node", "component", "l.leader", "l.of")
    return led.where("component <> of").select(*_ordered("leader", "node")).distinct()


def least_agreeing(similar: int) -> int:
    """Values of a sketch that agree in any pair worth confirming: six deviations below what the similarity gives.

    At s, s + (1 - s) / 16 agree. The two values of a permutation may depend on each
    other wholly, which makes the variance at most twice that of independent ones.
    """
    n, p = BANDS * VALUES, similar / 100 + (1 - similar / 100) / 16
    return int(n * p - 6 * (2 * n * p * (1 - p)) ** 0.5)


def compare_blocks(rows: DataFrame, docs: DataFrame, texts: DataFrame, similar: int) -> DataFrame:
    """Pairs (a, b) of the similarity among all nodes of a bucket whose components differ.

    A bucket is cut in blocks, and each block meets each other in a task of its
    own, so no bucket is too large. In it sizes and sketches refute most pairs;
    the full sets decide on the rest, each pair in the first band that it shares.
    """
    known = docs.select(F.col("doc_id").alias("node"), "n_shingles", "bands", "sketch")
    sized = rows.join(known, "node")
    blocks = F.greatest(F.ceil(F.sum("shingles") / BLOCK_SHINGLES), F.ceil(F.sum("nodes") / BLOCK_NODES)).alias("blocks")
    cut = _with_group(sized, ["band"], "node", [F.sum("n_shingles").alias("shingles"), F.count("*").alias("nodes")], [blocks])
    placed = cut.withColumn("block", F.expr("pmod(xxhash64(node), blocks)")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    asked = placed.select("band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "component", "n_shingles", "bands", "sketch")
    met = asked.join(texts, asked.node == texts.doc_id).select(*asked.columns, "text")
    least = least_agreeing(similar)

    def compare(group: list[dict]) -> list[tuple[int, int]]:
        band, across = group[0]["band"], group[0]["i"] != group[0]["j"]
        sketch, bands = (np.array([r[c] for r in group], np.int64).view(np.uint64) for c in ("sketch", "bands"))
        node, component, size, block = (np.array([r[c] for r in group], np.int64) for c in ("node", "component", "n_shingles", "block"))
        hashes, counts = shingles([r["text"].encode() for r in group], SHINGLE)
        ends, own = np.cumsum(counts), np.uint64(band & 0xFFFFFFFFFFFFFFFF)
        found = []
        for x in range(len(group)):
            may = (component != component[x]) & (node > node[x]) & (100 * np.minimum(size, size[x]) >= similar * np.maximum(size, size[x]))
            if across:
                may &= block != block[x]
            at = np.flatnonzero(may)
            if not len(at):
                continue
            unlike = sketch[at] ^ sketch[x]
            unlike |= unlike >> np.uint64(2)
            unlike |= unlike >> np.uint64(1)
            at = at[BANDS * VALUES - np.bitwise_count(unlike & np.uint64(0x1111111111111111)).sum(axis=1) >= least]
            at = at[bands[at, (bands[at] == bands[x]).argmax(axis=1)] == own]
            one = hashes[ends[x] - counts[x] : ends[x]]
            for y in at.tolist():
                other = hashes[ends[y] - counts[y] : ends[y]]
                common = int((one[np.minimum(np.searchsorted(one, other), len(one) - 1)] == other).sum())
                if 100 * common >= similar * (len(one) + len(other) - common):
                    found.append((int(node[x]), int(node[y])))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, group, found = None, [], []

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])
            found.clear()
            return batch

        for batch in slices(batches, "text", SLICE):
            for row in batch.to_pylist():
                key = row["band"], row["i"], row["j"]
                if key != place and group:
                    found += compare(group)
                    group = []
                place = key
                group.append(row)
            if found:
                yield out()
        if group:
            found += compare(group)
        yield out()

    return met.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j").mapInArrow(run, "a long, b long").distinct()


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents"))


QUERIES = {"op4_minhash_dedup": op4_minhash_dedup}
ORACLE_SQL = {
    "op4_minhash_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN []
         WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
         ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i : i + 4], ' ')) END) AS grams
  FROM w
), g AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM s
), inter AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS common
  FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM inter WHERE 100 * common >= 75 * (na + nb - common)
), e AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(node, root) AS (
  SELECT doc_id, doc_id FROM s
  UNION
  SELECT e.b, r.root FROM reach r JOIN e ON e.a = r.node WHERE r.root < e.b
), c AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node)
SELECT s.doc_id, CAST(len(grams) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept
FROM s JOIN c ON c.node = s.doc_id
"""
}
