"""Exact top-k search with block-at-a-time pruning.

Vectors become whole numbers and are kept in document-range blocks. A block has a
forward index, its vectors row by row, and the largest and smallest value of each
term (component). For a query, the sum over terms of the larger of weight times
maximum and weight times minimum bounds every score in the block. Blocks are taken
in order of that bound, scored through the forward index, until it falls below the
query's k-th score.

Parts of the index are searched in rounds, each of about as many parts as all
before it; a round starts from the k-th scores that are known by then. So of each
query a round returns about k rows, however many parts it searches. From the second
round on only the extremes of a part, a few kilobytes, meet each batch of queries:
where no bound reaches a known k-th score, the part's vectors are not sent at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluice.llm.common import load, written

SCALE = 64
#: Vectors in a block, blocks in a part of the index, queries in a batch. A task meets one part with one batch at a time.
BLOCK, PART, BATCH = 1024, 32, 1024


def quantised(vector: str | Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component; null if the vector or a component is null or not finite."""
    v = F.col(vector) if isinstance(vector, str) else vector
    bad = F.exists(v, lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(True)))
    return F.when(~bad, F.transform(v, lambda x: F.floor(scale * x.cast("double"))))


def _packed(vectors: DataFrame, rows: int, block: int) -> DataFrame:
    """Consecutive rows (id, v) packed: part, n, width, block, ids, matrix, and the largest and smallest values of each block of rows; part is unique."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ids, vectors = TaskContext.get().partitionId() << 32, [], []

        def out() -> pa.RecordBatch:
            width = max(map(len, vectors))
            matrix = np.zeros((len(vectors), width), np.int64)
            for i, v in enumerate(vectors):
                matrix[i, : len(v)] = v
            extremes = [_bytes(np.stack([f(matrix[a : a + block], axis=0) for a in range(0, len(ids), block)])) for f in (np.max, np.min)]
            return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([len(ids)]), pa.array([width]), pa.array([block]), *(pa.array([x]) for x in (np.array(ids, "<i8").tobytes(), _bytes(matrix), *extremes))], names=["part", "n", "width", "block", "ids", "matrix", "high", "low"])

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False), strict=True):
                ids.append(i)
                vectors.append(np.asarray(v, np.int64))
                if len(ids) == rows:
                    yield out()
                    part, ids, vectors = part + 1, [], []
        if ids:
            yield out()

    return vectors.mapInArrow(run, "part long, n long, width long, block long, ids binary, matrix binary, high binary, low binary")


def _bytes(matrix: np.ndarray) -> bytes:
    """The matrix in the smallest whole numbers that hold it; their size is the first byte."""
    top = int(np.abs(matrix).max(initial=0))
    size = next(s for s in (1, 2, 4, 8) if top < 1 << (8 * s - 1) or s == 8)
    return bytes([size]) + matrix.astype(f"<i{size}").tobytes()


def _matrix(raw: bytes, n: int, width: int) -> np.ndarray:
    return np.frombuffer(raw, f"<i{raw[0]}", offset=1).reshape(n, width)


def _exact(a: np.ndarray, b: np.ndarray) -> type:
    """The fastest kind of number in which inner products of these rows are exact."""
    top = int(np.abs(a).max(initial=0).astype(object)) * int(np.abs(b).max(initial=0).astype(object)) * max(1, a.shape[1])
    if top >= 1 << 63:
        raise OverflowError("inner products may not fit in 64 bits")
    return np.float32 if top < 1 << 24 else np.float64 if top < 1 << 53 else np.int64


def _padded(matrix: np.ndarray, width: int) -> np.ndarray:
    return np.pad(matrix, ((0, 0), (0, width - matrix.shape[1])))


def search_part(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, block: int = BLOCK, *, extremes: tuple[np.ndarray, np.ndarray] | None = None, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query row, id, score) of each query's k best in this part that reach its floor, and how many blocks were scored.

    Equal scores go to the smaller id. A vector with the query's own id is left
    out. extremes: the largest and smallest values of each block, if they are known.
    """
    width = max(queries.shape[1], vectors.shape[1])
    if extremes is None:
        extremes = tuple(np.stack([f(vectors[a : a + block], axis=0) for a in range(0, len(ids), block)]) for f in (np.max, np.min))
    queries, vectors, *extremes = (_padded(m, width) for m in (queries, vectors, *extremes))
    kind = _exact(queries, vectors)
    q, x = queries.astype(kind), vectors.astype(kind)
    cuts = range(0, len(ids), block)
    high, low = (m.astype(kind) for m in extremes)
    bounds = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    order = np.argsort(-bounds, axis=1, kind="stable")
    empty = np.iinfo(np.int64).min
    best_score, best_id = np.full((len(q), k), empty), np.zeros((len(q), k), np.int64)
    floors = np.full(len(q), empty) if floor is None else floor
    scored, active = 0, np.arange(len(q))
    for step in range(len(cuts)):
        at = order[active, step]
        # bounds fall along a query's order: below the k-th score nothing can follow
        active = active[bounds[active, at] >= np.maximum(best_score[active, -1], floors[active])]
        if not len(active):
            break
        at = order[active, step]
        for b in np.unique(at):
            rows = active[at == b]
            own = slice(b * block, b * block + block)
            scores = (q[rows] @ x[own].T).astype(np.int64)
            scores[query_ids[rows][:, None] == ids[own][None, :]] = empty
            scored += len(rows)
            least = np.maximum(best_score[rows, -1], np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] > k else empty + 1)
            i, j = np.nonzero(scores >= np.maximum(np.maximum(least, floors[rows]), empty + 1)[:, None])
            who = np.concatenate([np.repeat(np.arange(len(rows)), k), i])
            value = np.concatenate([best_score[rows].ravel(), scores[i, j]])
            name = np.concatenate([best_id[rows].ravel(), ids[own][j]])
            sort = np.lexsort((name, -value.astype(np.float64) if kind is not np.int64 else np.negative(value, where=value > empty, out=np.full_like(value, np.iinfo(np.int64).max)), who))
            who, value, name = who[sort], value[sort], name[sort]
            first = np.searchsorted(who, np.arange(len(rows)))
            take = first[:, None] + np.arange(k)
            best_score[rows], best_id[rows] = value[take], name[take]
    row, place = np.nonzero(best_score > empty)
    return row, best_id[row, place], best_score[row, place], scored


def _extremes(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """The largest and smallest values of a part's blocks; how large its blocks are the part says itself."""
    blocks = -(-row["n"] // row["block"])
    return _matrix(row["high"], blocks, row["width"]), _matrix(row["low"], blocks, row["width"])


def _floors(row: dict, query_ids: np.ndarray) -> np.ndarray:
    """The known k-th score of each query of a batch; the least number where none is known."""
    floor = np.full(len(query_ids), np.iinfo(np.int64).min)
    for i, least in zip(row["known"] or (), row["least"] or (), strict=True):
        floor[np.searchsorted(query_ids, i)] = least
    return floor


def promising(pairs: DataFrame, index: DataFrame, asked: DataFrame, floors: DataFrame) -> DataFrame:
    """Of pairs (part, batch) those in which some block's bound reaches some query's known k-th score. Vectors of parts are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for r in batch.to_pylist():
                query_ids = np.frombuffer(r["qids"], "<i8")
                queries, (high, low) = _matrix(r["qmatrix"], len(query_ids), r["qwidth"]), _extremes(r)
                width = max(queries.shape[1], high.shape[1])
                queries, high, low = (_padded(m, width) for m in (queries, high, low))
                kind = _exact(queries, np.concatenate([high, low]))
                queries, high, low = (m.astype(kind) for m in (queries, high, low))
                bounds = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
                if (bounds.max(axis=1) >= _floors(r, query_ids)).any():
                    kept.append(r)
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in kept], t) for c, t in (("part", pa.int64()), ("batch", pa.int32()))], names=["part", "batch"])

    met = pairs.join(index.select("part", "n", "width", "block", "high", "low"), "part").join(asked, "batch").join(floors, "batch", "left")
    return met.select("part", "batch", "qids", "qmatrix", "qwidth", "n", "width", "block", "high", "low", "known", "least").mapInArrow(run, "part long, batch int")


def _batches(queries: DataFrame, count: int) -> DataFrame:
    """Queries (id, v) in count batches by a hash of their ids: batch, qids, qwidth, qmatrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, vectors = None, [], []

        def out() -> pa.RecordBatch:
            width = max(map(len, vectors))
            matrix = np.stack([np.pad(v, (0, width - len(v))) for v in vectors])
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), *(pa.array([x]) for x in (np.array(ids, "<i8").tobytes(), width, _bytes(matrix)))], names=["batch", "qids", "qwidth", "qmatrix"])

        for rows in batches:
            for batch, i, v in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), rows.column(2).to_numpy(zero_copy_only=False), strict=True):
                if batch != at and ids:
                    yield out()
                    ids, vectors = [], []
                at = batch
                ids.append(i)
                vectors.append(np.asarray(v, np.int64))
        if ids:
            yield out()

    dealt = queries.select(F.pmod(F.xxhash64("id"), F.lit(count)).cast("int").alias("batch"), "id", "v")
    # a task for each batch
    return dealt.repartitionById(count, "batch").sortWithinPartitions("batch", "id").mapInArrow(run, "batch int, qids binary, qwidth long, qmatrix binary")


def top_k_search(vectors: DataFrame, queries: DataFrame, k: int = 20, *, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """query_id, rank from 1, vec_id, score: each query's k highest inner products, ties to the smaller id.

    Null ids and vectors that are null or hold null or non-finite components take
    no part. Vectors of unequal length count as padded with 0. Rows of vectors
    that repeat an id are candidates each; of queries that repeat an id, the
    smallest vector counts. Vectors whose inner products may not fit in 64 bits
    are an error. Every batch of queries meets every part of the index, as one
    packed row with another: rows are never paired.
    """
    clean = lambda df: df.select(F.col(vec_id).cast("long").alias("id"), quantised(vector, scale).alias("v")).where("id is not null and v is not null")
    index = written(_packed(clean(vectors), BLOCK * PART, BLOCK), "vector-index")
    asked = written(clean(queries).groupBy("id").agg(F.min("v").alias("v")), "queries")
    count = max(1, -(-asked.count() // BATCH))
    asked = written(_batches(asked, count), "query-index")
    # a part's round: the first has about one part, each later one as many as all before it
    rounds = max(0, index.count() - 1).bit_length()
    level = F.greatest(F.lit(0), rounds - F.floor(F.log2(F.lit(2.0**rounds) / (1 + F.pmod(F.xxhash64("part"), F.lit(1 << rounds))))))
    placed = index.withColumn("round", level.cast("int"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                query_ids = np.frombuffer(r["qids"], "<i8")
                queries, own = _matrix(r["qmatrix"], len(query_ids), r["qwidth"]), _matrix(r["matrix"], r["n"], r["width"])
                row, name, score, _ = search_part(query_ids, queries, np.frombuffer(r["ids"], "<i8"), own, k, r["block"], extremes=_extremes(r), floor=_floors(r, query_ids))
                yield pa.RecordBatch.from_arrays([pa.array(query_ids[row]), pa.array(name), pa.array(score)], names=["query_id", "vec_id", "score"])

    best = None
    for step in range(rounds + 1):
        own = placed.where(F.col("round") == step).drop("round")
        # the stated query set against all rows, in blocks: one row for each part and batch of queries
        pairs = own.select("part", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("batch")).repartition("part", "batch")
        if best is None:
            met = pairs.join(own, "part").join(asked, "batch").withColumns({"known": F.lit(None).cast("array<long>"), "least": F.lit(None).cast("array<long>")})
        else:
            # of queries with k rows by now, the k-th score; at most BATCH or so in a batch
            full = best.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") == k)
            floors = full.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(count)).cast("int").alias("batch")).agg(F.collect_list(F.struct("query_id", "least")).alias("f"))
            floors = written(floors.select("batch", F.col("f.query_id").alias("known"), F.col("f.least").alias("least")), "floors")
            met = promising(pairs, own, asked, floors).repartition("part", "batch").join(own, "part").join(asked, "batch").join(floors, "batch", "left")
        found = met.select("qids", "qmatrix", "qwidth", "ids", "matrix", "n", "width", "block", "high", "low", "known", "least").mapInArrow(search, "query_id long, vec_id long, score long")
        candidates = found if best is None else best.drop("rank").unionByName(found)
        ranked = candidates.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
        best = ranked if step == rounds else written(ranked, "best")
    return best.select("query_id", "rank", "vec_id", "score")


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = load(spark, sf_dir, "embeddings")
    return top_k_search(vectors, vectors.where("vec_id % 20 = 0"))


QUERIES = {"op6_top_k": op6_top_k}
ORACLE_SQL = {
    "op6_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE a.vec_id % 20 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
}
