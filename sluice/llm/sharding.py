"""Sharding on a consistent-hash ring with virtual nodes and bounded loads, in DataFrame functions alone.

A ring of CELLS places holds the virtual nodes of all shards. Texts hash to a cell,
so equal texts share one; a group of equal texts that is a large part of all bytes
or rows is cut into parts with cells of their own. A cell goes to the shard of the
first virtual node clockwise that is not full, in falling order of bytes. Shards
are full from (1 + SLACK) times their fair share on, so what overflows continues
clockwise, all else stays where the ring alone has it, and sizes are near equal.

The ring is a constant of shards and virtual nodes. What depends on data is summed
up to CELLS rows, over which the walk runs as one fold; rows meet their cell's
shard in a broadcast join of that bounded table.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluice.llm.common import load, written

SHARDS, VIRTUAL = 16, 256
#: Places of the ring; each holds about 1 / CELLS of the texts and moves as a whole.
CELLS = 1 << 14
#: A shard is full from (1 + SLACK) times its fair share on. With 0 sizes are as near equal as cells allow; with more, fewer texts overflow and move.
SLACK = 0.0
#: A group of equal texts is cut where it is over half a shard's share of all bytes, or over 1 / PARTS of all rows and LEAST_ROWS, into parts of 1 / PARTS.
PARTS, LEAST_ROWS = 1024, 64
#: Digits that name a shard in the fold.
DIGITS = 5


def ring(shards: int = SHARDS, virtual: int = VIRTUAL, cells: int = CELLS) -> tuple[list[int], list[list[int]]]:
    """The arc of each cell, and for each arc all shards in the order in which their virtual nodes come clockwise."""
    points = sorted((zlib.crc32(f"shard {s} node {v}".encode()), s) for s in range(shards) for v in range(virtual))
    orders, order = [], []
    # twice around, against the clock: each node's shard moves to the front
    for _, s in (points + points)[::-1]:
        order = [s, *(x for x in order if x != s)]
        orders.append(order)
    orders = orders[::-1][: len(points)]
    width = (1 << 32) // cells
    return [bisect_left(points, (c * width, -1)) % len(points) for c in range(cells)], orders


def _keys(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """id, size, crc, key (the text's hash) and row, which tells rows apart that are equal in all else."""
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    keys = df.select(F.col(doc_id).alias("id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("crc"), F.xxhash64(raw).alias("key"), F.monotonically_increasing_id().alias("row"))
    return written(keys, "shard-keys")


def _in_cells(keys: DataFrame, size: int, rows: int, shards: int = SHARDS) -> DataFrame:
    """keys with their cell. Parts of a group that is cut are dealt by hash; at most PARTS + 2 * shards groups are."""
    groups = keys.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    many = F.col("n") > max(rows / PARTS, LEAST_ROWS)
    large = groups.where((F.col("n") > 1) & ((F.col("bytes") > size / (2 * shards)) | many))
    parts = F.ceil(F.greatest(F.col("bytes") * (PARTS / max(1, size)), F.col("n") * (PARTS / max(1, rows))))
    cut = large.select("key", parts.alias("parts"))
    part = F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("id", "row"), F.col("parts")))
    return keys.join(F.broadcast(cut), "key", "left").withColumn("cell", F.pmod(F.xxhash64("key", part), F.lit(CELLS)).cast("int")).drop("parts")


def _walk(cells: Column, full: Column, shards: int) -> Column:
    """For cells (prefs, bytes) in turn: DIGITS digits each that name the first shard clockwise that is not full."""

    def step(acc: Column, cell: Column) -> Column:
        # some shard is always below its fair share while a cell is left
        first = F.coalesce(F.get(F.filter(cell["prefs"], lambda s: F.get(acc["loads"], s) < full), F.lit(0)), F.get(cell["prefs"], F.lit(0)))
        chosen = lambda pick: F.struct(F.transform(acc["loads"], lambda load, i: F.when(i == pick, load + cell["bytes"]).otherwise(load)).alias("loads"), F.concat(acc["picks"], F.lpad(pick.cast("string"), DIGITS, "0")).alias("picks"))
        return F.transform(F.array(first), chosen)[0]

    start = F.struct(F.array_repeat(F.lit(0).cast("long"), shards).alias("loads"), F.lit("").alias("picks"))
    return F.aggregate(cells, start, step, lambda acc: acc["picks"])


def shard_cells(sums: DataFrame, size: int, shards: int = SHARDS, virtual: int = VIRTUAL, slack: float = SLACK) -> DataFrame:
    """cell, home (its shard on the ring alone), shard and first (rows of the shard in earlier cells) for sums (cell, bytes, n)."""
    arcs, orders = ring(shards, virtual)
    arc = F.get(F.from_json(F.lit(json.dumps(arcs)), "array<int>"), F.col("cell"))
    prefs = F.get(F.from_json(F.lit(json.dumps(orders)), "array<array<int>>"), arc)
    # in falling order of bytes, then by cell
    ordered = sums.select(F.struct((-F.col("bytes")).alias("order"), "cell", "bytes", "n", prefs.alias("prefs")).alias("c"))
    turns = ordered.agg(F.sort_array(F.collect_list("c")).alias("cells"))
    full = F.lit(size * (1 + slack) / shards)
    walked = turns.select("cells", _walk(F.col("cells"), full, shards).alias("picks")).select("picks", F.posexplode("cells").alias("at", "c"))
    pick = F.expr(f"cast(substring(picks, at * {DIGITS} + 1, {DIGITS}) as int)")
    placed = walked.select("c.cell", "c.n", F.get("c.prefs", F.lit(0)).alias("home"), pick.alias("shard"))
    before = F.sum("n").over(W.partitionBy("shard").orderBy("cell").rowsBetween(W.unboundedPreceding, -1))
    return placed.select("cell", "home", "shard", F.coalesce(before, F.lit(0)).alias("first"))


def shard_documents(df: DataFrame, shards: int = SHARDS, *, doc_id: str = "doc_id", text: str = "text", virtual: int = VIRTUAL, slack: float = SLACK) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and home_shard of every row.

    size is the text's UTF-8 bytes plus 1; a null text counts as an empty one, and
    has its group. The law is bytes: shards are as large as (1 + slack) times their
    share and one cell more, at most; grown_shard is null, since shards also depend
    on loads. slot numbers a shard's rows from 0 without gaps, cell by cell.
    home_shard is where the ring alone has the row: rows for which it differs have
    overflowed. Rows that repeat an id, or have none, are rows like all others;
    repeated rows have slots of their own. Of an empty table nothing comes back.
    Further columns are left out, whatever their names. Up to 99,999 shards.
    """
    keys = _keys(df, doc_id, text)
    total = keys.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.count("*").alias("n")).first()
    dealt = _in_cells(keys, total["size"], total["n"], shards)
    sums = dealt.groupBy("cell").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    # at most CELLS rows
    placed = F.broadcast(shard_cells(sums, total["size"], shards, virtual, slack))
    numbered = dealt.withColumn("place", F.row_number().over(W.partitionBy("cell").orderBy("key", "id", "row")) - 1)
    return numbered.join(placed, "cell").select(
        F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("place")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("home").alias("home_shard")
    )


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(load(spark, sf_dir, "documents"))


QUERIES = {"op11_sharding": op11_sharding}
