"""Incremental arrival with Structured Streaming: what is there is processed once, and the next run goes on from the checkpoint."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from sluice.sources.sinks import latest, upsert_version


def work_dir(spark: SparkSession, name: str) -> str:
    """A folder of its own for a stream's state: under spark.checkpoint.dir, or a temporary one in local runs where it is unset. On a cluster it must be set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="sluice-")
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _owned.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


#: Folders that work_dir has named for each application, until drop_work removes them.
_owned: dict[str, list[str]] = {}


def drop_work(spark: SparkSession) -> list[str]:
    """Removes the folders that work_dir has given this application, and returns them. For when their results have been read; a stream that is to go on keeps a folder of its own."""
    paths = _owned.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return paths


def arriving(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A stream of a table's files."""
    path = f"{sf_dir}/{table}.parquet"
    # as a glob, so that a table may be a folder or a single file
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/{table}.parque[t]")


def run_available(stream: DataFrame, folder: str, each: Callable[[DataFrame, int], None] | None = None, mode: str = "append") -> StreamingQuery:
    """Processes all that has arrived, with its state under folder/state; appends to folder/out, or calls each for every batch. Returns the ended query, whose progress says what its state held."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    query = writer.foreachBatch(each).start() if each else writer.format("parquet").start(f"{folder}/out")
    query.awaitTermination()
    return query


def once_per_key(stream: DataFrame, key: Sequence[str], at: str, within: str) -> DataFrame:
    """The first arrival of each key; a key that comes again within the watermark is dropped, after it the state is."""
    return stream.withWatermark(at, within).dropDuplicatesWithinWatermark(list(key))


def windowed(stream: DataFrame, at: str, length: str, late: str, key: Sequence[str], *aggs: Column, slide: str | None = None) -> DataFrame:
    window = F.window(at, length, slide) if slide else F.window(at, length)
    return stream.withWatermark(at, late).groupBy(window.alias("w"), *key).agg(*aggs)


def keep_latest(spark: SparkSession, path: str, key: Sequence[str], order: Sequence[Column]) -> Callable[[DataFrame, int], None]:
    """For run_available: merges each batch into a table of buckets, of which it rewrites those that it touches; a batch that is repeated changes nothing."""

    def each(batch: DataFrame, number: int) -> None:
        upsert_version(spark, batch, path, number, key, order)

    return each


def stream_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    folder = work_dir(spark, "dedupe")
    stream = arriving(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    run_available(once_per_key(stream, ["user_id", "event_type"], "ts", "60 days").select("user_id", "event_type"), folder)
    return spark.read.parquet(f"{folder}/out")


def stream_daily(spark: SparkSession, sf: str) -> DataFrame:
    folder = work_dir(spark, "daily")
    stream = arriving(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    counts = windowed(stream, "ts", "1 day", "2 days", ["event_type"], F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("value"))
    rows = counts.select(F.col("w.start").cast("date").alias("day"), "event_type", "n", "value")
    run_available(rows, folder, keep_latest(spark, f"{folder}/out", ["day", "event_type"], [F.desc("n")]), mode="update")
    return latest(spark, f"{folder}/out")


def stream_latest(spark: SparkSession, sf: str) -> DataFrame:
    folder = work_dir(spark, "latest")
    rows = arriving(spark, sf, "events").select("user_id", "event_id", "ts", "event_type")
    run_available(rows, folder, keep_latest(spark, f"{folder}/out", ["user_id"], [F.desc("ts"), F.desc("event_id")]))
    return latest(spark, f"{folder}/out").select("user_id", "event_id", "event_type")


QUERIES = {"stream_dedupe": stream_dedupe, "stream_daily": stream_daily, "stream_latest": stream_latest}
ORACLE_SQL = {
    "stream_dedupe": "SELECT DISTINCT user_id, event_type FROM events",
    "stream_daily": "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 6) AS value FROM events GROUP BY 1, 2",
    "stream_latest": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1",
}
