"""Helpers that the corpus operators share."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Lower-cases A-Z only, whatever the locale or script.
ASCII_LOWER = str.maketrans(UPPER, LOWER)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def remainder(doc_id: str | Column, m: int) -> Column:
    """crc32 of the id as text, modulo m: the fold of a row."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % m


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local runs, where it is unset, one of our own. On a cluster it must be set."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not set_dir:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        set_dir = tempfile.mkdtemp(prefix="sluice-")
        spark.sparkContext.setCheckpointDir(set_dir)
    return set_dir.rstrip("/")


#: Folders that fresh_path has named for each application, until drop_owned removes them.
_owned: dict[str, list[str]] = {}


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses. Results that are not read yet may lie there: drop_owned removes it when they are."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _owned.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def drop_owned(spark: SparkSession) -> list[str]:
    """Removes every table, archive and model that this application has written to the shared folder, and returns their paths.

    To be called when results have been read or written elsewhere: frames that are
    still to be read from there fail afterwards.
    """
    paths = _owned.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return paths


def file_system(folder: str):
    """The file system of a folder, and the folder's path on it; a plain path is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if ":/" in folder else (fs.LocalFileSystem(), folder)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, and survives the loss of any executor."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Slots of a bitmap of keys.
SLOTS = 1 << 23


def perhaps_among(df: DataFrame, key: str, keys: DataFrame, slots: int = SLOTS) -> DataFrame:
    """df with __perhaps, false where keys surely do not have the row's key: by a bitmap of slots, sent as at most slots / 64 rows, however many keys there are. So df is not shuffled."""
    slot = F.pmod(F.xxhash64(key), F.lit(slots))
    word, bit = F.floor(slot / 64).cast("int"), (slot % 64).cast("int")
    marks = keys.select(key).groupBy(word.alias("__word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("__marks"))
    met = df.withColumns({"__word": word, "__bit": bit}).join(F.broadcast(marks), "__word", "left")
    hit = F.coalesce(F.call_function("bit_get", F.col("__marks"), F.col("__bit")) == 1, F.lit(False))
    return met.withColumn("__perhaps", hit).drop("__word", "__bit", "__marks")


def tokenizer_file(name: str) -> str:
    """Where a public vocabulary file lies: $SLUICE_TOKENIZERS, else the installed public_tokenizers package."""
    if folder := os.environ.get("SLUICE_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


#: Rows in an Arrow batch between Spark and Python; long texts must not add up.
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def few_rows(df: DataFrame, rows: int = 1024) -> DataFrame:
    """df, whose session from now on sends no more than so many rows at a time to Python."""
    if int(df.sparkSession.conf.get(ARROW_ROWS)) > rows:
        df.sparkSession.conf.set(ARROW_ROWS, str(rows))
    return df


def give_back() -> None:
    """Memory that is free, of Arrow and of the C library, goes back to the system."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches, text: str, max_bytes: int = 4 << 20, max_rows: int = 4096):
    """Arrow batches cut so that each holds at most max_bytes of text, or one row. At the end, freed memory goes back to the system: workers live on."""
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if i > start and (total + n > max_bytes or i - start >= max_rows):
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if len(sizes) > start:
            yield batch.slice(start, len(sizes) - start)
    give_back()
