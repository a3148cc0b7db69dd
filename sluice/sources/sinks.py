"""Sinks: appends that repeat without effect, versioned upserts, and change records."""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluice.operators.joins import insert_absent, merge_latest


def append_absent(spark: SparkSession, rows: DataFrame, path: str, key: Sequence[str]) -> int:
    """Appends rows whose key the table at path does not have; returns how many. Of rows that share a key one is written. One writer at a time."""
    fresh = rows.dropDuplicates(list(key))
    if _exists(spark, path):
        fresh = insert_absent(fresh, spark.read.parquet(path), key)
    seen = Observation()
    fresh.observe(seen, F.count("*").alias("n")).write.mode("append").parquet(path)
    return int(seen.get["n"])


def upsert_version(spark: SparkSession, changes: DataFrame, path: str, version: int, key: Sequence[str], order: Sequence[Column], buckets: int = 64) -> list[int]:
    """Merges changes into a table of buckets by key, and returns the buckets that were written anew.

    Only buckets with a change are read and rewritten, as path/data/v=<version>/b=<bucket>;
    the commit path/commits/v=<version> then says in which version each bucket lies. So
    what is written grows with the batch, not with the table. A repeated version starts
    from the commits before it and replaces itself; without its commit it was never
    there. buckets is part of the table: take as many as make a bucket a task's work.
    """
    base, bucket = _buckets(spark, path, before=version), _bucket(key, buckets)
    dealt, folder = changes.withColumn("b", bucket), f"{path}/data/v={version:09d}"
    if base:
        dealt = dealt.persist()
    try:
        # at most as many rows as there are buckets; a first version has nothing to read, and is made in one pass
        touched = sorted(r["b"] for r in dealt.select("b").distinct().collect()) if base else list(range(buckets))
        held = [f"{path}/data/v={base[b]:09d}/b={b}" for b in touched if b in base]
        old = spark.read.schema(changes.schema).parquet(*held).withColumn("b", bucket) if held else dealt.limit(0)
        if touched:
            # dealt by bucket, rows of a key meet where the bucket is written
            merge_latest(old, dealt, ["b", *key], order, (_parts(touched), "b")).write.mode("overwrite").partitionBy("b").parquet(folder)
        if not base:
            touched = _written_buckets(spark, folder)
    finally:
        if base:
            dealt.unpersist()
    rows = sorted((base | dict.fromkeys(touched, version)).items())
    spark.createDataFrame(rows, "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/v={version:09d}")
    return touched


def delete_rows(spark: SparkSession, doomed: DataFrame, path: str, audit: str, version: int, key: Sequence[str], at: Column, buckets: int = 64) -> DataFrame:
    """Deletes rows from a table of upsert_version by key, and returns the audit rows of this version.

    The audit comes first: what goes is written to audit/v=<version>, whole and with
    the time, before any bucket is rewritten without it. A repeated version starts
    from the commits before it, so it writes the same and nothing goes twice.
    """
    table, base = latest(spark, path, before=version), _buckets(spark, path, before=version)
    if table is None:
        raise ValueError(f"there is no table at {path}")
    bucket, folder = _bucket(key, buckets), f"{path}/data/v={version:09d}"

    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema if f.name not in key]
    # null keys are equal to nothing
    asked = doomed.select(*key).dropna().select(*key, *none).select(*table.columns, F.lit(1).alias("__goes"))
    both = table.select("*", F.lit(0).alias("__goes")).unionByName(asked).withColumn("b", bucket)
    # dealt by bucket, rows and keys meet where the bucket is written: the table is shuffled once, for the audit and the rest
    goes = F.max("__goes").over(W.partitionBy("b", *key)) == 1
    marked = both.repartition(_parts(base), "b").withColumn("__gone", goes).where("__goes = 0").drop("__goes").persist()
    try:
        gone = marked.where("__gone").select(*key, *(c for c in table.columns if c not in key)).withColumn("deleted_at", at)
        gone.write.mode("overwrite").parquet(f"{audit}/v={version:09d}")
        gone = spark.read.schema(gone.schema).parquet(f"{audit}/v={version:09d}")
        touched = sorted(r["b"] for r in gone.select(bucket.alias("b")).distinct().collect())
        if touched:
            marked.where(~F.col("__gone") & F.col("b").isin(touched)).select(*table.columns, "b").write.mode("overwrite").partitionBy("b").parquet(folder)
    finally:
        marked.unpersist()
    # a bucket that is empty now has no folder
    left = set(_written_buckets(spark, folder)) if touched else set()
    moved = {b: v for b, v in base.items() if b not in touched} | dict.fromkeys(sorted(left & set(touched)), version)
    spark.createDataFrame(sorted(moved.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/v={version:09d}")
    return gone


def _bucket(key: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def _parts(buckets: Collection[int]) -> int:
    """Parts to deal buckets in: so many that few share one."""
    return max(1, 2 * len(buckets))


def _written_buckets(spark: SparkSession, folder: str) -> list[int]:
    return sorted(int(n[2:]) for n in _names(spark, folder) if n.startswith("b="))


def _names(spark: SparkSession, path: str) -> list[str]:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def _buckets(spark: SparkSession, path: str, before: int | None = None) -> dict[int, int]:
    """The version in which each bucket of a table lies, as the last commit says."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/commits")
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return {}
    names = sorted(s.getPath().getName() for s in fs.listStatus(root) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))
    names = [n for n in names if n.startswith("v=") and (before is None or int(n[2:]) < before)]
    return {r["bucket"]: r["version"] for r in spark.read.schema("bucket int, version long").parquet(f"{path}/commits/{names[-1]}").collect()} if names else {}


def latest(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The table that upsert_version writes, as of its last commit; None where it holds nothing."""
    found = _buckets(spark, path, before)
    return spark.read.parquet(*(f"{path}/data/v={v:09d}/b={b}" for b, v in sorted(found.items()))) if found else None


def drop_unused(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Removes versions of buckets, and commits, that the last keep commits do not name; returns the folders removed. For when no reader holds older ones."""
    jvm, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    fs = jvm.Path(path).getFileSystem(conf)
    commits = sorted(s.getPath().getName() for s in fs.listStatus(jvm.Path(f"{path}/commits")))
    used: set[str] = set()
    for name in commits[-keep:]:
        used |= {f"v={v:09d}/b={b}" for b, v in _buckets(spark, path, before=int(name[2:]) + 1).items()}
    gone = [f"{path}/commits/{c}" for c in commits[:-keep]]
    for version in fs.listStatus(jvm.Path(f"{path}/data")):
        for bucket in fs.listStatus(version.getPath()):
            name = f"{version.getPath().getName()}/{bucket.getPath().getName()}"
            if bucket.isDirectory() and name not in used:
                gone.append(f"{path}/data/{name}")
    for folder in gone:
        fs.delete(jvm.Path(folder), True)
    return gone


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def replace_document(documents: str | Column, new: Column) -> Column:
    """An array of document structs with new in place of the one that has its path."""
    docs = F.col(documents) if isinstance(documents, str) else documents
    return F.array_append(F.filter(docs, lambda d: d["path"] != new["path"]), new)


#: Categories that a document may have, and how large it may be.
DOCUMENT_CATEGORIES, MOST_BYTES = ("specification", "drawing", "addendum", "form", "general"), 100 << 20


def attach_document(df: DataFrame, documents: str, purged: str, new: Column) -> DataFrame:
    """Rows with a new document struct (name, path, category, size) in place of the one at its path, the mark of a purge cleared, and event for what was attached.

    An unknown category is general. Nothing is attached where the document is null, empty
    or larger than MOST_BYTES; event is null there.
    """
    kind = F.when(new["category"].isin(*DOCUMENT_CATEGORIES), new["category"]).otherwise("general")
    own = F.struct(new["name"].alias("name"), new["path"].alias("path"), kind.alias("category"), new["size"].alias("size"))
    fits = F.coalesce(new["size"].between(1, MOST_BYTES), F.lit(False))
    event = F.when(fits, F.struct(F.lit("doc_uploaded").alias("event_type"), F.concat(kind, F.lit(":"), new["name"]).alias("detail")))
    given = F.coalesce(F.col(documents), F.array().cast(df.schema[documents].dataType))
    return df.withColumns({"event": event, documents: F.when(fits, replace_document(given, own)).otherwise(F.col(documents)), purged: F.when(~fits, F.col(purged))})


def purge(df: DataFrame, when: Column, documents: str, purged: str, now: Column) -> DataFrame:
    """Rows for which when holds lose their documents and get the time of it; those without documents stay as they are."""
    hit = when & (F.size(documents) > 0)
    return df.withColumns({documents: F.when(hit, F.filter(documents, lambda _: F.lit(False))).otherwise(F.col(documents)), purged: F.when(hit, now).otherwise(F.col(purged))})


def touch(contacts: DataFrame, messages: DataFrame, key: str, at: str, note: str) -> DataFrame:
    """contacts with last_contact moved on to their latest message, and the notes of messages before their own, newest first."""
    own = messages.groupBy(key).agg(F.max(at).alias("__at"), F.array_join(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct(at, note)))), lambda m: m[note]), "\n").alias("__notes"))
    joined = contacts.join(own, key, "left")
    return joined.withColumns({"last_contact": F.greatest("last_contact", "__at"), "notes": F.when(F.col("__notes").isNotNull(), F.concat_ws("\n", "__notes", "notes")).otherwise(F.col("notes"))}).drop("__at", "__notes")


def run_status(steps: str, errors: str) -> Column:
    """partial if any step failed, failed if all did, else ok."""
    return status_of(F.size(steps), F.size(errors))


def status_of(steps: Column, errors: Column) -> Column:
    return F.when((errors > 0) & (errors >= steps), "failed").when(errors > 0, "partial").otherwise("ok")


def events_of_change(df: DataFrame, key: str, old: str, new: str, at: Column) -> DataFrame:
    """An event for each row whose status changes."""
    return df.where(~F.col(old).eqNullSafe(F.col(new))).select(key, F.lit("status_change").alias("event_type"), F.concat_ws(" -> ", F.coalesce(old, F.lit("")), F.coalesce(new, F.lit(""))).alias("detail"), at.alias("ts"))
