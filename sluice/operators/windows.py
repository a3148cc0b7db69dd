"""Ordered sequences: latest and first rows, runs, clusters and budgets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_by(df: DataFrame, key: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key in the order given, which must be total for a defined result."""
    w = W.partitionBy(*key).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def numbered(df: DataFrame, key: Sequence[str], order: Sequence[Column | str], name: str = "n") -> DataFrame:
    return df.withColumn(name, F.row_number().over(W.partitionBy(*key).orderBy(*order)))


def numbered_in_buckets(df: DataFrame, key: Sequence[str], bucket: Column, order: Sequence[Column | str], name: str = "n") -> DataFrame:
    """As numbered, for keys with very many rows: each bucket is numbered by itself, and starts behind the counts of those before it.

    bucket must not fall along the order, and a bucket's rows are one task's.
    """
    placed = df.withColumn("__bucket", bucket)
    sizes = placed.groupBy(*key, "__bucket").agg(F.count("*").alias("__rows"))
    local = numbered(placed, [*key, "__bucket"], order, "__local")
    met = _met(local, _carried(sizes, key, F.sum("__rows"), "__before"), key)
    return met.withColumn(name, (F.col("__local") + F.coalesce("__before", F.lit(0))).cast("int")).select(*df.columns, name)


def last_before(rows: DataFrame, marks: DataFrame, key: str, at: str, value: str, bucket: Column) -> DataFrame:
    """rows with value: that of the latest mark of their key at or before them, the larger of equally late ones; null for none.

    Rows and marks meet in time order in each bucket of at, never in pairs; a bucket
    starts from the last mark of those before it. bucket must not fall with at.
    """
    both = rows.withColumn("__row", F.lit(1)).unionByName(marks.select(key, at, value).withColumn("__row", F.lit(0)), allowMissingColumns=True).withColumn("__bucket", bucket)
    mark = F.when(F.col("__row") == 0, F.struct(F.col(at).alias("at"), F.col(value).alias("value")))
    last = both.groupBy(key, "__bucket").agg(F.max(mark).alias("__last"))
    carried = last.withColumn("__carried", F.max("__last").over(W.partitionBy(key).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1))).select(F.col(key).alias("__key"), F.col("__bucket").alias("__of"), "__carried")
    here = both.withColumn("__here", F.max(mark).over(W.partitionBy(key, "__bucket").orderBy(at, "__row").rowsBetween(W.unboundedPreceding, 0)))
    met = here.where("__row = 1").join(carried, F.col(key).eqNullSafe(F.col("__key")) & F.col("__bucket").eqNullSafe(F.col("__of")), "left")
    return met.withColumn(value, F.coalesce("__here", "__carried")["value"]).select(*(c for c in rows.columns if c != value), value)


def _carried(sums: DataFrame, key: Sequence[str], value: Column, name: str) -> DataFrame:
    """For (key, __bucket): what value gives over all earlier buckets of the key, with the names that _met joins by."""
    before = value.over(W.partitionBy(*key).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1))
    return sums.withColumn(name, before).select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(key)), F.col("__bucket").alias("__of"), name)


def _met(rows: DataFrame, carried: DataFrame, key: Sequence[str]) -> DataFrame:
    same = F.col("__bucket").eqNullSafe(F.col("__of"))
    for i, k in enumerate(key):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return rows.join(carried, same).drop("__of", *(f"__k{i}" for i in range(len(key))))


def running_sum(df: DataFrame, key: Sequence[str], bucket: Column, order: Sequence[Column | str], value: Column, name: str) -> DataFrame:
    """df with the sum of value over a key's rows up to each, bucket by bucket: a bucket starts from the sums of those before it, and its rows are one task's. bucket must not fall along the order."""
    placed = df.withColumns({"__bucket": bucket, "__v": value})
    sums = placed.groupBy(*key, "__bucket").agg(F.sum("__v").alias("__s"))
    local = placed.withColumn("__local", F.sum("__v").over(W.partitionBy(*key, "__bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))
    met = _met(local, _carried(sums, key, F.sum("__s"), "__before"), key)
    return met.withColumn(name, F.col("__local") + F.coalesce("__before", F.lit(0))).select(*df.columns, name)


def gap_clusters(df: DataFrame, key: Sequence[str], at: Column, gap: float, ties: Sequence[str], name: str = "cluster", bucket: Column | None = None) -> DataFrame:
    """Clusters of a key's rows: a new one begins where a row is more than gap after the row before it.

    With a bucket, which must not fall along at, no key is one task's: a bucket's first
    row is compared with the last of those before.
    """
    if bucket is None:
        w = W.partitionBy(*key).orderBy(at, *ties)
        begins = F.when(at - F.lag(at).over(w) > gap, 1).otherwise(0)
        return df.withColumn("__b", begins).withColumn(name, F.sum("__b").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__b")
    placed = df.withColumns({"__bucket": bucket, "__at": at})
    last = _carried(placed.groupBy(*key, "__bucket").agg(F.max("__at").alias("__end")), key, F.max("__end"), "__prev")
    before = F.coalesce(F.lag("__at").over(W.partitionBy(*key, "__bucket").orderBy("__at", *ties)), F.col("__prev"))
    marked = _met(placed, last, key).withColumn("__b", F.when(F.col("__at") - before > gap, 1).otherwise(0))
    return running_sum(marked.select(*df.columns, "__at", "__b"), key, bucket, ["__at", *ties], F.col("__b"), name).select(*df.columns, name)


def phases(df: DataFrame, key: Sequence[str], order: Sequence[str], header: Column, total: Column, bucket: Column | None = None) -> DataFrame:
    """Rows with the number of the header before them as phase, for phases that have a row of totals after their header.

    Rows before the first header, and phases that the next header cuts off, are left
    out. With a bucket, which must not fall along the order, a key's headers are
    counted bucket by bucket; a phase is one task's.
    """
    one = F.when(header, 1).otherwise(0)
    if bucket is None:
        marked = df.withColumn("phase", F.sum(one).over(W.partitionBy(*key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))
    else:
        marked = running_sum(df, key, bucket, order, one, "phase")
    marked = marked.withColumn("__t", total)
    inside = W.partitionBy(*key, "phase").orderBy(*order)
    ended = F.coalesce(F.sum(F.col("__t").cast("int")).over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    has = F.max(F.col("__t").cast("int")).over(W.partitionBy(*key, "phase"))
    return marked.withColumn("__e", ended).withColumn("__h", has).where("phase > 0 and __h = 1 and __e = 0").drop("__t", "__e", "__h")


def budget_prefix(df: DataFrame, key: Sequence[str], order: Sequence[Column | str], size: Column, budget: float) -> DataFrame:
    """Rows in order as long as what came before is within the budget: the row that crosses it is still in."""
    w = W.partitionBy(*key).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn("__before", F.coalesce(F.sum(size).over(w), F.lit(0))).where(F.col("__before") <= budget).drop("__before")


def greedy_budget(items: Column, size: str, budget: float, most: int) -> Column:
    """Of an ordered array of structs, at most so many that fit the budget, passing over each that would exceed it."""
    start = F.struct(F.lit(0.0).alias("used"), F.filter(items, lambda _: F.lit(False)).alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        fits = (F.size(acc["kept"]) < most) & (acc["used"] + x[size] <= budget)
        return F.when(fits, F.struct((acc["used"] + x[size]).alias("used"), F.array_append(acc["kept"], x).alias("kept"))).otherwise(acc)

    return F.aggregate(items, start, step, lambda acc: acc["kept"])
