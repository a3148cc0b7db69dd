"""Aggregations that are more than one built-in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def zero_filled_counts(df: DataFrame, column: str, domain: Sequence[str]) -> DataFrame:
    """The count of each value of a small domain, 0 for those that do not occur; values outside it are left out."""
    values = df.sparkSession.createDataFrame([(v,) for v in domain], f"{column} string")
    counted = df.groupBy(column).agg(F.count("*").alias("n"))
    return values.join(counted, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def upper_median_by(df: DataFrame, key: Sequence[str], value: str, width: float = 1.0) -> DataFrame:
    """key, n and upper median by exact rank. Equal values are counted first; then ranges of width find the range of the middle, and only its values are put in order."""
    from pyspark.sql import Window as W

    counted = df.where(F.col(value).isNotNull()).withColumn("__range", F.floor(F.col(value) / width)).groupBy(*key, "__range", value).agg(F.count("*").alias("__n"))
    ranges = counted.groupBy(*key, "__range").agg(F.sum("__n").alias("__rows"))
    w = W.partitionBy(*key).orderBy("__range")
    placed = ranges.withColumn("__upto", F.sum("__rows").over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("n", F.sum("__rows").over(W.partitionBy(*key)))
    middle = F.floor(F.col("n") / 2) + 1
    own = placed.where((F.col("__upto") >= middle) & (F.col("__upto") - F.col("__rows") < middle)).select(*key, "__range", "n", (F.col("__upto") - F.col("__rows")).alias("__before"))
    inside = counted.join(own, [*key, "__range"])
    upto = F.col("__before") + F.sum("__n").over(W.partitionBy(*key).orderBy(value).rowsBetween(W.unboundedPreceding, 0))
    return inside.withColumn("__at", upto).where((F.col("__at") >= middle) & (F.col("__at") - F.col("__n") < middle)).select(*key, "n", F.col(value).alias("median"))


def difference(actual: Column, predicted: Column) -> Column:
    """(actual - predicted) / predicted, null if either is null or predicted is 0."""
    return F.try_divide(actual - predicted, predicted)


def calibration(df: DataFrame, key: str, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """n and, for each named pair of (predicted, actual), the mean difference and mean ratio, over rows that have an actual."""
    aggs = [F.count("*").alias("n")]
    for name, (predicted, actual) in pairs.items():
        p, a = F.col(predicted), F.col(actual)
        aggs += [F.avg(difference(a, p)).alias(f"{name}_delta"), F.avg(F.try_divide(a, p)).alias(f"{name}_ratio")]
    some = F.coalesce(*(F.col(a) for _, a in pairs.values())).isNotNull()
    return df.where(some).groupBy(key).agg(*aggs)


def densest(df: DataFrame, key: Sequence[str], group: str) -> DataFrame:
    """For each key the group with most rows; the smaller name of equally large ones."""
    from sluice.operators.windows import first_by

    counted = df.groupBy(*key, group).agg(F.count("*").alias("n"))
    return first_by(counted, key, [F.desc("n"), group])


def weight_scale(df: DataFrame, key: str, weight: str, least: int = 5) -> DataFrame:
    """key, samples and scale: the mean weight in hundreds, where more than so many rows have one; null for fewer."""
    return df.where(F.col(weight).isNotNull()).groupBy(key).agg(F.count("*").alias("samples"), (F.avg(weight) / 100).alias("__mean")).select(key, "samples", F.when(F.col("samples") > least, F.col("__mean")).alias("scale"))
