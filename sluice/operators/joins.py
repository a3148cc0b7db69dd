"""Joins beyond a plain equality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def reconcile(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key and in_both, left_only or right_only, for the distinct keys of both sides."""
    a = left.select(key).distinct().withColumn("__l", F.lit(True))
    b = right.select(key).distinct().withColumn("__r", F.lit(True))
    side = F.when(F.col("__l") & F.col("__r"), "in_both").when(F.col("__l"), "left_only").otherwise("right_only")
    return a.join(b, key, "full_outer").select(key, side.alias("side"))


def multiset_difference(expected: DataFrame, have: DataFrame, category: str, order: Sequence[str], bucket: Column) -> tuple[DataFrame, DataFrame]:
    """(missing, unexpected): expected rows beyond the count of their category in have (category, have), and categories there that nothing expects.

    bucket must not fall along the order: a category's rows are numbered bucket by bucket.
    """
    from sluice.operators.windows import numbered_in_buckets

    placed = numbered_in_buckets(expected, [category], bucket, order, "ordinal")
    missing = placed.join(have, category, "left").where(F.col("ordinal") > F.coalesce("have", F.lit(0))).drop("have")
    return missing, have.join(expected.select(category).distinct(), category, "left_anti")


def as_of_version(facts: DataFrame, versions: DataFrame, at: str, start: str, end: str, pinned: str | None = None, version: str = "version") -> DataFrame:
    """Each fact with the version in force at its time, start included and end not (null: open); a pinned version goes first.

    Versions meet facts by the days that they are in force, an equality however many
    of either there are. A fact that no version is in force for, or that pins one
    that does not exist, has nulls.
    """
    first, last = facts.agg(F.min(F.to_date(at)), F.max(F.to_date(at))).first()
    begins, ends = F.greatest(F.to_date(start), F.lit(first)), F.least(F.coalesce(F.to_date(end), F.lit(last)), F.lit(last))
    by_day = versions.where(begins <= ends).withColumn("__day", F.explode(F.sequence(begins, ends)))
    free = facts if not pinned else facts.where(F.col(pinned).isNull())
    out = free.join(by_day, (F.to_date(at) == F.col("__day")) & (F.col(start) <= F.col(at)) & (F.col(end).isNull() | (F.col(at) < F.col(end))), "left").drop("__day")
    if pinned:
        out = out.unionByName(facts.where(F.col(pinned).isNotNull()).join(versions, F.col(pinned) == F.col(version), "left"))
    return out


def best_of_two(left: DataFrame, right: DataFrame, on: str, narrow: tuple[str, str], order: Sequence[Column | str]) -> DataFrame:
    """Each left row with its best partner in order: of those with the same on and narrow (a column of each side), else of those with the same on.

    Partners are cut down to one for each key before they are joined.
    """
    own, theirs = narrow
    columns = [c for c in right.columns if c not in (on, theirs)]
    best = lambda key, name: right.withColumn("__n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("__n = 1").select(*key, F.struct(theirs, *columns).alias(name))
    exact = best([on, theirs], "__exact")
    # the best of a key is among the best of its narrow keys
    wide = exact.select(on, "__exact.*").withColumn("__n", F.row_number().over(W.partitionBy(on).orderBy(*order))).where("__n = 1").select(on, F.struct(theirs, *columns).alias("__wide"))
    met = left.join(exact.withColumnRenamed(theirs, "__narrow"), (left[on] == exact[on]) & (F.col(own) == F.col("__narrow")), "left").drop(exact[on])
    found = met.join(wide, on, "left").withColumn("__found", F.coalesce("__exact", "__wide"))
    return found.select(*left.columns, "__found.*")


def nearest(value: Column, points: Sequence[float]) -> Column:
    """The place, from 0, of the point that is nearest to value; the first of equally near ones."""
    return F.array_position(F.transform(F.array(*map(F.lit, points)), lambda p: F.abs(p - value)), F.array_min(F.transform(F.array(*map(F.lit, points)), lambda p: F.abs(p - value)))) - 1


def hierarchical(code: str, exact: DataFrame, prefix: DataFrame, default: str, digits: int = 2) -> tuple:
    """How to look code up: exactly, then by its first digits, then the default. Give it to resolve()."""
    return code, exact, prefix, default, digits


def resolve(df: DataFrame, spec: tuple, name: str = "tag") -> DataFrame:
    """df with the tag that a hierarchical lookup finds. The two dimensions have columns code and tag."""
    code, exact, prefix, default, digits = spec
    e = exact.select(F.col("code").alias("__e"), F.col("tag").alias("__et"))
    p = prefix.select(F.col("code").alias("__p"), F.col("tag").alias("__pt"))
    joined = df.join(e, F.col(code) == F.col("__e"), "left").join(p, F.substring(code, 1, digits) == F.col("__p"), "left")
    return joined.withColumn(name, F.coalesce("__et", "__pt", F.lit(default))).drop("__e", "__et", "__p", "__pt")


def insert_absent(new: DataFrame, existing: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of new whose key is not there yet: an insert that repeats without effect."""
    return new.join(existing.select(*key).distinct(), list(key), "left_anti")


def merge_latest(target: DataFrame, changes: DataFrame, key: Sequence[str], order: Sequence[Column], parts: tuple[int, str] | None = None) -> DataFrame:
    """One row for each key, the latest of both; changes win ties. parts: how many, and the column of the key that deals them; nothing else is shuffled then."""
    both = target.withColumn("__new", F.lit(0)).unionByName(changes.withColumn("__new", F.lit(1)))
    if parts:
        both = both.repartition(*parts)
    w = W.partitionBy(*key).orderBy(*order, F.desc("__new"))
    return both.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__new")


def field_changes(old: DataFrame, new: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """key, field, before and after for each field that differs; values as text."""
    unpivot = lambda df, name: df.select(key, F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias(name)) for f in fields))).alias("x")).select(key, "x.*")
    joined = unpivot(old, "before").join(unpivot(new, "after"), [key, "field"])
    return joined.where(~F.col("before").eqNullSafe(F.col("after")))
