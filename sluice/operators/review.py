"""Audits, disputes, approvals and edits of estimates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluice.operators import pricing


def preflight(checks: Sequence[tuple[str, Column]]) -> Column:
    """struct<ready, blockers>: all named checks hold, or the names of those that do not; null does not hold."""
    found = F.filter(F.array(*(F.struct(F.lit(n).alias("name"), F.coalesce(ok, F.lit(False)).alias("ok")) for n, ok in checks)), lambda c: ~c["ok"])
    return F.struct((F.size(found) == 0).alias("ready"), F.transform(found, lambda c: c["name"]).alias("blockers"))


def disputes(findings: DataFrame, lines: DataFrame, key: str) -> DataFrame:
    """Findings to settle, numbered D1, D2, .. in each run, with the line that they are about."""
    wanted = findings.where((F.col("severity") == "error") | F.col("category").isin("missing_scope", "quantity_sanity"))
    w = W.partitionBy(key).orderBy("severity", "category", F.asc_nulls_last("related_line"), "finding")
    placed = wanted.withColumn("dispute", F.concat(F.lit("D"), F.row_number().over(w).cast("string")))
    own = lines.select(key, F.col("line_no").alias("related_line"), F.col("category").alias("line_category"))
    return placed.join(own, [key, "related_line"], "left")


def settle(findings: DataFrame, verdicts: DataFrame, key: str) -> DataFrame:
    """findings and, for each verdict, one more of severity info. verdicts: key, dispute, verdict, related_line."""
    told = verdicts.select(key, F.lit("info").alias("severity"), F.lit("arbitration").alias("category"), F.concat_ws(": ", "dispute", "verdict").alias("finding"), "related_line")
    return findings.unionByName(told)


def tally(findings: DataFrame, key: str) -> DataFrame:
    return findings.groupBy(key).agg(*(F.count_if(F.col("severity") == s).alias(f"{s}s") for s in ("error", "warning", "info")))


def blind(df: DataFrame, reasoning: Sequence[str]) -> DataFrame:
    """What an auditor sees: conclusions without the columns that reason."""
    return df.drop(*reasoning)


def patched(lines: DataFrame, patches: DataFrame, key: Sequence[str], fields: Sequence[str], weight_fields: Sequence[str], rates: Mapping[str, float] = pricing.RATES) -> DataFrame:
    """lines with the patches' values, priced again; the weight is worked out anew only where a field that it depends on changes.

    Fields that are not listed cannot be patched. A null in a patch leaves the value.
    """
    allowed = [f for f in patches.columns if f in fields]
    new = patches.select(*key, *(F.col(f).alias(f"__{f}") for f in allowed))
    joined = lines.join(new, list(key), "left")
    moved = F.lit(False)
    for f in allowed:
        if f in weight_fields:
            moved = moved | (F.col(f"__{f}").isNotNull() & ~F.col(f"__{f}").eqNullSafe(F.col(f)))
    out = joined.withColumn("__moved", moved).withColumn("__weight", F.col("weight")).withColumns({f: F.coalesce(f"__{f}", f) for f in allowed})
    again = pricing.priced(out.drop("weight", "material", "labor", "finishing", "total"), rates)
    kept = F.when(F.col("__moved"), F.col("weight")).otherwise(F.col("__weight"))
    again = again.withColumn("weight", kept).withColumn("material", F.col("weight") * (pricing.RATES | dict(rates))["steel"])
    return again.withColumn("total", pricing.not_zero(pricing.zero("material") + pricing.zero("labor") + pricing.zero("finishing"))).drop(*(f"__{f}" for f in allowed), "__moved", "__weight")


def approved_scenario(total: Column, snapshots: Mapping[str, Column]) -> Column:
    """The scenario whose total was approved, expected if none fits."""
    return F.coalesce(*(F.when(c == total, F.lit(n)) for n, c in snapshots.items()), F.lit("expected"))


def gated(df: DataFrame, condition: Column, most: int = 50, force: bool = False) -> DataFrame:
    """Rows for which the condition holds; an error if they are more than may go at once."""
    found = df.where(condition)
    n = found.limit(most + 1).count()
    if n > most and not force:
        raise ValueError(f"more than {most} rows would go; give force=True to let them")
    return found


def patch_reminders(reminders: DataFrame, command: str, days: str, now: Column) -> DataFrame:
    """reminders with completed_at or snoozed_until by their command: complete, or snooze for so many days. Other commands and nulls change nothing."""
    done, later = F.coalesce(F.col(command) == "complete", F.lit(False)), F.coalesce((F.col(command) == "snooze") & (F.col(days) > 0), F.lit(False))
    until = F.timestamp_add("DAY", F.col(days).cast("int"), now)
    return reminders.withColumns({"completed_at": F.when(done, now).otherwise(F.col("completed_at")), "snoozed_until": F.when(later, until).otherwise(F.col("snoozed_until"))})


def completion_events(reminders: DataFrame, key: str, command: str, now: Column) -> DataFrame:
    """An event for each reminder that is completed now; one that was completed before gives none."""
    return reminders.where((F.col(command) == "complete") & F.col("completed_at").isNull()).select(key, F.lit("reminder_completed").alias("event_type"), now.alias("ts"))


def high_issues(*issues: str) -> Column:
    """How many issues of severity high there are in several arrays; a null array has none."""
    each = [F.size(F.filter(F.coalesce(F.col(c), F.array().cast("array<struct<severity:string>>")), lambda i: i["severity"] == "high")) for c in issues]
    return reduce(Column.__add__, each)


def find_first(documents: str, category: str, path: Column, name: str) -> Column:
    """The first document of a category; else the one at path; else the one of a fixed name; null for none."""
    first = lambda test: F.get(F.filter(F.col(documents), test), F.lit(0))
    return F.coalesce(first(lambda d: d["category"] == category), first(lambda d: d["path"] == path), first(lambda d: d["name"] == name))
