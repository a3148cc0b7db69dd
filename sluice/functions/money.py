"""Amounts of money."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_money(text: Column) -> Column:
    """The number that a text of an amount begins with, without $, commas and spaces; null if there is none."""
    plain = F.regexp_replace(text, r"[$,\s]", "")
    return F.regexp_extract(plain, r"^-?[0-9]*\.?[0-9]+", 0).try_cast("double")


def dollar_range(text: Column) -> Column:
    """struct(low, high) of all amounts in a text; nulls if there is none."""
    found = F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"\$\s*([0-9][0-9,]*(?:\.[0-9]+)?)"), F.lit(1)), parse_money), lambda v: v.isNotNull())
    return F.struct(F.array_min(found).alias("low"), F.array_max(found).alias("high"))


def award_range(raw: Column, text: Column) -> Column:
    """struct(low, high) of a notice: what the first field of its payload says that holds a number, else the least and most amounts of its text.

    A range may have one end; a missing upper end is the lower one.
    """
    at = lambda path: parse_money(F.get_json_object(raw, path))
    pairs = [(at("$.award.floor"), at("$.award.ceiling")), (at("$.awardFloor"), at("$.awardCeiling"))]
    singles = [at(p) for p in ("$.award.amount", "$.estimatedTotalValue", "$.baseAndAllOptionsValue")]
    both = lambda low, high: F.struct(low.alias("low"), F.coalesce(high, low).alias("high"))
    steps = [F.when(low.isNotNull() | high.isNotNull(), both(low, high)) for low, high in pairs] + [F.when(v.isNotNull(), both(v, v)) for v in singles]
    return F.coalesce(*steps, dollar_range(F.coalesce(text, F.lit(""))))


def compact_money(value: Column) -> Column:
    """$1.2M, $15K or $900; null stays null."""
    return (
        F.when(value.isNull(), F.lit(None).cast("string"))
        .when(value >= 1e6, F.concat(F.lit("$"), F.format_string("%.1f", F.floor(value / 1e5 + 0.5) / 10), F.lit("M")))
        .when(value >= 1000, F.concat(F.lit("$"), F.floor(value / 1000 + 0.5).cast("string"), F.lit("K")))
        .otherwise(F.concat(F.lit("$"), F.floor(value + 0.5).cast("string")))
    )


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))
