"""Predicates and row selections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def contains_any(columns: Sequence[str], needle: str) -> Column:
    """Whether any column holds needle, in any case; a null column holds nothing."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.contains(F.lower(F.col(c)), F.lit(needle.lower())), F.lit(False))
    return out


def open_until(deadline: str, now: Column) -> Column:
    """No deadline, or one that has not passed."""
    return F.col(deadline).isNull() | (F.col(deadline) >= now)


def stale(checked: str, now: Column, hours: int = 24) -> Column:
    """Never checked, or longer than hours ago."""
    return F.col(checked).isNull() | (F.col(checked) < now - F.expr(f"interval {hours} hours"))


def active(completed: str, snoozed: str, due: str, now: Column, days: int = 7) -> Column:
    """Not completed, not snoozed into the future, and due within days."""
    return F.col(completed).isNull() & (F.col(snoozed).isNull() | (F.col(snoozed) <= now)) & (F.col(due) <= now + F.expr(f"interval {days} days"))


def first_rule(text: str | Column, rules: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """The name of the first rule one of whose substrings the text holds, in any case; null if none does."""
    lowered = F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    return F.coalesce(*(F.when(_any(lowered, words), F.lit(name)) for name, words in rules))


def _any(lowered: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(lowered, F.lit(w.lower()))
    return out


def domain_errors(checks: Sequence[tuple[str, Column]]) -> Column:
    """The names of the checks that fail; a check that is null fails."""
    found = F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks))
    return F.filter(found, lambda x: x.isNotNull())


def first_failing(tests: Sequence[tuple[str, Column]], otherwise: str) -> Column:
    """The name of the first test, in order, that does not hold."""
    return F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in tests), F.lit(otherwise))


def page(df: DataFrame, order: Sequence[Column], offset: int, limit: int, most: int = 200) -> DataFrame:
    """A page of rows in a total order, with the count of all rows as total."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset(offset).limit(min(limit, most)).crossJoin(F.broadcast(total))


def retention(status: str, updated: str, deadline: str, now: Column, won: int = 90, lost: int = 14, bidding: int = 30) -> Column:
    """Rows that may be purged: won or lost long enough ago, or still bidding well after the deadline."""
    before = lambda days: now - F.expr(f"interval {days} days")
    s = F.col(status)
    return ((s == "won") & (F.col(updated) < before(won))) | ((s == "lost") & (F.col(updated) < before(lost))) | ((s == "bidding") & (F.col(deadline) < before(bidding)))
