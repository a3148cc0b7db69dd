"""Text functions as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

PUNCTUATION = ("‘’“”–— ", "''\"\"-- ")


def strip_html(html: Column) -> Column:
    """Text without scripts, styles, comments and tags; white space as single spaces."""
    out = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, r"<[^>]*>", " ")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(out, r"[ \t\r\n]+", " "))


def escape_html(text: Column) -> Column:
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(sign), F.lit(entity))
    return text


def truncated(text: Column, n: int) -> Column:
    """At most n characters, the last three of a longer text as dots."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - 3), F.lit("..."))).otherwise(text)


def plain_punctuation(text: Column) -> Column:
    """Typographic quotes, dashes and spaces as ASCII, white space single, in lower case."""
    return F.trim(F.regexp_replace(F.lower(F.translate(text, *PUNCTUATION)), r"\s+", " "))


def tokens(text: Column, least: int = 3, stop: Sequence[str] = ()) -> Column:
    """Distinct runs of a-z and 0-9 of at least so many characters that are not stop words."""
    words = F.split(F.lower(text), "[^a-z0-9]+")
    kept = F.filter(words, lambda w: (F.length(w) >= least) & ~w.isin(*stop) if stop else F.length(w) >= least)
    return F.array_distinct(kept)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def snake(label: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(label), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def file_name(name: Column, most: int = 200) -> Column:
    return F.substring(F.regexp_replace(name, r"[^A-Za-z0-9._-]", "_"), 1, most)


def title_of(name: Column) -> Column:
    """A file's name without its ending, words apart."""
    return F.trim(F.regexp_replace(F.regexp_replace(name, r"\.[A-Za-z0-9]+$", ""), r"[_-]+", " "))


def notice_id(prefix: str, number: Column, most: int = 24) -> Column:
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.regexp_replace(number, "[^A-Za-z0-9]", ""), 1, most))


def ascii_only(text: Column) -> Column:
    return F.regexp_replace(F.translate(text, *PUNCTUATION), r"[^\x00-\x7F]", "")


def subject_base(subject: Column) -> Column:
    """A subject without its reply and forward marks."""
    return F.trim(F.regexp_replace(subject, r"(?i)^(\s*(re|fwd?)\s*:\s*)+", ""))


def emails(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9_.+-]+@[a-z0-9-]+(\.[a-z0-9-]+)+"), F.lit(0)))


def links(html: Column) -> Column:
    """Targets of links, in order."""
    return F.regexp_extract_all(html, F.lit(r'(?i)<a\s[^>]*href="([^"]+)"'), F.lit(1))
