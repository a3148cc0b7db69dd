"""Tokens, sheet numbers and glossaries from positioned items of pages.

Items have file, page, item_idx, str, x, y, width and font_size; y grows downwards.
A page's items meet in one window or one small array; files and pages are never
paired with each other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluice.operators.layout import PAGE, rows_of

#: How far apart items of one line may stand, the least gap that is no gap, and the font size where none is known.
LINE_GAP, LEAST_GAP, FONT = 4.0, 8.0, 12.0
#: Letters that sheet numbers begin with, longer ones first, and where on a page its title block begins.
SHEET_LETTERS = ("FP", "FA", "A", "S", "M", "P", "E", "C", "L", "T", "G", "I", "D")
TITLE_BLOCK = (0.55, 0.65)
#: What a note's code looks like, how far apart rows of notes stand, and how short a description is none.
NOTE_CODE, NOTE_GAP, NOTE_LEAST = r"[A-Z]\d+\.\d+", 8.0, 10
SHEET = rf"\b(?:{'|'.join(SHEET_LETTERS)})[- ]?\d{{1,3}}(?:\.\d{{1,2}})?\b"


def _in_order(what: Column | str, *order: str) -> Column:
    """The values of a group as an array, in order."""
    kept = F.struct(*order, (F.col(what) if isinstance(what, str) else what).alias("__v"))
    return F.transform(F.array_sort(F.collect_list(kept)), lambda s: s["__v"])


def clusters(items: DataFrame) -> DataFrame:
    """file, page, cluster, token, parts, x and y: items of a line that stand no farther apart than their font is wide, as one token.

    Drawings are often written letter by letter. Items go by y, x and item_idx; one
    joins the item before it if it is at most LINE_GAP higher or lower and begins
    at most the larger of LEAST_GAP and that item's font size behind its end. A null
    width is 0, a null or zero font size FONT, a null str empty.
    """
    w = W.partitionBy(*PAGE).orderBy("y", "x", "item_idx")
    font = F.coalesce(F.nullif(F.lag("font_size").over(w), F.lit(0.0)), F.lit(FONT))
    ends = F.lag("x").over(w) + F.coalesce(F.lag("width").over(w), F.lit(0.0))
    joins = (F.abs(F.col("y") - F.lag("y").over(w)) <= LINE_GAP) & (F.col("x") - ends <= F.greatest(F.lit(LEAST_GAP), font))
    marked = items.withColumn("__b", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1))
    numbered = marked.withColumn("cluster", F.sum("__b").over(w.rowsBetween(W.unboundedPreceding, 0)))
    text = F.array_join(_in_order(F.coalesce("str", F.lit("")), "y", "x", "item_idx"), "")
    return numbered.groupBy(*PAGE, "cluster").agg(F.trim(text).alias("token"), F.count("*").alias("parts"), F.min("x").alias("x"), F.min("y").alias("y"))


def sheet_identity(items: DataFrame, width: str, height: str) -> DataFrame:
    """file, page, sheet and found_in for pages whose title block names a sheet.

    The block's items are read as they stand in the file first (found_in line);
    where that gives none, the first cluster that holds a number counts (cluster).
    Numbers lose their spaces and dash.
    """
    x, y = TITLE_BLOCK
    block = items.where((F.col("x") >= x * F.col(width)) & (F.col("y") >= y * F.col(height)))
    line = block.groupBy(*PAGE).agg(F.regexp_extract(F.array_join(_in_order(F.coalesce("str", F.lit("")), "item_idx"), " "), SHEET, 0).alias("__line"))
    tokens = clusters(block).withColumn("__hit", F.regexp_extract("token", SHEET, 0)).where("__hit <> ''")
    first = tokens.groupBy(*PAGE).agg(F.min_by("__hit", "cluster").alias("__cluster"))
    both = line.join(first, list(PAGE), "left")
    found = F.coalesce(F.nullif(F.col("__line"), F.lit("")), F.col("__cluster"))
    return both.select(*PAGE, F.regexp_replace(found, "[ -]", "").alias("sheet"), F.when(F.col("__line") != "", "line").otherwise("cluster").alias("found_in")).where("sheet is not null")


def glossary(items: DataFrame, key: Sequence[str] = ("file",)) -> DataFrame:
    """key, code, description and page: rows that begin with a note's code, the first of a code by page and row.

    What follows the code in its row, with single spaces, is the description, if it
    has NOTE_LEAST characters.
    """
    rows = rows_of(items, NOTE_GAP).groupBy(*dict.fromkeys([*key, *PAGE]), "row").agg(_in_order(F.coalesce("str", F.lit("")), "x", "item_idx").alias("cells"))
    said = F.trim(F.regexp_replace(F.array_join(F.slice("cells", 2, F.greatest(F.lit(1), F.size("cells"))), " "), r"[\x20\x09-\x0D]+", " "))
    notes = rows.where(F.size("cells") > 1).select(*key, "page", "row", F.trim(F.element_at("cells", 1)).alias("code"), said.alias("description"))
    notes = notes.where(F.col("code").rlike(f"^{NOTE_CODE}$") & (F.length("description") >= NOTE_LEAST))
    return notes.groupBy(*key, "code").agg(F.min(F.struct("page", "row", "description")).alias("n")).select(*key, "code", "n.description", "n.page")


def resolved(df: DataFrame, text: str, notes: DataFrame, key: Sequence[str] = ("file", "page"), of: Sequence[str] = ("file",)) -> DataFrame:
    """key, place, code and description: the codes that a text names and the glossary of its file (of) explains, each once, in order of first mention."""
    named = df.select(*key, F.posexplode(F.array_distinct(F.regexp_extract_all(text, F.lit(rf"\b({NOTE_CODE})\b"), F.lit(1)))).alias("place", "code"))
    return named.join(notes.select(*of, "code", "description"), [*of, "code"]).select(*key, "place", "code", "description")
