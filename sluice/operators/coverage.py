"""Tags of sections, sheets and schedules, and the manifest that lines must cover."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INCLUDED, EXCLUDED, NOT_APPLICABLE, JUDGMENT = "included", "excluded", "n_a", "judgment"
#: A policy of our own: exact sections, divisions and disciplines.
SECTIONS = {"05 12 00": INCLUDED, "05 50 00": INCLUDED, "05 51 00": INCLUDED, "05 52 00": INCLUDED, "08 11 13": INCLUDED, "05 21 00": EXCLUDED, "05 31 00": EXCLUDED, "08 41 13": EXCLUDED}
DIVISIONS_EXCLUDED = ("03", "04", "06", "07", "09")
DIVISIONS_NOT_APPLICABLE = ("22", "23", "26", "27", "28")
DISCIPLINES = {"S": INCLUDED, "A": INCLUDED, "M": EXCLUDED, "E": EXCLUDED, "P": EXCLUDED, "FP": EXCLUDED, "C": JUDGMENT, "L": EXCLUDED}
SCHEDULES = {"door": INCLUDED, "lintel": INCLUDED, "column": INCLUDED, "window": EXCLUDED, "finish": NOT_APPLICABLE}
CATEGORIES = {"05 12 00": ("structural_beam", "column"), "05 50 00": ("misc_metal", "lintel"), "05 51 00": ("stair",), "05 52 00": ("railing",), "08 11 13": ("hm_frame",)}


def _map(table: Mapping[str, str], key: Column) -> Column:
    return F.coalesce(*(F.when(key == k, F.lit(v)) for k, v in table.items()))


def section_code(text: Column) -> Column:
    """dd dd dd from digits with any separators; null for what is no code."""
    d = F.regexp_replace(text, r"[^0-9]", "")
    return F.when(F.length(d) >= 6, F.concat_ws(" ", F.substring(d, 1, 2), F.substring(d, 3, 2), F.substring(d, 5, 2)))


def section_tag(code: Column) -> Column:
    """The exact section's tag, else its division's, else judgment."""
    division = F.substring(code, 1, 2)
    return F.coalesce(_map(SECTIONS, code), F.when(division.isin(*DIVISIONS_NOT_APPLICABLE), NOT_APPLICABLE).when(division.isin(*DIVISIONS_EXCLUDED), EXCLUDED), F.lit(JUDGMENT))


def discipline(sheet: Column) -> Column:
    return F.regexp_extract(F.upper(sheet), r"^(FP|[A-Z])", 1)


def sheet_tag(sheet: Column) -> Column:
    return F.coalesce(_map(DISCIPLINES, discipline(sheet)), F.lit(JUDGMENT))


def needs_vision(tag: Column, items: Column, raster: Column, thin: int = 80) -> Column:
    """A sheet that counts has too little text to be read by its text, or is for judgment."""
    return ((tag == INCLUDED) & ((items < thin) | raster)) | (tag == JUDGMENT)


def schedule_tag(kind: Column) -> Column:
    return F.coalesce(_map(SCHEDULES, kind), F.lit(JUDGMENT))


def manifest(sections: DataFrame, sheets: DataFrame, schedules: DataFrame, key: str) -> DataFrame:
    """key, kind, ref, tag, needs_vision and unresolved of everything that a package names.

    sections: key, code; sheets: key, sheet, items, raster; schedules: key, schedule.
    Several sources may name a section: it counts once.
    """
    s = sections.select(key, F.lit("section").alias("kind"), section_code(F.col("code")).alias("ref")).where("ref is not null").distinct().withColumns({"tag": section_tag(F.col("ref")), "needs_vision": F.lit(False)})
    d = sheets.groupBy(key, F.col("sheet").alias("ref")).agg(F.max("items").alias("items"), F.max("raster").alias("raster")).withColumn("tag", sheet_tag(F.col("ref")))
    d = d.select(key, F.lit("sheet").alias("kind"), "ref", "tag", needs_vision(F.col("tag"), F.col("items"), F.col("raster")).alias("needs_vision"))
    c = schedules.select(key, F.lit("schedule").alias("kind"), F.col("schedule").alias("ref")).distinct().withColumns({"tag": schedule_tag(F.col("ref")), "needs_vision": F.lit(False)})
    return s.unionByName(d).unionByName(c).withColumn("unresolved", (F.col("tag") == JUDGMENT) | F.col("needs_vision"))


def tag_counts(entries: DataFrame, key: str) -> DataFrame:
    tags = [F.count_if(F.col("tag") == t).alias(t) for t in (INCLUDED, EXCLUDED, NOT_APPLICABLE, JUDGMENT)]
    return entries.groupBy(key, "kind").agg(*tags, F.count_if("needs_vision").alias("needs_vision"), F.count_if("unresolved").alias("unresolved"))


def expected_categories(entries: DataFrame, key: str) -> DataFrame:
    """The categories that a package's included sections call for, in order."""
    of = F.create_map(*(x for k, v in CATEGORIES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    found = entries.where(f"kind = 'section' and tag = '{INCLUDED}'").select(key, F.explode(F.try_element_at(of, F.col("ref"))).alias("category"))
    return found.groupBy(key).agg(F.array_sort(F.collect_set("category")).alias("categories"))


def uncovered(entries: DataFrame, covered: DataFrame, excluded: DataFrame, key: str, least: int = 12) -> DataFrame:
    """Included entries that no line covers and no exclusion with a real reason explains: findings that block.

    covered: key, kind, ref; excluded: key, kind, ref, reason.
    """
    explained = excluded.where(F.length(F.trim("reason")) >= least).select(key, "kind", "ref")
    open_ = entries.where(F.col("tag") == INCLUDED).join(covered.select(key, "kind", "ref").unionByName(explained).distinct(), [key, "kind", "ref"], "left_anti")
    return open_.select(key, F.lit("error").alias("severity"), F.concat(F.lit("uncovered_"), "kind").alias("category"), "ref")


def cascade(sources: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """One row for each key, from the first source that has the key; fields that are null there fall through to the next.

    sources have the columns of the first one, in order of precedence. A source that
    gives a key several times counts with its least row, so that the order is total;
    source names, from 1, the first one that has the key. Rows with a null in the key
    are left out.
    """
    fields = [c for c in sources[0].columns if c not in key]
    ranked = [df.select(*key, *fields).withColumn("__rank", F.lit(i)) for i, df in enumerate(sources, 1)]
    every = reduce(DataFrame.unionByName, ranked).dropna(subset=list(key))
    # per source one row, then per field the first source that says something
    one = every.groupBy(*key, "__rank").agg(F.min(F.struct(*fields)).alias("__row")) if fields else every.distinct()
    pick = [F.min_by(F.col("__row")[f], F.when(F.col("__row")[f].isNotNull(), F.col("__rank"))).alias(f) for f in fields]
    return one.groupBy(*key).agg(F.min("__rank").alias("source"), *pick)


def package_manifest(sections: Sequence[DataFrame], sheets: Sequence[DataFrame], schedules: DataFrame, key: str) -> DataFrame:
    """The manifest of packages whose sections and sheets several sources name, in order of precedence.

    sections: key, code, title, page each; sheets: key, sheet, items, raster each. An
    index comes before an older list, and that before what the pages themselves say.
    """
    spaced = [s.withColumn("code", section_code(F.col("code"))) for s in sections]
    known = cascade(spaced, [key, "code"])
    plain = [s.withColumn("sheet", F.upper(F.regexp_replace("sheet", r"[\s-]", ""))) for s in sheets]
    drawn = cascade(plain, [key, "sheet"])
    entries = manifest(known.select(key, "code"), drawn.select(key, "sheet", "items", "raster"), schedules, key)
    titles = known.select(key, F.lit("section").alias("kind"), F.col("code").alias("ref"), "title", "page", "source").unionByName(drawn.select(key, F.lit("sheet").alias("kind"), F.col("sheet").alias("ref"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("long").alias("page"), "source"))
    return entries.join(titles, [key, "kind", "ref"], "left")
