"""Tables, references and revisions from positioned text.

Items have file, page, item_idx, str, x, y; y grows downwards. Work is within a
page, which a window or a small array holds.
"""

from __future__ import annotations

from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluice.operators.schedules import ROWS, Kinds, rows_of_schedules

ROW_GAP = 12.0
#: How far beside a label a word of the next row may stand that belongs to it.
UNDER = 40.0
#: Share of a header's items that its labels are at least, and of a schedule's rows that have its mark.
SHARE, QUALITY = 0.25, 0.4
#: Kinds of schedules in their order, with the labels that their header rows have, how many at least, those of which some are needed, and how many of these.
HEADERS = {
    "door_schedule": (("number", "room", "width", "height", "type", "material", "frame", "hardware", "finish"), 4, ("frame", "hardware"), 1),
    "lintel_schedule": (("mark", "lintel", "size", "span", "bearing", "angle", "plate", "opening"), 3, ("lintel", "span", "bearing"), 1),
    "embed_schedule": (("mark", "embed", "plate", "studs", "anchor", "detail", "thickness"), 3, ("embed", "studs", "anchor"), 1),
    "frame_schedule": (("mark", "frame", "type", "size", "material", "profile", "gauge", "jamb"), 3, ("frame", "jamb"), 1),
    "beam_schedule": (("mark", "beam", "size", "span", "reaction", "camber", "shape"), 3, ("beam", "reaction", "camber"), 1),
    "equipment_schedule": (("mark", "description", "manufacturer", "model", "item", "quantity", "qty", "remarks", "equipment"), 3, ("mark", "description"), 2),
}
#: Disciplines by the letters that sheets begin with.
PREFIXES = {
    "A": "architectural", "S": "structural", "M": "mechanical", "E": "electrical", "P": "plumbing", "C": "civil", "D": "demolition", "G": "general", "L": "landscape",
    "T": "telecom", "I": "interior", "FP": "fire_protection", "FA": "fire_alarm",
}
#: Standards that look like sheets, and the bodies whose standards they are.
STANDARDS = (
    "A036", "A123", "A153", "A307", "A325", "A490", "A500", "A529", "A563", "A572", "A588", "A615", "A653", "A706", "A780", "A847", "A992", "A1011", "A1085",
    "C150", "C270", "C476", "E84", "E119", "E330",
)
BODIES = "ASTM|AISI|AWS|AISC|ANSI"
SHEET_LETTERS = "FP|FA|[ASMPECLTGID]"
PAGE = ("file", "page")


def rows_of(items: DataFrame, gap: float = ROW_GAP) -> DataFrame:
    """Items with row: a new one begins where an item is more than gap below the one before it, in order of y."""
    w = W.partitionBy(*PAGE).orderBy("y", "x", "item_idx")
    begins = F.when(F.col("y") - F.lag("y").over(w) > gap, 1).otherwise(0)
    return items.withColumn("__b", begins).withColumn("row", F.sum("__b").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__b")


def pages_of(items: DataFrame) -> DataFrame:
    """file, page and items: the items of a page as one array, in order of y, x and item_idx."""
    return items.groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.struct("y", "x", "item_idx", "str"))).alias("items"))


def schedule_rows(items: DataFrame, kinds: Kinds = HEADERS, margin: float = 50.0) -> DataFrame:
    """file, page, kind, row and cells, a map of label to text: the body rows of each page's schedule, from positioned items."""
    return page_schedules(pages_of(items), kinds, margin)


def page_schedules(pages: DataFrame, kinds: Kinds = HEADERS, margin: float = 50.0, marks: Mapping[str, str] | None = None) -> DataFrame:
    """schedule_rows of pages whose items are arrays in order of y, x and item_idx: nothing is shuffled.

    The first row of a page that is a kind's header counts: it has 4 to 25 items and
    holds enough of the kind's labels, and of those that it needs; the labels are such a
    share of the items at least. Of several kinds the first counts. Short words of the
    next row go to the label above them; those with digits are marks or sizes of a first
    body row. An item of the body belongs to the nearest column, the first of equally
    near ones; texts of a cell stand in order of x. Rows of fewer than three items are
    dropped where there are more than four columns. With marks, schedules are left out
    as quality does, where each page is one row.
    """

    def rows(items: pa.Array) -> pa.Array:
        return rows_of_schedules(items, kinds, ROW_GAP, UNDER, margin, SHARE)

    # else the optimiser would work the rows out again for each filter on them
    found = pages.select(*PAGE, F.arrow_udf(rows, ROWS).asNondeterministic()("items").alias("__rows"))
    if marks is not None:
        good = F.filter("__rows", lambda r: F.exists(r["cells"], lambda c: _marked(c["cell"], r["kind"], marks)))
        found = found.where((F.size("__rows") > 0) & (F.size(good) >= QUALITY * F.size("__rows")))
    return found.select(*PAGE, F.explode("__rows").alias("r")).select(*PAGE, "r.kind", "r.row", F.map_from_entries("r.cells").alias("cells"))


def _marked(cell: Column, kind: Column, marks: Mapping[str, str]) -> Column:
    pattern = F.coalesce(*(F.when(kind == k, F.lit(p)) for k, p in marks.items()))
    return F.coalesce(F.regexp_like(cell, pattern), F.lit(True))


def quality(schedules: DataFrame, marks: Mapping[str, str], share: float = QUALITY) -> DataFrame:
    """Schedules of which enough rows have a cell with the kind's mark; kinds without a pattern all stay."""
    has = F.exists(F.map_values("cells"), lambda v: _marked(v, F.col("kind"), marks))
    w = W.partitionBy(*PAGE, "kind")
    return schedules.withColumn("__q", F.avg(F.when(has, 1.0).otherwise(0.0)).over(w)).where(F.col("__q") >= share).drop("__q")


def section_headers(text: Column) -> Column:
    """Codes of section headers, dd dd dd, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?i)(?:SECTION|DOCUMENT)\s+(\d{2})[ -]?(\d{2})[ -]?(\d{2})"), F.lit(0)), lambda s: F.regexp_replace(F.regexp_replace(s, r"[^0-9]", ""), r"^(\d{2})(\d{2})(\d{2}).*$", "$1 $2 $3"))


def references(text: Column, kind: Column) -> Column:
    """struct<callouts, sheets, sections, disciplines> that a text refers to, each distinct and in order.

    A callout is a detail of a sheet, 3/A400. A sheet has three digits; it is none
    after the name of a body of standards, before the metric twin of a standard
    (/A123M), or where it is a well-known standard itself. Specifications are full of
    standards, so only sections are read there. Sections are three pairs of digits.
    """
    spec = F.coalesce(kind == "specification", F.lit(False))
    none = F.array().cast("array<string>")
    tight = lambda found: F.transform(found, lambda s: F.regexp_replace(s, r"[\s-]", ""))
    each = lambda found: F.array_sort(F.array_distinct(found))
    callouts = tight(F.regexp_extract_all(text, F.lit(r"\b[A-Z0-9]{1,3}\s*/\s*[A-Z]{1,3}-?\d{1,3}(?:\.\d{1,2})?\b"), F.lit(0)))
    bare = tight(F.regexp_extract_all(text, F.lit(rf"(?<!\b(?:{BODIES})\s{{1,8}})\b(?:{SHEET_LETTERS})-?\d{{3}}(?:\.\d{{1,2}})?\b(?!\s*/\s*A\d{{2,4}}M\b)"), F.lit(0)))
    sheets = each(F.concat(F.transform(callouts, lambda c: F.substring_index(c, "/", -1)), F.filter(bare, lambda s: ~s.isin(*STANDARDS))))
    sections = each(F.transform(F.regexp_extract_all(text, F.lit(r"\b\d{2}\s+\d{2}\s+\d{2}\b"), F.lit(0)), lambda s: F.regexp_replace(s, r"\s+", " ")))
    own = F.when(spec, none).otherwise(sheets)
    return F.struct(F.when(spec, none).otherwise(each(callouts)).alias("callouts"), own.alias("sheets"), sections.alias("sections"), each(F.transform(own, discipline_of)).alias("disciplines"))


def sheet_references(text: Column) -> Column:
    """Sheets that a text refers to, whatever its kind."""
    return references(text, F.lit(None).cast("string"))["sheets"]


def discipline_of(sheet: Column) -> Column:
    letters = F.regexp_extract(F.upper(sheet), r"^([A-Z]{1,2})", 1)
    return F.coalesce(*(F.when(letters == k, F.lit(v)) for k, v in PREFIXES.items()), F.lit("other"))


def missing_sheets(referenced: DataFrame, covered: DataFrame, key: str) -> DataFrame:
    """key and sheet: sheets that a package refers to and does not hold. Both: key, sheet; spaces, dashes and case do not tell sheets apart."""
    plain = F.upper(F.regexp_replace("sheet", r"[\s-]", ""))
    there = covered.select(key, plain.alias("__s")).distinct()
    return referenced.select(key, "sheet").distinct().withColumn("__s", plain).join(there, [key, "__s"], "left_anti").select(key, "sheet")


def revision(text: Column) -> Column:
    """struct<kind, value, raw>: a number after REV, R or Addendum, else a date, else none."""
    number = r"(?i)\b(?:REV(?:ISION)?\.?|ADDENDUM)\s*#?\s*(\d{1,3})\b"
    date = r"\b(\d{1,2}/\d{1,2}/\d{2,4})\b"
    return F.when(text.rlike(number), F.struct(F.lit("number").alias("kind"), F.regexp_extract(text, number, 1).alias("value"), F.regexp_extract(text, number, 0).alias("raw"))).when(text.rlike(date), F.struct(F.lit("date").alias("kind"), F.regexp_extract(text, date, 1).alias("value"), F.regexp_extract(text, date, 0).alias("raw"))).otherwise(F.struct(F.lit("none").alias("kind"), F.lit("").alias("value"), F.lit("").alias("raw")))


def latest_revisions(sheets: DataFrame, key: str, text: str, place: str) -> tuple[DataFrame, DataFrame]:
    """(winners, conflicts) of sheets that a package shows several times.

    sheets: key, sheet, and the text and place of each showing. A numbered revision
    goes before a dated one and that before none, a later before an earlier, and of
    equal ones the first by place. A conflict names all showings in that order, as they
    are written. Sheets without a number are left out.
    """
    said = revision(F.coalesce(F.col(text), F.lit("")))
    day = F.coalesce(F.try_to_date(said["value"], "M/d/yyyy"), F.try_to_date(said["value"], "M/d/yy"))
    value = F.when(said["kind"] == "number", said["value"].try_cast("long")).otherwise(F.unix_date(day).cast("long"))
    rank = F.when(said["kind"] == "number", 0).when(said["kind"] == "date", 1).otherwise(2)
    one = F.struct(rank.alias("rank"), (-F.coalesce(value, F.lit(0))).alias("late"), F.col(place).alias("place"), said["raw"].alias("raw"))
    # showings of one sheet in one package are few
    groups = sheets.where("sheet is not null").groupBy(key, "sheet").agg(F.array_sort(F.collect_list(one)).alias("r"))
    winners = groups.select(key, "sheet", F.get("r", F.lit(0))["place"].alias(place), F.nullif(F.get("r", F.lit(0))["raw"], F.lit("")).alias("revision"), F.size("r").alias("showings"))
    raws = F.array_join(F.transform("r", lambda x: F.when(x["raw"] == "", "(unrevised)").otherwise(x["raw"])), ", ")
    text_of = F.concat(F.lit("Sheet "), "sheet", F.lit(" is there "), F.size("r").cast("string"), F.lit(" times: "), raws)
    conflicts = groups.where(F.size("r") > 1).select(key, F.lit("warning").alias("severity"), F.lit("revision_conflict").alias("category"), text_of.alias("finding"), "sheet")
    return winners, conflicts


#: How texts state a weight of steel; the number, and whether it is in tons.
WEIGHTS = (
    (r"(?i)(?:approximately|approx\.?|about|min(?:imum)?|max(?:imum)?|\x{b1})\s*([\d.]+)\s*(?:tons?|t)\b\s*(?:of\s+)?(?:structural\s+)?(?:steel|metal|fabrication)", 2000),
    (r"(?i)(?:(?:approximately|approx\.?|about|min(?:imum)?|max(?:imum)?|\x{b1})?\s*)([\d,]+)\s*(?:lbs?|pounds?)\s*(?:of\s+)?(?:structural\s+)?(?:steel|metal|fabrication)", 1),
    (r"(?i)(?:estimated|est\.?)\s+(?:weight|tonnage)[:\s]+([\d.]+)\s*(?:tons?|t)\b", 2000),
)


def tonnages(text: Column) -> Column:
    """Pounds of steel that a page states: the first match of each of three ways to say so, as an array; numbers that are none, or 0, are left out."""
    number = lambda p: F.regexp_replace(F.regexp_extract(text, p, 1), ",", "").try_cast("double")
    found = F.array(*(number(p) * factor for p, factor in WEIGHTS))
    return F.filter(found, lambda x: F.coalesce(x > 0, F.lit(False)))


def tonnage(text: Column) -> Column:
    """The middle between the least and the most pounds of steel that a text states; null if it states none."""
    said = tonnages(text)
    return F.when(F.size(said) > 0, (F.array_min(said) + F.array_max(said)) / 2)


def tonnage_verdict(asserted: Column, priced: Column, within: float = 0.2) -> Column:
    return F.when(asserted.isNull() | (asserted == 0), "no_assertion").when(priced < asserted * (1 - within), "low").when(priced > asserted * (1 + within), "high").otherwise("ok")
