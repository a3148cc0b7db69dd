"""An ordered chain of checks on estimate lines.

Each check appends findings, struct<severity, category, finding, related_line>, to
a line's array and may change the line; later checks see the changes. Checks on
a run as a whole return findings of their own.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluice.functions.text import plain_punctuation

FINDING = "struct<severity:string,category:string,finding:string,related_line:int>"

#: Words by which a line says that its item exists already or goes.
EXISTING = r"(?i)\b(etr|existing to remain|exist\.? to remain|to be removed|demolish|demolition|salvage)\b"
FIELD_VERIFY = r"(?i)(field[ -]verify|verify in field|\bv\.?i\.?f\.?\b|confirm on site|by others to confirm)"
COLD_FORMED = r"(?i)\b\d{3,4}[sjtf]\d{3}-\d{2,3}\b"
#: Shape family by designation, and the grades that suit it.
FAMILIES = (("wide_flange", r"^W\d", ("A992", "A572")), ("tube", r"^HSS", ("A500", "A1085")), ("angle", r"^L\d", ("A36", "A529")), ("channel", r"^(C|MC)\d", ("A36",)), ("pipe", r"^PIPE", ("A53", "A500")))
#: Pounds per square foot that a kind of building usually has.
DENSITY = {"school": (6.0, 14.0), "office": (7.0, 15.0), "warehouse": (4.0, 10.0), "hospital": (10.0, 20.0)}


def _add(df: DataFrame, fires: Column, severity: str | Column, category: str, text: Column | str) -> DataFrame:
    one = F.struct((F.lit(severity) if isinstance(severity, str) else severity).alias("severity"), F.lit(category).alias("category"), (F.lit(text) if isinstance(text, str) else text).alias("finding"), F.col("line_no").cast("int").alias("related_line"))
    return df.withColumn("findings", F.when(F.coalesce(fires, F.lit(False)), F.array_append("findings", one)).otherwise(F.col("findings")))


def begin(lines: DataFrame) -> DataFrame:
    return lines.withColumn("findings", F.array().cast(f"array<{FINDING}>"))


def quote_check(df: DataFrame, page_text: str, least: float = 0.5) -> DataFrame:
    """A quoted source must be in the text: its first 80 characters, if 12 or more, or half of its words. No text, or no quote, no finding."""
    quote, text = plain_punctuation(F.col("source_evidence")), plain_punctuation(F.col(page_text))
    words = F.array_distinct(F.filter(F.split(quote, r"[^a-z0-9./'\"-]+"), lambda w: (F.length(w) >= 4) & ~w.rlike("^[0-9]+$")))
    ratio = F.size(F.filter(words, lambda w: F.contains(text, w))) / F.nullif(F.size(words), F.lit(0))
    direct = (F.length(quote) >= 12) & F.contains(text, F.substring(quote, 1, 80))
    asked = ~F.col("source_kind").isin("manual", "industry_default") & (F.length(quote) > 0) & (F.length(text) > 0)
    bad = F.coalesce(asked & ~direct & (F.coalesce(ratio, F.lit(0.0)) < least), F.lit(False))
    out = df.withColumn("__bad", bad)
    return _add(out, F.col("__bad"), "error", "fabricated_quote", "quoted text is not in the documents").withColumn("flagged", F.col("__bad") | F.coalesce("flagged", F.lit(False))).drop("__bad")


def band_downgrade(df: DataFrame) -> DataFrame:
    """A point quantity needs a schedule or a dimension in its evidence; else it is a range."""
    sure = F.coalesce(F.col("source_evidence"), F.lit("")).rlike(r"(?i)(schedule|\d+'-?\d*|\d+\s*(ea|each)\b)")
    weak = (F.col("quantity_band") == "point") & ~sure
    out = _add(df, weak, "warning", "band_downgrade", "a point quantity without schedule or dimension is a range")
    return out.withColumn("quantity_band", F.when(weak, "range").otherwise(F.col("quantity_band")))


def existing_work(df: DataFrame) -> DataFrame:
    """Work that exists or is removed is out of scope and flagged; a line from a demolition sheet is flagged."""
    marked = F.concat_ws(" ", "description", "source_evidence").rlike(EXISTING)
    sheet = F.coalesce(F.col("source_section"), F.lit("")).rlike(r"(?i)^D-?\d") & ~marked
    out = _add(df, marked, "error", "etr_in_scope", "existing or removed work is priced")
    out = _add(out, sheet, "warning", "demolition_sheet", "taken from a demolition sheet")
    return out.withColumns({"in_scope": F.when(marked, F.lit(False)).otherwise(F.coalesce("in_scope", F.lit(True))), "flagged": F.coalesce("flagged", F.lit(False)) | marked | sheet})


def replaced_equipment(df: DataFrame, categories: Sequence[str]) -> DataFrame:
    """Removed work that is replaced in kind is in scope again, and its flag is cleared."""
    back = ~F.col("in_scope") & F.col("category").isin(*categories) if categories else F.lit(False)
    out = df.withColumn("__back", back)
    out = _add(out, F.col("__back"), "info", "demo_replaced", "removed and replaced")
    return out.withColumns({"in_scope": F.col("in_scope") | F.col("__back"), "flagged": F.col("flagged") & ~F.col("__back")}).drop("__back")


def labor_floor(df: DataFrame, priors: DataFrame, hours: Sequence[str] = ("fab_hrs", "ironworker_hrs"), share: float = 0.5) -> DataFrame:
    """Hours above 0 that are under a share of the category's usual hours are raised to it. priors: category, and a column usual_<hours> each."""
    # a row for each category: few, and categories are too few to be dealt by
    out = df.join(F.broadcast(priors), "category", "left")
    for h in hours:
        low = (F.col(h) > 0) & (F.col(h) < share * F.col(f"usual_{h}"))
        out = _add(out.withColumn("__low", F.coalesce(low, F.lit(False))), F.col("__low"), "warning", "labor_floor", f"{h} raised to the usual floor")
        out = out.withColumn(h, F.when(F.col("__low"), share * F.col(f"usual_{h}")).otherwise(F.col(h))).drop("__low", f"usual_{h}")
    return out


def family(designation: Column) -> Column:
    return F.coalesce(*(F.when(F.upper(designation).rlike(p), F.lit(n)) for n, p, _ in FAMILIES))


def grade_check(df: DataFrame) -> DataFrame:
    """A shape's grade is one that its family comes in."""
    wrong = F.lit(False)
    for _, pattern, grades in FAMILIES:
        fits = F.lit(False)
        for g in grades:
            fits = fits | F.contains(F.upper("material_grade"), F.lit(g))
        wrong = wrong | (F.upper("steel_shape_designation").rlike(pattern) & ~fits)
    return _add(df, wrong & F.col("material_grade").isNotNull(), "warning", "grade_mismatch", "the grade does not suit the shape")


def prior_for(priors: DataFrame, building: str | None) -> DataFrame:
    """One prior for each category: of the building's type, else of any type, else without one; of several the least row."""
    kind = F.col("building_type")
    place = F.when(kind.eqNullSafe(F.lit(building)) & kind.isNotNull(), 0).when(F.coalesce(kind, F.lit("")) != "", 1).otherwise(2)
    return priors.groupBy("category").agg(F.min(F.struct(place.alias("place"), F.struct(*(c for c in priors.columns if c != "category")).alias("row"))).alias("p")).select("category", "p.row.*")


def bracket(df: DataFrame, priors: DataFrame, building: str | None = None, hours: str = "iron_hrs") -> DataFrame:
    """A quantity over 1.5 times the largest usual one, or, above 0, under half of the smallest; hours for each unit over twice the most or under 0.4 of the least usual.

    priors: category, low, high, and where known building_type, hours_low and hours_high.
    """
    known = priors
    for column, kind in (("building_type", "string"), ("hours_low", "double"), ("hours_high", "double")):
        known = known if column in known.columns else known.withColumn(column, F.lit(None).cast(kind))
    one = prior_for(known, building).select("category", *(F.col(c).alias(f"__{c}") for c in ("low", "high", "hours_low", "hours_high")))
    out = df.join(F.broadcast(one), "category", "left")
    quantity = F.coalesce("quantity", F.lit(0.0))
    out = _add(out, quantity > 1.5 * F.col("__high"), "warning", "above_bracket", "more than 1.5 times the usual most")
    out = _add(out, (quantity > 0) & (quantity < 0.5 * F.col("__low")), "info", "below_bracket", "less than half of the usual least")
    if hours in df.columns:
        each = F.when((quantity > 0) & (F.col(hours) > 0) & F.col("__hours_high").isNotNull(), F.col(hours) / quantity)
        above = each > 2 * F.col("__hours_high")
        out = _add(out, above, "warning", "labor_above_bracket", "more than twice the usual hours for each unit")
        out = _add(out, ~above & (each < 0.4 * F.col("__hours_low")), "warning", "labor_below_bracket", "under 0.4 of the usual hours for each unit")
    return out.drop("__low", "__high", "__hours_low", "__hours_high")


def cold_formed(df: DataFrame) -> DataFrame:
    hit = F.coalesce(F.concat_ws(" ", "steel_shape_designation", "description").rlike(COLD_FORMED), F.lit(False))
    return _add(df, hit, "warning", "cold_formed", "a cold-formed section belongs to another trade").withColumn("flagged", F.col("flagged") | hit)


def field_verify(df: DataFrame) -> DataFrame:
    """What must be verified on site is at most half sure; an unknown confidence becomes 0."""
    hit = F.coalesce(F.concat_ws(" ", "source_evidence", "description").rlike(FIELD_VERIFY), F.lit(False))
    out = _add(df, hit, "warning", "field_verify", "to be verified in the field")
    return out.withColumns({"flagged": F.col("flagged") | hit, "confidence": F.when(hit, F.least(F.coalesce("confidence", F.lit(0.0)), F.lit(0.5))).otherwise(F.col("confidence"))})


def overlaps(df: DataFrame, key: str) -> DataFrame:
    """Findings on categories of a run whose lines share type markers such as F1 or L2."""
    marks = F.regexp_extract_all(F.upper("description"), F.lit(r"\b([A-Z]{1,2}\d{1,2})\b"), F.lit(1))
    grouped = df.where("in_scope").groupBy(key, "category").agg(F.count("*").alias("n"), F.flatten(F.collect_list(marks)).alias("marks"), F.min("line_no").cast("int").alias("related_line"))
    hit = grouped.where((F.col("n") > 1) & (F.size("marks") > 0) & (F.size(F.array_distinct("marks")) < F.col("n")))
    return hit.select(key, F.lit("info").alias("severity"), F.lit("overlap").alias("category"), F.concat_ws(" ", F.col("n").cast("string"), F.lit("lines of"), "category", F.lit("share markers")).alias("finding"), "related_line")


def section_coverage(df: DataFrame, sections: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Findings on sections of a run none of whose expected categories has a line. sections: key, section; expected: section, category."""
    have = df.select(key, "category").distinct()
    asked = sections.join(expected, "section")
    met = asked.join(have, [key, "category"], "left_semi").select(key, "section").distinct()
    gone = asked.select(key, "section").distinct().join(met, [key, "section"], "left_anti")
    return gone.select(key, F.lit("warning").alias("severity"), F.lit("spec_uncovered").alias("category"), F.concat(F.lit("no line for section "), "section").alias("finding"), F.lit(None).cast("int").alias("related_line"))


def density(df: DataFrame, areas: DataFrame, key: str, bands: Mapping[str, tuple[float, float]] = DENSITY) -> DataFrame:
    """Findings on runs whose pounds per square foot are out of their building's band. areas: key, area, building."""
    weight = df.groupBy(key).agg(F.sum(F.coalesce("total_weight_lbs", F.lit(0.0))).alias("weight"))
    found = weight.join(areas, key).where("weight > 0 and area > 0").withColumn("d", F.col("weight") / F.col("area"))
    low, high = (F.coalesce(*(F.when(F.col("building") == b, F.lit(v[i])) for b, v in bands.items())) for i in (0, 1))
    side = F.when(F.col("d") < low, "below").when(F.col("d") > high, "above")
    return found.withColumn("side", side).where("side is not null").select(key, F.lit("warning").alias("severity"), F.concat(F.lit("density_"), "side").alias("category"), F.concat(F.round("d", 2).cast("string"), F.lit(" lb/sf")).alias("finding"), F.lit(None).cast("int").alias("related_line"))


def validate_lines(lines: DataFrame, *, page_text: str = "page_text", equipment: Sequence[str] = (), usual_hours: DataFrame | None = None, brackets: DataFrame | None = None) -> DataFrame:
    """All checks on lines, in their order. The override for replaced equipment clears flags that earlier checks have set."""
    out = existing_work(band_downgrade(quote_check(begin(lines), page_text)))
    out = replaced_equipment(out, equipment)
    if usual_hours is not None:
        out = labor_floor(out, usual_hours)
    out = grade_check(out)
    if brackets is not None:
        out = bracket(out, brackets)
    return field_verify(cold_formed(out))


def findings(lines: DataFrame, key: str, *run_level: DataFrame) -> DataFrame:
    """All findings, a row each: of validated lines and of runs."""
    own = lines.select(key, F.explode("findings").alias("f")).select(key, "f.severity", "f.category", "f.finding", "f.related_line")
    for other in run_level:
        own = own.unionByName(other)
    return own


def questions(lines: DataFrame, key: str, least: float = 0.7) -> DataFrame:
    """Numbered questions on unsure or flagged lines of each run, in line order."""
    asked = lines.where((F.coalesce("confidence", F.lit(0.0)) < least) | F.col("flagged"))
    placed = asked.withColumn("question_no", F.row_number().over(W.partitionBy(key).orderBy("line_no", "part_id") if "part_id" in lines.columns else W.partitionBy(key).orderBy("line_no")))
    reason = F.when(F.col("flagged"), "flagged for review").otherwise("low confidence")
    return placed.select(key, "question_no", "line_no", F.concat(F.lit("RFI "), F.lpad(F.col("question_no").cast("string"), 3, "0"), F.lit(": confirm "), "category", F.lit(" ("), reason, F.lit(")")).alias("question"))


def request_texts(lines: DataFrame, key: str, topics: Mapping[str, str], least: float = 0.7) -> DataFrame:
    """key, question_no, line_no, topic, context, source_cited, asked_for and copy_text of the questions on unsure or flagged lines.

    lines: category, description, quantity, quantity_unit, quantity_band (point, range
    or assumed_typical), quantity_min, quantity_max, source_kind, source_section,
    source_page, assumptions, confidence, flagged. What is asked for depends on where
    the number comes from.
    """
    asked = lines.where((F.coalesce("confidence", F.lit(0.0)) < least) | F.col("flagged"))
    placed = asked.withColumn("question_no", F.row_number().over(W.partitionBy(key).orderBy("line_no", "description")))
    number = lambda c: F.col(c).cast("string")
    some, unit = F.concat_ws(" ", number("quantity"), "quantity_unit"), F.col("quantity_unit")
    span = F.concat(number("quantity_min"), F.lit(" to "), number("quantity_max"), F.lit(" "), unit)
    ranged = F.coalesce((F.col("quantity_band") == "range") & F.col("quantity_min").isNotNull() & F.col("quantity_max").isNotNull(), F.lit(False))
    amount = F.when(F.col("quantity_band") == "point", some).when(ranged, F.concat(span, F.lit(" (assumed "), some, F.lit(")"))).otherwise(F.concat(some, F.lit(" (assumed)")))
    page = F.when(F.col("source_page").isNotNull(), F.concat(F.lit("page "), number("source_page")))
    cited = F.nullif(F.concat_ws(", ", "source_section", page), F.lit(""))
    context = F.concat_ws(" ", F.concat(F.lit("The documents show "), F.lower("description"), F.lit(".")), F.concat(F.lit("Source: "), cited, F.lit(".")), F.concat(F.lit("Quantity: "), amount, F.lit(".")), F.concat(F.lit("Assumed: "), F.col("assumptions")))
    what = F.replace(F.col("category"), F.lit("_"), F.lit(" "))
    guess = F.coalesce(F.col("source_kind").isin("assumption", "industry_default"), F.lit(False))
    asks = (
        F.when(guess, F.concat(F.lit("Confirm quantity, sizes and places of "), what, F.lit(", or that it is excluded.")))
        .when(F.col("flagged") & (F.col("quantity_band") == "assumed_typical"), F.concat(F.lit("Confirm the quantity of "), what, F.lit("; "), some, F.lit(" are assumed as usual for such a building.")))
        .when(F.col("flagged") & ranged, F.concat(F.lit("Confirm the count of "), what, F.lit(" between "), span, F.lit(".")))
        .otherwise(F.concat(F.lit("Confirm quantity and sizes of "), what, F.lit(".")))
    )
    topic = F.coalesce(*(F.when(F.col("category") == k, F.lit(v)) for k, v in topics.items()), F.concat(what, F.lit(" scope and quantity")))
    named = placed.select(key, "question_no", "line_no", topic.alias("topic"), context.alias("context"), F.coalesce(cited, F.concat(F.lit("inferred from "), "source_kind")).alias("source_cited"), asks.alias("asked_for"))
    lines_of = F.concat_ws("\n", F.concat(F.lit("Q"), number("question_no"), F.lit(": "), "topic"), F.concat(F.lit("Context: "), "context"), F.concat(F.lit("Source: "), "source_cited"), F.concat(F.lit("Request: "), "asked_for"))
    return named.withColumn("copy_text", lines_of)
