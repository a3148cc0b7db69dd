"""Priors and weights of sections from the rows of estimating workbooks.

Rows have file, row_no and cells, an array of texts by position. A workbook is small
and one task's; workbooks are many.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.operators import intake
from sluice.operators.windows import phases

#: The columns of a sheet, from the second cell on.
COLUMNS = ("drawing", "section", "item", "quantity", "pieces", "total_quantity", "unit", "unit_weight", "total_weight", "fab_hrs", "det_hrs", "eng_hrs", "foreman_hrs", "ironworker_hrs", "deliveries")
NUMBERS = ("unit_weight", "total_weight", "fab_hrs", "det_hrs", "eng_hrs", "foreman_hrs", "ironworker_hrs", "deliveries")
#: How units are named, and by how much expected hours may be off.
UNITS = {"FT": "lb/ft", "LF": "lb/ft", "EA": "lb/ea"}
LOW, HIGH = 0.75, 1.30


def named_cells(rows: DataFrame) -> DataFrame:
    """file, row_no and the columns of a sheet; empty cells are null, and so are numbers that are none."""
    cell = lambda i: F.nullif(F.trim(F.get("cells", F.lit(i))), F.lit(""))
    return rows.select("file", "row_no", *(cell(i).try_cast("double").alias(c) if c in NUMBERS else cell(i).alias(c) for i, c in enumerate(COLUMNS, 1)))


def in_phases(rows: DataFrame) -> DataFrame:
    """Named rows with phase, name and role (header, line or total) of the phases that end with a row of totals.

    A header is a text with a letter and nothing beside it. A total has hours or weight,
    no section and item, and begins with TOTAL or repeats the header.
    """
    named = named_cells(rows)
    bare = F.col("section").isNull() & F.col("item").isNull() & F.col("drawing").isNotNull()
    labor = F.greatest(*(F.coalesce(c, F.lit(0.0)) for c in NUMBERS[1:])) > 0
    header = bare & ~labor & F.col("drawing").rlike("[A-Za-z]")
    from pyspark.sql import Window as W

    w = W.partitionBy("file").orderBy("row_no").rowsBetween(W.unboundedPreceding, 0)
    named = named.withColumn("name", F.last(F.when(header, F.col("drawing")), ignorenulls=True).over(w))
    total = bare & labor & (F.upper("drawing").startswith("TOTAL") | F.coalesce(F.col("drawing") == F.col("name"), F.lit(False)))
    marked = named.withColumn("role", F.when(header, "header").when(total, "total").otherwise("line"))
    return phases(marked, ["file"], ["row_no"], F.col("role") == "header", F.col("role") == "total")


def priors(rows: DataFrame) -> DataFrame:
    """file, phase, name, assembly, size band, weight, expected hours and their bounds, a row for each phase."""
    totals = in_phases(rows).where("role = 'total'")
    hours = {c: F.coalesce(c, F.lit(0.0)) for c in ("fab_hrs", "det_hrs", "eng_hrs", "foreman_hrs", "ironworker_hrs", "deliveries")}
    bounds = {f"{c}_{end}": F.when(hours[c] > 0, F.round(hours[c] * by, 1)) for c in ("fab_hrs", "ironworker_hrs") for end, by in (("min", LOW), ("max", HIGH))}
    return totals.select("file", "phase", "name", intake.assembly(F.col("name")).alias("assembly_type"), intake.size_band(F.col("total_weight")).alias("size_band"), F.col("total_weight").alias("weight"), *(v.alias(f"{c}_expected") for c, v in hours.items()), *(v.alias(c) for c, v in bounds.items()))


def shapes(rows: DataFrame) -> DataFrame:
    """designation, unit, family and unit_weight: the first weight, by file and row, that lines in phases give a section in a unit.

    Lines without an item, a weight or a known unit are left out.
    """
    lines = in_phases(rows).where("role = 'line' and item is not null and unit_weight <> 0")
    unit = F.upper("unit")
    known = F.coalesce(*(F.when(unit == u, F.lit(n)) for u, n in UNITS.items()))
    found = lines.select(intake.designation(F.col("item")).alias("designation"), known.alias("unit"), F.struct("file", "row_no", "unit_weight").alias("at")).where("unit is not null")
    first = found.groupBy("designation", "unit").agg(F.min("at").alias("at"))
    return first.select("designation", "unit", intake.shape(F.col("designation")).alias("family"), "at.unit_weight")
