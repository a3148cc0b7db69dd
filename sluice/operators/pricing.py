"""Line pricing, confidence, scenarios and run totals."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rates of a card; a card of a run overrides what it names.
RATES = {"steel": 0.62, "stainless": 2.4, "galvanize": 0.45, "paint_factor": 0.12, "fab": 68.0, "iron": 82.0, "waste": 0.05, "sales_tax": 0.055, "overhead": 0.12, "profit": 0.1, "bond": 0.015, "delivery": 450.0, "equipment": 900.0}
#: What a line's source and the kind of its quantity are worth.
AUTHORITY = {"from_schedule": 0.95, "drawing": 0.9, "spec": 0.75, "qa": 0.78, "audit": 0.65, "manual": 0.85, "industry_default": 0.45}
PRECISION = {"point": 1.0, "range": 0.92, "assumed_typical": 0.78}
#: Scenario: share of the bound in the quantity and which bound, factor on labour, factor on contingency.
SCENARIOS = (("conservative", "quantity_max", 1.08, 1.25), ("expected", None, 1.0, 1.0), ("aggressive", "quantity_min", 0.95, 0.5))


def zero(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0.0))


def not_zero(c: Column) -> Column:
    return F.nullif(c, F.lit(0.0))


def priced(lines: DataFrame, rates: Mapping[str, float] = RATES, grade: str | None = None) -> DataFrame:
    """lines with weight, material, labor, finishing and total; amounts of 0 are null.

    A weight comes from the unit weight with waste, else from the total weight as
    given. A quantity in pounds is its own weight where there is a unit weight.
    """
    r = {k: F.lit(v) for k, v in (RATES | dict(rates)).items()}
    waste, q = 1 + r["waste"], F.col("quantity")
    by_unit = F.when((F.col("quantity_unit") == "LBS"), q).otherwise(q * F.col("unit_weight") * waste)
    weight = F.when(F.col("unit_weight").isNotNull() & q.isNotNull(), by_unit).otherwise(F.col("total_weight"))
    rate = F.when(F.upper(grade).rlike("STAINLESS|316|304"), r["stainless"]).otherwise(r["steel"]) if grade else r["steel"]
    out = lines.withColumn("weight", weight).withColumn("material", F.col("weight") * rate)
    labor = zero("fab_hrs") * r["fab"] + zero("iron_hrs") * r["iron"]
    finish = F.when(F.col("finish") == "galvanized", zero("weight") * r["galvanize"]).when(F.col("finish").isin("shop_primer", "powder_coat"), zero("material") * r["paint_factor"]).otherwise(F.lit(0.0))
    return out.withColumns({"labor": not_zero(labor), "finishing": not_zero(finish), "total": not_zero(zero("material") + labor + finish)})


def priced_at_commit(lines: DataFrame, catalog: DataFrame, rates: Mapping[str, float] = RATES) -> DataFrame:
    """lines with weight, material, labor, finishing and total, as they are priced when a takeoff is committed.

    catalog (designation, unit_weight, unit) fills in a missing unit weight and its unit
    for lines that name a section. Pounds a foot weigh by LF or FT, pounds each by EA;
    LBS are their own weight; any other quantity takes the weight as given, or the
    product. Waste comes on top of every weight, also of one that is given.
    """
    r = {k: F.lit(v) for k, v in (RATES | dict(rates)).items()}
    known = catalog.groupBy("designation").agg(F.min(F.struct("unit_weight", "unit")).alias("__c"))
    # a catalog names some hundreds of sections, and lines of one section are too many for a task
    met = lines.join(F.broadcast(known), lines["steel_shape_designation"] == known["designation"], "left").drop("designation")
    each, unit, q, given = F.coalesce("unit_weight", "__c.unit_weight"), F.coalesce("unit_weight_unit", "__c.unit"), F.col("quantity"), F.col("total_weight")
    fits = ((unit == "lb/ft") & F.col("quantity_unit").isin("LF", "FT")) | ((unit == "lb/ea") & (F.col("quantity_unit") == "EA"))
    by_unit = F.when(fits, q * each).when(F.col("quantity_unit") == "LBS", q).when(each != 0, F.coalesce(given, q * each))
    weight = F.when(each.isNotNull() & q.isNotNull(), by_unit).otherwise(given) * (1 + r["waste"])
    rate = F.when(F.coalesce(F.upper("material_grade").rlike("STAINLESS|316|304"), F.lit(False)), r["stainless"]).otherwise(r["steel"])
    out = met.withColumn("weight", weight).withColumn("material", F.col("weight") * rate)
    labor = zero("fab_hrs") * r["fab"] + zero("iron_hrs") * r["iron"]
    finish = F.when(F.col("finish") == "galvanized", zero("weight") * r["galvanize"]).when(F.col("finish").isin("shop_primer", "powder_coat") & F.col("weight").isNotNull(), zero("material") * r["paint_factor"]).otherwise(F.lit(0.0))
    return out.withColumns({"labor": not_zero(labor), "finishing": not_zero(finish), "total": not_zero(zero("material") + labor + finish)}).drop("__c")


def totals(pre: Column, rates: Mapping[str, float] = RATES) -> dict[str, Column]:
    """subtotal, overhead, profit, bond and bid, from the sum before tax."""
    r = RATES | dict(rates)
    subtotal = pre * (1 + r["sales_tax"])
    overhead = subtotal * r["overhead"]
    profit = (subtotal + overhead) * r["profit"]
    bond = (subtotal + overhead + profit) * r["bond"]
    return {"subtotal": subtotal, "overhead": overhead, "profit": profit, "bond": bond, "bid": subtotal + overhead + profit + bond}


def rolled_up(lines: DataFrame, key: str, rates: Mapping[str, float] = RATES) -> DataFrame:
    """One row for each run of priced lines: sums, fixed costs once, and what comes on top."""
    r = RATES | dict(rates)
    sums = lines.groupBy(key).agg(*(F.sum(zero(c)).alias(c) for c in ("material", "labor", "finishing")), F.avg(zero("confidence")).alias("confidence"), F.count_if("flagged").alias("flagged"))
    pre = F.col("material") + F.col("labor") + F.col("finishing") + r["delivery"] + r["equipment"]
    return sums.withColumns(totals(pre, rates))


def contingency(confidence: Column) -> Column:
    c = F.coalesce(confidence, F.lit(0.0))
    return F.when(c >= 0.9, 0.0).when(c >= 0.8, 0.02).when(c >= 0.7, 0.05).when(c >= 0.6, 0.08).otherwise(0.12)


def scenario_lines(lines: DataFrame, rates: Mapping[str, float] = RATES) -> DataFrame:
    """Each line in each scenario: one pass over the lines, three rows out."""
    r = RATES | dict(rates)
    q = F.col("quantity")
    forms = []
    for name, bound, labor, cont in SCENARIOS:
        quantity = q if bound is None else F.when(F.col(bound).isNotNull(), 0.7 * q + 0.3 * F.col(bound)).otherwise(q)
        forms.append(F.struct(F.lit(name).alias("scenario"), quantity.alias("quantity"), F.lit(labor).alias("labor_factor"), F.lit(cont).alias("contingency_factor")))
    each = lines.withColumn("s", F.explode(F.array(*forms)))
    qs = F.col("s.quantity")
    weight = F.when(F.col("total_weight").isNotNull() & (q > 0), F.col("total_weight") / q * qs).when(F.col("unit_weight").isNotNull(), qs * F.col("unit_weight") * (1 + r["waste"])).otherwise(0.0)
    ratio = F.when(q > 0, qs / q).otherwise(1.0)
    out = each.withColumns({"scenario": F.col("s.scenario"), "weight": weight})
    out = out.withColumns({"material": F.col("weight") * r["steel"], "labor": (zero("fab_hrs") * r["fab"] + zero("iron_hrs") * r["iron"]) * ratio * F.col("s.labor_factor")})
    out = out.withColumn("finishing", F.when(F.col("finish") == "galvanized", F.col("weight") * r["galvanize"]).when(F.col("finish").isin("shop_primer", "powder_coat"), F.col("material") * r["paint_factor"]).otherwise(0.0))
    return out.withColumn("contingency", (F.col("material") + F.col("labor") + F.col("finishing")) * contingency(F.col("confidence")) * F.col("s.contingency_factor")).drop("s")


def scenario_totals(lines: DataFrame, key: list[str], rates: Mapping[str, float] = RATES) -> DataFrame:
    """Bids and margins of each key and scenario."""
    r = RATES | dict(rates)
    sums = scenario_lines(lines, rates).groupBy(*key, "scenario").agg(*(F.sum(c).alias(c) for c in ("material", "labor", "finishing", "contingency")))
    pre = F.col("material") + F.col("labor") + F.col("finishing") + F.col("contingency") + r["delivery"] + r["equipment"]
    out = sums.withColumns(totals(pre, rates))
    return out.withColumn("margin", F.when(F.col("bid") > 0, (F.col("overhead") + F.col("profit") + F.col("bond")) / F.col("bid") * 100).otherwise(0.0))


def confidence(source: str, band: str, n: Column, low: str, high: str, quantity: str) -> Column:
    """Authority x precision x corroboration x tightness, within 0.30 and 0.99."""
    pick = lambda c, table, other: F.coalesce(*(F.when(F.lower(c) == k, F.lit(v)) for k, v in table.items()), F.lit(other))
    corroborated = F.least(F.lit(1.1), 1 + 0.05 * (F.greatest(F.lit(1), F.coalesce(F.nullif(n, F.lit(0)), F.lit(1))) - 1))
    q, span = F.col(quantity), F.greatest(F.col(high) - F.col(low), F.lit(0.0))
    tight = F.when(q.isNull() | (q == 0) | F.col(low).isNull() | F.col(high).isNull(), 1.0).otherwise(F.greatest(F.lit(0.75), 1 - 0.125 * span / F.greatest(q, F.lit(1.0))))
    return F.least(F.lit(0.99), F.greatest(F.lit(0.3), pick(source, AUTHORITY, 0.5) * pick(band, PRECISION, 0.85) * corroborated * tight))
