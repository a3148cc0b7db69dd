"""Kinds, stages, doors, weights and brackets by fixed rules, as queries over documents and order lines.

Files are documents with a name and a phrase at the end of their text. The SQL has
the patterns written out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators import documents, layout, validate
from sluice.plans.intake import pick
from sluice.plans.relations import cte, lines, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


L = cte("lines")
FILE = {
    "doc_id": "doc_id",
    "pkg": "doc_id % 61",
    "filename": f"concat({pick('doc_id * 5 + doc_id % 3', 'Project Manual', 'A-plan', 'Geotech report', 'Bid Form', 'RFP draft', 'Permit Set final', 'Q&A log', 'Addendum 2', 'Revision B', 'Spec book', 'aerial site', 'IFB documents', 'photos', 'Issued for bid sheets', '95% progress print', 'SOW', 'Affidavit')}, ' ', doc_id, '.pdf')",
    "hint": pick("doc_id", None, "general", "drawing", "form"),
    "kind": pick("doc_id % 11", "qa_log", "specification", "drawing", None),
    "raster": "doc_id % 9 = 4",
    "text": f"concat(coalesce(text, ''), {pick('doc_id * 3 + doc_id % 5', ' Section 05 50 00 metals', ' please carry a reasonable assumption', ' issued for construction', ' as IFC', ' as ifc', ' the specs will be updated later', ' Boring log 4', ' response status open', ' sheet no 4', ' about 12.5 tons of structural steel', ' 1,250 lbs of steel and minimum 2 tons steel', ' estimated weight: 3 tons', ' 900 pounds', '', ' about 0 tons of steel', ' the task name column', ' approx. 40 t metal')})",
}
FILES = f"WITH files AS (SELECT {', '.join(f'{e} AS {n}' for n, e in FILE.items())} FROM documents)"


def files(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(*(F.expr(e).alias(n) for n, e in FILE.items()))


@query(rf"""{FILES}, c AS (SELECT CASE WHEN regexp_matches(lower(filename), 'spec|scope\s*of\s*work|sow\b') THEN 'specification'
  WHEN regexp_matches(lower(filename), 'drawing|plan|blueprint|sheet|civil|arch|structural|detail|rfp') THEN 'drawing'
  WHEN regexp_matches(lower(filename), 'addendum|amendment|revision|rev\b') THEN 'addendum'
  WHEN regexp_matches(lower(filename), 'form|checklist|affidavit|certification|submittal') THEN 'form' ELSE 'general' END AS category FROM files)
SELECT category, CASE category WHEN 'specification' THEN 1 WHEN 'drawing' THEN 2 WHEN 'addendum' THEN 3 WHEN 'general' THEN 4 ELSE 5 END AS priority, count(*) AS n FROM c GROUP BY 1, 2""")
def file_categories(spark: SparkSession, sf: str) -> DataFrame:
    found = files(spark, sf).select(documents.file_category(F.col("filename")).alias("category"))
    return found.withColumn("priority", documents.file_priority(F.col("category"))).groupBy("category", "priority").agg(F.count("*").alias("n"))


KIND = r"""CASE
  WHEN regexp_matches(t, 'geotechnical engineering|standard penetration|soil borin|boring log|atterberg|n[- ]value') THEN 'geotech'
  WHEN regexp_matches(t, 'question (and|&) answer|response status|clarifications? log') THEN 'qa_log'
  WHEN regexp_matches(t, '\b(task name|gantt|predecessors|critical path)\b') THEN 'schedule'
  WHEN regexp_matches(t, 'section \d\d\s\d\d\s\d\d\b|csi format|division \d\d\b') THEN 'specification'
  WHEN regexp_matches(t, '\bsheet (no|number|#)|\bscale[: ]+1[/=]|\b(plan|elevation|section|detail) view\b') THEN 'drawing'
  WHEN regexp_matches(f, 'geotech') THEN 'geotech' WHEN regexp_matches(f, '\bq(uestion)?[\s_-]*&?[\s_-]*a(nswer)?\b') THEN 'qa_log' WHEN regexp_matches(f, 'addend|revision') THEN 'addendum'
  WHEN regexp_matches(f, '\bspecs?\b|project[\s_-]?manual|\bsow\b') THEN 'specification' WHEN regexp_matches(f, '\bsheet\b|permit[\s_-]?set|section|detail') THEN 'drawing' WHEN regexp_matches(f, 'aerial') THEN 'site_markup'
  WHEN regexp_matches(f, 'bid[\s_-]?form') THEN 'proposal_form' WHEN coalesce(hint, 'general') <> 'general' THEN hint WHEN raster THEN 'raster_scan' ELSE 'unknown' END"""


@query(rf"""{FILES}, t AS (SELECT *, CASE WHEN raster THEN '' ELSE lower(text) END AS t, lower(filename) AS f FROM files)
SELECT doc_id, {KIND} AS kind,
  CAST(CASE WHEN regexp_matches(t, 'geotechnical engineering|standard penetration|soil borin|boring log|atterberg|n[- ]value|question (and|&) answer|response status|clarifications? log') THEN 80
  WHEN regexp_matches(t, '\b(task name|gantt|predecessors|critical path)\b|section \d\d\s\d\d\s\d\d\b|csi format|division \d\d\b|\bsheet (no|number|#)|\bscale[: ]+1[/=]|\b(plan|elevation|section|detail) view\b') THEN 70
  WHEN regexp_matches(f, 'geotech|\bq(uestion)?[\s_-]*&?[\s_-]*a(nswer)?\b|addend|revision|\bspecs?\b|project[\s_-]?manual|\bsow\b|\bsheet\b|permit[\s_-]?set|aerial|bid[\s_-]?form') THEN 60
  WHEN coalesce(hint, 'general') <> 'general' THEN 50 ELSE 0 END AS INTEGER) AS confidence FROM t""")
def document_kinds(spark: SparkSession, sf: str) -> DataFrame:
    kind = documents.document_kind(F.col("filename"), F.col("hint"), F.col("text"), F.col("raster"))
    return files(spark, sf).select("doc_id", kind.alias("k")).select("doc_id", "k.*")


@query(rf"""{FILES}, s AS (SELECT pkg,
  sum(CASE WHEN regexp_matches(lower(filename), '\b(draft|pre[\s_-]?gmp|rfp|preliminary|progress[\s_-]?print|dd\b|95[\s_-]?%)') THEN 2 ELSE 0 END
    + CASE WHEN kind IN ('qa_log', 'specification') THEN regexp_matches(text, '(?i)please\s+(make|carry|use)\s+(a\s+)?reasonable\s+assumption')::INT + regexp_matches(text, '(?i)(specs|specifications)\s+(will\s+be\s+|to\s+be\s+)?(updated|provided|added)')::INT ELSE 0 END) AS rfp,
  sum(CASE WHEN regexp_matches(lower(filename), '\b(final|issued[\s_-]?for[\s_-]?(construction|bid|permit)|ifc\b|ifb\b|cd[\s_-]?set|100[\s_-]?%|permit[\s_-]?set)') THEN 2 ELSE 0 END
    + CASE WHEN kind IN ('qa_log', 'specification') THEN regexp_matches(text, '(?i)\bissued\s+for\s+construction\b')::INT + regexp_matches(text, '\bIFC\b')::INT ELSE 0 END) AS cd
  FROM files GROUP BY 1)
SELECT pkg, CASE WHEN rfp + cd = 0 THEN 'unknown' WHEN rfp >= cd THEN 'pre_gmp_rfp' ELSE 'final_cd' END AS stage,
  CAST(CASE WHEN rfp <> cd AND greatest(rfp, cd) >= 2 THEN least(95, 50 + 8 * greatest(rfp, cd)) WHEN rfp + cd > 0 THEN 40 ELSE 0 END AS INTEGER) AS confidence FROM s""")
def package_stages(spark: SparkSession, sf: str) -> DataFrame:
    return documents.stage(files(spark, sf), "pkg", "filename", "kind", "text")


WEIGHED = r"""w AS (SELECT pkg, list_filter([
  2000 * try_cast(regexp_extract(text, '(?i)(?:approximately|approx\.?|about|min(?:imum)?|max(?:imum)?|±)\s*([\d.]+)\s*(?:tons?|t)\b\s*(?:of\s+)?(?:structural\s+)?(?:steel|metal|fabrication)', 1) AS DOUBLE),
  try_cast(replace(regexp_extract(text, '(?i)([\d,]+)\s*(?:lbs?|pounds?)\s*(?:of\s+)?(?:structural\s+)?(?:steel|metal|fabrication)', 1), ',', '') AS DOUBLE),
  2000 * try_cast(regexp_extract(text, '(?i)(?:estimated|est\.?)\s+(?:weight|tonnage)[:\s]+([\d.]+)\s*(?:tons?|t)\b', 1) AS DOUBLE)], lambda x: x > 0) AS said FROM files)"""


@query(f"""{FILES}, {WEIGHED}, e AS (SELECT pkg, unnest(said) AS pounds FROM w), m AS (SELECT pkg, min(pounds) AS least, max(pounds) AS most, count(*) AS n FROM e GROUP BY 1),
t AS (SELECT l_suppkey % 61 AS pkg, sum(l_quantity * 12.5) AS taken FROM lineitem GROUP BY 1)
SELECT pkg, coalesce(n, 0) AS stated, least, most, CASE WHEN n IS NULL THEN 'no_assertion' WHEN abs(taken - (least + most) / 2) <= 0.2 * (least + most) / 2 THEN 'ok' WHEN taken < (least + most) / 2 THEN 'low' ELSE 'high' END AS status FROM t LEFT JOIN m USING (pkg)""")
def stated_tonnage(spark: SparkSession, sf: str) -> DataFrame:
    each = files(spark, sf).select("pkg", F.explode(layout.tonnages(F.col("text"))).alias("pounds"))
    said = each.groupBy("pkg").agg(F.count("*").alias("n"), F.min("pounds").alias("least"), F.max("pounds").alias("most"))
    taken = table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 61).alias("pkg")).agg(F.sum(F.col("l_quantity") * 12.5).alias("taken"))
    both = taken.join(said, "pkg", "left")
    verdict = layout.tonnage_verdict((F.col("least") + F.col("most")) / 2, F.col("taken"))
    return both.select("pkg", F.coalesce("n", F.lit(0).cast("long")).alias("stated"), "least", "most", verdict.alias("status"))


DOOR = {
    "o": "l_orderkey % 500",
    "number": "CAST(100 + l_partkey % 40 AS VARCHAR(10))",
    "room": "CAST(l_suppkey % 6 AS VARCHAR(10))",
    "cells": pick("l_partkey % 40 + l_suppkey % 6", "HM frame F1", "hm FG", "Hollow metal, sidelight", "ETR", "existing to remain HM", "Alum. storefront", "FRP door", "HM standard", "hm oak", "wood", "HM f 3x7", "glass"),
}
DOORS = f"WITH doors AS (SELECT {', '.join(f'{e} AS {n}' for n, e in DOOR.items())} FROM lineitem)"
DOOR_KIND = r"""CASE WHEN regexp_matches(c, '\betr\b|existing.to.remain') THEN 'etr' WHEN regexp_matches(c, '\balum') THEN 'aluminum' WHEN regexp_matches(c, '\bfrp\b') THEN 'frp'
  WHEN regexp_matches(c, '\bhm\b|hollow.metal') THEN CASE WHEN regexp_matches(c, '\bfg\b|hm/?glass|sidelight|full.glass') THEN 'hm_glass' WHEN regexp_matches(c, '\bf1\b|standard|flush|\bf\s') THEN 'hm_f1' ELSE 'hm_other' END ELSE 'other' END"""


def doors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(*(F.expr(e).alias(n) for n, e in DOOR.items()))


@query(f"{DOORS}, c AS (SELECT lower(cells) AS c FROM doors) SELECT {DOOR_KIND} AS kind, count(*) AS n FROM c GROUP BY 1")
def door_classes(spark: SparkSession, sf: str) -> DataFrame:
    return doors(spark, sf).groupBy(documents.door_class(F.col("cells")).alias("kind")).agg(F.count("*").alias("n"))


@query(f"""{DOORS}, d AS (SELECT o, number, room, lower(min(cells)) AS c FROM doors GROUP BY 1, 2, 3), k AS (SELECT o, CASE WHEN number = CAST(100 + o % 40 AS VARCHAR) THEN 'excluded_by_room' ELSE {DOOR_KIND} END AS k FROM d)
SELECT o, count(*) AS total, {", ".join(f"count(*) FILTER (WHERE k = '{x}') AS {x}" for x in ("excluded_by_room", "etr", "aluminum", "frp", "hm_glass", "hm_f1", "hm_other"))}, count(*) FILTER (WHERE k IN ('hm_f1', 'hm_glass', 'hm_other')) AS ours FROM k GROUP BY 1""")
def door_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = doors(spark, sf)
    left_out = rows.select("o", (100 + F.col("o") % 40).alias("number")).distinct()
    return documents.door_counts(rows, "o", ["number", "room"], "number", "cells", left_out)


@query(f"""{L}, q AS (SELECT *, CASE WHEN line_no = 7 THEN 0 ELSE quantity END AS q FROM lines), p AS (SELECT *, CASE WHEN category IN ('SMALL', 'PROMO') THEN 8 ELSE 10 END AS low, CASE WHEN category IN ('SMALL', 'PROMO') THEN 20 ELSE 30 END AS high FROM q)
SELECT category, count(*) FILTER (WHERE q > 1.5 * high) AS above_bracket, count(*) FILTER (WHERE q > 0 AND q < 0.5 * low) AS below_bracket,
  count(*) FILTER (WHERE q > 0 AND iron_hrs / nullif(q, 0) * (1 + line_no) > 1.0) AS labor_above_bracket, count(*) FILTER (WHERE q > 0 AND iron_hrs / nullif(q, 0) * (1 + line_no) <= 1.0 AND iron_hrs / nullif(q, 0) * (1 + line_no) < 0.6) AS labor_below_bracket FROM p GROUP BY 1""")
def quantity_brackets(spark: SparkSession, sf: str) -> DataFrame:
    own = lines(spark, sf).withColumns({"quantity": F.when(F.col("line_no") == 7, 0.0).otherwise(F.col("quantity")), "iron_hrs": F.col("iron_hrs") * (1 + F.col("line_no"))})
    # small and promotional work has a prior for shops; of the others the one of any building counts
    usual = own.select("category").distinct().withColumns({"low": F.lit(10.0), "high": F.lit(30.0), "building_type": F.lit("school"), "hours_low": F.lit(1.5), "hours_high": F.lit(0.5)})
    shops = usual.where("category in ('SMALL', 'PROMO')").withColumns({"low": F.lit(8.0), "high": F.lit(20.0), "building_type": F.lit("shop")})
    none = usual.withColumns({"low": F.lit(0.0), "high": F.lit(0.0), "building_type": F.lit(None).cast("string")})
    named = validate.bracket(validate.begin(own), usual.unionByName(shops).unionByName(none), "shop").withColumn("c", F.transform("findings", lambda f: f["category"]))
    return named.groupBy("category").agg(*(F.count_if(F.array_contains("c", c)).alias(c) for c in ("above_bracket", "below_bracket", "labor_above_bracket", "labor_below_bracket")))
