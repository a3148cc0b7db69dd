"""Scores, filters, classes and counters of notices and document packages as queries.

Notices and package pages are derived from the tables at hand by expressions that
Spark and DuckDB read alike; what is asked of them is written twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators import coverage, intake, scoring, validate
from sluice.plans.relations import dealt, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def pick(n: str, *values: str | None) -> str:
    """SQL for the value at n modulo their number."""
    return f"CASE ({n}) % {len(values)} " + " ".join(f"WHEN {i} THEN {'NULL' if v is None else repr(v)}" for i, v in enumerate(values)) + " END"


K = "o_orderkey"
NOTICES = {
    "opp_id": K,
    "status": pick(f"{K} + 1", "new", "reviewing", "bidding", "passed", "won", "lost"),
    "code": pick(K, "332312", "332323", "238120", "541511", None),
    "low": f"CASE {K} % 7 WHEN 0 THEN NULL WHEN 1 THEN CAST(3000 AS DOUBLE) WHEN 2 THEN CAST(2500000 AS DOUBLE) ELSE o_totalprice END",
    "high": f"CASE {K} % 5 WHEN 0 THEN NULL WHEN 1 THEN CAST(4000 AS DOUBLE) ELSE o_totalprice * 2 END",
    "title": pick(f"{K} + o_custkey", "Handrail welding at depot", "VALVE,GATE", "53--BEARING, ROLLER", "Roof replacement, hangar 4", "Steel fabrication of a canopy", "RFP #310001", "Ladder repair", "2031-QRSTV-00417-ABC", "  ", "Mowing services", "WQ70331:", "31-204XYZ-NOPQ7-K-40815", "900112-Z31-0000045", "Illinois Bid 31-204", "203100770011", "70001-3-2031-XY", None),
    "description": pick(f"{K} + o_custkey % 3", "A site visit is required", "Mandatory walk on Monday; shop drawings come later", "Prevailing wage applies", "Supply only, no labor", "National stock number 1234", "See attached prints", None, "Certified payroll and a pre-bid conference", "NADCAP shops only", "Asphalt and repaving", "About 12,500 SF of floor", "", "Site visit; 900 sq. ft. mezzanine"),
    "place": pick(f"{K} + o_custkey % 7", "Chicago, IL", "Elmville, PA", "Guam", "Yard 7", None, "", "somewhere", "Honolulu, Hawaii", "Bay 4 TX", "Racine", "Denver, CO"),
    "type": pick(K, "Solicitation", "Award Notice", "Sole Source intent", "Combined Synopsis", "Special Notice", None, "Intent to Bundle Requirements", "Presolicitation (draft)"),
    "active": f"CASE {K} % 9 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END",
    "cancelled": f"CASE {K} % 12 WHEN 0 THEN true WHEN 1 THEN NULL ELSE false END",
    "state": pick(K, "WI", "IL", "PA", None, "MN", "TX", "IA", "wi"),
    "notes": pick(K, "good BLUE job", "", None, "salvage and blue", "none"),
    "business": pick(K, "blue", None, "salvage"),
    "url": f"CASE {K} % 5 WHEN 0 THEN NULL WHEN 1 THEN concat('https://sam.gov/opp/', lpad(CAST({K} AS VARCHAR(20)), 32, 'a'), '/view') WHEN 2 THEN concat('https://SAM.gov/workspace/contract/opp/', lpad(CAST({K} AS VARCHAR(20)), 32, '0')) WHEN 3 THEN 'https://sam.gov/opp/short' ELSE 'https://example.org/x' END",
    "recommendation": pick(K, "bid", "pass", "clarify", None),
    "documents": f"CASE {K} % 4 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE {K} % 4 END",
    "old_score": "CAST(floor(o_totalprice / 5000) AS INT)",
    "created": "o_orderdate",
}
P = "l_partkey"
PAGES = {
    "package": "l_orderkey",
    "page": "l_linenumber",
    "filename": "concat('file-', l_linenumber % 4, '.pdf')",
    "kind": pick("l_orderkey + l_linenumber % 4", "drawing", "specification", "qa_log", "addendum", "raster_scan", "geotech", "site_markup", "schedule"),
    "raster": "l_suppkey % 6 = 0",
    "discipline": pick(f"{P} + l_suppkey", "structural", "electrical", None, "civil", "architectural", "plumbing"),
    "sheet": f"CASE {P} % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat({pick(P, 'S', 'A', 'M', 'FP', 'Q')}, '-', {P} % 30 + 101) END",
    "items": f"{P} % 120",
    "confidence": f"CASE {P} % 6 WHEN 0 THEN NULL ELSE CAST({P} % 10 AS DOUBLE) / 10 END",
    "str": f"concat(' ', {pick(P, 'D1', 'W12', 'B3', 'note', 'D')}, {P} % 3, ' ')",
    "section": pick(f"{P} + l_suppkey", "051200", "05 50 00", "05-51-00", "233100", "092900", "14 20 00", "12"),
    "schedule": pick(P, "door", "lintel", "window", "finish", "louver"),
    "mark": f"concat('M', {P} % 9)",
    "description": pick(f"{P} + l_linenumber", "Steel Bollards, painted", "Hollow  metal frame", "alum gate", "wall fan", "HSS frame", "W12x26 to be removed", "600S162-54 studs", "shelf angle, verify in field", "pan stair F1"),
    "qty": f"CASE {P} % 3 WHEN 0 THEN NULL ELSE CAST({P} % 50 AS VARCHAR(10)) END",
    "item": pick(f"{P} + l_suppkey", "w8x10", "HSS4X4X1/4", "L2X2X1/4 - 6in", "1 1/2\" DIA.  ST. PIPE SCH. 40", "2\" DIA PIPE 11 GA", "3/8\" X 12\" STRINGER PL", "PL 1/2", "C8X11.5", "flat bar", "  odd   one "),
    "weight": f"CASE {P} % 8 WHEN 0 THEN NULL ELSE CAST(l_quantity * 40 AS DOUBLE) END",
}


def _sql(name: str, source: str, columns: dict[str, str]) -> str:
    return f"{name} AS (SELECT {', '.join(f'{e} AS {quoted}' for n, e in columns.items() for quoted in [chr(34) + n + chr(34)])} FROM {source})"


N, G = "WITH " + _sql("notices", "orders", NOTICES), "WITH " + _sql("pages_of", "lineitem", PAGES)


def notices(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(*(F.expr(e).alias(n) for n, e in NOTICES.items()))


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(*(F.expr(e).alias(n) for n, e in PAGES.items()))


def _has(text: str, *words: str) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


# what the SQL looks for, written out apart from the code that it checks
SQL_NEAR = (
    "chicago", "milwaukee", "madison", "green bay", "racine", "kenosha", "rockford", "peoria", "springfield", "indianapolis", "detroit", "grand rapids",
    "minneapolis", "st. paul", "des moines", "st. louis", "fort wayne", "south bend", "gary", "joliet", "aurora", "naperville", "great lakes", "waukegan",
    "duluth", "lansing", "ann arbor", "davenport", "quad cities", "dubuque", "cedar rapids", "champaign", "kalamazoo", "bloomington", "normal", "elgin",
    "cicero", "evanston", "oak park", "wisconsin", "wi", "illinois", "il", "indiana", "in", "michigan", "mi", "iowa",
    "ia", "minnesota", "mn", "missouri", "mo", "ohio", "oh", "kentucky", "ky",
)
SQL_OVERSEAS = (
    "japan", "korea", "germany", "overseas", "foreign", "oconus", "far east", "pacific", "europe", "middle east", "guam", "puerto rico",
    "hawaii", "alaska",
)
SQL_VISIT = (
    "site visit", "pre-bid conference", "pre-proposal conference", "mandatory walk", "mandatory inspection",
)
SQL_DRAWINGS = (
    "drawings", "prints", "blueprints", "shop drawings", "specifications attached", "see attached", "per plans", "per specification", "scope of work attached", "sow attached",
)
SQL_PARTS = (
    "proposed procurement for nsn", "national stock number", "dla troop support", "dla land and maritime", "dla aviation", "in repair/modification of",
)
SQL_TRADES = (
    "concrete pour", "repaving", "asphalt", "roofing", "roof replacement", "hvac", "plumbing", "electrical contractor", "painting services", "janitorial", "landscaping", "mowing",
    "demolition only", "fall protection engineering", "fall protection program",
)
SQL_OPAQUE = (
    r"(?i)^\d{4}-[A-Z]{2,}[-\d]+(-[A-Z]+)?$",
    r"(?i)^[\d]+-[\d]+-[\d]+-[A-Z]+$",
    r"(?i)^\d{6}-[A-Z]\d{2}-\d+$",
    r"(?i)^[A-Z]{2,4}-?(?:RFP|RFB|BID)-?\d{4}-\d+$",
    r"(?i)^RFP\s*#\d+$",
    r"^W[A-Z]\d{4,}:?\s*$",
    r"^\d{10,}$",
    r"^\d{4}[A-Z]{3,}-\d+\s+\d+",
    r"^\d{2}-\d{3}[A-Z]{2,6}-[A-Z0-9]+-[A-Z]-\d{4,6}$",
    r"^Illinois Bid \d{2}-\d{3}",
)
SQL_EQUIPMENT = (
    r"(?i)\bbollard",
    r"(?i)\bladder",
    r"(?i)\brailing",
    r"(?i)\bhandrail",
    r"(?i)\bguardrail",
    r"(?i)\blintel",
    r"(?i)\bembed",
    r"(?i)\bshelf\s+angle",
    r"(?i)\bsteel\s+(?:plate|frame|angle|gate|stair)",
    r"(?i)\bmetal\s+(?:plate|frame|panel|gate|stair)",
    r"(?i)\bhollow\s+metal",
)
SQL_ASSEMBLIES = (("stair", "pan_stair"), ("handrail", "wall_handrail_run"), ("guardrail", "guardrail_run"), ("railing", "guardrail_run"), ("lintel", "lintel_set"), ("bollard", "bollard_set"), ("mezzanine", "mezzanine"), ("hss", "hss_framing"), ("frame", "w_framing"), ("partition", "hss_framing"))

# the scorer, as plain SQL over the words that it is documented to look for
TXT, PLACE = "lower(concat_ws(' ', title, description))", "lower(coalesce(place, ''))"
NEAR = f"CASE WHEN {PLACE} = '' THEN NULL WHEN {_has(PLACE, *SQL_NEAR)} THEN true WHEN contains({PLACE}, ',') OR regexp_matches({PLACE}, '\\b[a-z]{{2}}\\b') THEN false END"
FAR, HOME = f"coalesce(NOT ({NEAR}), false)", f"(NOT {_has(PLACE, *SQL_OVERSEAS)})"
VMAX, VMIN = "coalesce(high, low)", "coalesce(low, high)"
VISITS, DRAWN = _has(TXT, *SQL_VISIT), _has(TXT, *SQL_DRAWINGS)
NAME = "trim(coalesce(title, ''))"
FIRED = {
    "code": (30, "code IN ('332312', '332323', '238120')"),
    "value": (20, f"{VMAX} >= 10000 AND {VMAX} <= 300000"),
    "primary": (20, _has(TXT, "welding", "handrail", "steel fabrication")),
    "secondary": (10, _has(TXT, "ladder", "canopy")),
    "domestic": (10, HOME),
    "near": (15, NEAR),
    "out_of_region": (-20, f"{FAR} AND {HOME}"),
    "payroll": (-15, _has(TXT, "davis-bacon", "davis bacon", "certified payroll", "prevailing wage")),
    "too_small": (-25, f"{VMAX} < 5000"),
    "too_large": (-20, f"{VMIN} > 2000000"),
    "supply_only": (-20, _has(TXT, "supply only", "supply-only", "supplies only", "material supply")),
    "disqualified": (-15, _has(TXT, "nadcap")),
    "parts": (-30, f"({_has(TXT, *SQL_PARTS)} OR regexp_matches({NAME}, '^\\d{{2}}--') OR (regexp_matches({NAME}, '^[A-Z][A-Z ,\\-/]{{3,}}$') AND length({NAME}) < 40))"),
    "far_site_visit": (-20, f"{FAR} AND {VISITS} AND NOT {DRAWN}"),
    "far_with_drawings": (-5, f"{FAR} AND {VISITS} AND {DRAWN}"),
    "far": (-5, f"{FAR} AND NOT {VISITS}"),
    "other_trade": (-20, _has(TXT, *SQL_TRADES)),
}
SCORE = f"CAST(least(100, greatest(0, {' + '.join(f'CASE WHEN {c} THEN {d} ELSE 0 END' for d, c in FIRED.values())})) AS INTEGER)"


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.signals(notices(spark, sf), code="code", low="low", high="high", title="title", description="description", place="place")


@query(f"{N} SELECT opp_id, {SCORE} AS score FROM notices")
def opportunity_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).select("opp_id", "score")


@query(f"{N} " + " UNION ALL ".join(f"SELECT '{label}' AS label, count(*) FILTER (WHERE {c}) AS n, {d} AS delta FROM notices" for label, (d, c) in FIRED.items()))
def fired_signals(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).select(F.explode("signals").alias("s")).groupBy("s.label", "s.delta").agg(F.count_if("s.fired").alias("n"))


@query(f"{N} SELECT status, count(*) AS changed FROM notices WHERE old_score <> {SCORE} GROUP BY 1")
def rescored(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.changed(_scored(spark, sf), [("old_score", "score")]).groupBy("status").agg(F.count("*").alias("changed"))


@query(f"{N} SELECT coalesce(place, '?') AS place, CAST({NEAR} AS VARCHAR) AS near, {HOME} AS domestic, count(*) AS n FROM notices GROUP BY 1, 2, 3")
def near_places(spark: SparkSession, sf: str) -> DataFrame:
    near = scoring.near(F.col("place")).cast("string").alias("near")
    return notices(spark, sf).groupBy(F.coalesce("place", F.lit("?")).alias("place"), near, (~scoring.any_of(F.col("place"), scoring.OVERSEAS)).alias("domestic")).agg(F.count("*").alias("n"))


@query(f"""{N} SELECT coalesce(type, '?') AS type, state, count(*) AS n FROM notices
WHERE active AND cancelled IS DISTINCT FROM true AND NOT regexp_matches(lower(coalesce(type, '')), 'award|justification|sole source|presolicitation|sources sought|special notice')
  AND coalesce(type, '') <> 'Intent to Bundle Requirements' AND state IN ('WI', 'IL', 'IN', 'MI', 'MN', 'IA') GROUP BY 1, 2""")
def biddable_in_region(spark: SparkSession, sf: str) -> DataFrame:
    kept = notices(spark, sf).where(intake.biddable(F.col("type"), F.col("active"), F.col("cancelled")) & intake.in_region(F.col("state")))
    return kept.groupBy(F.coalesce("type", F.lit("?")).alias("type"), "state").agg(F.count("*").alias("n"))


@query(f"{N} SELECT opp_id, created FROM notices WHERE status NOT IN ('passed', 'lost') AND (notes ILIKE '%blue%' OR business = 'blue') ORDER BY created, opp_id LIMIT 25")
def tagged_notices(spark: SparkSession, sf: str) -> DataFrame:
    return notices(spark, sf).where(~F.col("status").isin("passed", "lost") & intake.tagged(F.col("notes"), F.col("business"), "blue")).orderBy("created", "opp_id").limit(25).select("opp_id", "created")


@query(f"""{N}, t AS (SELECT trim(title) AS t FROM notices)
SELECT coalesce(t, '?') AS title, coalesce({" OR ".join(f"regexp_matches(t, '{p}')" for p in SQL_OPAQUE)}, false) AS opaque, count(*) AS n FROM t GROUP BY 1, 2""")
def opaque_titles(spark: SparkSession, sf: str) -> DataFrame:
    return notices(spark, sf).groupBy(F.coalesce(F.trim("title"), F.lit("?")).alias("title"), intake.opaque(F.col("title")).alias("opaque")).agg(F.count("*").alias("n"))


@query(f"{N} SELECT opp_id, nullif(regexp_extract(url, '(?i)sam\\.gov/(?:opp|workspace/contract/opp)/([0-9a-f]{{32}})', 1), '') AS uuid FROM notices WHERE url IS NOT NULL")
def notice_uuids(spark: SparkSession, sf: str) -> DataFrame:
    return notices(spark, sf).where("url is not null").select("opp_id", intake.notice_uuid(F.col("url")).alias("uuid"))


@query(f"""{N} SELECT CAST(replace(nullif(regexp_extract(description, '(?i)([\\d,]+)\\s*(?:sq[.\\s]?ft\\.?|sq\\. ft|sf\\b|square\\s+feet)', 1), ''), ',', '') AS DOUBLE) AS area, count(*) AS n FROM notices GROUP BY 1""".replace("|sq\\. ft", ""))
def stated_areas(spark: SparkSession, sf: str) -> DataFrame:
    return notices(spark, sf).groupBy(intake.area_of(F.col("description")).alias("area")).agg(F.count("*").alias("n"))


@query(f"{N} SELECT CASE WHEN old_score >= 70 THEN 'green' WHEN old_score >= 40 THEN 'yellow' ELSE 'red' END AS colour, CASE recommendation WHEN 'bid' THEN 'qa_qualified' WHEN 'pass' THEN 'qa_rejected' ELSE 'awaiting_qa' END AS new_status, recommendation IS NULL OR recommendation NOT IN ('bid', 'pass') AS needs_human, count(*) AS n FROM notices GROUP BY 1, 2, 3")
def review_decisions(spark: SparkSession, sf: str) -> DataFrame:
    return notices(spark, sf).groupBy(intake.colour(F.col("old_score")).alias("colour"), *intake.decided(F.col("recommendation"))).agg(F.count("*").alias("n"))


@query(f"""{N} SELECT coalesce(CASE WHEN coalesce(documents, 0) = 0 THEN 'no_documents' WHEN old_score < 30 THEN 'below_threshold' WHEN status NOT IN ('new', 'reviewing') THEN 'status_' || status END, 'promoted') AS reason, count(*) AS n FROM notices GROUP BY 1""")
def promotion_queue(spark: SparkSession, sf: str) -> DataFrame:
    reason = intake.promotion(F.col("documents"), F.col("old_score"), F.col("status"), 30)
    return notices(spark, sf).groupBy(F.coalesce(reason, F.lit("promoted")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"{N} SELECT state, count(*) AS total, count(*) FILTER (WHERE status = 'passed') AS passed, count(*) FILTER (WHERE status = 'reviewing') AS review, count(*) FILTER (WHERE status IN ('new', 'bidding')) AS kept FROM notices GROUP BY 1")
def brief_counters(spark: SparkSession, sf: str) -> DataFrame:
    status = F.col("status")
    return intake.counters(notices(spark, sf), {"passed": status == "passed", "review": status == "reviewing", "kept": status.isin("new", "bidding")}, "state")


@query(f"{N} SELECT CAST(date_trunc('day', created) AS DATE) AS day, count(*) AS n FROM notices WHERE dayofweek(created) = 5 AND status IN ('passed', 'lost') AND created < TIMESTAMP '1996-01-01' GROUP BY 1")
def friday_reports(spark: SparkSession, sf: str) -> DataFrame:
    due = notices(spark, sf).where((F.dayofweek("created") == 6) & F.col("status").isin("passed", "lost") & (F.col("created") < F.lit("1996-01-01").cast("timestamp_ntz")))
    return due.groupBy(F.to_date("created").alias("day")).agg(F.count("*").alias("n"))


REL = """CASE WHEN kind IN ('geotech', 'schedule', 'qa_log') THEN 'skip' WHEN kind = 'drawing' THEN CASE WHEN discipline IN ('structural', 'architectural', 'mechanical', 'plumbing') THEN 'high' ELSE 'medium' END
  WHEN kind IN ('specification', 'addendum') THEN 'high' WHEN kind IN ('site_markup', 'raster_scan') THEN 'low' ELSE 'medium' END"""


def _relevant(spark: SparkSession, sf: str) -> DataFrame:
    of = F.when(F.col("discipline").isNotNull(), F.array("discipline")).otherwise(F.array().cast("array<string>"))
    return pages(spark, sf).withColumn("relevance", intake.relevance(F.col("kind"), of))


@query(f"{G} SELECT kind, {REL} AS relevance, count(*) AS n FROM pages_of GROUP BY 1, 2")
def document_relevance(spark: SparkSession, sf: str) -> DataFrame:
    return _relevant(spark, sf).groupBy("kind", "relevance").agg(F.count("*").alias("n"))


@query(f"""{G}, r AS (SELECT *, {REL} AS relevance FROM pages_of),
s AS (SELECT package, bool_or(kind = 'addendum') AS early, bool_or(regexp_replace(section, '[^0-9]', '', 'g') LIKE '05____') AS metals, count(*) FILTER (WHERE coalesce(sheet, '') = '') AS missing, bool_or(kind = 'drawing' AND relevance = 'high') AS usable FROM r GROUP BY 1)
SELECT CASE WHEN early THEN CASE WHEN metals THEN 'estimate_from_spec' ELSE 'spec_missing_div05' END WHEN missing = 0 AND usable THEN 'ready_for_takeoff' ELSE 'awaiting_drawings' END AS readiness, count(*) AS n FROM s GROUP BY 1""")
def package_readiness(spark: SparkSession, sf: str) -> DataFrame:
    code = coverage.section_code(F.col("section"))
    found = _relevant(spark, sf).groupBy("package").agg(
        F.bool_or(F.col("kind") == "addendum").alias("early"), F.coalesce(F.bool_or(F.startswith(code, F.lit("05"))), F.lit(False)).alias("metals"),
        F.count_if(F.coalesce("sheet", F.lit("")) == "").alias("missing"), F.bool_or((F.col("kind") == "drawing") & (F.col("relevance") == "high")).alias("usable"),
    )
    stage = F.when(F.col("early"), "pre_gmp_rfp").otherwise("bid")
    return found.groupBy(intake.ready(stage, F.col("metals"), F.col("missing"), F.col("usable")).alias("readiness")).agg(F.count("*").alias("n"))


@query(f"""{G} SELECT package, count(*) AS total_documents, count(*) FILTER (WHERE kind = 'drawing') AS drawings, count(*) FILTER (WHERE kind = 'specification') AS specs, count(*) FILTER (WHERE kind = 'qa_log') AS qa_logs,
  count(*) FILTER (WHERE kind = 'raster_scan') AS raster_only,
  coalesce(string_agg(DISTINCT filename, ',' ORDER BY filename) FILTER (WHERE {REL} = 'skip'), '') AS skipped, coalesce(string_agg(DISTINCT filename, ',' ORDER BY filename) FILTER (WHERE {REL} = 'high'), '') AS high_relevance,
  coalesce(string_agg(DISTINCT filename, ',' ORDER BY filename) FILTER (WHERE raster), '') AS requires_ocr, coalesce(string_agg(DISTINCT sheet, ',' ORDER BY sheet) FILTER (WHERE sheet <> ''), '') AS sheets
FROM pages_of GROUP BY 1""")
def package_digest(spark: SparkSession, sf: str) -> DataFrame:
    docs = _relevant(spark, sf).withColumn("sheets", F.when(F.col("sheet") != "", F.array("sheet")).otherwise(F.array().cast("array<string>")))
    found = intake.package_summary(docs, "package")
    return found.withColumns({c: F.array_join(c, ",") for c in ("skipped", "high_relevance", "requires_ocr", "sheets")})


@query(f"""{G}, c AS (SELECT package, filename, page, items, CASE WHEN kind = 'qa_log' THEN NULL WHEN raster THEN 'raster_no_text' WHEN kind = 'drawing' AND coalesce(sheet, '') = '' AND items < 50 THEN 'no_sheet_few_items' END AS reason FROM pages_of),
d AS (SELECT DISTINCT * FROM c WHERE reason IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY package ORDER BY filename, page, items, reason) AS place FROM d)
SELECT package, filename, page, items, reason, CAST(place AS INTEGER) AS place FROM r WHERE place <= 2""")
def vision_pages(spark: SparkSession, sf: str) -> DataFrame:
    reason = intake.vision_reason(F.col("kind"), F.col("raster"), F.col("sheet"), F.col("items"))
    asked = pages(spark, sf).select("package", "filename", "page", "items", reason.alias("reason")).where("reason is not null").distinct()
    return intake.first_few(asked, "package", ["filename", "page", "items", "reason"], 2)


@query(f"""{G}, p AS (SELECT package AS doc, page, max(nullif(sheet, '')) AS sheet FROM pages_of GROUP BY 1, 2),
b AS (SELECT package AS doc, page, mark, coalesce(confidence, 0.85) AS c FROM pages_of WHERE coalesce(confidence, 0.85) >= 0.7),
s AS (SELECT doc, page, mark, row_number() OVER (PARTITION BY doc, page ORDER BY c DESC, mark DESC) AS place FROM b)
SELECT p.doc, p.page, coalesce(p.sheet, s.mark) AS sheet FROM p LEFT JOIN s ON s.doc = p.doc AND s.page = p.page AND s.place = 1""")
def late_sheet_ids(spark: SparkSession, sf: str) -> DataFrame:
    found = pages(spark, sf).withColumnRenamed("package", "doc")
    own = found.groupBy("doc", "page").agg(F.max(F.nullif("sheet", F.lit(""))).alias("sheet"))
    return intake.filled_sheets(own, found.select("doc", "page", F.col("mark").alias("sheet"), "confidence"))


@query(f"""{G}, m AS (SELECT DISTINCT package AS doc, trim("str") AS mark, page FROM pages_of WHERE regexp_matches(trim("str"), '^[A-Z]{{1,2}}\\d{{1,2}}$'))
SELECT m.doc, m.mark, string_agg(CAST(m.page AS VARCHAR), ',' ORDER BY m.page) AS pages FROM m WHERE NOT EXISTS (SELECT 1 FROM pages_of s WHERE s.package = m.doc AND s.page = m.page AND s.kind = 'schedule') GROUP BY 1, 2""")
def mark_occurrences(spark: SparkSession, sf: str) -> DataFrame:
    found = pages(spark, sf).withColumnRenamed("package", "doc")
    marks = intake.mark_pages(found.select("doc", "page", "str"), found.where("kind = 'schedule'").select("doc", "page"), r"^[A-Z]{1,2}\d{1,2}$")
    return marks.select("doc", "mark", F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"))


CELLS = "trim(concat(coalesce(description, ''), ' ', mark, ' ', coalesce(qty, '')))"
SMALL = CELLS.replace("description", "c.description")


@query(f"""{G}, c AS (SELECT *, {CELLS} AS cells FROM pages_of), h AS (SELECT *, CASE {" ".join(f"WHEN regexp_matches(cells, '{p}') THEN {i}" for i, p in enumerate(SQL_EQUIPMENT, 1))} END AS hint FROM c)
SELECT hint, cells, count(*) AS n FROM h WHERE hint IS NOT NULL GROUP BY 1, 2""")
def equipment_rows(spark: SparkSession, sf: str) -> DataFrame:
    row = F.create_map(F.lit("a"), "description", F.lit("b"), "mark", F.lit("c"), "qty")
    cells = pages(spark, sf).select(intake.joined_cells(row).alias("cells"))
    return cells.withColumn("hint", intake.equipment_hint(F.col("cells"))).where("hint is not null").groupBy("hint", "cells").agg(F.count("*").alias("n"))


@query(f"{G} SELECT kind, count(*) FILTER (WHERE regexp_matches(lower(description), '\\bgate\\b')) AS gates, count(*) AS rows_of FROM pages_of GROUP BY 1")
def gate_rows(spark: SparkSession, sf: str) -> DataFrame:
    return pages(spark, sf).groupBy("kind").agg(F.count_if(F.lower("description").rlike(r"\bgate\b")).alias("gates"), F.count("*").alias("rows_of"))


@query(f"""{G} SELECT CASE {" ".join(f"WHEN contains(lower(description), '{w}') THEN '{k}'" for w, k in SQL_ASSEMBLIES)} ELSE 'misc' END AS assembly,
  CASE WHEN upper(item) LIKE 'W%' THEN 'W' WHEN upper(item) LIKE 'HSS%' THEN 'HSS' WHEN contains(upper(item), 'PIPE') THEN 'PIPE' WHEN upper(item) LIKE 'L%' OR contains(upper(item), 'ANGLE') THEN 'ANGLE'
       WHEN upper(item) LIKE 'C%' OR contains(upper(item), 'CHANNEL') THEN 'CHANNEL' WHEN contains(upper(item), 'PL') THEN 'PLATE' WHEN contains(upper(item), 'BAR') THEN 'BAR' ELSE 'CUSTOM' END AS shape,
  CASE WHEN weight < 200 THEN 'small' WHEN weight < 1500 THEN 'medium' WHEN weight IS NOT NULL THEN 'large' END AS band, count(*) AS n FROM pages_of GROUP BY 1, 2, 3""")
def assemblies(spark: SparkSession, sf: str) -> DataFrame:
    return pages(spark, sf).groupBy(intake.assembly(F.col("description")).alias("assembly"), intake.shape(F.col("item")).alias("shape"), intake.size_band(F.col("weight")).alias("band")).agg(F.count("*").alias("n"))


@query(f"""{G} SELECT item, CASE item WHEN 'w8x10' THEN 'W8x10' WHEN 'HSS4X4X1/4' THEN 'HSS4x4x1/4' WHEN 'L2X2X1/4 - 6in' THEN 'L2x2x1/4 - 6in' WHEN '1 1/2" DIA.  ST. PIPE SCH. 40' THEN '1 1/2" pipe sch 40' WHEN '2" DIA PIPE 11 GA' THEN '2" pipe (11 GA)'
  WHEN '3/8" X 12" STRINGER PL' THEN 'PL 3/8 x 12' WHEN '  odd   one ' THEN 'odd one' ELSE item END AS designation, count(*) AS n FROM pages_of GROUP BY 1, 2""")
def designations(spark: SparkSession, sf: str) -> DataFrame:
    return pages(spark, sf).groupBy("item", intake.designation(F.col("item")).alias("designation")).agg(F.count("*").alias("n"))


# ---- checks, manifests and variances


V = "l_partkey + l_suppkey"
LINES = {
    "run": "l_orderkey",
    "line_no": "l_linenumber",
    "category": pick("l_partkey", "structural_beam", "stair", "railing", "lintel", "hm_frame"),
    "description": pick(V, "beam F1", "existing to remain ladder", "600S162-54 studs", "stair L2 and F1", "railing, verify in field", "demolish lintel", None, "frame F1", "plate"),
    "source_kind": pick(V, "drawing", "spec", "manual"),
    "source_section": pick("l_suppkey", "S-101", "D-101", "05 50 00", None),
    "source_evidence": pick("l_partkey + l_linenumber", "provide galvanized railing at stair two", "2 EA per schedule", "bent plate   closure angle", "no such words anywhere here at all", "", None, "V.I.F. dimensions"),
    "page_text": pick("l_suppkey + l_linenumber", "Provide galvanized railing at stair two. Bent plate closure angle.", "", "galvanized railing only"),
    "quantity": "l_quantity",
    "quantity_band": pick("l_partkey", "point", "range"),
    "material_grade": pick("l_suppkey", "A992", "A36", None, "A500 Gr. B"),
    "steel_shape_designation": pick(V, "W12X26", "HSS4X4X1/4", "L3X3X1/4", None, "C8X11.5", "362S137-43"),
    "fab_hrs": "CAST(l_linenumber AS DOUBLE)",
    "ironworker_hrs": "l_quantity * 0.1D",
    "confidence": "CASE l_partkey % 5 WHEN 0 THEN NULL ELSE CAST(0.4D + l_tax * 5 AS DOUBLE) END",
    "flagged": "l_suppkey % 11 = 0",
    "in_scope": "CASE l_suppkey % 5 WHEN 0 THEN NULL ELSE true END",
    "total_weight_lbs": "CASE l_partkey % 8 WHEN 0 THEN NULL ELSE l_quantity * 40 END",
}
DUCK = {k: v.replace("0.1D", "CAST(0.1 AS DOUBLE)").replace("0.4D", "0.4") for k, v in LINES.items()}
E_LINES = "WITH " + _sql("lines_of", "lineitem", DUCK)
USUAL = {"structural_beam": (4.0, 2.0), "stair": (10.0, 8.0)}
USUAL_QUANTITY = {"railing": (10.0, 20.0), "lintel": (30.0, 32.0)}


def estimate_lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(*(F.expr(e).alias(n) for n, e in LINES.items()))


def _validated(spark: SparkSession, sf: str) -> DataFrame:
    hours = spark.createDataFrame([(k, *v) for k, v in USUAL.items()], "category string, usual_fab_hrs double, usual_ironworker_hrs double")
    quantity = spark.createDataFrame([(k, *v) for k, v in USUAL_QUANTITY.items()], "category string, low double, high double")
    return validate.validate_lines(estimate_lines(spark, sf), equipment=("stair",), usual_hours=hours, brackets=quantity)


EXIST = "regexp_matches(concat_ws(' ', description, source_evidence), '(?i)\\b(etr|existing to remain|exist\\.? to remain|to be removed|demolish|demolition|salvage)\\b')"
WORDS = "list_filter(list_distinct(regexp_split_to_array(q, '[^a-z0-9./''\"-]+')), lambda w: length(w) >= 4 AND NOT regexp_matches(w, '^[0-9]+$'))"
UNSURE = "regexp_matches(concat_ws(' ', source_evidence, description), '(?i)(field[ -]verify|verify in field|\\bv\\.?i\\.?f\\.?\\b|confirm on site|by others to confirm)')"
COLD = "regexp_matches(concat_ws(' ', steel_shape_designation, description), '(?i)\\b\\d{3,4}[sjtf]\\d{3}-\\d{2,3}\\b')"
CHAIN = f"""{E_LINES}, a AS (SELECT *, lower(trim(regexp_replace(coalesce(source_evidence, ''), '\\s+', ' ', 'g'))) AS q, lower(trim(regexp_replace(coalesce(page_text, ''), '\\s+', ' ', 'g'))) AS t FROM lines_of),
b AS (SELECT *, source_kind <> 'manual' AND length(q) > 0 AND length(t) > 0 AND NOT (length(q) >= 12 AND contains(t, q[:80]))
    AND coalesce(len(list_filter({WORDS}, lambda w: contains(t, w))) / nullif(len({WORDS}), 0), 0) < 0.5 AS fabricated,
  quantity_band = 'point' AND NOT regexp_matches(coalesce(source_evidence, ''), '(?i)(schedule|\\d+''-?\\d*|\\d+\\s*(ea|each)\\b)') AS weak, {EXIST} AS marked FROM a),
c AS (SELECT *, coalesce(regexp_matches(source_section, '(?i)^D-?\\d'), false) AND NOT marked AS demo_sheet,
  CASE category WHEN 'structural_beam' THEN 2.0 WHEN 'stair' THEN 5.0 END AS fab_floor, CASE category WHEN 'structural_beam' THEN 1.0 WHEN 'stair' THEN 4.0 END AS iron_floor,
  NOT (NOT marked AND coalesce(in_scope, true)) AND category = 'stair' AS back FROM b),
d AS (SELECT *, material_grade IS NOT NULL AND coalesce(CASE WHEN steel_shape_designation LIKE 'W%' THEN material_grade NOT LIKE '%A992%' AND material_grade NOT LIKE '%A572%'
    WHEN steel_shape_designation LIKE 'HSS%' THEN material_grade NOT LIKE '%A500%' WHEN steel_shape_designation LIKE 'L%' THEN material_grade <> 'A36' WHEN steel_shape_designation LIKE 'C%' THEN material_grade <> 'A36' END, false) AS wrong_grade,
  coalesce(fab_hrs > 0 AND fab_hrs < fab_floor, false) AS low_fab, coalesce(ironworker_hrs > 0 AND ironworker_hrs < iron_floor, false) AS low_iron,
  coalesce({COLD}, false) AS cold, coalesce({UNSURE}, false) AS unsure FROM c)"""


@query(CHAIN + """ SELECT category, CASE WHEN weak THEN 'range' ELSE quantity_band END AS band, (NOT marked AND coalesce(in_scope, true)) OR back AS in_scope,
  (((flagged OR fabricated OR marked OR demo_sheet) AND NOT back) OR cold OR unsure) AS flagged, count(*) AS n,
  round(sum(CASE WHEN low_fab THEN fab_floor ELSE fab_hrs END), 6) AS fab_hrs, round(sum(CASE WHEN low_iron THEN iron_floor ELSE ironworker_hrs END), 6) AS ironworker_hrs,
  round(sum(CASE WHEN unsure THEN least(coalesce(confidence, 0), 0.5) ELSE confidence END), 6) AS confidence
FROM d GROUP BY 1, 2, 3, 4""")
def validated_lines(spark: SparkSession, sf: str) -> DataFrame:
    sums = [F.round(F.sum(c), 6).alias(c) for c in ("fab_hrs", "ironworker_hrs", "confidence")]
    return _validated(spark, sf).groupBy("category", F.col("quantity_band").alias("band"), "in_scope", "flagged").agg(F.count("*").alias("n"), *sums)


@query(CHAIN + " SELECT name AS category, severity, count(*) AS n, min(line_no) AS first_line FROM d, (VALUES " + ", ".join(f"('{n}', '{s}')" for n, s in (
    ("fabricated_quote", "error"), ("band_downgrade", "warning"), ("etr_in_scope", "error"), ("demolition_sheet", "warning"), ("demo_replaced", "info"), ("labor_floor_fab", "warning"), ("labor_floor_iron", "warning"),
    ("grade_mismatch", "warning"), ("above_bracket", "warning"), ("below_bracket", "info"), ("cold_formed", "warning"), ("field_verify", "warning"))) + """) k(name, severity)
WHERE CASE name WHEN 'fabricated_quote' THEN fabricated WHEN 'band_downgrade' THEN weak WHEN 'etr_in_scope' THEN marked WHEN 'demolition_sheet' THEN demo_sheet WHEN 'demo_replaced' THEN back
  WHEN 'labor_floor_fab' THEN low_fab WHEN 'labor_floor_iron' THEN low_iron WHEN 'grade_mismatch' THEN wrong_grade WHEN 'cold_formed' THEN cold WHEN 'field_verify' THEN unsure
  WHEN 'above_bracket' THEN coalesce(quantity > 1.5 * CASE category WHEN 'railing' THEN 20 WHEN 'lintel' THEN 32 END, false)
  WHEN 'below_bracket' THEN coalesce(quantity < 0.5 * CASE category WHEN 'railing' THEN 10 WHEN 'lintel' THEN 30 END, false) END GROUP BY 1, 2""")
def line_findings(spark: SparkSession, sf: str) -> DataFrame:
    found = validate.findings(_validated(spark, sf), "run")
    hours = F.when(F.startswith("finding", F.lit("fab")), "labor_floor_fab").otherwise("labor_floor_iron")
    return found.groupBy(F.when(F.col("category") == "labor_floor", hours).otherwise(F.col("category")).alias("category"), "severity").agg(F.count("*").alias("n"), F.min("related_line").alias("first_line"))


@query(f"""{E_LINES}, w AS (SELECT run, sum(coalesce(total_weight_lbs, 0)) AS weight, 50 + run % 400 AS area, CASE run % 3 WHEN 0 THEN 'school' WHEN 1 THEN 'office' ELSE 'barn' END AS building FROM lines_of GROUP BY 1)
SELECT run, CASE WHEN weight / area < CASE building WHEN 'school' THEN 6 ELSE 7 END THEN 'density_below' ELSE 'density_above' END AS category FROM w
WHERE building <> 'barn' AND weight > 0 AND (weight / area < CASE building WHEN 'school' THEN 6 ELSE 7 END OR weight / area > CASE building WHEN 'school' THEN 14 ELSE 15 END)""")
def run_density(spark: SparkSession, sf: str) -> DataFrame:
    found = estimate_lines(spark, sf)
    areas = found.select("run").distinct().select("run", (50 + F.col("run") % 400).alias("area"), F.expr("case run % 3 when 0 then 'school' when 1 then 'office' else 'barn' end").alias("building"))
    return validate.density(found, areas, "run").select("run", "category")


@query(f"""{E_LINES}, s AS (SELECT DISTINCT run, e.section, e.wanted FROM lines_of, (VALUES ('05 51 00', 'stair'), ('05 12 00', 'structural_beam'), ('05 12 00', 'column'), ('05 52 00', 'railing')) e(section, wanted) WHERE run % 4 = CASE section WHEN '05 51 00' THEN 0 WHEN '05 12 00' THEN 1 ELSE 2 END)
SELECT run, 'no line for section ' || section AS finding FROM s GROUP BY run, section HAVING NOT bool_or(EXISTS (SELECT 1 FROM lines_of l WHERE l.run = s.run AND l.category = s.wanted))""")
def uncovered_sections(spark: SparkSession, sf: str) -> DataFrame:
    found = estimate_lines(spark, sf)
    expected = spark.createDataFrame([("05 51 00", "stair"), ("05 12 00", "structural_beam"), ("05 12 00", "column"), ("05 52 00", "railing")], "section string, category string")
    asked = found.select("run", F.expr("case run % 4 when 0 then '05 51 00' when 1 then '05 12 00' when 2 then '05 52 00' end").alias("section")).where("section is not null").distinct()
    return validate.section_coverage(found, asked, expected, "run").select("run", "finding")


CODE = "regexp_replace(section, '[^0-9]', '', 'g')"
MANIFEST = f"""{G}, sec AS (SELECT DISTINCT package, 'section' AS kind, {CODE}[1:2] || ' ' || {CODE}[3:4] || ' ' || {CODE}[5:6] AS ref FROM pages_of WHERE length({CODE}) >= 6),
sect AS (SELECT *, CASE WHEN ref IN ('05 12 00', '05 50 00', '05 51 00') THEN 'included' WHEN ref LIKE '23%' THEN 'n_a' WHEN ref LIKE '09%' THEN 'excluded' ELSE 'judgment' END AS tag, false AS needs_vision FROM sec),
sh AS (SELECT package, 'sheet' AS kind, sheet AS ref, CASE WHEN sheet LIKE 'S%' OR sheet LIKE 'A%' THEN 'included' WHEN sheet LIKE 'M%' OR sheet LIKE 'FP%' THEN 'excluded' ELSE 'judgment' END AS tag, max("items") AS items, bool_or(raster) AS raster FROM pages_of WHERE sheet <> '' GROUP BY 1, 2, 3, 4),
sch AS (SELECT DISTINCT package, 'schedule' AS kind, schedule AS ref, CASE WHEN schedule IN ('door', 'lintel') THEN 'included' WHEN schedule = 'window' THEN 'excluded' WHEN schedule = 'finish' THEN 'n_a' ELSE 'judgment' END AS tag, false AS needs_vision FROM pages_of),
man AS (SELECT * FROM sect UNION ALL SELECT package, kind, ref, tag, (tag = 'included' AND (items < 80 OR raster)) OR tag = 'judgment' FROM sh UNION ALL SELECT * FROM sch)"""


def _manifest(spark: SparkSession, sf: str) -> DataFrame:
    lines = dealt(spark, sf, "lineitem", "l_orderkey", columns=("l_orderkey", "l_partkey", "l_suppkey"))
    found = lines.select(*(F.expr(PAGES[n]).alias(n) for n in ("package", "section", "sheet", "items", "raster", "schedule")))
    sheets = found.where("sheet <> ''").select("package", "sheet", "items", "raster")
    return coverage.manifest(found.select("package", F.col("section").alias("code")), sheets, found.select("package", "schedule"), "package")


@query(f"""{MANIFEST} SELECT package, kind, {", ".join(f"count(*) FILTER (WHERE tag = '{t}') AS {t}" for t in ("included", "excluded", "n_a", "judgment"))},
  count(*) FILTER (WHERE needs_vision) AS needs_vision, count(*) FILTER (WHERE needs_vision OR tag = 'judgment') AS unresolved FROM man GROUP BY 1, 2""")
def manifest_counts(spark: SparkSession, sf: str) -> DataFrame:
    return coverage.tag_counts(_manifest(spark, sf), "package")


@query(f"""{MANIFEST}, x AS (SELECT DISTINCT package, unnest(CASE ref WHEN '05 12 00' THEN ['column', 'structural_beam'] WHEN '05 50 00' THEN ['lintel', 'misc_metal'] ELSE ['stair'] END) AS category FROM man WHERE kind = 'section' AND tag = 'included')
SELECT package, string_agg(category, ',' ORDER BY category) AS categories FROM x GROUP BY 1""")
def expected_by_package(spark: SparkSession, sf: str) -> DataFrame:
    return coverage.expected_categories(_manifest(spark, sf), "package").withColumn("categories", F.array_join("categories", ","))


@query(f"""{MANIFEST} SELECT package, 'uncovered_' || kind AS category, ref FROM man m WHERE tag = 'included'
  AND NOT EXISTS (SELECT 1 FROM pages_of p WHERE p.package = m.package AND m.kind = 'schedule' AND p.schedule = m.ref AND p.page = 1)
  AND NOT EXISTS (SELECT 1 FROM pages_of p WHERE p.package = m.package AND m.kind = 'sheet' AND p.sheet = m.ref AND p.page = 2 AND length(p.description) >= 12)""")
def manifest_gaps(spark: SparkSession, sf: str) -> DataFrame:
    found = pages(spark, sf)
    covered = found.where("page = 1").select("package", F.lit("schedule").alias("kind"), F.col("schedule").alias("ref"))
    excluded = found.where("page = 2 and sheet is not null").select("package", F.lit("sheet").alias("kind"), F.col("sheet").alias("ref"), F.col("description").alias("reason"))
    return coverage.uncovered(_manifest(spark, sf), covered, excluded, "package").select("package", "category", "ref")
