"""What is done to records and asked about them, as queries: patches, deletions with their audit, ranges of amounts, requests and priors of workbooks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions import dates, money
from sluice.operators import filters, review, scoring, validate, workbook
from sluice.plans.intake import FIRED, N, SCORE, notices, pick
from sluice.plans.relations import AS_OF, as_of, cte, file_bytes, lines, opportunities, table
from sluice.sources import sinks
from sluice.streaming.arrivals import work_dir

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
O, L = cte("opportunities"), cte("lines")


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


DOOMED = "l_discount >= 0.09 AND l_linenumber % 2 = 0"


@query(f"""WITH gone AS (SELECT l_orderkey, count(*) AS deleted, round(sum(l_extendedprice), 4) AS deleted_price FROM lineitem WHERE {DOOMED} GROUP BY 1)
SELECT g.l_orderkey, deleted, deleted_price, count(l.l_orderkey) AS left_over, round(coalesce(sum(l.l_extendedprice), 0), 4) AS total FROM gone g LEFT JOIN lineitem l ON l.l_orderkey = g.l_orderkey AND NOT ({DOOMED.replace("l_", "l.l_")}) GROUP BY 1, 2, 3""")
def deleted_lines(spark: SparkSession, sf: str) -> DataFrame:
    folder = work_dir(spark, "lines")
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate"]
    # lines that repeat are one row with a number of copies
    whole = table(spark, sf, "lineitem").groupBy(*key).agg(F.count("*").alias("copies"))
    # a bucket is about 4 MB of the table's files, however large it is
    buckets = max(64, file_bytes(spark, sf, "lineitem") >> 22)
    sinks.upsert_version(spark, whole, f"{folder}/t", 1, key, [F.lit(0)], buckets)
    audit = sinks.delete_rows(spark, whole.where(DOOMED), f"{folder}/t", f"{folder}/audit", 2, key, as_of(), buckets)
    price = F.col("l_extendedprice") * F.col("copies")
    gone = audit.groupBy("l_orderkey").agg(F.sum("copies").alias("deleted"), F.round(F.sum(price), 4).alias("deleted_price"))
    # only runs that lost a line are rolled up anew
    left = sinks.latest(spark, f"{folder}/t").join(gone.select("l_orderkey"), "l_orderkey", "left_semi").groupBy("l_orderkey").agg(F.sum("copies").alias("left_over"), F.round(F.sum(price), 4).alias("total"))
    both = gone.join(left, "l_orderkey", "left")
    return both.withColumns({"left_over": F.coalesce("left_over", F.lit(0).cast("long")), "total": F.coalesce("total", F.lit(0.0))})


COMMAND = pick("event_id", "complete", "snooze", None, "later")


@query(f"""WITH r AS (SELECT event_id, {COMMAND} AS command, event_id % 9 AS days, CASE WHEN event_id % 7 = 0 THEN ts END AS completed_at FROM events)
SELECT command, count(*) AS n, count(CASE WHEN command = 'complete' THEN TIMESTAMP '{AS_OF}' ELSE completed_at END) AS completed, count(CASE WHEN command = 'snooze' AND days > 0 THEN 1 END) AS snoozed,
  max(CASE WHEN command = 'snooze' AND days > 0 THEN TIMESTAMP '{AS_OF}' + to_days(CAST(days AS INTEGER)) END) AS until, count(CASE WHEN command = 'complete' AND completed_at IS NULL THEN 1 END) AS events FROM r GROUP BY 1""")
def patched_reminders(spark: SparkSession, sf: str) -> DataFrame:
    given = table(spark, sf, "events").select("event_id", F.expr(COMMAND).alias("command"), (F.col("event_id") % 9).alias("days"), F.when(F.col("event_id") % 7 == 0, F.col("ts")).alias("completed_at"), F.lit(None).cast("timestamp_ntz").alias("snoozed_until"))
    patched = review.patch_reminders(given, "command", "days", as_of()).groupBy("command").agg(F.count("*").alias("n"), F.count("completed_at").alias("completed"), F.count("snoozed_until").alias("snoozed"), F.max("snoozed_until").alias("until"))
    events = review.completion_events(given, "event_id", "command", as_of()).agg(F.count("*").alias("__n")).select(F.lit("complete").alias("__c"), "__n")
    return patched.join(events, F.col("command") == F.col("__c"), "left").select("command", "n", "completed", "snoozed", "until", F.coalesce("__n", F.lit(0).cast("long")).alias("events"))


RAW = """CASE o_orderkey % 8 WHEN 0 THEN concat('{"award": {"floor": ', o_custkey, ', "ceiling": "', 2 * o_custkey, '"}}') WHEN 1 THEN concat('{"award": {"floor": ', o_custkey, '}}') WHEN 2 THEN concat('{"awardCeiling": "$', o_custkey, ',000"}') WHEN 3 THEN concat('{"award": {"amount": ', o_custkey, '}}')
  WHEN 4 THEN concat('{"estimatedTotalValue": ', o_custkey, '.5}') WHEN 5 THEN concat('{"baseAndAllOptionsValue": ', o_custkey, '}') ELSE '{}' END"""


@query("""SELECT o_orderkey AS k, CASE o_orderkey % 8 WHEN 2 THEN NULL WHEN 4 THEN o_custkey + 0.5 WHEN 6 THEN 5.0 WHEN 7 THEN NULL ELSE CAST(o_custkey AS DOUBLE) END AS low,
CASE o_orderkey % 8 WHEN 0 THEN 2.0 * o_custkey WHEN 2 THEN 1000.0 * o_custkey WHEN 4 THEN o_custkey + 0.5 WHEN 6 THEN 10.0 + o_custkey WHEN 7 THEN NULL ELSE CAST(o_custkey AS DOUBLE) END AS high FROM orders""")
def award_ranges(spark: SparkSession, sf: str) -> DataFrame:
    said = F.expr("case when o_orderkey % 8 = 6 then concat('between $5 and $ ', 10 + o_custkey) else 'no amount' end")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), money.award_range(F.expr(RAW), said).alias("r")).select("k", "r.*")


@query(f"""{N}, s AS (SELECT opp_id, status, old_score, {SCORE} AS score, coalesce({FIRED["parts"][1]}, false) AS parts, coalesce({FIRED["other_trade"][1]}, false) AS other FROM notices),
c AS (SELECT *, CASE WHEN status = 'new' AND (parts OR (other AND score < 30)) THEN 'passed' ELSE status END AS new_status FROM s)
SELECT status, new_status, count(*) AS n FROM c WHERE old_score <> score OR status <> new_status GROUP BY 1, 2""")
def passed_on_rescore(spark: SparkSession, sf: str) -> DataFrame:
    scored = scoring.signals(notices(spark, sf), code="code", low="low", high="high", title="title", description="description", place="place")
    return scoring.auto_pass(scored, "old_score", "status", F.lit(False)).groupBy("status", "new_status").agg(F.count("*").alias("n"))


ASKED = {
    "opp_id": "l_orderkey", "line_no": "l_linenumber", "category": pick("l_partkey", "handrail", "base_plate", "odd_item"), "description": "concat('Item ', l_partkey, ' of ', l_suppkey)", "quantity": "CAST(l_quantity AS INT)", "quantity_unit": "'EA'",
    "quantity_band": pick("l_suppkey", "point", "range", "assumed_typical"), "quantity_min": "CASE WHEN l_suppkey % 2 = 0 THEN CAST(l_quantity AS INT) - 1 END", "quantity_max": "CAST(l_quantity AS INT) + 5", "source_kind": pick("l_partkey + l_suppkey", "drawing", "assumption", "spec", "industry_default"),
    "source_section": "CASE WHEN l_partkey % 4 = 0 THEN '05 50 00' END", "source_page": "CASE WHEN l_partkey % 5 < 2 THEN l_linenumber END", "assumptions": "CASE WHEN l_suppkey % 5 = 0 THEN 'as drawn' END", "confidence": "CAST(l_partkey % 10 AS DOUBLE) / 10", "flagged": "l_discount > 0.08",
}


@query(f"""WITH a AS (SELECT {', '.join(f'{e} AS {n}' for n, e in ASKED.items())} FROM lineitem),
q AS (SELECT *, row_number() OVER (PARTITION BY opp_id ORDER BY line_no, description) AS i, CASE WHEN quantity_band = 'range' AND quantity_min IS NOT NULL THEN true ELSE false END AS ranged FROM a WHERE confidence < 0.7 OR flagged),
t AS (SELECT opp_id, i, CASE category WHEN 'handrail' THEN 'Length and height of handrails' WHEN 'base_plate' THEN 'base plate scope and quantity' ELSE 'odd item scope and quantity' END AS topic,
  'The documents show ' || lower(description) || '.' || coalesce(' Source: ' || nullif(concat_ws(', ', source_section, 'page ' || source_page), '') || '.', '') || ' Quantity: ' || CASE WHEN quantity_band = 'point' THEN quantity || ' EA' WHEN ranged THEN quantity_min || ' to ' || quantity_max || ' EA (assumed ' || quantity || ' EA)' ELSE quantity || ' EA (assumed)' END || '.' || coalesce(' Assumed: ' || assumptions, '') AS context,
  coalesce(nullif(concat_ws(', ', source_section, 'page ' || source_page), ''), 'inferred from ' || source_kind) AS cited,
  CASE WHEN source_kind IN ('assumption', 'industry_default') THEN 'Confirm quantity, sizes and places of ' || replace(category, '_', ' ') || ', or that it is excluded.' WHEN flagged AND quantity_band = 'assumed_typical' THEN 'Confirm the quantity of ' || replace(category, '_', ' ') || '; ' || quantity || ' EA are assumed as usual for such a building.'
    WHEN flagged AND ranged THEN 'Confirm the count of ' || replace(category, '_', ' ') || ' between ' || quantity_min || ' to ' || quantity_max || ' EA.' ELSE 'Confirm quantity and sizes of ' || replace(category, '_', ' ') || '.' END AS asks FROM q)
SELECT opp_id, i AS question_no, 'Q' || i || ': ' || topic || chr(10) || 'Context: ' || context || chr(10) || 'Source: ' || cited || chr(10) || 'Request: ' || asks AS copy_text FROM t""")
def request_texts(spark: SparkSession, sf: str) -> DataFrame:
    given = table(spark, sf, "lineitem").select(*(F.expr(e).alias(n) for n, e in ASKED.items()))
    return validate.request_texts(given, "opp_id", {"handrail": "Length and height of handrails"}).select("opp_id", "question_no", "copy_text")


@query(f"""{O}, c AS (SELECT *, CASE WHEN opp_id % 3 = 0 THEN NULL ELSE created END AS checked FROM opportunities)
SELECT status, count(*) AS n FROM c WHERE (checked IS NULL OR checked < {f"TIMESTAMP '{AS_OF}'"} - INTERVAL 24 HOUR) AND deadline <= {f"TIMESTAMP '{AS_OF}'"} + INTERVAL 3 DAY AND status IN ('new', 'bidding', 'reviewing') GROUP BY 1""")
def unchecked_awards(spark: SparkSession, sf: str) -> DataFrame:
    given = opportunities(spark, sf).withColumn("checked", F.when(F.col("opp_id") % 3 != 0, F.col("created")))
    due = given.where(filters.stale("checked", as_of()) & (F.col("deadline") <= as_of() + F.expr("interval 3 days")) & F.col("status").isin("new", "bidding", "reviewing"))
    return due.groupBy("status").agg(F.count("*").alias("n"))


@query(f"{L} SELECT opp_id, line_no, part_id, supp_id, quantity, predicted FROM lines")
def blind_lines(spark: SparkSession, sf: str) -> DataFrame:
    kept = ("opp_id", "line_no", "part_id", "supp_id", "quantity", "predicted")
    every = lines(spark, sf)
    return review.blind(every, [c for c in every.columns if c not in kept])


@query("SELECT o_orderkey, greatest(CASE WHEN month(o_orderdate) >= 10 THEN make_date(year(o_orderdate), 10, 1) ELSE make_date(year(o_orderdate) - 1, 10, 1) END, CAST(o_orderdate - INTERVAL 6 MONTH AS DATE)) AS since, strftime(o_orderdate, '%m/%d/%Y') AS shown, greatest(1000.0, least(200000.0, o_totalprice)) AS within FROM orders")
def award_windows(spark: SparkSession, sf: str) -> DataFrame:
    day = F.col("o_orderdate")
    return table(spark, sf, "orders").select("o_orderkey", dates.award_window(day).alias("since"), dates.us_date(day).alias("shown"), money.clamp(F.col("o_totalprice"), 1000.0, 200000.0).alias("within"))


ISSUES = [("l_linenumber % 3", "a"), ("l_partkey % 4", "b"), ("l_suppkey % 5", "c")]


@query(f"SELECT l_orderkey AS k, l_linenumber AS line, CAST({' + '.join(f'CASE WHEN {e} = 0 THEN 0 ELSE {e} - 1 END' for e, _ in ISSUES)} AS INTEGER) AS high FROM lineitem")
def high_issue_counts(spark: SparkSession, sf: str) -> DataFrame:
    made = [F.when(F.expr(e) > 0, F.transform(F.sequence(F.lit(1), F.expr(e).cast("int")), lambda i: F.struct(F.when(i == 1, "low").otherwise("high").alias("severity")))).alias(n) for e, n in ISSUES]
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), *made).select("k", "line", review.high_issues("a", "b", "c").alias("high"))


@query("""SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN 'p2' WHEN c_custkey % 4 = 1 THEN 'p3' WHEN c_custkey % 4 = 2 THEN 'p1' END AS path FROM customer""")
def packages_found(spark: SparkSession, sf: str) -> DataFrame:
    docs = F.expr("array(named_struct('category', 'general', 'path', 'p1', 'name', if(c_custkey % 4 = 2, 'package.pdf', 'x')), named_struct('category', if(c_custkey % 4 = 0, 'package', 'form'), 'path', 'p2', 'name', 'y'), named_struct('category', 'form', 'path', 'p3', 'name', concat(c_name, '.pdf')))")
    wanted = F.when(F.col("c_custkey") % 4 == 1, "p3").otherwise("none")
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), docs.alias("docs"), wanted.alias("wanted")).select("k", review.find_first("docs", "package", F.col("wanted"), "package.pdf")["path"].alias("path"))


@query(f"{L} SELECT category, count(*) AS samples, CASE WHEN count(*) > 5 THEN round(avg(unit_weight) / 100, 9) END AS scale FROM lines WHERE unit_weight IS NOT NULL GROUP BY 1")
def weight_scales(spark: SparkSession, sf: str) -> DataFrame:
    from sluice.operators.aggregates import weight_scale

    return weight_scale(lines(spark, sf), "category", "unit_weight").select("category", "samples", F.round("scale", 9).alias("scale"))


# ---- workbooks: a sheet for each order, with a header, its lines and totals

SHEET_NAME = pick("l_orderkey", "Steel Bollards", "Pan stair 2", "HSS frame", "Odd work", "Guardrail run")
HOURS = "(l_orderkey % 9) * 10 + 5"
ITEM = pick("l_partkey + l_suppkey", "w8x10", "HSS4X4X1/4", "L2X2X1/4 - 6in", "1 1/2\" DIA.  ST. PIPE SCH. 40", "2\" DIA PIPE 11 GA", "3/8\" X 12\" STRINGER PL", "flat bar")
UNIT = pick("l_suppkey", "EA", "lf", "FT", "SF", None)


def sheet_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").withColumns({"file": F.col("l_orderkey"), "name": F.expr(SHEET_NAME)})
    text = lambda e: F.expr(e).cast("string")
    blank = F.lit("")
    cells = lambda *found: F.array(blank, *(found + (blank,) * (15 - len(found)))).alias("cells")
    one = rows.select("file", "name").distinct()
    header = one.select("file", F.lit(0).cast("long").alias("row_no"), cells(F.col("name")))
    body = rows.select("file", (F.col("l_linenumber") * 1000 + F.col("l_suppkey") % 1000).cast("long").alias("row_no"), cells(blank, F.lit("A1"), F.expr(ITEM), text("l_quantity"), blank, blank, F.coalesce(F.expr(UNIT), blank), text("l_partkey % 7"), text("l_quantity * 2")))
    total = one.where("file % 5 <> 4").select("file", F.lit(90_000).cast("long").alias("row_no"), cells(F.when(F.col("file") % 2 == 0, F.concat(F.lit("Total "), "name")).otherwise(F.col("name")), blank, blank, blank, blank, blank, blank, blank, text("file % 40 * 50"), text(HOURS.replace("l_orderkey", "file")), text("file % 3"), text("0"), text("file % 4"), text("file % 8"), text("1")))
    return header.unionByName(body).unionByName(total)


@query(f"""WITH s AS (SELECT DISTINCT l_orderkey AS file, {SHEET_NAME} AS name FROM lineitem WHERE l_orderkey % 5 <> 4), h AS (SELECT *, CAST((file % 9) * 10 + 5 AS DOUBLE) AS fab, CAST(file % 8 AS DOUBLE) AS iron, CAST(file % 40 * 50 AS DOUBLE) AS weight FROM s)
SELECT file, name, CASE WHEN name LIKE '%Bollard%' THEN 'bollard_set' WHEN name LIKE '%stair%' THEN 'pan_stair' WHEN name LIKE 'HSS%' THEN 'hss_framing' WHEN name LIKE 'Guard%' THEN 'guardrail_run' ELSE 'misc' END AS assembly_type,
  CASE WHEN weight < 200 THEN 'small' WHEN weight < 1500 THEN 'medium' ELSE 'large' END AS size_band, fab AS fab_hrs_expected, round(fab * 0.75, 1) AS fab_hrs_min, round(fab * 1.3, 1) AS fab_hrs_max, CASE WHEN iron > 0 THEN round(iron * 0.75, 1) END AS ironworker_hrs_min FROM h""")
def workbook_priors(spark: SparkSession, sf: str) -> DataFrame:
    return workbook.priors(sheet_rows(spark, sf)).select("file", "name", "assembly_type", "size_band", "fab_hrs_expected", "fab_hrs_min", "fab_hrs_max", "ironworker_hrs_min")


@query(f"""WITH l AS (SELECT l_orderkey AS file, l_linenumber * 1000 + l_suppkey % 1000 AS row_no, {ITEM} AS item, CASE upper({UNIT}) WHEN 'EA' THEN 'lb/ea' WHEN 'LF' THEN 'lb/ft' WHEN 'FT' THEN 'lb/ft' END AS unit, CAST(l_partkey % 7 AS DOUBLE) AS unit_weight FROM lineitem WHERE l_orderkey % 5 <> 4),
d AS (SELECT *, CASE item WHEN 'w8x10' THEN 'W8x10' WHEN 'HSS4X4X1/4' THEN 'HSS4x4x1/4' WHEN 'L2X2X1/4 - 6in' THEN 'L2x2x1/4 - 6in' WHEN '1 1/2" DIA.  ST. PIPE SCH. 40' THEN '1 1/2" pipe sch 40' WHEN '2" DIA PIPE 11 GA' THEN '2" pipe (11 GA)' WHEN '3/8" X 12" STRINGER PL' THEN 'PL 3/8 x 12' ELSE item END AS designation FROM l WHERE unit IS NOT NULL AND unit_weight <> 0)
SELECT designation, unit, CASE WHEN designation LIKE 'W8%' THEN 'W' WHEN designation LIKE 'HSS%' THEN 'HSS' WHEN designation LIKE '%pipe%' THEN 'PIPE' WHEN designation LIKE 'L2%' THEN 'ANGLE' WHEN designation LIKE 'PL%' THEN 'PLATE' ELSE 'BAR' END AS family,
  min(struct_pack(f := file, r := row_no, w := unit_weight)).w AS unit_weight FROM d GROUP BY 1, 2, 3""")
def workbook_shapes(spark: SparkSession, sf: str) -> DataFrame:
    return workbook.shapes(sheet_rows(spark, sf))
