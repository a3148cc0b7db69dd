"""Revisions, scopes, prices at commit, inbound mail and attached documents as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators import documents, layout, pricing
from sluice.plans.intake import pick
from sluice.plans.relations import AS_OF, as_of, table
from sluice.sources import readers, sinks

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


SHOWN = {
    "pkg": "l_orderkey",
    "sheet": "CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE concat('S', 100 + l_partkey % 2) END",
    "said": "CASE l_suppkey % 4 WHEN 0 THEN concat('REV ', l_suppkey % 9) WHEN 1 THEN concat('dated ', 1 + l_suppkey % 12, '/', 1 + l_suppkey % 28, '/2024') WHEN 2 THEN 'as bid' END",
    "place": "l_linenumber * 100000 + l_partkey",
}
SHOWINGS = f"""WITH s AS (SELECT DISTINCT {', '.join(f'{e} AS {n}' for n, e in SHOWN.items())} FROM lineitem),
r AS (SELECT *, CASE WHEN said LIKE 'REV%' THEN 0 WHEN said LIKE 'dated%' THEN 1 ELSE 2 END AS k, CASE WHEN said LIKE 'REV%' THEN CAST(substr(said, 5) AS BIGINT) WHEN said LIKE 'dated%' THEN epoch_ms(strptime(substr(said, 7), '%m/%d/%Y')) // 86400000 ELSE 0 END AS v, CASE WHEN said LIKE 'REV%' THEN said WHEN said LIKE 'dated%' THEN substr(said, 7) ELSE '' END AS raw FROM s WHERE sheet IS NOT NULL)"""


def showings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(*(F.expr(e).alias(n) for n, e in SHOWN.items())).distinct()


@query(f"{SHOWINGS}, n AS (SELECT *, row_number() OVER (PARTITION BY pkg, sheet ORDER BY k, v DESC, place, raw) AS i, count(*) OVER (PARTITION BY pkg, sheet) AS showings FROM r) SELECT pkg, sheet, place, nullif(raw, '') AS revision, CAST(showings AS INTEGER) AS showings FROM n WHERE i = 1")
def latest_sheets(spark: SparkSession, sf: str) -> DataFrame:
    return layout.latest_revisions(showings(spark, sf), "pkg", "said", "place")[0]


@query(f"{SHOWINGS} SELECT pkg, sheet, 'Sheet ' || sheet || ' is there ' || count(*) || ' times: ' || string_agg(CASE WHEN raw = '' THEN '(unrevised)' ELSE raw END, ', ' ORDER BY k, v DESC, place, raw) AS finding FROM r GROUP BY 1, 2 HAVING count(*) > 1")
def revision_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return layout.latest_revisions(showings(spark, sf), "pkg", "said", "place")[1].select("pkg", "sheet", "finding")


SCOPE = "concat(coalesce(text, ''), '. Doors of room ', 100 + doc_id % 50, 'A and 2', 10 + doc_id % 80, ' are by others. Provide all handrails for hall ', doc_id, '. Stations ', doc_id % 9, ' excluded from this work. Short. Include ladders of room 777, priced separately.')"


@query(rf"""WITH t AS (SELECT doc_id, regexp_replace({SCOPE}, '[ \t\r\n\f\v]+', ' ', 'g') AS t FROM documents),
s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(t, '([.!?:]) ([A-Z*•])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x, ' ')), lambda x: length(x) >= 12) AS l FROM t),
o AS (SELECT doc_id, list_filter(l, lambda x: regexp_matches(x, '(?i)(priced separately|by others|not included|out of scope|excluded|under separate contract|by owner)')) AS o, l FROM s)
SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(flatten(list_transform(o, lambda x: regexp_extract_all(x, '(?i)\b(?:room|rm\.?)\s+(\d{{2,3}}[A-Za-z]?)\b', 1))), flatten(list_transform(o, lambda x: regexp_extract_all(x, '\b(\d{{3}}[A-Za-z]?)\b', 1)))))), '|') AS rooms,
  array_to_string(list_sort(list_distinct(flatten(list_transform(o, lambda x: regexp_extract_all(x, '(?i)\b(?:stations?|sta\.?)\s+(?:no\.?\s*)?#?(\d+)\b', 1))))), '|') AS stations, CAST(len(o) AS INTEGER) AS excluded,
  CAST(len(list_filter(l, lambda x: NOT list_contains(o, x) AND regexp_matches(x, '(?i)^\s*(?:include[ds]?|provide[ds]?|the project includes|scope of work)'))) AS INTEGER) AS included FROM o""")
def scopes_of_work(spark: SparkSession, sf: str) -> DataFrame:
    found = table(spark, sf, "documents").select("doc_id", documents.scope_of_work(F.expr(SCOPE)).alias("s"))
    return found.select("doc_id", F.array_join("s.rooms", "|").alias("rooms"), F.array_join("s.stations", "|").alias("stations"), F.size("s.excluded").alias("excluded"), F.size("s.included").alias("included"))


COMMIT = {
    "opp_id": "l_orderkey", "line_no": "l_linenumber", "part": "l_partkey", "quantity": "CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE l_quantity END", "quantity_unit": pick("l_suppkey", "LF", "EA", "LBS", "SF", "FT"), "unit_weight": "CASE WHEN l_partkey % 3 = 0 THEN CAST(l_partkey % 20 AS DOUBLE) END",
    "unit_weight_unit": pick("l_partkey + l_suppkey", "lb/ft", "lb/ea", None), "steel_shape_designation": pick("l_partkey", "W8x10", "HSS4", None, "odd"), "total_weight": "CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE l_quantity * 7 END", "material_grade": pick("l_suppkey + l_linenumber", "A36", None, "316L", "stainless"),
    "fab_hrs": "CAST(l_linenumber AS DOUBLE)", "iron_hrs": "CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity * 0.1 END", "finish": pick("l_partkey + l_linenumber", "galvanized", "shop_primer", "none", None),
}


@query(f"""WITH l AS (SELECT {', '.join(f'{e} AS {n}' for n, e in COMMIT.items())} FROM lineitem), c AS (SELECT * FROM (VALUES ('W8x10', 10.0, 'lb/ft'), ('HSS4', 30.0, 'lb/ea')) v(d, w, u)),
m AS (SELECT l.*, coalesce(unit_weight, w) AS e, coalesce(unit_weight_unit, u) AS u FROM l LEFT JOIN c ON d = steel_shape_designation),
t AS (SELECT *, 1.05 * CASE WHEN e IS NOT NULL AND quantity IS NOT NULL THEN CASE WHEN (u = 'lb/ft' AND quantity_unit IN ('LF', 'FT')) OR (u = 'lb/ea' AND quantity_unit = 'EA') THEN quantity * e WHEN quantity_unit = 'LBS' THEN quantity WHEN e <> 0 THEN coalesce(total_weight, quantity * e) END ELSE total_weight END AS weight FROM m),
p AS (SELECT *, weight * CASE WHEN regexp_matches(upper(material_grade), 'STAINLESS|316|304') THEN 2.4 ELSE 0.62 END AS material, fab_hrs * 68.0 + coalesce(iron_hrs, 0) * 82.0 AS labor FROM t)
SELECT opp_id, count(weight) AS weighed, round(sum(weight), 4) AS weight, round(sum(material), 4) AS material, round(sum(coalesce(material, 0) + labor + CASE WHEN finish = 'galvanized' THEN coalesce(weight, 0) * 0.45 WHEN finish = 'shop_primer' THEN coalesce(material, 0) * 0.12 ELSE 0 END), 4) AS total FROM p GROUP BY 1""")
def committed_prices(spark: SparkSession, sf: str) -> DataFrame:
    given = table(spark, sf, "lineitem").select(*(F.expr(e).alias(n) for n, e in COMMIT.items()))
    catalog = spark.createDataFrame([("W8x10", 10.0, "lb/ft"), ("HSS4", 30.0, "lb/ea")], "designation string, unit_weight double, unit string")
    out = pricing.priced_at_commit(given, catalog)
    return out.groupBy("opp_id").agg(F.count("weight").alias("weighed"), *(F.round(F.sum(c), 4).alias(c) for c in ("weight", "material", "total")))


@query(f"""WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations)
SELECT 'm-' || conv_id || '-' || turn AS message_id, '[forwarded] ' || CASE WHEN turn % 3 = 0 THEN '(no subject)' ELSE left(repeat('Turn ' || turn || ' ', 60), 300) END AS title,
  left('From: ' || CASE WHEN conv_id % 2 = 0 THEN 'Ann' ELSE '' END || ' <' || role || '@mail.example>' || chr(10) || 'Received: ' || CASE WHEN conv_id % 5 = 0 THEN '{AS_OF}' ELSE '2031-01-0' || (1 + turn) END || chr(10) || chr(10) || CASE WHEN turn % 2 = 0 THEN repeat(text, 3) ELSE trim(regexp_replace('Hello ' || text, '[ \t\r\n]+', ' ', 'g'), ' ') END, 10000) AS description, role || '@mail.example' AS sender FROM c""")
def inbound_mail(spark: SparkSession, sf: str) -> DataFrame:
    name = F.when(F.col("conv_id") % 2 == 0, "Ann")
    text = F.coalesce("text", F.lit(""))
    item = F.struct(
        F.concat_ws("-", F.lit("m"), "conv_id", "turn").alias("MessageId"), F.struct(F.concat("role", F.lit("@mail.example")).alias("Address"), name.alias("Name")).alias("From"), F.when(F.col("turn") % 3 != 0, F.repeat(F.concat(F.lit("Turn "), "turn", F.lit(" ")), F.lit(60))).alias("Subject"),
        F.when(F.col("turn") % 2 == 0, F.repeat(text, F.lit(3))).alias("RawTextBody"), F.concat(F.lit("<style>x</style><p>Hello</p>"), text).alias("RawHtmlBody"), F.when(F.col("conv_id") % 5 != 0, F.concat(F.lit("2031-01-0"), 1 + F.col("turn"))).alias("SentAtDate"),
    )
    # each message comes twice
    posts = table(spark, sf, "conversations").select(F.to_json(F.struct(F.array(item, item).alias("items"))).alias("body"))
    return readers.inbound_items(posts, "body", as_of()).drop("sender_name")


@query("""WITH o AS (SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN 200000000 ELSE o_custkey + 1 END AS size, CASE o_orderkey % 3 WHEN 0 THEN 'drawing' WHEN 1 THEN 'photo' END AS category, o_orderkey % 4 AS path FROM orders)
SELECT k, CASE WHEN coalesce(size, 0) BETWEEN 1 AND 104857600 THEN CASE WHEN path < 2 THEN 2 ELSE 3 END ELSE 2 END AS documents, coalesce(size, 0) NOT BETWEEN 1 AND 104857600 AS still_purged, CASE WHEN coalesce(size, 0) BETWEEN 1 AND 104857600 THEN coalesce(nullif(category, 'photo'), 'general') || ':new ' || k END AS detail FROM o""")
def attached_documents(spark: SparkSession, sf: str) -> DataFrame:
    size = F.expr("cast(case o_orderkey % 5 when 0 then null when 1 then 0 when 2 then 200000000 else o_custkey + 1 end as long)")
    doc = lambda name, path, category, size: F.struct(name.alias("name"), path.cast("string").alias("path"), category.alias("category"), size.alias("size"))
    held = F.array(*(doc(F.lit(f"old {i}"), F.lit(i), F.lit("general"), F.lit(5).cast("long")) for i in range(2)))
    new = doc(F.concat(F.lit("new "), "k"), F.col("k") % 4, F.expr("case k % 3 when 0 then 'drawing' when 1 then 'photo' end"), F.col("size"))
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), size.alias("size"), held.alias("docs"), as_of().alias("purged"))
    out = sinks.attach_document(rows, "docs", "purged", new)
    return out.select("k", F.size("docs").alias("documents"), F.col("purged").isNotNull().alias("still_purged"), F.col("event.detail").alias("detail"))
