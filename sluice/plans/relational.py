"""Filters, joins, aggregations, windows and set operations as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluice.operators import aggregates, filters, joins, windows
from sluice.plans.relations import NOW, STATUSES, as_of, cte, lines, opportunities, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


O, L = cte("opportunities"), cte("lines")


@query(f"{O}, d AS (SELECT unnest({list(STATUSES)!r}) AS status) SELECT d.status, count(o.opp_id) AS n FROM d LEFT JOIN opportunities o ON o.status = d.status GROUP BY 1")
def status_counts(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.zero_filled_counts(opportunities(spark, sf), "status", STATUSES)


@query(f"{O} SELECT coalesce(source, 'unknown') AS source, count(*) AS n FROM opportunities WHERE status NOT IN ('passed', 'lost') GROUP BY 1")
def source_counts(spark, sf):
    return opportunities(spark, sf).where(~F.col("status").isin("passed", "lost")).groupBy(F.coalesce("source", F.lit("unknown")).alias("source")).agg(F.count("*").alias("n"))


@query(f"{O} SELECT count(*) FILTER (WHERE status = 'won' AND created >= date_trunc('month', {NOW})) AS won_month, count(*) FILTER (WHERE status = 'lost' AND created >= date_trunc('month', {NOW})) AS lost_month, count(*) FILTER (WHERE status IN ('new', 'reviewing', 'bidding')) AS active FROM opportunities")
def period_counts(spark, sf):
    month = F.date_trunc("month", as_of())
    since = F.col("created") >= month
    return opportunities(spark, sf).agg(F.count_if((F.col("status") == "won") & since).alias("won_month"), F.count_if((F.col("status") == "lost") & since).alias("lost_month"), F.count_if(F.col("status").isin("new", "reviewing", "bidding")).alias("active"))


@query(f"{O} SELECT status, count(*) AS touched, CAST(sum(coalesce(CAST(value AS DECIMAL(14,2)), 0)) AS DOUBLE) AS amount FROM opportunities WHERE created > {NOW} - INTERVAL 7 DAY AND created <= {NOW} GROUP BY 1")
def weekly_amount(spark, sf):
    recent = opportunities(spark, sf).where((F.col("created") > as_of() - F.expr("interval 7 days")) & (F.col("created") <= as_of()))
    return recent.groupBy("status").agg(F.count("*").alias("touched"), F.sum(F.coalesce(F.col("value").cast("decimal(14,2)"), F.lit(0))).cast("double").alias("amount"))


@query(f"{O} SELECT c_custkey AS customer_id, count(opp_id) AS total, count(*) FILTER (WHERE status = 'won') AS won, count(*) FILTER (WHERE status = 'lost') AS lost, count(*) FILTER (WHERE status = 'bidding') AS bidding, count(*) FILTER (WHERE status IN ('new','reviewing','bidding')) AS active, CAST(coalesce(sum(CAST(CASE WHEN status = 'won' THEN value END AS DECIMAL(14,2))), 0) AS DOUBLE) AS won_value, max(created) AS last_contact FROM customer LEFT JOIN opportunities ON customer_id = c_custkey GROUP BY 1")
def customer_pipeline(spark, sf):
    own = opportunities(spark, sf).groupBy("customer_id").agg(
        F.count("*").alias("total"), *(F.count_if(F.col("status") == s).alias(s) for s in ("won", "lost", "bidding")), F.count_if(F.col("status").isin("new", "reviewing", "bidding")).alias("active"), F.sum(F.when(F.col("status") == "won", F.col("value").cast("decimal(14,2)"))).alias("won_value"), F.max("created").alias("last_contact")
    )
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("total", "won", "lost", "bidding", "active")}
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("customer_id")).join(own, "customer_id", "left").withColumns(zero).withColumn("won_value", F.coalesce("won_value", F.lit(0)).cast("double"))


@query(f"{L} SELECT category, count(*) AS n, round(avg((actual - predicted) / nullif(predicted, 0)), 6) AS cost_delta, round(avg(actual / nullif(predicted, 0)), 6) AS cost_ratio FROM lines WHERE actual IS NOT NULL GROUP BY 1")
def calibration_by_category(spark, sf):
    found = aggregates.calibration(lines(spark, sf), "category", {"cost": ("predicted", "actual")})
    return found.select("category", "n", F.round("cost_delta", 6).alias("cost_delta"), F.round("cost_ratio", 6).alias("cost_ratio"))


@query(f"{L} SELECT category, count(*) AS n, list_sort(list(fab_hrs * quantity))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS median FROM lines GROUP BY 1")
def upper_median_hours(spark, sf):
    return aggregates.upper_median_by(lines(spark, sf).withColumn("hours", F.col("fab_hrs") * F.col("quantity")), ["category"], "hours")


@query("SELECT event_type, count(*) FILTER (WHERE value >= 150) AS error, count(*) FILTER (WHERE value >= 50 AND value < 150) AS warning, count(*) FILTER (WHERE value < 50) AS info FROM events GROUP BY 1")
def severity_tally(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").groupBy("event_type").agg(F.count_if(v >= 150).alias("error"), F.count_if((v >= 50) & (v < 150)).alias("warning"), F.count_if(v < 50).alias("info"))


@query(f"{L} SELECT category, array_to_string(list_sort(list(DISTINCT finish)), ' / ') AS finishes, min(quantity) AS low, max(quantity) AS high, (min(quantity) + max(quantity)) / 2 AS middle FROM lines GROUP BY 1")
def category_summary(spark, sf):
    q = F.col("quantity")
    return lines(spark, sf).groupBy("category").agg(F.array_join(F.array_sort(F.collect_set("finish")), " / ").alias("finishes"), F.min(q).alias("low"), F.max(q).alias("high"), ((F.min(q) + F.max(q)) / 2).alias("middle"))


@query(f"{L}, c AS (SELECT assembly, category, count(*) AS n FROM lines GROUP BY 1, 2) SELECT assembly, category, n FROM (SELECT *, row_number() OVER (PARTITION BY assembly ORDER BY n DESC, category) AS r FROM c) WHERE r = 1")
def densest_category(spark, sf):
    return aggregates.densest(lines(spark, sf), ["assembly"], "category")


@query(f"{L} SELECT opp_id, category, count(*) AS n, count(DISTINCT assembly) AS markers FROM lines GROUP BY 1, 2 HAVING count(*) > 1 AND count(DISTINCT assembly) < count(*)")
def overlapping_lines(spark, sf):
    grouped = lines(spark, sf).groupBy("opp_id", "category").agg(F.count("*").alias("n"), F.size(F.collect_set("assembly")).cast("long").alias("markers"))
    return grouped.where("n > 1 and markers < n")


@query(f"{O} SELECT opp_id, 'PRP-' || CAST(year(created) AS VARCHAR) || '-' || lpad(CAST(row_number() OVER (PARTITION BY year(created) ORDER BY created, opp_id) AS VARCHAR), 6, '0') AS number FROM opportunities")
def number_per_year(spark, sf):
    placed = windows.numbered_in_buckets(opportunities(spark, sf).withColumn("year", F.year("created")), ["year"], F.to_date("created"), ["created", "opp_id"])
    return placed.select("opp_id", F.concat(F.lit("PRP-"), F.col("year").cast("string"), F.lit("-"), F.lpad(F.col("n").cast("string"), 6, "0")).alias("number"))


@query(f"{O}, f AS (SELECT opp_id, score, deadline, count(*) OVER () AS total FROM opportunities WHERE status = 'bidding' AND score >= 40) SELECT * FROM f ORDER BY score DESC, deadline NULLS LAST, opp_id LIMIT 50 OFFSET 100")
def list_page(spark, sf):
    wanted = opportunities(spark, sf).where((F.col("status") == "bidding") & (F.col("score") >= 40)).select("opp_id", "score", "deadline")
    return filters.page(wanted, [F.desc("score"), F.asc_nulls_last("deadline"), F.asc("opp_id")], 100, 50)


@query(f"{O} SELECT opp_id, agency, title FROM opportunities WHERE title ILIKE '%urgent%' OR agency ILIKE '%00009%'")
def text_search(spark, sf):
    return opportunities(spark, sf).where(filters.contains_any(["title"], "urgent") | filters.contains_any(["agency"], "00009")).select("opp_id", "agency", "title")


RULES = (("vehicle", ("automobile",)), ("home", ("household", "furniture")), ("low", ("5-low", "not specified")), ("heavy", ("machinery",)))


@query(f"{O} SELECT rule, count(*) AS n FROM (SELECT CASE WHEN title ILIKE '%automobile%' THEN 'vehicle' WHEN title ILIKE '%household%' OR title ILIKE '%furniture%' THEN 'home' WHEN title ILIKE '%5-low%' OR title ILIKE '%not specified%' THEN 'low' WHEN title ILIKE '%machinery%' THEN 'heavy' ELSE 'none' END AS rule FROM opportunities) GROUP BY 1")
def first_matching_rule(spark, sf):
    return opportunities(spark, sf).groupBy(F.coalesce(filters.first_rule("title", RULES), F.lit("none")).alias("rule")).agg(F.count("*").alias("n"))


@query(f"{O} SELECT opp_id, deadline FROM opportunities WHERE status IN ('new', 'reviewing') AND (deadline IS NULL OR deadline >= {NOW})")
def open_opportunities(spark, sf):
    return opportunities(spark, sf).where(F.col("status").isin("new", "reviewing") & filters.open_until("deadline", as_of())).select("opp_id", "deadline")


@query("SELECT user_id, count(*) AS due FROM events WHERE event_type <> 'purchase' AND (CASE WHEN event_type = 'error' THEN ts + INTERVAL 3 DAY END IS NULL OR ts + INTERVAL 3 DAY <= TIMESTAMP '2024-01-15') AND ts <= TIMESTAMP '2024-01-15' + INTERVAL 7 DAY GROUP BY 1")
def active_reminders(spark, sf):
    now = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    tasks = table(spark, sf, "events").withColumns({"completed": F.expr("case when event_type = 'purchase' then ts end"), "snoozed": F.expr("case when event_type = 'error' then ts + interval 3 days end")})
    return tasks.where(filters.active("completed", "snoozed", "ts", now)).groupBy("user_id").agg(F.count("*").alias("due"))


@query(f"{L} SELECT error, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN NOT coalesce(quantity > 2, false) THEN 'quantity' END, CASE WHEN NOT coalesce(confidence BETWEEN 0.7 AND 1, false) THEN 'confidence' END, CASE WHEN NOT coalesce(unit_weight >= 0, false) THEN 'unit_weight' END], lambda x: x IS NOT NULL)) AS error FROM lines) GROUP BY 1")
def domain_violations(spark, sf):
    checks = [("quantity", F.col("quantity") > 2), ("confidence", F.col("confidence").between(0.7, 1)), ("unit_weight", F.col("unit_weight") >= 0)]
    return lines(spark, sf).select(F.explode(filters.domain_errors(checks)).alias("error")).groupBy("error").agg(F.count("*").alias("n"))


@query(f"{O} SELECT status, count(*) AS n FROM opportunities WHERE (status = 'won' AND created < {NOW} - INTERVAL 90 DAY) OR (status = 'lost' AND created < {NOW} - INTERVAL 14 DAY) OR (status = 'bidding' AND deadline < {NOW} - INTERVAL 30 DAY) GROUP BY 1")
def retention_candidates(spark, sf):
    return opportunities(spark, sf).where(filters.retention("status", "created", "deadline", as_of())).groupBy("status").agg(F.count("*").alias("n"))


@query(f"{O} SELECT reason, count(*) AS n FROM (SELECT CASE WHEN NOT coalesce(deadline IS NOT NULL, false) THEN 'no_documents' WHEN NOT coalesce(score >= 50, false) THEN 'low_score' WHEN NOT coalesce(status IN ('new', 'reviewing'), false) THEN 'status' ELSE 'promote' END AS reason FROM opportunities) GROUP BY 1")
def promotion_reasons(spark, sf):
    tests = [("no_documents", F.col("deadline").isNotNull()), ("low_score", F.col("score") >= 50), ("status", F.col("status").isin("new", "reviewing"))]
    return opportunities(spark, sf).groupBy(filters.first_failing(tests, "promote").alias("reason")).agg(F.count("*").alias("n"))


@query(f"{cte('opportunities', 'lines')} SELECT l.opp_id, l.line_no, o.agency, l.category FROM lines l JOIN opportunities o USING (opp_id) WHERE l.flagged AND o.status = 'bidding'")
def flagged_lines_of_bids(spark, sf):
    bids = opportunities(spark, sf).where("status = 'bidding'").select("opp_id", "agency")
    return lines(spark, sf).where("flagged").join(bids, "opp_id").select("opp_id", "line_no", "agency", "category")


@query(f"{O} SELECT customer_id, array_to_string(list_sort(list(CAST(created AS DATE)::VARCHAR || ' ' || status)), ';') AS history FROM opportunities GROUP BY 1")
def nested_history(spark, sf):
    step = F.concat_ws(" ", F.col("created").cast("date").cast("string"), "status")
    return opportunities(spark, sf).groupBy("customer_id").agg(F.array_join(F.array_sort(F.collect_list(step)), ";").alias("history"))


@query(f"{L} SELECT category, round(sum(quantity * coalesce(unit_weight, p_size)), 6) AS weight FROM lines JOIN part ON p_partkey = part_id GROUP BY 1")
def weight_by_lookup(spark, sf):
    catalog = table(spark, sf, "part").select(F.col("p_partkey").alias("part_id"), "p_size")
    return lines(spark, sf).join(catalog, "part_id", "left").groupBy("category").agg(F.round(F.sum(F.col("quantity") * F.coalesce("unit_weight", "p_size")), 6).alias("weight"))


@query("SELECT o_custkey AS customer_id, count(*) AS n FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_discount > 0.09) GROUP BY 1")
def customers_with_deep_discounts(spark, sf):
    deep = table(spark, sf, "lineitem").where("l_discount > 0.09").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf, "orders").join(deep, "o_orderkey", "left_semi").groupBy(F.col("o_custkey").alias("customer_id")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS opp_id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def opportunities_without_lines(spark, sf):
    covered = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf, "orders").join(covered, "o_orderkey", "left_anti").select(F.col("o_orderkey").alias("opp_id"))


@query("WITH a AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_linestatus = 'O') SELECT coalesce(a.k, b.k) AS opp_id, CASE WHEN b.k IS NULL THEN 'left_only' WHEN a.k IS NULL THEN 'right_only' ELSE 'in_both' END AS side FROM a FULL JOIN b ON a.k = b.k")
def reconcile_marks(spark, sf):
    li = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "opp_id")
    return joins.reconcile(li.where("l_returnflag = 'A'"), li.where("l_linestatus = 'O'"), "opp_id")


@query("WITH e AS (SELECT p_type AS category, p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS ordinal FROM part), t AS (SELECT p_type AS category, count(DISTINCT l_partkey) // 2 AS have FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_type <> 'PROMO' GROUP BY 1) SELECT category, count(*) AS missing, min(ordinal) AS first_missing FROM e LEFT JOIN t USING (category) WHERE ordinal > coalesce(have, 0) GROUP BY 1")
def missing_items(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_type").alias("category"), "p_partkey")
    sold = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey")).distinct().join(part, "p_partkey").where("category <> 'PROMO'")
    have = sold.groupBy("category").agg(F.floor(F.count("*") / 2).alias("have"))
    missing, _ = joins.multiset_difference(part, have, "category", ["p_partkey"], F.floor(F.col("p_partkey") / 100_000))
    return missing.groupBy("category").agg(F.count("*").alias("missing"), F.min("ordinal").alias("first_missing"))


VERSIONS = [(1, "1990-01-01", "1996-01-01", 0.55), (2, "1996-01-01", "1998-01-01", 0.62), (3, "1998-01-01", None, 0.7)]


@query("WITH v(version, f, t, rate) AS (VALUES (1, DATE '1990-01-01', DATE '1996-01-01', 0.55::DOUBLE), (2, DATE '1996-01-01', DATE '1998-01-01', 0.62), (3, DATE '1998-01-01', NULL, 0.7)) SELECT version, count(*) AS n, max(rate) AS rate FROM orders JOIN v ON CASE WHEN o_orderpriority = '1-URGENT' THEN version = 2 ELSE f <= o_orderdate AND (t IS NULL OR o_orderdate < t) END GROUP BY 1")
def rate_card_as_of(spark, sf):
    versions = spark.createDataFrame(VERSIONS, "version int, start string, end string, rate double").withColumns({"start": F.col("start").cast("date"), "end": F.col("end").cast("date")})
    facts = table(spark, sf, "orders").select("o_orderdate", F.expr("case when o_orderpriority = '1-URGENT' then 2 end").alias("pinned"))
    return joins.as_of_version(facts, versions, "o_orderdate", "start", "end", "pinned").groupBy("version").agg(F.count("*").alias("n"), F.max("rate").alias("rate"))


POINTS = (5.0, 40.0, 41.0, 120.0, 300.0)


@query("WITH p(i, x) AS (VALUES (0, 5.0), (1, 40.0), (2, 41.0), (3, 120.0), (4, 300.0)), r AS (SELECT event_id, i, row_number() OVER (PARTITION BY event_id ORDER BY abs(x - value), i) AS n FROM events, p) SELECT i AS place, count(*) AS n FROM r WHERE n = 1 GROUP BY 1")
def nearest_column(spark, sf):
    return table(spark, sf, "events").groupBy(joins.nearest(F.col("value"), POINTS).cast("int").alias("place")).agg(F.count("*").alias("n"))


@query(f"{L}, p AS (SELECT p_partkey, p_type AS category, p_brand, p_retailprice FROM part), a AS (SELECT category, assembly FROM lines GROUP BY 1, 2), m AS (SELECT a.category, a.assembly, p_partkey, p_retailprice, row_number() OVER (PARTITION BY a.category, a.assembly ORDER BY CASE WHEN p_brand = a.assembly THEN 0 ELSE 1 END, p_retailprice DESC, p_partkey) AS n FROM a JOIN p ON p.category = a.category) SELECT category, assembly, p_partkey, p_retailprice FROM m WHERE n = 1")
def prior_by_priority(spark, sf):
    asked = lines(spark, sf).select("category", "assembly").distinct()
    priors = table(spark, sf, "part").select(F.col("p_type").alias("category"), "p_partkey", "p_brand", "p_retailprice")
    return joins.best_of_two(asked, priors, "category", ("assembly", "p_brand"), [F.desc("p_retailprice"), "p_partkey"]).select("category", "assembly", "p_partkey", "p_retailprice")


SECTION_TAGS = [("SMALL", "included"), ("PROMO", "excluded")]
PREFIX_TAGS = [("ST", "judgment"), ("PR", "included"), ("LA", "excluded")]


@query("SELECT tag, count(*) AS n FROM (SELECT CASE WHEN p_type = 'SMALL' THEN 'included' WHEN p_type = 'PROMO' THEN 'excluded' WHEN left(p_type, 2) = 'ST' THEN 'judgment' WHEN left(p_type, 2) = 'PR' THEN 'included' WHEN left(p_type, 2) = 'LA' THEN 'excluded' ELSE 'n_a' END AS tag FROM part) GROUP BY 1")
def hierarchical_lookup(spark, sf):
    exact, prefix = (spark.createDataFrame(x, "code string, tag string") for x in (SECTION_TAGS, PREFIX_TAGS))
    found = joins.resolve(table(spark, sf, "part"), joins.hierarchical("p_type", exact, prefix, "n_a"))
    return found.groupBy("tag").agg(F.count("*").alias("n"))


@query("WITH d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1) SELECT user_id, event_id, event_type FROM d")
def latest_per_user(spark, sf):
    return windows.first_by(table(spark, sf, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query("SELECT text_hash, doc_id FROM (SELECT md5(text) AS text_hash, doc_id, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def first_seen_documents(spark, sf):
    docs = table(spark, sf, "documents").select(F.md5(F.col("text").cast("binary")).alias("text_hash"), "doc_id")
    return docs.groupBy("text_hash").agg(F.min("doc_id").alias("doc_id"))


@query("SELECT o_custkey AS customer_id, o_orderkey AS opp_id, n FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'P' THEN 1 ELSE 2 END, o_orderdate DESC, o_orderkey) AS n FROM orders) WHERE n <= 3")
def revision_rank(spark, sf):
    kind = F.expr("case o_orderstatus when 'F' then 0 when 'P' then 1 else 2 end")
    placed = windows.numbered(table(spark, sf, "orders"), ["o_custkey"], [kind, F.desc("o_orderdate"), "o_orderkey"])
    return placed.where("n <= 3").select(F.col("o_custkey").alias("customer_id"), F.col("o_orderkey").alias("opp_id"), "n")


@query("WITH s AS (SELECT *, CASE WHEN epoch(ts) / 3600.0 - lag(epoch(ts) / 3600.0) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 12 THEN 1 ELSE 0 END AS b FROM events), c AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS cluster FROM s) SELECT user_id, CAST(cluster AS BIGINT) AS cluster, count(*) AS n FROM c GROUP BY 1, 2")
def gap_clusters(spark, sf):
    hours = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) / 1e6D") / 3600.0
    found = windows.gap_clusters(table(spark, sf, "events"), ["user_id"], hours, 12, ["event_id"], bucket=F.to_date("ts"))
    return found.groupBy("user_id", "cluster").agg(F.count("*").alias("n"))


@query("WITH s AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS phase FROM events), e AS (SELECT *, coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, phase ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, phase) AS has FROM s) SELECT user_id, CAST(phase AS BIGINT) AS phase, count(*) AS n, round(sum(value), 6) AS total FROM e WHERE phase > 0 AND has = 1 AND ended = 0 GROUP BY 1, 2")
def phase_sessions(spark, sf):
    kind = F.col("event_type")
    found = windows.phases(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], kind == "signup", kind == "purchase", F.to_date("ts"))
    return found.groupBy("user_id", "phase").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query("WITH p AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM conversations) SELECT conv_id, turn, role FROM p WHERE before <= 1500")
def budget_prefix(spark, sf):
    found = windows.budget_prefix(table(spark, sf, "conversations"), ["conv_id"], ["turn"], F.length("text") + 1, 1500)
    return found.select("conv_id", "turn", "role")


def greedy_budget(spark: SparkSession, sf: str) -> DataFrame:
    """Each conversation's turns, shortest role name first, as long as they fit 1,000 characters; at most three."""
    item = F.struct("role", "turn", F.length("text").cast("double").alias("size"))
    grouped = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    kept = grouped.select("conv_id", F.explode(windows.greedy_budget(F.col("items"), "size", 1000, 3)).alias("x"))
    return kept.select("conv_id", "x.turn", "x.role")


QUERIES["greedy_budget"] = greedy_budget
ORACLE_SQL["greedy_budget"] = """
WITH RECURSIVE i AS (SELECT conv_id, turn, role, length(text) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY role, turn, length(text)) AS n FROM conversations),
f(conv_id, n, used, kept, take) AS (
  SELECT conv_id, n, CASE WHEN size <= 1000 THEN size ELSE 0 END, CASE WHEN size <= 1000 THEN 1 ELSE 0 END, size <= 1000 FROM i WHERE n = 1
  UNION ALL
  SELECT i.conv_id, i.n, CASE WHEN kept < 3 AND used + size <= 1000 THEN used + size ELSE used END, CASE WHEN kept < 3 AND used + size <= 1000 THEN kept + 1 ELSE kept END, kept < 3 AND used + size <= 1000
  FROM f JOIN i ON i.conv_id = f.conv_id AND i.n = f.n + 1)
SELECT i.conv_id, turn, role FROM f JOIN i ON i.conv_id = f.conv_id AND i.n = f.n WHERE take"""


@query(f"{O} SELECT opp_id, score, deadline FROM opportunities ORDER BY score DESC NULLS LAST, deadline ASC NULLS LAST, opp_id LIMIT 100")
def top_opportunities(spark, sf):
    return opportunities(spark, sf).select("opp_id", "score", "deadline").orderBy(F.desc_nulls_last("score"), F.asc_nulls_last("deadline"), "opp_id").limit(100)


@query("SELECT source, kind, count(*) AS n FROM (SELECT source, 'document' AS kind FROM documents UNION ALL SELECT role, 'message' FROM conversations) GROUP BY 1, 2")
def union_of_sources(spark, sf):
    docs = table(spark, sf, "documents").select("source", F.lit("document").alias("kind"))
    mail = table(spark, sf, "conversations").select(F.col("role").alias("source"), F.lit("message").alias("kind"))
    return docs.unionByName(mail).groupBy("source", "kind").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS k FROM orders WHERE o_orderpriority = '1-URGENT' UNION SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 400000")
def union_by_key(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), "o_orderpriority", "o_orderstatus", "o_totalprice")
    return orders.where("o_orderpriority = '1-URGENT'").select("k").union(orders.where("o_orderstatus = 'F' and o_totalprice > 400000").select("k")).distinct()


@query("SELECT 'except' AS op, count(*) AS n FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'N') UNION ALL SELECT 'intersect', count(*) FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'N')")
def except_and_intersect(spark, sf):
    li = table(spark, sf, "lineitem")
    a, n = (li.where(F.col("l_returnflag") == f).select("l_partkey") for f in "AN")
    count = lambda df, op: df.agg(F.count("*").alias("n")).select(F.lit(op).alias("op"), "n")
    return count(a.exceptAll(n).distinct().join(n, "l_partkey", "left_anti").union(a.join(n, "l_partkey", "left_anti")).distinct(), "except").union(count(a.intersect(n), "intersect"))


@query("WITH f AS (SELECT o_orderkey, o_orderstatus AS status, o_totalprice AS value FROM orders), c AS (SELECT o_orderkey, 'X' AS status, value + 1 AS value FROM f WHERE status = 'P' UNION ALL SELECT -o_orderkey - 1, 'N', value FROM f WHERE status = 'O') SELECT status, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(14,2))) AS DOUBLE) AS value FROM (SELECT * FROM c UNION ALL SELECT * FROM f WHERE o_orderkey NOT IN (SELECT o_orderkey FROM c)) GROUP BY 1")
def merge_latest(spark, sf):
    old = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("value"))
    changed = old.where("status = 'P'").select("o_orderkey", F.lit("X").alias("status"), (F.col("value") + 1).alias("value"))
    new = old.where("status = 'O'").select((-F.col("o_orderkey") - 1).alias("o_orderkey"), F.lit("N").alias("status"), "value")
    merged = joins.merge_latest(old, changed.union(new), ["o_orderkey"], [F.lit(0)])
    return merged.groupBy("status").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(14,2)")).cast("double").alias("value"))


@query("SELECT field, count(*) AS n FROM (SELECT CASE WHEN o_totalprice > 250000 THEN 'status' END AS field FROM orders WHERE o_orderstatus <> 'X' UNION ALL SELECT 'priority' FROM orders WHERE o_orderpriority <> 'none') WHERE field IS NOT NULL GROUP BY 1")
def field_changes(spark, sf):
    old = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("value"))
    new = old.withColumns({"status": F.expr("case when value > 250000 then 'X' else status end"), "priority": F.lit("none")})
    return joins.field_changes(old, new, "o_orderkey", ["status", "priority", "value"]).groupBy("field").agg(F.count("*").alias("n"))


@query("SELECT o_custkey AS customer_id, count(*) AS inserted FROM (SELECT DISTINCT o_custkey, o_orderstatus FROM orders) a WHERE NOT EXISTS (SELECT 1 FROM orders b WHERE b.o_custkey = a.o_custkey AND b.o_orderstatus = a.o_orderstatus AND b.o_totalprice > 300000) GROUP BY 1")
def idempotent_insert(spark, sf):
    orders = table(spark, sf, "orders")
    absent = joins.insert_absent(orders.select("o_custkey", "o_orderstatus").distinct(), orders.where("o_totalprice > 300000"), ["o_custkey", "o_orderstatus"])
    return absent.groupBy(F.col("o_custkey").alias("customer_id")).agg(F.count("*").alias("inserted"))
