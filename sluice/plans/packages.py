"""Documents, messages, reviews and dashboards as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators import documents, pricing, review
from sluice.plans.relations import NOW, as_of, cte, lines, opportunities, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


O, L = cte("opportunities"), cte("lines")


@query("WITH p(code, pattern) AS (VALUES ('en', '(^|[^a-z])the([^a-z]|$)'), ('fr', '(^|[^a-z])les([^a-z]|$)'), ('de', '(^|[^a-z])und([^a-z]|$)')) SELECT conv_id, code, min(turn) AS first_page FROM conversations JOIN p ON regexp_matches(lower(text), pattern) GROUP BY 1, 2")
def first_page_of_code(spark, sf):
    pages = table(spark, sf, "conversations").withColumn("t", F.lower("text"))
    return documents.first_page(pages, "conv_id", "turn", "t", {"en": "(^|[^a-z])the([^a-z]|$)", "fr": "(^|[^a-z])les([^a-z]|$)", "de": "(^|[^a-z])und([^a-z]|$)"})


@query("""WITH m AS (SELECT event_id AS message, CASE WHEN event_type = 'click' THEN user_id * 10 END AS answers, event_type AS subject, ts AS at FROM events), t AS (SELECT DISTINCT user_id AS thread_id, user_id * 10 AS message_id FROM events),
s AS (SELECT event_type AS subject, user_id AS thread_id, min(ts) AS at FROM events WHERE event_type = 'error' GROUP BY 1, 2),
b AS (SELECT m.message, t.thread_id AS by_id FROM m LEFT JOIN t ON m.answers = t.message_id),
f AS (SELECT m.message, s.thread_id, row_number() OVER (PARTITION BY m.message ORDER BY s.at DESC, s.thread_id DESC) AS n FROM m JOIN s ON m.subject = s.subject AND s.at <= m.at)
SELECT coalesce(by_id, f.thread_id) AS thread_id, count(*) AS n FROM b LEFT JOIN f ON f.message = b.message AND f.n = 1 GROUP BY 1""")
def thread_of_message(spark, sf):
    e = table(spark, sf, "events")
    messages = e.select(F.col("event_id").alias("message"), F.expr("case when event_type = 'click' then user_id * 10 end").alias("answers"), F.concat(F.lit("Re: "), "event_type").alias("subject"), F.col("ts").alias("at"))
    first = e.where("event_type = 'error'").groupBy("user_id").agg(F.min("ts").alias("at"))
    threads = e.select("user_id").distinct().join(first, "user_id", "left").select(F.col("user_id").alias("thread_id"), (F.col("user_id") * 10).alias("message_id"), F.lit("error").alias("subject"), "at")
    return documents.key_then_like(messages, threads, "answers", "subject", "at").groupBy("thread_id").agg(F.count("*").alias("n"))


@query(f"{L} SELECT scope, count(*) AS n FROM (SELECT CASE WHEN (source_kind = 'spec' AND category IN ('SMALL', 'LARGE')) OR (source_kind = 'drawing' AND category = 'PROMO') THEN 'in_scope' ELSE 'phantom' END AS scope FROM lines) GROUP BY 1")
def scope_by_codes(spark, sf):
    codes = spark.createDataFrame([("spec", "05"), ("drawing", "08")], "source_kind string, code string")
    return documents.allowed_categories(lines(spark, sf), codes, {"05": ("SMALL", "LARGE"), "08": ("PROMO",)}, "source_kind").groupBy("scope").agg(F.count("*").alias("n"))


@query("WITH s AS (SELECT conv_id, turn, role, length(text) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY role, turn) AS n, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY role, turn ROWS UNBOUNDED PRECEDING) AS s FROM conversations) SELECT conv_id, turn, role FROM s WHERE n <= 3 AND s <= 2000")
def attachments_under_budget(spark, sf):
    sized = table(spark, sf, "conversations").withColumn("size", F.length("text"))
    return documents.top_under_budget(sized, "conv_id", ["role", "turn"], "size", 2000).select("conv_id", "turn", "role")


@query(f"{O} SELECT ready, blockers, count(*) AS n FROM (SELECT deadline IS NOT NULL AND value > 100000 AND score >= 30 AS ready, array_to_string(list_filter([CASE WHEN deadline IS NULL THEN 'deadline' END, CASE WHEN NOT value > 100000 THEN 'value' END, CASE WHEN NOT score >= 30 THEN 'score' END], lambda x: x IS NOT NULL), ',') AS blockers FROM opportunities) GROUP BY 1, 2")
def preflight_checks(spark, sf):
    p = review.preflight([("deadline", F.col("deadline").isNotNull()), ("value", F.col("value") > 100_000), ("score", F.col("score") >= 30)])
    return opportunities(spark, sf).select(p.alias("p")).groupBy(F.col("p.ready").alias("ready"), F.array_join("p.blockers", ",").alias("blockers")).agg(F.count("*").alias("n"))


@query(f"{L}, k AS (SELECT opp_id, line_no, part_id, supp_id, quantity FROM lines GROUP BY ALL HAVING count(*) = 1), u AS (SELECT l.*, CASE WHEN unit_weight IS NOT NULL THEN CASE WHEN quantity_unit = 'LBS' THEN l.quantity ELSE l.quantity * unit_weight * 1.05 END ELSE total_weight END AS old, CASE WHEN l.part_id % 3 = 0 THEN l.quantity + 1 ELSE l.quantity END AS q2, CASE WHEN l.part_id % 3 = 0 THEN true ELSE false END AS moved FROM lines l JOIN k USING (opp_id, line_no, part_id, supp_id, quantity)), w AS (SELECT *, CASE WHEN moved THEN CASE WHEN unit_weight IS NOT NULL THEN CASE WHEN quantity_unit = 'LBS' THEN q2 ELSE q2 * unit_weight * 1.05 END ELSE total_weight END ELSE old END AS weight FROM u) SELECT category, count(*) AS n, round(sum(weight), 6) AS weight, sum(q2) AS quantity FROM w GROUP BY 1")
def repriced_after_edits(spark, sf):
    key = ["opp_id", "line_no", "part_id", "supp_id", "was"]
    own = lines(spark, sf).withColumn("was", F.col("quantity"))
    single = own.groupBy(*key).agg(F.count("*").alias("c")).where("c = 1").drop("c")
    own = pricing.priced(own.join(single, key, "left_semi"))
    patches = own.where("part_id % 3 = 0").select(*key, (F.col("quantity") + 1).alias("quantity"), F.lit("sneaked in").alias("source_kind"))
    out = review.patched(own, patches, key, ["quantity", "fab_hrs"], ["quantity", "unit_weight"])
    return out.groupBy("category").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 6).alias("weight"), F.sum("quantity").alias("quantity"))


@query(f"{L} SELECT opp_id, count(*) AS disputes, count(line_category) AS named FROM (SELECT opp_id, category AS line_category FROM (SELECT *, count(*) OVER (PARTITION BY opp_id, line_no) AS c FROM lines) WHERE quantity > 45 AND c = 1) GROUP BY 1")
def numbered_disputes(spark, sf):
    own = lines(spark, sf)
    once = own.groupBy("opp_id", "line_no").agg(F.count("*").alias("c")).where("c = 1").select("opp_id", "line_no")
    own = own.join(once, ["opp_id", "line_no"], "left_semi")
    told = own.select("opp_id", F.when(F.col("quantity") > 45, "error").otherwise("info").alias("severity"), F.lit("quantity").alias("category"), F.lit("large").alias("finding"), F.col("line_no").alias("related_line"))
    return review.disputes(told, own, "opp_id").groupBy("opp_id").agg(F.count("dispute").alias("disputes"), F.count("line_category").alias("named"))


@query(f"{O} SELECT customer_id, agency, last_contact FROM (SELECT c_custkey AS customer_id, c_name AS agency, max(created) AS last_contact FROM customer LEFT JOIN opportunities ON customer_id = c_custkey AND status = 'lost' GROUP BY 1, 2) ORDER BY last_contact DESC NULLS LAST, agency LIMIT 200")
def contacts_nulls_last(spark, sf):
    lost = opportunities(spark, sf).where("status = 'lost'").groupBy("customer_id").agg(F.max("created").alias("last_contact"))
    people = table(spark, sf, "customer").select(F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("agency"))
    return people.join(lost, "customer_id", "left").orderBy(F.desc_nulls_last("last_contact"), "agency").limit(200)


@query(f"{O} SELECT opp_id, deadline, CASE WHEN deadline <= {NOW} + INTERVAL 7 DAY THEN 'urgent' ELSE 'upcoming' END AS queue FROM opportunities WHERE status IN ('bidding', 'reviewing') AND deadline > {NOW} AND deadline <= {NOW} + INTERVAL 14 DAY ORDER BY deadline, opp_id LIMIT 20")
def upcoming_deadlines(spark, sf):
    days = lambda n: as_of() + F.expr(f"interval {n} days")
    soon = opportunities(spark, sf).where(F.col("status").isin("bidding", "reviewing") & (F.col("deadline") > as_of()) & (F.col("deadline") <= days(14)))
    return soon.select("opp_id", "deadline", F.when(F.col("deadline") <= days(7), "urgent").otherwise("upcoming").alias("queue")).orderBy("deadline", "opp_id").limit(20)


@query(f"{O} SELECT status, source, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(14,2))) AS DOUBLE) AS value FROM opportunities GROUP BY ROLLUP (status, source)")
def pipeline_rollup(spark, sf):
    return opportunities(spark, sf).rollup("status", "source").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(14,2)")).cast("double").alias("value"))


@query("SELECT quality, toxic, count(doc_id) AS n, count(*) FILTER (WHERE labelled) AS labelled FROM (SELECT d.doc_id, l.quality, l.toxic, l.doc_id IS NOT NULL AS labelled FROM documents d LEFT JOIN labels l USING (doc_id)) GROUP BY 1, 2")
def labelled_documents(spark, sf):
    labels = table(spark, sf, "labels").withColumn("labelled", F.lit(True))
    return table(spark, sf, "documents").select("doc_id").join(labels, "doc_id", "left").groupBy("quality", "toxic").agg(F.count("doc_id").alias("n"), F.count_if(F.coalesce("labelled", F.lit(False))).alias("labelled"))
