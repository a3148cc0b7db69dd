"""Mail and notices sorted by ordered rules, as queries. Mail is conversations with an address and a subject, notices are orders.

The SQL names by hand what the texts at hand hold of the word lists.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators import sorting
from sluice.plans.intake import pick
from sluice.plans.relations import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


MAIL = {
    "conv_id": "conv_id",
    "turn": "turn",
    "sender": pick("conv_id * 3 + turn", "Bids@DemandStar.com", "someone@aol.com", "marketing@shop.example", "joe@oakconstruction.example", "clerk@county.example.us", "no-reply@procore.com", "friend@mail.example", None, "ann@hall.example.edu", "mail@docusign.example", "docusign.bids@trade.example"),
    "subject": pick("conv_id + turn * 5", "Invitation to bid, hall 4", "Save $20 now", "Password reset", "Steel stairs for the depot", "Hello", None, "RFQ 31", "Lunch on Friday", "Your order is on its way", "Weekly digest", "Fence of the yard", "Rfi: door 12", "Metallic paint"),
    "body": "concat(text, CASE WHEN conv_id % 6 = 1 THEN ' see the Addendum' WHEN conv_id % 13 = 2 THEN ' with a solicitation' ELSE '' END)",
    "files": "conv_id % 4",
    "bytes": "600 * (turn + 1)",
}
MAILS = f"WITH mail AS (SELECT {', '.join(f'{e} AS {n}' for n, e in MAIL.items())} FROM conversations)"


def mails(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").select(*(F.expr(e).alias(n) for n, e in MAIL.items()))
    names = F.when(F.col("files") > 0, F.sequence(F.lit(1), F.col("files").cast("int"))).otherwise(F.array().cast("array<int>"))
    return rows.withColumn("attachments", F.transform(names, lambda i: F.struct(F.concat(F.lit("plan-"), i).alias("name"), F.col("bytes").alias("size"))))


@query(rf"""{MAILS}, t AS (SELECT *, lower(coalesce(sender, '')) AS s, coalesce(subject, '') AS j, coalesce(subject, '') || ' ' || substr(coalesce(body, ''), 1, 2000) AS h FROM mail),
v AS (SELECT conv_id, turn, CASE
    WHEN regexp_matches(s, 'demandstar|procore') THEN 'bid known_portal'
    WHEN regexp_matches(s, '@aol\.com$|marketing@') OR (contains(s, 'docusign.') AND NOT regexp_matches(s, 'docusign\..*bid')) THEN 'spam spam_sender'
    WHEN regexp_matches(j, '(?i)\bsave\s+\$?\d+|password\s+reset|your\s+order|weekly\s+digest') THEN 'spam spam_subject'
    WHEN regexp_matches(h, '(?i)invitation\s+to\s+(bid|quote)|\brfp\b|\brfq\b|\bitb\b|\brfi\b|solicitation|addend(um|a)|procurement|tender|prequalif') THEN 'bid bid_keyword'
    WHEN regexp_matches(j, '(?i)\b(bid|steel|metal|stair|fence|canopy|weld)\b') THEN 'bid construction_subject'
    WHEN bytes > 1000 AND files >= 2 AND regexp_matches(split_part(s, '@', 2), '\.gov|\.us|\.edu|construction|builders') THEN 'bid attachments_from_industry_domain'
    ELSE 'unclear no_signal' END AS v,
  CASE WHEN contains(s, 'demandstar') THEN 'email-demandstar' WHEN contains(s, 'procore') THEN 'email-procore' ELSE 'email' END AS source FROM t)
SELECT conv_id, turn, split_part(v, ' ', 1) AS verdict, split_part(v, ' ', 2) AS reason, source FROM v""")
def mail_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return sorting.sort_mail(mails(spark, sf), "sender", "subject", "body", "attachments").select("conv_id", "turn", "verdict", "reason", "source")


K = "o_orderkey"
OFFERS = {
    "opp_id": K,
    "title": pick(f"{K} + o_custkey", "Handrail at the depot", "VALVE,GATE", "53--BEARING, ROLLER", "6515--GLOVES", "Gate attendant for a lake", "Sole source repair of a pump", "Works in Japan", "Campground hosts", "RFP #310001", "Software licences", "Towing service, city", "Bench of oak", None, "Chairs"),
    "description": pick(f"{K} + o_custkey % 5", "<b>plain</b> work", "For Germany <i>only</i>", None, "restricted to Acme (CAGE 12345)", "sources sought, then sole source", "Roofing of a hall", "<p>Ladder</p> of ten steps", "", "Notice of intent to award", "of wood"),
    "deadline": f"CASE WHEN {K} % 7 = 0 THEN NULL ELSE o_orderdate END",
    "country": pick(K, "USA", "US", None, "", "DEU", "usa", "us"),
}
NOW = "1993-06-17"


@query(rf"""WITH o AS (SELECT {', '.join(f'{e} AS {n}' for n, e in OFFERS.items())} FROM orders),
t AS (SELECT *, trim(coalesce(title, '')) AS n, lower(coalesce(title, '') || ' ' || regexp_replace(coalesce(description, ''), '<[^>]*>', '', 'g')) AS t FROM o),
b AS (SELECT *, CASE WHEN regexp_matches(t, 'handrail|ladder') THEN 'fabrication' WHEN contains(t, 'towing service') THEN 'salvage' END AS business,
  CASE WHEN deadline < TIMESTAMP '{NOW}' THEN 'expired'
    WHEN regexp_matches(n, '^[A-Z][A-Z ,\-/]{{3,}}$') AND length(n) < 40 THEN 'catalog_title'
    WHEN regexp_matches(n, '^\d{{2}}--') THEN 'supply_class_title'
    WHEN regexp_matches(n, '^\d{{4}}--') THEN 'class_code_title'
    WHEN contains(lower(n), 'gate attendant') THEN 'gate_attendant'
    WHEN (contains(t, 'sole source') AND NOT contains(t, 'sources sought')) OR contains(t, 'notice of intent to award') OR regexp_matches(t, 'restricted to .+ \(cage') THEN 'sole_source'
    WHEN regexp_matches(t, 'japan|germany') OR upper(coalesce(country, '')) NOT IN ('', 'US', 'USA') THEN 'overseas'
    WHEN contains(t, 'campground') THEN 'park_services'
    WHEN n = 'RFP #310001' THEN 'opaque_title'
    WHEN regexp_matches(t, 'software|roofing') THEN 'not_ours' END AS why FROM t)
SELECT CASE WHEN business IS NOT NULL THEN 'review' WHEN why IS NOT NULL THEN 'passed' ELSE 'open' END AS outcome, business, CASE WHEN business IS NULL THEN why END AS reason, count(*) AS n FROM b GROUP BY 1, 2, 3""")
def sorted_notices(spark: SparkSession, sf: str) -> DataFrame:
    offers = table(spark, sf, "orders").select(*(F.expr(e).alias(n) for n, e in OFFERS.items()))
    found = sorting.sort_notices(offers, F.lit(NOW).cast("timestamp_ntz"), title="title", description="description", deadline="deadline", country="country")
    return found.groupBy("outcome", "business", "reason").agg(F.count("*").alias("n"))
