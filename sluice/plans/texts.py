"""What texts say, as queries over documents, pages, orders and order lines.

Where a text is built from columns, the SQL works out what it must give from those
columns; where it is a document's or a page's, the SQL reads it in its own way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions import dates, money, text
from sluice.operators import documents, layout, review
from sluice.plans.kinds import FILES, files
from sluice.plans.relations import table
from sluice.sources import sinks

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


MARKED = "concat(' “', coalesce(text, ''), '” – it’s  ', doc_id, ' <x', doc_id % 7, '@mail.example.org> ')"
SIGNS = "'‘’“”–— ', '''''\"\"-- '"


@query(f"""WITH e AS (SELECT doc_id, list_sort(list_distinct(regexp_extract_all(lower({MARKED}), '[a-z0-9_.+-]+@[a-z0-9-]+(?:\\.[a-z0-9-]+)+'))) AS found FROM documents)
SELECT doc_id, CAST(len(found) AS INTEGER) AS n, array_to_string(found, '|') AS addresses FROM e""")
def found_emails(spark: SparkSession, sf: str) -> DataFrame:
    found = table(spark, sf, "documents").select("doc_id", F.array_sort(text.emails(F.expr(MARKED))).alias("found"))
    return found.select("doc_id", F.size("found").alias("n"), F.array_join("found", "|").alias("addresses"))


@query(f"SELECT doc_id, md5(regexp_replace(translate({MARKED}, {SIGNS}), '[^\\x00-\\x7F]', '', 'g')) AS digest FROM documents")
def ascii_texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.md5(text.ascii_only(F.expr(MARKED)).cast("binary")).alias("digest"))


@query(f"SELECT doc_id, md5(trim(regexp_replace(lower(translate({MARKED}, {SIGNS})), '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' ')) AS digest FROM documents")
def plain_quotes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.md5(text.plain_punctuation(F.expr(MARKED)).cast("binary")).alias("digest"))


@query("SELECT doc_id, CASE WHEN length(text) > 60 THEN left(text, 57) || '...' ELSE text END AS shown FROM documents WHERE text IS NOT NULL")
def cut_texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("text is not null").select("doc_id", text.truncated(F.col("text"), 60).alias("shown"))


@query("""SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) AS digest FROM pages WHERE html IS NOT NULL""")
def escaped_texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").where("html is not null").select("page_id", F.md5(text.escape_html(F.col("html")).cast("binary")).alias("digest"))


NOTICE = "concat('Scope: page ', page_id, '<br/>', html, '<br>Due Date : May &amp; June')"


@query(rf"""WITH a AS (SELECT page_id, regexp_replace({NOTICE}, '(?i)<br[ \t\r\n\f\v]*/?>', chr(10), 'g') AS t FROM pages WHERE html IS NOT NULL),
b AS (SELECT page_id, regexp_replace(regexp_replace(t, '<[^>]+>', '', 'g'), '&[a-z]+;', ' ', 'g') AS t FROM a),
c AS (SELECT page_id, regexp_replace(t, '[ \t\r\n\f\v]*\b(Due Date|Scope|Date)[ \t\r\n\f\v]*:[ \t\r\n\f\v]*', chr(10) || chr(10) || '\1: ', 'g') AS t FROM b)
SELECT page_id, md5(regexp_replace(regexp_replace(t, '\n{{3,}}', chr(10) || chr(10), 'g'), '^[ \t\r\n\f\v]+|[ \t\r\n\f\v]+$', '', 'g')) AS digest FROM c""")
def reflowed_texts(spark: SparkSession, sf: str) -> DataFrame:
    found = documents.reflowed(F.expr(NOTICE), ("Due Date", "Scope", "Date"))
    return table(spark, sf, "pages").where("html is not null").select("page_id", F.md5(found.cast("binary")).alias("digest"))


@query(r"""WITH f AS (SELECT page_id, regexp_extract(url, '[^/]*$') || '_rev-' || page_id % 5 || '.pdf' AS f FROM pages)
SELECT page_id, trim(regexp_replace(left(f, length(f) - 4), '[_-]+', ' ', 'g'), ' ') AS title FROM f""")
def file_titles(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat(F.regexp_extract("url", "[^/]*$", 0), F.lit("_rev-"), F.col("page_id") % 5, F.lit(".pdf"))
    return table(spark, sf, "pages").select("page_id", text.title_of(name).alias("title"))


@query(r"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(coalesce(text, '') || ' Painting ' || doc_id || ' is by others; All welds are included.', '([.;\n])[ \t\r\n\f\v]+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ')), lambda x: length(x) >= 12) AS parts FROM documents)
SELECT doc_id, CAST(len(parts) AS INTEGER) AS sentences, CAST(len(list_filter(parts, lambda x: regexp_matches(x, '(?i)\b(not included|excluded?|by others|exclusion)\b'))) AS INTEGER) AS left_out, md5(array_to_string(parts, '|')) AS digest FROM s""")
def scope_parts(spark: SparkSession, sf: str) -> DataFrame:
    said = F.expr("concat(coalesce(text, ''), ' Painting ', doc_id, ' is by others; All welds are included.')")
    found = table(spark, sf, "documents").select("doc_id", documents.scope_sentences(said).alias("s"))
    return found.select("doc_id", F.size("s").alias("sentences"), F.size(F.filter("s", lambda x: ~x["included"])).alias("left_out"), F.md5(F.array_join(F.transform("s", lambda x: x["text"]), "|").cast("binary")).alias("digest"))


REFERRED = "concat(text, ' see 3/A-', 100 + doc_id % 50, ' and S', 200 + doc_id % 90, '.1, ASTM A', 300 + doc_id % 40, ', A572, A', 120 + doc_id % 5, '/A123M, FP-', 101 + doc_id % 3, ', Q', 400 + doc_id % 9, ', 05 ', 10 + doc_id % 80, ' 00')"


@query(rf"""{FILES}, r AS (SELECT doc_id, kind, {REFERRED} AS t FROM files),
p AS (SELECT *, regexp_replace(regexp_replace(t, '\b(ASTM|AISI|AWS|AISC|ANSI)[ \t\r\n\f\v]{{1,8}}(FP|FA|[ASMPECLTGID])-?\d\d\d(\.\d\d?)?\b', ' ~ ', 'g'), '\b(FP|FA|[ASMPECLTGID])-?\d\d\d(\.\d\d?)?\s*/\s*A\d{{2,4}}M\b', ' ~ ', 'g') AS plain FROM r),
q AS (SELECT doc_id, kind, t, list_transform(regexp_extract_all(t, '\b[A-Z0-9]{{1,3}}\s*/\s*[A-Z]{{1,3}}-?\d{{1,3}}(?:\.\d{{1,2}})?\b'), lambda x: regexp_replace(x, '[\s-]', '', 'g')) AS callouts,
  list_filter(list_transform(regexp_extract_all(plain, '\b(?:FP|FA|[ASMPECLTGID])-?\d{{3}}(?:\.\d{{1,2}})?\b'), lambda x: replace(x, '-', '')), lambda x: x NOT IN ('A036', 'A123', 'A153', 'A307', 'A325', 'A490', 'A500', 'A529', 'A563', 'A572', 'A588', 'A615', 'A653', 'A706', 'A780', 'A847', 'A992', 'C150', 'C270', 'C476', 'E119', 'E330')) AS bare FROM p)
SELECT doc_id, CASE WHEN kind = 'specification' THEN '' ELSE array_to_string(list_sort(list_distinct(callouts)), '|') END AS callouts,
  CASE WHEN kind = 'specification' THEN '' ELSE array_to_string(list_sort(list_distinct(list_concat(bare, list_transform(callouts, lambda x: split_part(x, '/', 2))))), '|') END AS sheets,
  array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(t, '\b\d\d\s+\d\d\s+\d\d\b'), lambda x: regexp_replace(x, '\s+', ' ', 'g')))), '|') AS sections FROM q""".replace("FROM q", "FROM q"))
def referenced_sheets(spark: SparkSession, sf: str) -> DataFrame:
    found = files(spark, sf).select("doc_id", layout.references(F.expr(REFERRED), F.col("kind")).alias("r"))
    return found.select("doc_id", *(F.array_join(F.col("r")[c], "|").alias(c) for c in ("callouts", "sheets", "sections")))


DUE = "CASE o_orderkey % 5 WHEN 0 THEN concat('Bids due by ', {m}, '/', {d}, '/', {y}, ' noon') WHEN 1 THEN concat('opened 1/1/1990. Deadline: ', CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10))) WHEN 2 THEN concat('posted ', {m}, '/', {d}, '/', {y}) WHEN 3 THEN concat('Closing on ', {name}, ' ', {d}, ', ', {y}) ELSE concat('no later than the day ', {d}) END"
PARTS = {"m": "month(o_orderdate)", "d": "day(o_orderdate)", "y": "year(o_orderdate)"}


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 IN (0, 1, 3) THEN CAST(o_orderdate AS DATE) END AS due FROM orders")
def guessed_deadlines(spark: SparkSession, sf: str) -> DataFrame:
    said = DUE.format(**PARTS, name="date_format(o_orderdate, 'MMMM')")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), documents.deadline_guess(F.expr(said)).alias("due"))


@query("""SELECT l_orderkey AS k, l_linenumber AS line, lpad(CAST(l_partkey % 50 AS VARCHAR), 2, '0') || ' ' || lpad(CAST(l_suppkey % 90 AS VARCHAR), 2, '0') || ' 00' || CASE WHEN l_linenumber % 2 = 0 THEN '|' || lpad(CAST(l_suppkey % 40 AS VARCHAR), 2, '0') || ' 12 13' ELSE '' END AS codes FROM lineitem""")
def section_codes(spark: SparkSession, sf: str) -> DataFrame:
    said = F.expr("concat('SECTION ', lpad(l_partkey % 50, 2, '0'), ' ', lpad(l_suppkey % 90, 2, '0'), ' 00 and ', if(l_linenumber % 2 = 0, concat('Document ', lpad(l_suppkey % 40, 2, '0'), '1213'), 'then'), ', 01 02 03 alone')")
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), F.array_join(layout.section_headers(said), "|").alias("codes"))


@query("""SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 3 THEN 'none' WHEN 2 THEN 'date' ELSE 'number' END AS kind,
CASE o_orderkey % 4 WHEN 0 THEN CAST(o_custkey % 30 AS VARCHAR) WHEN 1 THEN CAST(o_custkey % 7 AS VARCHAR) WHEN 2 THEN month(o_orderdate) || '/' || day(o_orderdate) || '/' || year(o_orderdate) ELSE '' END AS value FROM orders""")
def revisions(spark: SparkSession, sf: str) -> DataFrame:
    said = F.expr("case o_orderkey % 4 when 0 then concat('REV. ', o_custkey % 30, ' of ', month(o_orderdate), '/1/2024') when 1 then concat('plans, Addendum #', o_custkey % 7) when 2 then concat('issued ', month(o_orderdate), '/', day(o_orderdate), '/', year(o_orderdate)) else concat('as bid ', o_custkey) end")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), layout.revision(said).alias("r")).select("k", "r.kind", "r.value")


@query("""WITH s AS (SELECT CASE l_partkey % 8 WHEN 0 THEN 'S' WHEN 1 THEN 'a' WHEN 2 THEN 'FP' WHEN 3 THEN 'E' WHEN 4 THEN 'X' WHEN 5 THEN 'D' WHEN 6 THEN 'FA' ELSE 'G' END AS p FROM lineitem)
SELECT CASE p WHEN 'S' THEN 'structural' WHEN 'a' THEN 'architectural' WHEN 'FP' THEN 'fire_protection' WHEN 'E' THEN 'electrical' WHEN 'D' THEN 'demolition' WHEN 'FA' THEN 'fire_alarm' WHEN 'G' THEN 'general' ELSE 'other' END AS discipline, count(*) AS n FROM s GROUP BY 1""")
def sheet_disciplines(spark: SparkSession, sf: str) -> DataFrame:
    sheet = F.expr("concat(case l_partkey % 8 when 0 then 'S' when 1 then 'a' when 2 then 'FP' when 3 then 'E' when 4 then 'X' when 5 then 'D' when 6 then 'FA' else 'G' end, '-', l_suppkey)")
    return table(spark, sf, "lineitem").groupBy(layout.discipline_of(sheet).alias("discipline")).agg(F.count("*").alias("n"))


@query("""SELECT c_custkey AS k, CASE c_custkey % 7 WHEN 0 THEN n_name || ', ' || c_mktsegment WHEN 1 THEN n_name || ', ST' WHEN 2 THEN c_mktsegment WHEN 3 THEN n_name || ', ST, USA' WHEN 4 THEN 'Office ' || c_nationkey || ', US' WHEN 5 THEN 'S' || c_nationkey END AS place FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def payload_places(spark: SparkSession, sf: str) -> DataFrame:
    raw = """case c_custkey % 7 when 0 then concat('{"placeOfPerformance": {"city": {"name": "', n_name, '"}, "state": {"code": "', c_mktsegment, '"}}}') when 1 then concat('{"officeAddress": {"city": "', n_name, '", "state": "ST"}}')
      when 2 then concat('{"placeOfPerformance": {"state": {"code": "', c_mktsegment, '"}}}') when 3 then concat('{"placeOfPerformance": [{"city": "', n_name, '", "state": "ST", "country": "USA"}, {"city": "other"}]}')
      when 4 then concat('{"placeOfPerformance": {"city": "late"}, "organizationHierarchy": [{"name": "x"}, {"address": {"city": "Office ', c_nationkey, '", "country": "US"}}]}') when 5 then concat('{"Place of Performance State Code": "S', c_nationkey, '"}') else concat('{"title": "', c_name, '"}') end"""
    named = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return named.select(F.col("c_custkey").alias("k"), documents.place_of(F.expr(raw)).alias("place"))


@query("""SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 < 3 THEN 'Firm ' || o_custkey END AS name, CASE o_orderkey % 4 WHEN 0 THEN 1000.0 + o_custkey WHEN 1 THEN NULL WHEN 2 THEN nullif(CAST(o_custkey AS DOUBLE), 0) END AS amount FROM orders""")
def payload_awards(spark: SparkSession, sf: str) -> DataFrame:
    raw = """case o_orderkey % 4 when 0 then concat('{"award": {"awardee": {"name": "Firm ', o_custkey, '"}, "amount": "$', format_number(1000 + o_custkey, 2), '"}}') when 1 then concat('{"awardee": "Firm ', o_custkey, '", "amount": "0"}')
      when 2 then concat('{"award": {"awardee": "Firm ', o_custkey, '", "value": ', o_custkey, '}}') else concat('{"n": ', o_custkey, '}') end"""
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), documents.award(F.expr(raw)).alias("a")).select("k", "a.*")


@query("SELECT o_orderkey % 5 AS steps, o_custkey % 4 AS errors, CASE WHEN o_custkey % 4 = 0 THEN 'ok' WHEN o_custkey % 4 >= o_orderkey % 5 THEN 'failed' ELSE 'partial' END AS status, count(*) AS n FROM orders GROUP BY 1, 2, 3")
def run_states(spark: SparkSession, sf: str) -> DataFrame:
    some = lambda n: F.filter(F.sequence(F.lit(0), n.cast("int")), lambda x: x > 0)
    runs = table(spark, sf, "orders").select((F.col("o_orderkey") % 5).alias("steps"), (F.col("o_custkey") % 4).alias("errors"))
    made = runs.withColumns({"s": some(F.col("steps")), "e": some(F.col("errors"))})
    return made.groupBy("steps", "errors", sinks.run_status("s", "e").alias("status")).agg(F.count("*").alias("n"))


@query("SELECT CASE l_linenumber % 4 WHEN 0 THEN 'low' WHEN 2 THEN 'high' ELSE 'expected' END AS scenario, count(*) AS n FROM lineitem GROUP BY 1")
def approved_scenarios(spark: SparkSession, sf: str) -> DataFrame:
    price, kind = F.col("l_extendedprice"), F.col("l_linenumber") % 4
    approved = F.when(kind == 0, price * 0.85).when(kind == 1, price).when(kind == 2, price * 1.25).otherwise(price * 2)
    snapshots = {"low": price * 0.85, "expected": price, "high": price * 1.25}
    return table(spark, sf, "lineitem").groupBy(review.approved_scenario(approved, snapshots).alias("scenario")).agg(F.count("*").alias("n"))


@query("SELECT event_id, dayofweek(ts - INTERVAL 6 HOUR) = 5 AS friday FROM events WHERE ts < TIMESTAMP '2024-03-01'")
def friday_gates(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").where("ts < timestamp_ntz'2024-03-01'").select("event_id", dates.is_friday(F.col("ts").cast("timestamp")).alias("friday"))


@query(r"""WITH r AS (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, '') || CASE WHEN doc_id % 3 < 2 THEN ' from $' || doc_id || ',500.25 to $ 12' ELSE '' END, '\$\s*([0-9][0-9,]*(?:\.[0-9]+)?)', 1), lambda x: CAST(replace(x, ',', '') AS DOUBLE)) AS v FROM documents)
SELECT doc_id, list_min(v) AS low, list_max(v) AS high FROM r""")
def dollar_ranges(spark: SparkSession, sf: str) -> DataFrame:
    said = F.expr("concat(coalesce(text, ''), if(doc_id % 3 < 2, concat(' from $', doc_id, ',500.25 to $ 12'), ''))")
    return table(spark, sf, "documents").select("doc_id", money.dollar_range(said).alias("r")).select("doc_id", "r.*")
