"""Records read from pages by rules, grids and embedded JSON, as queries over pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.plans.relations import table
from sluice.sources import readers
from sluice.sources.sites import Site, page_projects, site_records

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


SITES = (
    Site(r"\.example\.net$", "NET", "Net town", r"(?is)<p>.*?</p>", noise=r"(?i)^the ", years=r"\b20(22|23)\b", least=40),
    Site(r"^blog\.|^news\.", "NEWS", "News town", r"(?is)<h1>.*?</h1>"),
    Site(r"\.example\.org$", "ORG", "Org town", r"(?is)<li><a [^>]*>[^<]*</a></li>", noise=r"(?i)^(and|that|with)", least=4),
)
DATED = "concat('<p>Gate ', page_id, ' closes 1', page_id % 2, '/0', 1 + page_id % 9, '/2031 at <b>noon</b> in the hall of the town</p><p>Fence ', page_id, ' of 2023, as was told in the hall of the town</p><p>Stair ', page_id, ' was awarded to those who came to the hall</p>', html)"


@query(rf"""WITH p AS (SELECT page_id, regexp_extract(lower(url), '//([^/?#]*)', 1) AS host, {DATED} AS html FROM pages WHERE html IS NOT NULL),
s AS (SELECT *, CASE WHEN regexp_matches(host, '\.example\.net$') THEN 0 WHEN regexp_matches(host, '^blog\.|^news\.') THEN 1 WHEN regexp_matches(host, '\.example\.org$') THEN 2 END AS site FROM p),
e AS (SELECT page_id, site, unnest(list_transform(l, lambda x, i: struct_pack(i := i, r := x))) AS u FROM (SELECT page_id, site, CASE site WHEN 0 THEN regexp_extract_all(html, '(?is)<p>.*?</p>') WHEN 1 THEN regexp_extract_all(html, '(?is)<h1>.*?</h1>') ELSE regexp_extract_all(html, '(?is)<li><a [^>]*>[^<]*</a></li>') END AS l FROM s WHERE site IS NOT NULL)),
t AS (SELECT page_id, site, u.i AS i, u.r AS r, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(u.r, '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '[ \t\r\n]+', ' ', 'g'), ' ') AS title FROM e),
k AS (SELECT * FROM t WHERE NOT regexp_matches(title, '(?i)\b(closed|awarded)\b') AND CASE site WHEN 0 THEN length(title) >= 40 AND NOT regexp_matches(title, '(?i)^the ') AND NOT regexp_matches(title, '\b20(22|23)\b') WHEN 1 THEN length(title) >= 10 ELSE length(title) >= 4 AND NOT regexp_matches(title, '(?i)^(and|that|with)') END),
d AS (SELECT CASE site WHEN 0 THEN 'NET' WHEN 1 THEN 'NEWS' ELSE 'ORG' END || '-' || left(regexp_replace(title, '[^a-zA-Z0-9]', '', 'g'), 40) AS id, * FROM k)
SELECT id, split_part(id, '-', 1) AS prefix, CASE site WHEN 0 THEN 'Net town' WHEN 1 THEN 'News town' ELSE 'Org town' END AS agency, title, nullif(regexp_extract(r, '(?i)href="([^"]*)"', 1), '') AS link, CAST(try_strptime(regexp_extract(title, '(\d{{1,2}}/\d{{1,2}}/\d{{4}})', 1), '%m/%d/%Y') AS DATE) AS closes
FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY page_id, i) = 1""")
def records_of_sites(spark: SparkSession, sf: str) -> DataFrame:
    return site_records(table(spark, sf, "pages").withColumn("html", F.expr(DATED)).where("html is not null"), SITES)


PROJECTS = """concat(html, '<script>site.page = {"projects": [{"name": "Hall ', page_id, ' - ', CASE page_id % 4 WHEN 0 THEN 'AWARDED' WHEN 1 THEN 'pending' WHEN 2 THEN 'Closed GC' ELSE 'phase 2' END, '", "location": {"city": "Town ', page_id % 7, '"}}, {"name": "Yard ', page_id, '"}]};</script>')"""


@query("""SELECT page_id, CASE page_id % 4 WHEN 1 THEN 'Hall ' || page_id ELSE 'Hall ' || page_id || ' - phase 2' END AS title, CASE page_id % 4 WHEN 1 THEN 'pending' ELSE 'open' END AS status, 'Town ' || page_id % 7 AS city FROM pages WHERE html IS NOT NULL AND page_id % 4 IN (1, 3)
UNION ALL SELECT page_id, 'Yard ' || page_id, 'open', NULL FROM pages WHERE html IS NOT NULL""")
def projects_of_pages(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "pages").where("html is not null").select("page_id", F.expr(PROJECTS).alias("html"))
    return page_projects(rows, r"site\.page").select("page_id", "title", "status", "city")


GRID = """concat('<rows><row id="', page_id, '"><cell><![CDATA[', page_id % 5, ' & more]]></cell><cell>0', 1 + page_id % 9, '/15/2031</cell><cell><b>x</b> y</cell><cell>d</cell><cell>', left(regexp_replace(html, '[^a-z ]', ''), 30), '</cell></row><row id="short"><cell>a</cell></row></rows>')"""


@query("""SELECT CAST(page_id AS VARCHAR) AS id, page_id % 5 || ' & more' AS name, '2031-0' || (1 + page_id % 9) || '-15' AS day, 'x y' AS kind, trim(regexp_replace(left(regexp_replace(html, '[^a-z ]', '', 'g'), 30), ' +', ' ', 'g'), ' ') AS said FROM pages WHERE html IS NOT NULL""")
def grid_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = readers.xml_grid(table(spark, sf, "pages").where("html is not null").select(F.expr(GRID).alias("xml")))
    return rows.select("id", *(F.get("cells", F.lit(i)).alias(n) for i, n in ((0, "name"), (1, "day"), (2, "kind"), (4, "said"))))


@query("""SELECT page_id, 'page ' || page_id AS name, trim(regexp_replace(left(regexp_replace(html, '[^a-z ]', '', 'g'), 25), ' +', ' ', 'g'), ' ') AS said FROM pages WHERE html IS NOT NULL""")
def json_rows(spark: SparkSession, sf: str) -> DataFrame:
    body = F.to_json(F.struct(F.array(F.array(F.concat(F.lit("<a href='#'>page "), "page_id", F.lit("</a>")), F.substring(F.regexp_replace("html", "[^a-z ]", ""), 1, 25))).alias("data")))
    rows = readers.json_grid(table(spark, sf, "pages").where("html is not null").select("page_id", body.alias("body")))
    return rows.select("page_id", F.get("cells", F.lit(0)).alias("name"), F.get("cells", F.lit(1)).alias("said"))


@query("""SELECT page_id, unnest(CASE WHEN len(l) > 0 THEN l ELSE [NULL] END) AS candidate, regexp_matches(url, '\\.net/') AS auth_required, CASE WHEN len(l) = 0 THEN 'no_links' END AS reason FROM (SELECT page_id, url, regexp_extract_all(html, '(?i)<a\\s[^>]*href="([^"]+)"', 1) AS l FROM pages WHERE html IS NOT NULL)""")
def attachment_links(spark: SparkSession, sf: str) -> DataFrame:
    from sluice.functions.text import links

    rows = table(spark, sf, "pages").where("html is not null").select("page_id", links(F.col("html")).alias("l"), F.when(F.col("url").rlike(r"\.net/"), "net").otherwise("other").alias("source"))
    return readers.attachment_candidates(rows, "l", "source", ("net",)).select("page_id", "candidate", "auth_required", "reason")
