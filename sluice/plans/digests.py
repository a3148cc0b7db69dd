"""Packages as a whole: digests from pages to one row, and manifests from several sources, as queries over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators import coverage, digest
from sluice.plans.kinds import FILES, KIND, WEIGHED, files
from sluice.plans.page_items import CLUSTERS, HEIGHT, ITEMS, SHEET, WIDTH, items
from sluice.plans.relations import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


SAID = "concat(text, ' see S', 101 + doc_id % 60, ', A-', 200 + doc_id % 7, ' and M2', doc_id % 10)"


@query(rf"""{FILES}, {ITEMS.removeprefix("WITH ")}, {WEIGHED},
b AS (SELECT * FROM items WHERE x >= 0.55 * {WIDTH} AND y >= 0.65 * {HEIGHT}){CLUSTERS.format(source="b")}
, l AS (SELECT file, page, regexp_extract(string_agg(str, ' ' ORDER BY item_idx), '{SHEET}') AS line FROM b GROUP BY 1, 2)
, h AS (SELECT file, page, arg_min(regexp_extract(token, '{SHEET}'), cluster) AS hit FROM t WHERE regexp_matches(token, '{SHEET}') GROUP BY 1, 2)
, sheets AS (SELECT DISTINCT file % 61 AS pkg, regexp_replace(coalesce(nullif(line, ''), hit), '[ -]', '', 'g') AS sheet FROM l LEFT JOIN h USING (file, page) WHERE line <> '' OR hit IS NOT NULL)
, x AS (SELECT *, CASE WHEN raster THEN '' ELSE lower({SAID}) END AS t, lower(filename) AS f, {SAID} AS said FROM files)
, k AS (SELECT *, {KIND} AS kind_now FROM x)
, r AS (SELECT doc_id, pkg, unnest(list_concat(list_transform(regexp_extract_all(said, '\b[A-Z0-9]{{1,3}}\s*/\s*[A-Z]{{1,3}}-?\d{{1,3}}(?:\.\d{{1,2}})?\b'), lambda x: replace(split_part(regexp_replace(x, '\s', '', 'g'), '/', 2), '-', '')),
    list_transform(regexp_extract_all(said, '\b(?:FP|FA|[ASMPECLTGID])-?\d{{3}}(?:\.\d{{1,2}})?\b'), lambda x: replace(x, '-', '')))) AS sheet FROM k WHERE kind_now <> 'specification')
, g AS (SELECT DISTINCT pkg, sheet FROM r WHERE sheet NOT IN ('A036', 'A123', 'A153', 'A307', 'A325', 'A490', 'A500', 'A529', 'A563', 'A572', 'A588', 'A615', 'A653', 'A706', 'A780', 'A847', 'A992', 'C150', 'C270', 'C476', 'E119', 'E330'))
, gaps AS (SELECT pkg, count(*) AS missing, count(*) FILTER (WHERE regexp_matches(sheet, '^[ASMP]\d')) AS missing_in_scope FROM g WHERE NOT EXISTS (SELECT 1 FROM sheets s WHERE s.pkg = g.pkg AND upper(s.sheet) = upper(g.sheet)) GROUP BY 1)
, cover AS (SELECT pkg, count(*) AS covered FROM sheets GROUP BY 1)
, e AS (SELECT pkg, unnest(said) AS pounds FROM w), p AS (SELECT pkg, min(pounds) AS least_pounds, max(pounds) AS most_pounds FROM e GROUP BY 1)
, d AS (SELECT pkg, count(*) AS total_documents, count(*) FILTER (WHERE kind_now = 'drawing') AS drawings, count(*) FILTER (WHERE kind_now = 'specification') AS specs, count(*) FILTER (WHERE kind_now = 'qa_log') AS qa_logs, count(*) FILTER (WHERE kind_now = 'raster_scan') AS raster_only FROM k GROUP BY 1)
SELECT pkg, total_documents, drawings, specs, qa_logs, raster_only, coalesce(covered, 0) AS covered, coalesce(missing, 0) AS missing, coalesce(missing_in_scope, 0) AS missing_in_scope, least_pounds, most_pounds
FROM d LEFT JOIN gaps USING (pkg) LEFT JOIN cover USING (pkg) LEFT JOIN p USING (pkg)""")
def package_digests(spark: SparkSession, sf: str) -> DataFrame:
    given = files(spark, sf).drop("kind").withColumn("text", F.expr(SAID)).withColumn("file", F.col("doc_id"))
    placed = items(spark, sf).withColumns({"page_width": F.lit(WIDTH), "page_height": F.lit(HEIGHT)})
    found = digest.package_digest(given, placed, "pkg", width="page_width", height="page_height")
    return found.select("pkg", "total_documents", "drawings", "specs", "qa_logs", "raster_only", F.size("covered").cast("long").alias("covered"), F.size("missing").cast("long").alias("missing"), "missing_in_scope", "least_pounds", "most_pounds")


CODES = ("05 12 00", "055000", "05-51-00", "05.52.00", "081113", "09 29 00", "23 31 00", "14 20 00")
CODE = "CASE doc_id * 7 % 8 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CODES)) + " END"
ROWS = f"""SELECT doc_id % 61 AS pkg, {CODE} AS code, CASE WHEN (doc_id * 7 % 8 + doc_id % 3) % 3 = 0 THEN NULL ELSE concat('Title ', doc_id) END AS title, CASE WHEN doc_id * 7 % 8 = doc_id % 3 THEN NULL ELSE doc_id % 30 END AS page, doc_id % 3 AS source,
  concat(CASE doc_id % 5 WHEN 0 THEN 'S-' WHEN 1 THEN 'a' WHEN 2 THEN 'E' WHEN 3 THEN 'C ' ELSE 'Q' END, 100 + doc_id % 12) AS sheet, CAST(doc_id % 200 AS INT) AS items, doc_id % 7 = 0 AS raster, CASE doc_id % 4 WHEN 0 THEN 'door' WHEN 1 THEN 'window' WHEN 2 THEN 'finish' ELSE 'louver' END AS schedule FROM """


@query(rf"""WITH r AS ({ROWS} documents), n AS (SELECT *, regexp_replace(code, '[^0-9]', '', 'g') AS d FROM r),
o AS (SELECT pkg, source, left(d, 2) || ' ' || substr(d, 3, 2) || ' ' || substr(d, 5, 2) AS ref, min(struct_pack(title := title, page := page)) AS x FROM n GROUP BY 1, 2, 3),
s AS (SELECT pkg, ref, min(source) + 1 AS source, arg_min(x.title, source) FILTER (WHERE x.title IS NOT NULL) AS title, arg_min(x.page, source) FILTER (WHERE x.page IS NOT NULL) AS page FROM o GROUP BY 1, 2),
h AS (SELECT pkg, upper(regexp_replace(sheet, '[ -]', '', 'g')) AS ref, source % 2 AS source, min(struct_pack(i := items, r := raster)) AS x FROM r GROUP BY 1, 2, 3),
i AS (SELECT pkg, ref, min(source) + 1 AS source, arg_min(x.i, source) AS items, arg_min(x.r, source) AS raster FROM h GROUP BY 1, 2),
a AS (SELECT pkg, 'section' AS kind, ref, CASE WHEN ref IN ('05 12 00', '05 50 00', '05 51 00', '05 52 00', '08 11 13') THEN 'included' WHEN ref = '09 29 00' THEN 'excluded' WHEN ref = '23 31 00' THEN 'n_a' ELSE 'judgment' END AS tag, false AS vision, title, page, source FROM s
  UNION ALL SELECT pkg, 'sheet', ref, CASE left(ref, 1) WHEN 'S' THEN 'included' WHEN 'A' THEN 'included' WHEN 'E' THEN 'excluded' ELSE 'judgment' END, CASE WHEN left(ref, 1) IN ('S', 'A') THEN items < 80 OR raster ELSE left(ref, 1) <> 'E' END, NULL, NULL, source FROM i
  UNION ALL SELECT DISTINCT pkg, 'schedule', schedule, CASE schedule WHEN 'door' THEN 'included' WHEN 'window' THEN 'excluded' WHEN 'finish' THEN 'n_a' ELSE 'judgment' END, false, NULL, NULL, NULL FROM r)
SELECT pkg, kind, ref, tag, vision AS needs_vision, tag = 'judgment' OR vision AS unresolved, title, CAST(page AS BIGINT) AS page, CAST(source AS INTEGER) AS source FROM a""")
def source_manifest(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.sql(ROWS + "{documents}", documents=table(spark, sf, "documents"))
    sections = [rows.where(F.col("source") == i).select("pkg", "code", "title", F.col("page").cast("long").alias("page")) for i in range(3)]
    sheets = [rows.where(F.col("source") % 2 == i).select("pkg", "sheet", "items", "raster") for i in range(2)]
    return coverage.package_manifest(sections, sheets, rows.select("pkg", "schedule"), "pkg")
