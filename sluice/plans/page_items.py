"""Queries over items of pages, which are the words of documents set in lines.

The words of a text fill pages of 15 lines of 8 words. Some lines begin with the
code of a note, and the title block of some pages names a sheet, whole or glyph by
glyph. Both expressions below are read by Spark and by DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators import page_text
from sluice.plans.relations import dealt

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
WIDTH, HEIGHT = 600.0, 320.0


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def div(a: str, b: int) -> str:
    return f"CAST(floor(({a}) / {b}.0) AS BIGINT)"


K = "(i % 120)"
LINE, COL = div("i % 120", 8), "(i % 8)"
GLYPH = f"({LINE} = 12 AND {COL} >= 5 AND doc_id % 3 = 1)"
ITEM = {
    "file": "doc_id",
    "page": f"{div('i', 120)} + 1",
    "item_idx": K,
    "str": f"""CASE WHEN {COL} = 0 AND {LINE} % 2 = 1 THEN concat('A', doc_id % 9, '.', {LINE})
                    WHEN {LINE} = 12 AND {COL} = 6 AND doc_id % 3 = 0 THEN concat('S-', 100 + doc_id % 50)
                    WHEN {GLYPH} THEN CASE {COL} WHEN 5 THEN 'M-' WHEN 6 THEN '2' ELSE CAST(doc_id % 10 AS VARCHAR(2)) END
                    ELSE w END""",
    "x": f"CAST(CASE WHEN {GLYPH} THEN 335 + 7 * ({COL} - 5) ELSE 70 * {COL} + (doc_id * 7 + i) % 5 END AS DOUBLE)",
    "y": f"CAST(20 * {LINE} + CASE WHEN {GLYPH} THEN 0 ELSE (i * 3 + doc_id) % 4 END AS DOUBLE)",
    "width": f"CAST(CASE WHEN {GLYPH} THEN 6 ELSE 6 * length(w) END AS DOUBLE)",
    "font_size": "CASE WHEN i % 11 = 0 THEN NULL ELSE CAST(8 + i % 7 AS DOUBLE) END",
}
COLUMNS = ", ".join(f"{e} AS {n}" for n, e in ITEM.items())
ITEMS = rf"""WITH words AS (
  SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i
  FROM (SELECT doc_id, string_split(trim(regexp_replace(text, '[\x20\x09-\x0D]+', ' ', 'g'), ' '), ' ') AS ws FROM documents WHERE text IS NOT NULL) WHERE ws <> ['']
), items AS (SELECT {COLUMNS} FROM words)"""


def items(spark: SparkSession, sf: str) -> DataFrame:
    plain = F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " "))
    # texts are dealt, not their words, which are many times as large: files and pages need no further shuffle
    words = dealt(spark, sf, "documents", "doc_id", columns=("doc_id", "text")).where(plain != "").select("doc_id", F.posexplode(F.split(plain, " ")).alias("i", "w"))
    return words.select(*(F.expr(e).alias(n) for n, e in ITEM.items()))


CLUSTERS = """, m AS (
  SELECT *, CASE WHEN abs(y - lag(y) OVER o) <= 4 AND x - (lag(x) OVER o + lag(width) OVER o) <= greatest(8, coalesce(lag(font_size) OVER o, 12)) THEN 0 ELSE 1 END AS b
  FROM {source} WINDOW o AS (PARTITION BY file, page ORDER BY y, x, item_idx)
), c AS (
  SELECT *, sum(b) OVER (PARTITION BY file, page ORDER BY y, x, item_idx ROWS UNBOUNDED PRECEDING) AS cluster FROM m
), t AS (
  SELECT file, page, cluster, trim(string_agg(str, '' ORDER BY y, x, item_idx), ' ') AS token, count(*) AS parts FROM c GROUP BY 1, 2, 3
)"""
SHEET = r"\b(?:FP|FA|A|S|M|P|E|C|L|T|G|I|D)[- ]?\d{1,3}(?:\.\d{1,2})?\b"


@query(f"""{ITEMS}{CLUSTERS.format(source="items")}
SELECT file, page, count(*) AS tokens, count(*) FILTER (WHERE parts > 1) AS joined, md5(string_agg(token, '|' ORDER BY cluster)) AS digest FROM t GROUP BY 1, 2""")
def clustered_tokens(spark: SparkSession, sf: str) -> DataFrame:
    tokens = page_text.clusters(items(spark, sf))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cluster", "token"))), lambda t: t["token"]), "|")
    return tokens.groupBy("file", "page").agg(F.count("*").alias("tokens"), F.count_if(F.col("parts") > 1).alias("joined"), F.md5(text.cast("binary")).alias("digest"))


@query(f"""{ITEMS}, b AS (SELECT * FROM items WHERE x >= 0.55 * {WIDTH} AND y >= 0.65 * {HEIGHT}){CLUSTERS.format(source="b")}
, l AS (SELECT file, page, regexp_extract(string_agg(str, ' ' ORDER BY item_idx), '{SHEET}') AS line FROM b GROUP BY 1, 2)
, h AS (SELECT file, page, arg_min(regexp_extract(token, '{SHEET}'), cluster) AS hit FROM t WHERE regexp_matches(token, '{SHEET}') GROUP BY 1, 2)
SELECT file, page, regexp_replace(coalesce(nullif(line, ''), hit), '[ -]', '', 'g') AS sheet, CASE WHEN line <> '' THEN 'line' ELSE 'cluster' END AS found_in
FROM l LEFT JOIN h USING (file, page) WHERE line <> '' OR hit IS NOT NULL""")
def sheets_of_pages(spark: SparkSession, sf: str) -> DataFrame:
    placed = items(spark, sf).withColumns({"page_width": F.lit(WIDTH), "page_height": F.lit(HEIGHT)})
    return page_text.sheet_identity(placed, "page_width", "page_height")


NOTES = rf"""{ITEMS}, m AS (
  SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY file, page ORDER BY y, x, item_idx) > 8 THEN 1 ELSE 0 END AS b FROM items
), r AS (
  SELECT *, sum(b) OVER (PARTITION BY file, page ORDER BY y, x, item_idx ROWS UNBOUNDED PRECEDING) AS row_no FROM m
), n AS (
  SELECT file, page, row_no, arg_min(str, struct_pack(x := x, i := item_idx)) AS code, string_agg(str, ' ' ORDER BY x, item_idx) AS whole FROM r GROUP BY 1, 2, 3 HAVING count(*) > 1
), g AS (
  SELECT file, page, row_no, code, trim(substr(whole, length(code) + 2), ' ') AS description FROM n WHERE regexp_full_match(code, '[A-Z]\d+\.\d+')
), glossary AS (
  SELECT file, code, arg_min(description, struct_pack(p := page, r := row_no)) AS description, min(page) AS page FROM g WHERE length(description) >= 10 GROUP BY 1, 2
)"""


@query(f"{NOTES} SELECT file, code, description, page FROM glossary")
def note_glossary(spark: SparkSession, sf: str) -> DataFrame:
    return page_text.glossary(items(spark, sf))


@query(rf"""{NOTES}, q AS (SELECT file, page, string_agg(str, ' ' ORDER BY item_idx) AS said FROM items GROUP BY 1, 2),
c AS (SELECT DISTINCT file, page, unnest(regexp_extract_all(said, '\b([A-Z]\d+\.\d+)\b', 1)) AS code FROM q)
SELECT file, c.page, count(*) AS codes, count(glossary.code) AS explained, coalesce(sum(length(description)), 0)::BIGINT AS characters FROM c LEFT JOIN glossary USING (file, code) GROUP BY 1, 2""")
def explained_codes(spark: SparkSession, sf: str) -> DataFrame:
    rows = items(spark, sf)
    said = rows.groupBy("file", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_idx", "str"))), lambda s: s["str"]), " ").alias("said"))
    named = said.select("file", "page", F.size(F.array_distinct(F.regexp_extract_all("said", F.lit(rf"\b({page_text.NOTE_CODE})\b"), F.lit(1)))).cast("long").alias("codes")).where("codes > 0")
    counts = page_text.resolved(said, "said", page_text.glossary(rows)).groupBy("file", "page").agg(F.count("*").alias("explained"), F.sum(F.length("description")).alias("characters"))
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("explained", "characters")]
    return named.join(counts, ["file", "page"], "left").select("file", "page", "codes", *zero)
