"""Sources: files of records, HTML tables, JSON and XML grids, and stored objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BAD = "_bad_record"


def json_records(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(good, bad): JSON objects of a schema, one a file; what cannot be read is a row of bad with its text and file, and stops nothing."""
    whole = T.StructType([*schema.fields, T.StructField(BAD, T.StringType())])
    raw = spark.read.option("wholetext", "true").text(path).select("value", F.col("_metadata.file_path").alias("file"))
    read = raw.withColumn("r", F.from_json("value", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}))
    broken = F.col(f"r.{BAD}").isNotNull() | F.col("r").isNull()
    return read.where(~broken).select("r.*", "file").drop(BAD), read.where(broken).select("file", F.col("value").alias("record"))


def _cells(row: Column, tag: str) -> Column:
    found = F.regexp_extract_all(row, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>"), F.lit(1))
    return F.transform(found, lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1"), r"<[^>]*>", " "), r"\s+", " ")))


def table_rows(pages: DataFrame, html: str = "html", least: int = 2) -> DataFrame:
    """pages with row_no and cells, a row for each row of a table that has so many cells of data and says more than that there is nothing."""
    rows = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))
    each = pages.select("*", F.posexplode(rows).alias("row_no", "__row")).withColumn("cells", _cells(F.col("__row"), "td")).drop("__row", html)
    return each.where((F.size("cells") >= least) & ~F.lower(F.array_join("cells", " ")).rlike(r"^\s*(none|no (open|current) (bids|items).*)?\s*$"))


def xml_grid(pages: DataFrame, xml: str = "xml", least: int = 5) -> DataFrame:
    """pages with id and cells of each <row id> of an XML grid that has so many <cell>s. Dates MM/DD/YYYY become YYYY-MM-DD."""
    rows = F.regexp_extract_all(F.col(xml), F.lit(r"(?is)<row\b[^>]*>.*?</row>"), F.lit(0))
    each = pages.select("*", F.explode(rows).alias("__row"))
    iso = lambda c: F.regexp_replace(c, r"^(\d{2})/(\d{2})/(\d{4})$", "$3-$1-$2")
    out = each.withColumns({"id": F.regexp_extract("__row", r'(?i)<row\b[^>]*\bid="([^"]*)"', 1), "cells": F.transform(_cells(F.col("__row"), "cell"), iso)})
    return out.where(F.size("cells") >= least).drop("__row", xml)


def json_grid(pages: DataFrame, body: str = "body") -> DataFrame:
    """pages with cells of each row of {"data": [[..], ..]}, without tags."""
    rows = F.from_json(F.get_json_object(body, "$.data"), "array<array<string>>")
    return pages.select("*", F.explode(rows).alias("__r")).withColumn("cells", F.transform("__r", lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]*>", " "), r"\s+", " ")))).drop("__r", body)


def objects(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """Stored objects with path, size, time and bytes; at most so many, by path."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found if most is None else found.orderBy("path").limit(most)


def attachment_candidates(df: DataFrame, links: str, source: str, login: tuple[str, ...] = ()) -> DataFrame:
    """A row for each link of a record, with whether its source asks for a login."""
    return df.withColumn("candidate", F.explode_outer(links)).withColumns({"auth_required": F.col(source).isin(*login) if login else F.lit(False), "reason": F.when(F.size(links) > 0, F.lit(None).cast("string")).otherwise(F.lit("no_links"))})


#: How long a subject and a description may be.
MOST_SUBJECT, MOST_DESCRIPTION = 300, 10_000
ITEM = "struct<MessageId:string,From:struct<Address:string,Name:string>,Subject:string,RawTextBody:string,RawHtmlBody:string,SentAtDate:string>"


def inbound_items(posts: DataFrame, body: str, received: Column) -> DataFrame:
    """message_id, title, description, sender and sender_name of the mail in posts of JSON {"items": [..]}, each message once.

    A message without text has that of its HTML; descriptions begin with who sent it
    and when, by default received, and are cut to MOST_DESCRIPTION characters. A
    message without id gets one from its contents. Of messages that share an id the
    least row stays. Posts that are no such JSON give nothing.
    """
    from sluice.functions.text import strip_html

    each = posts.select(F.explode(F.from_json(body, f"struct<items:array<{ITEM}>>")["items"]).alias("m"), received.cast("string").alias("__at"))
    plain = lambda c: F.coalesce(F.col(c), F.lit(""))
    text = F.coalesce(F.nullif(F.col("m.RawTextBody"), F.lit("")), strip_html(plain("m.RawHtmlBody")))
    head = F.concat(F.lit("From: "), plain("m.From.Name"), F.lit(" <"), plain("m.From.Address"), F.lit(">\nReceived: "), F.coalesce("m.SentAtDate", "__at"), F.lit("\n\n"))
    made = F.concat(F.lit("inbound-"), F.substring(F.sha2(F.to_json("m"), 256), 1, 16))
    subject = F.coalesce(F.nullif(F.col("m.Subject"), F.lit("")), F.lit("(no subject)"))
    rows = each.select(F.coalesce(F.nullif(F.col("m.MessageId"), F.lit("")), made).alias("message_id"), F.concat(F.lit("[forwarded] "), F.substring(subject, 1, MOST_SUBJECT)).alias("title"), F.substring(F.concat(head, text), 1, MOST_DESCRIPTION).alias("description"), plain("m.From.Address").alias("sender"), plain("m.From.Name").alias("sender_name"))
    one = rows.groupBy("message_id").agg(F.min(F.struct("title", "description", "sender", "sender_name")).alias("r"))
    return one.select("message_id", "r.*")
