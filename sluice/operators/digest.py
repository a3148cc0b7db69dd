"""A package of documents from its files and the items of its pages to one row, as a single plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.operators import documents, intake, layout, page_text


def package_digest(files: DataFrame, items: DataFrame, key: str, *, width: str, height: str) -> DataFrame:
    """key and what is known of each package.

    files: key, file, filename, hint, text, raster; items: those of the files' pages,
    with the page's width and height. Files are classified and their references read;
    sheets come from title blocks; sheets that are referred to and not there are
    missing, and missing_in_scope where their discipline is of interest; stage is how
    far the package has come; pounds are the least and the most that texts state;
    notes are codes that drawings explain. A package without a file is not there.
    """
    kind = documents.document_kind(F.col("filename"), F.col("hint"), F.col("text"), F.col("raster"))
    known = files.withColumn("kind", kind["kind"])
    read = known.withColumn("refs", layout.references(F.coalesce("text", F.lit("")), F.col("kind")))
    docs = read.select(key, "file", "filename", "kind", "raster", intake.relevance(F.col("kind"), F.col("refs.disciplines")).alias("relevance"), F.col("refs.sheets").alias("sheets"))
    of_file = files.select("file", key)
    drawn = page_text.sheet_identity(items, width, height).join(of_file, "file").select(key, "sheet")
    missing = layout.missing_sheets(docs.select(key, F.explode("sheets").alias("sheet")), drawn, key)
    in_scope = layout.discipline_of(F.col("sheet")).isin(*intake.SCOPE_DISCIPLINES)
    gaps = missing.groupBy(key).agg(F.array_sort(F.collect_set("sheet")).alias("missing"), F.count_if(in_scope).alias("missing_in_scope"))
    stages = documents.stage(known, key, "filename", "kind", "text")
    said = files.select(key, F.explode(layout.tonnages(F.col("text"))).alias("pounds")).groupBy(key).agg(F.min("pounds").alias("least_pounds"), F.max("pounds").alias("most_pounds"))
    drawings = known.where("kind = 'drawing'").select("file", key)
    notes = page_text.glossary(items.join(drawings, "file"), (key,)).groupBy(key).agg(F.count("*").alias("notes"))
    covered = drawn.groupBy(key).agg(F.array_sort(F.collect_set("sheet")).alias("covered"))
    whole = intake.package_summary(docs, key)
    for part in (stages, gaps, covered, said, notes):
        whole = whole.join(part, key, "left")
    none = F.array().cast("array<string>")
    return whole.withColumns({"missing": F.coalesce("missing", none), "covered": F.coalesce("covered", none), "missing_in_scope": F.coalesce("missing_in_scope", F.lit(0).cast("long")), "notes": F.coalesce("notes", F.lit(0).cast("long"))})
