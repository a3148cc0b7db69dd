"""Records from pages of many sites by a table of rules, and from JSON that pages carry.

A rule says how a site's rows look and which of them are none; it compiles to column
expressions, so all sites are read in one pass over the pages.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.text import strip_html

#: How many characters of a number or title an id has.
ID_CHARS = 40
#: Marks that names carry of what is no longer open.
STATES = ("AWARDED", "PENDING", "CLOSED")


@dataclass(frozen=True)
class Site:
    """How one site's records are read: host and row are patterns, the others tell rows that are no records."""

    host: str
    prefix: str
    agency: str
    row: str
    #: Titles of navigation and the like, and of what is closed; years that are over.
    noise: str = "$^"
    closed: str = r"(?i)\b(closed|awarded)\b"
    years: str = "$^"
    least: int = 10


def site_records(pages: DataFrame, sites: Sequence[Site], url: str = "url", html: str = "html") -> DataFrame:
    """id, prefix, agency, title, link and closes: a row for each record, the first in order of page and place where pages repeat it.

    The first site whose host fits a page's address counts; pages of no site give
    nothing. pages has page_id. Titles are the rows' text; closes is the first date
    MM/DD/YYYY in the row; rows with too short a title, noise, closed ones and those
    of years that are over are left out.
    """
    host = F.regexp_extract(F.lower(F.col(url)), r"//([^/?#]*)", 1)

    def of(value) -> Column:
        return F.coalesce(*(F.when(F.col("__site") == i, value(s)) for i, s in enumerate(sites)))

    which = F.coalesce(*(F.when(host.rlike(s.host), F.lit(i)) for i, s in enumerate(sites)))
    named = pages.where(F.col(html).isNotNull()).select("page_id", html, which.alias("__site")).where("__site is not null")
    rows = named.select("page_id", "__site", F.posexplode(of(lambda s: F.regexp_extract_all(F.col(html), F.lit(s.row), F.lit(0)))).alias("place", "__row"))
    read = rows.select("page_id", "place", "__site", "__row", strip_html(F.col("__row")).alias("title"))
    keep = of(lambda s: (F.length("title") >= s.least) & ~F.col("title").rlike(s.noise) & ~F.col("title").rlike(s.closed) & ~F.col("title").rlike(s.years))
    made = read.where(keep).select(
        F.concat(of(lambda s: F.lit(s.prefix)), F.lit("-"), F.substring(F.regexp_replace("title", "[^a-zA-Z0-9]", ""), 1, ID_CHARS)).alias("id"),
        F.struct("page_id", "place", of(lambda s: F.lit(s.prefix)).alias("prefix"), of(lambda s: F.lit(s.agency)).alias("agency"), "title", F.nullif(F.regexp_extract("__row", r'(?i)href="([^"]*)"', 1), F.lit("")).alias("link"), F.try_to_date(F.regexp_extract("title", r"(\d{1,2}/\d{1,2}/\d{4})", 1), "M/d/yyyy").alias("closes")).alias("r"),
    )
    return made.groupBy("id").agg(F.min("r").alias("r")).select("id", "r.prefix", "r.agency", "r.title", "r.link", "r.closes")


def page_projects(pages: DataFrame, name: str, html: str = "html") -> DataFrame:
    """page_id, title, status, city and state of the open projects in the JSON that a page's script assigns to name.

    The JSON is {"projects": [{"name", "location": {"city", "state"}}]}; the status
    stands at the end of a name, and goes from the title. Awarded and closed ones are
    left out, and pages without such JSON, or with what is none.
    """
    body = F.regexp_extract(html, rf"(?s){name}\s*=\s*(\{{.*?\}});\s*</script>", 1)
    kind = "struct<projects:array<struct<name:string,location:struct<city:string,state:string>>>>"
    each = pages.select("page_id", F.explode(F.from_json(body, kind)["projects"]).alias("p"))
    said = F.upper("p.name")
    status = F.coalesce(*(F.when(F.contains(said, F.lit(s)), F.lit(s.lower())) for s in STATES[::-1]), F.lit("open"))
    title = F.trim(F.regexp_replace("p.name", rf"(?i)\s*[-\x{{2013}}]\s*({'|'.join(STATES)}|CANCELLED)\s*(GC)?$", ""))
    return each.select("page_id", title.alias("title"), status.alias("status"), F.col("p.location.city").alias("city"), F.col("p.location.state").alias("state")).where("status not in ('awarded', 'closed')")
