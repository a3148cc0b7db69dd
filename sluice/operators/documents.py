"""Classes, stages, references and text of documents and messages."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Categories of files by their name in lower case, the first that fits, and how early each is read.
CATEGORIES = (
    ("specification", r"spec|specification|specs\b|scope\s*of\s*work|sow\b"),
    ("drawing", r"drawing|plan|blueprint|sheet|civil|arch|structural|detail|rfp"),
    ("addendum", r"addendum|amendment|revision|rev\b"),
    ("form", r"form|checklist|affidavit|certification|bid\s*form|submittal"),
)
PRIORITIES = {"specification": 1, "drawing": 2, "addendum": 3, "general": 4, "form": 5}
#: Kinds of documents by file name, the first that fits, and by what their first pages say, with its weight.
NAME_KINDS = (
    ("geotech", r"geotech|soil[s]?\s*report|boring"),
    ("schedule", r"\bschedule|gantt|timeline|milestone"),
    ("qa_log", r"\bq(?:uestion)?[\s_-]*&?[\s_-]*a(?:nswer)?\b|\brfp[_-]?question|\bclarifications?\b"),
    ("addendum", r"addend|amendment|revision"),
    ("specification", r"\bspecs?\b|specification|project[\s_-]?manual|statement[\s_-]?of[\s_-]?work|\bsow\b|scope[\s_-]?of[\s_-]?work|bid[\s_-]?scope"),
    ("drawing", r"\bplan[\s_-]?sheet|drawing|elevation|section|detail|\bsheet\b|permit[\s_-]?set|bid[\s_-]?permit|construction[\s_-]?(?:set|documents?)|\bcd[\s_-]?set"),
    ("site_markup", r"markup|aerial|site[\s_-]?plan"),
    ("proposal_form", r"proposal[\s_-]?form|bid[\s_-]?form"),
)
TEXT_KINDS = (
    ("geotech", 3, r"geotechnical engineering|standard penetration|soil borin|boring log|atterberg|n[- ]value"),
    ("schedule", 2, r"\b(task name|gantt|predecessors|critical path)\b"),
    ("qa_log", 3, r"question (and|&) answer|response status|clarifications? log"),
    ("specification", 2, r"section \d{2}\s\d{2}\s\d{2}\b|csi format|division \d{2}\b"),
    ("drawing", 2, r"\bsheet (no|number|#)|\bscale[: ]+1[/=]|\b(plan|elevation|section|detail) view\b"),
)
#: What file names and texts say about how far a package has come. Texts of these kinds count.
NAME_STAGES = {
    "pre_gmp_rfp": r"\b(?:draft|pre[\s_-]?gmp|rfp|preliminary|progress[\s_-]?print|design[\s_-]?development|dd\b|95[\s_-]?%)",
    "final_cd": r"\b(?:final|issued[\s_-]?for[\s_-]?(?:construction|bid|permit)|ifc\b|ifb\b|construction[\s_-]?documents?|cd[\s_-]?set|100[\s_-]?%|bid[\s_-]?permit|permit[\s_-]?set|bidding[\s_-]?set)",
}
TEXT_STAGES = {
    "pre_gmp_rfp": (
        r"(?i)construction\s+(?:docs?|documents?)\s+(?:to\s+(?:be\s+)?(?:provide|update|reflect|have)|will\s+(?:be\s+)?(?:provide|include))",
        r"(?i)please\s+(?:make|carry|use)\s+(?:a\s+)?reasonable\s+assumption",
        r"(?i)(?:specs|specifications)\s+(?:will\s+be\s+|to\s+be\s+)?(?:updated|provided|added)",
        r"(?i)to\s+be\s+(?:provided\s+)?(?:in|with)\s+(?:the\s+)?(?:final|construction)\s+(?:cd|documents?)",
        r"(?i)pre[\s-]?gmp\s+cost\s+commitment",
        r"(?i)final\s+gmp\s+based\s+on\s+100\s*%",
    ),
    "final_cd": (r"(?i)\bissued\s+for\s+construction\b", r"\bIFC\b", r"(?i)\bbidding\s+set\b"),
}
STAGE_TEXTS = ("qa_log", "specification")
#: What rows of door schedules say, by whose work the door is; the first that fits counts.
DOORS = (
    ("etr", r"\betr\b|existing.to.remain"),
    ("aluminum", r"\balum"),
    ("frp", r"\bfrp\b"),
    ("hm_glass", r"(?=.*(?:\bhm\b|hollow.metal)).*(?:\bfg\b|hm/?glass|sidelight|full.glass)"),
    ("hm_f1", r"(?=.*(?:\bhm\b|hollow.metal)).*(?:\bf1\b|standard|flush|\bf\s)"),
    ("hm_other", r"\bhm\b|hollow.metal"),
)
OUR_DOORS = ("hm_f1", "hm_glass", "hm_other")


def file_category(name: Column) -> Column:
    lowered = F.lower(F.coalesce(name, F.lit("")))
    return F.coalesce(*(F.when(lowered.rlike(p), F.lit(c)) for c, p in CATEGORIES), F.lit("general"))


def file_priority(category: Column) -> Column:
    return F.coalesce(*(F.when(category == c, F.lit(i)) for c, i in PRIORITIES.items()), F.lit(PRIORITIES["general"]))


def document_kind(filename: Column, hint: Column, text: Column, raster: Column) -> Column:
    """struct<kind, confidence>: by the text where it says enough, else by the name, else by the uploader's hint, else raster_scan or unknown.

    Text is what the first pages hold; a raster document has none.
    """
    said = F.lower(F.coalesce(text, F.lit("")))
    weights = [(kind, weight, said.rlike(p) & ~raster) for kind, weight, p in TEXT_KINDS]
    heaviest = sorted(weights, key=lambda w: -w[1])
    answer = lambda kind, confidence: F.struct(kind.alias("kind"), F.lit(confidence).alias("confidence"))
    by_text = [F.when(hit, answer(F.lit(kind), min(95, 50 + 10 * weight))) for kind, weight, hit in heaviest]
    name = F.lower(F.coalesce(filename, F.lit("")))
    by_name = [F.when(name.rlike(p), answer(F.lit(kind), 60)) for kind, p in NAME_KINDS]
    by_hint = F.when(F.coalesce(hint, F.lit("general")) != "general", answer(hint, 50))
    return F.coalesce(*by_text, *by_name, by_hint, F.when(raster, answer(F.lit("raster_scan"), 0)), answer(F.lit("unknown"), 0))


def stage(df: DataFrame, key: str, name: str, kind: str, text: str) -> DataFrame:
    """key, stage and confidence of each package.

    Two for each file whose name speaks for a stage, one for each marker in a text of
    the kinds that tell. The stage with more counts if that is 2 at least, with a
    confidence that grows with it; less, or a tie, gives 40, and a tie pre_gmp_rfp.
    Without any sign the stage is unknown with 0.
    """
    tells = F.coalesce(F.col(kind).isin(*STAGE_TEXTS), F.lit(False))
    hit = lambda c, p: F.coalesce(c.rlike(p), F.lit(False)).cast("int")
    points = {s: 2 * hit(F.lower(name), NAME_STAGES[s]) + F.when(tells, sum((hit(F.col(text), p) for p in TEXT_STAGES[s]), F.lit(0))).otherwise(0) for s in NAME_STAGES}
    sums = df.groupBy(key).agg(*(F.sum(c).alias(s) for s, c in points.items()))
    rfp, cd = F.col("pre_gmp_rfp"), F.col("final_cd")
    best, clear = F.greatest(rfp, cd), rfp != cd
    named = F.when(best == 0, "unknown").when(rfp >= cd, "pre_gmp_rfp").otherwise("final_cd")
    sure = F.when(clear & (best >= 2), F.least(F.lit(95), 50 + 8 * best)).when(best > 0, 40).otherwise(0)
    return sums.select(key, named.alias("stage"), sure.cast("int").alias("confidence"))


def door_class(row: Column) -> Column:
    """Whose work a row of a door schedule is, the first that fits; other for none."""
    t = F.lower(F.coalesce(row, F.lit("")))
    return F.coalesce(*(F.when(t.rlike(p), F.lit(c)) for c, p in DOORS), F.lit("other"))


def door_counts(rows: DataFrame, key: str, same: Sequence[str], number: str, text: str, excluded: DataFrame) -> DataFrame:
    """key, doors by class, those in excluded rooms and ours: each door once, however many sheets show it.

    same names the columns that make a door; excluded (key, number) are doors of rooms
    that the scope leaves out. Of rows for one door the least text counts.
    """
    once = rows.groupBy(key, *same).agg(F.min(text).alias(text))
    out = excluded.select(key, F.trim(F.col(number).cast("string")).alias("__n")).distinct().withColumn("__out", F.lit(True))
    marked = once.withColumn("__n", F.trim(F.col(number).cast("string"))).join(out, [key, "__n"], "left")
    kind = F.when(F.col("__out"), "excluded_by_room").otherwise(door_class(F.col(text)))
    counts = [F.count_if(F.col("__k") == c).alias(c) for c in ("excluded_by_room", *(c for c, _ in DOORS))]
    return marked.withColumn("__k", kind).groupBy(key).agg(F.count("*").alias("total"), *counts, F.count_if(F.col("__k").isin(*OUR_DOORS)).alias("ours"))


def first_page(pages: DataFrame, key: str, page: str, text: str, patterns: Mapping[str, str]) -> DataFrame:
    """key, code and the first page whose text has the code's pattern. Patterns are few; each is tried in the scan, and no pages are joined."""
    hits = F.array(*(F.when(F.col(text).rlike(p), F.lit(c)) for c, p in patterns.items()))
    each = pages.select(key, page, F.explode(F.filter(hits, lambda c: c.isNotNull())).alias("code"))
    return each.groupBy(key, "code").agg(F.min(page).alias("first_page"))


def key_then_like(messages: DataFrame, threads: DataFrame, id_column: str, subject: str, at: str) -> DataFrame:
    """messages with thread_id: by the id they answer, else the newest thread before them of the same subject without reply marks.

    messages: message (distinct), answers, subject, at; threads: thread_id, message_id,
    subject, at. Messages and threads of a subject meet in time order, day by day.
    """
    from sluice.functions.text import subject_base
    from sluice.operators.windows import last_before

    by_id = threads.select(F.col("message_id").alias("__m"), F.col("thread_id").alias("__by_id"))
    first = messages.join(by_id, F.col(id_column) == F.col("__m"), "left").drop("__m")
    base = lambda c: F.nullif(F.lower(subject_base(F.col(c))), F.lit(""))
    named = threads.select(base("subject").alias("__s"), F.col("at").alias(at), F.col("thread_id").alias("__by_subject")).where(F.col(at).isNotNull())
    open_ = first.where("__by_id is null").select("message", at, base(subject).alias("__s"))
    met = last_before(open_.where("__s is not null"), named.where("__s is not null"), "__s", at, "__by_subject", F.to_date(at)).select("message", "__by_subject")
    return first.join(met, "message", "left").withColumn("thread_id", F.coalesce("__by_id", "__by_subject")).drop("__by_id", "__by_subject")


def allowed_categories(lines: DataFrame, codes: DataFrame, of: Mapping[str, Sequence[str]], key: str) -> DataFrame:
    """lines with scope: in_scope where a code of its package allows its category, phantom else."""
    table = F.create_map(*(x for k, v in of.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    allowed = codes.select(key, F.explode(F.try_element_at(table, F.col("code"))).alias("category")).distinct().withColumn("__ok", F.lit(True))
    return lines.join(allowed, [key, "category"], "left").withColumn("scope", F.when(F.col("__ok"), "in_scope").otherwise("phantom")).drop("__ok")


def dereference(df: DataFrame, text: str, glossary: DataFrame, key: str, pattern: str = r"[A-Z]\d+\.\d+") -> DataFrame:
    """key and notes: the glossary's descriptions of the codes that a text names, each once, in order of first mention. glossary: code, description."""
    found = df.select(key, F.posexplode(F.array_distinct(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)))).alias("place", "code"))
    met = found.join(glossary, "code")
    return met.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "description"))), lambda s: s["description"]).alias("notes"))


def sheet_id(items: DataFrame, key: Sequence[str], width: str, height: str) -> DataFrame:
    """key and sheet: the first sheet number in the lower right quarter of a page, where title blocks stand."""
    quarter = items.where((F.col("y") >= 0.65 * F.col(height)) & (F.col("x") >= 0.55 * F.col(width)))
    found = quarter.withColumn("sheet", F.regexp_extract(F.upper(F.trim("str")), r"^((?:FP|[ASMEPCD])-?\d{1,3}(?:\.\d{1,2})?)$", 1)).where("sheet <> ''")
    w = W.partitionBy(*key).orderBy(F.desc("y"), F.desc("x"), "item_idx")
    return found.withColumn("__n", F.row_number().over(w)).where("__n = 1").select(*key, F.regexp_replace("sheet", "-", "").alias("sheet"))


def scope_sentences(text: Column, least: int = 12) -> Column:
    """Sentences of a scope of work, of at least so many characters, as array<struct<text, included>>."""
    parts = F.filter(F.transform(F.split(text, r"(?<=[.;\n])\s+"), lambda s: F.trim(s)), lambda s: F.length(s) >= least)
    return F.transform(parts, lambda s: F.struct(s.alias("text"), (~s.rlike(r"(?i)\b(not included|excluded?|by others|exclusion)\b")).alias("included")))


def deadline_guess(text: Column, most: int = 4000) -> Column:
    """The first date near a word for when something is due, in the first characters of a text: 3/4/2024, 2024-03-04 or March 4, 2024."""
    head = F.substring(text, 1, most)
    near = F.regexp_extract(head, r"(?i)(?:due|deadline|closing|no later than|by)\D{0,40}?(\d{1,2}/\d{1,2}/\d{4}|\d{4}-\d{2}-\d{2}|(?:january|february|march|april|may|june|july|august|september|october|november|december) \d{1,2},? \d{4})", 1)
    return F.coalesce(F.try_to_date(near, "M/d/yyyy"), F.try_to_date(near, "yyyy-MM-dd"), F.try_to_date(F.initcap(F.replace(near, F.lit(","), F.lit(""))), "MMMM d yyyy"))


def place_of(raw: Column) -> Column:
    """A place from a payload of JSON: the first of a list of places, else the first office with an address, else a place that is one object, else a state's code; null for none."""
    path = lambda p: F.nullif(F.get_json_object(raw, p), F.lit(""))
    joined = lambda *parts: F.nullif(F.concat_ws(", ", *parts), F.lit(""))
    at = lambda root: joined(F.coalesce(path(f"{root}.city.name"), path(f"{root}.city")), F.coalesce(path(f"{root}.state.code"), path(f"{root}.state")), F.coalesce(path(f"{root}.country.code"), path(f"{root}.country")))
    offices = F.from_json(F.get_json_object(raw, "$.organizationHierarchy"), "array<struct<address:struct<city:string,state:string,country:string>>>")
    office = F.get(F.filter(offices, lambda o: o["address"].isNotNull()), F.lit(0))["address"]
    listed = path("$.placeOfPerformance[0]").isNotNull()
    whole = F.when(~listed, at("$.placeOfPerformance"))
    return F.coalesce(F.when(listed, at("$.placeOfPerformance[0]")), joined(office["city"], office["state"], office["country"]), whole, path("$['Place of Performance State Code']"), at("$.officeAddress"))


#: How a scope of work says that something is left out, and how it names rooms and stations.
LEFT_OUT = r"(?i)(?:priced separately|to be priced separately|by others|not included|out of scope|excluded|under separate contract|by owner)"
INCLUDES = r"(?i)^\s*(?:include[ds]?|provide[ds]?|the project includes|scope of work)"
ROOM, BARE_ROOM, STATION = r"(?i)\b(?:room|rm\.?)\s+(\d{2,3}[A-Za-z]?)\b", r"\b(\d{3}[A-Za-z]?)\b", r"(?i)\b(?:stations?|sta\.?)\s+(?:no\.?\s*)?#?(\d+)\b"
LEAST_SENTENCE, MOST_NOTE = 12, 200


def scope_of_work(text: Column) -> Column:
    """struct<rooms, stations, excluded, included> of a scope of work.

    Sentences of LEAST_SENTENCE characters or more count. Of those that leave something
    out, rooms are named as such or by three digits alone, and stations by number;
    sentences are cut to MOST_NOTE characters.
    """
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")
    sentences = F.filter(F.transform(F.split(plain, r"(?<=[.!?:])\s+(?=[A-Z*\u2022])"), lambda s: F.trim(s)), lambda s: F.length(s) >= LEAST_SENTENCE)
    out = F.filter(sentences, lambda s: s.rlike(LEFT_OUT))
    within = F.filter(sentences, lambda s: ~s.rlike(LEFT_OUT) & s.rlike(INCLUDES))
    every = lambda pattern: F.flatten(F.transform(out, lambda s: F.regexp_extract_all(s, F.lit(pattern), F.lit(1))))
    cut = lambda found: F.transform(found, lambda s: F.substring(s, 1, MOST_NOTE))
    return F.struct(F.array_sort(F.array_distinct(F.concat(every(ROOM), every(BARE_ROOM)))).alias("rooms"), F.array_sort(F.array_distinct(every(STATION))).alias("stations"), cut(out).alias("excluded"), cut(within).alias("included"))


def reflowed(text: Column, labels: Sequence[str]) -> Column:
    """Breaks as lines, other tags and entities gone, each known label on a line of its own, no more than one empty line."""
    out = F.regexp_replace(text, r"(?i)<br\s*/?>", "\n")
    out = F.regexp_replace(F.regexp_replace(out, r"<[^>]+>", ""), r"&[a-z]+;", " ")
    known = "|".join(sorted(labels, key=len, reverse=True))
    out = F.regexp_replace(out, rf"\s*\b({known})\s*:\s*", "\n\n$1: ")
    return F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def award(raw: Column) -> Column:
    """struct<name, amount> of an award, from the shapes that payloads have."""
    first = lambda *paths: F.coalesce(*(F.nullif(F.get_json_object(raw, p), F.lit("")) for p in paths))
    amount = F.regexp_replace(first("$.award.amount", "$.award.value", "$.amount"), "[$,]", "").try_cast("double")
    return F.struct(first("$.award.awardee.name", "$.award.awardee", "$.awardee").alias("name"), F.nullif(amount, F.lit(0.0)).alias("amount"))


def page_package(pages: DataFrame, documents: DataFrame, key: str) -> DataFrame:
    """key, file and its kept pages, in range, each once, in order. pages: key, file, page; documents: file, page_count."""
    kept = pages.join(documents, "file").where("page between 1 and page_count")
    return kept.groupBy(key, "file").agg(F.array_sort(F.collect_set("page")).alias("pages"))


def top_under_budget(df: DataFrame, key: str, order: Sequence[Column | str], size: str, budget: float, most: int = 3) -> DataFrame:
    """The first rows of each key, at most so many, up to the row with which their size would pass the budget."""
    w = W.partitionBy(key).orderBy(*order)
    placed = df.withColumns({"__n": F.row_number().over(w), "__s": F.sum(size).over(w.rowsBetween(W.unboundedPreceding, 0))})
    return placed.where((F.col("__n") <= most) & (F.col("__s") <= budget)).drop("__n", "__s")
