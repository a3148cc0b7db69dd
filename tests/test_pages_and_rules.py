"""Operators on items of pages, sources in order, ordered rules and deletions, on small planted rows."""

import random

from pyspark.sql import functions as F

from sluice.operators import coverage, documents, layout, page_text, sorting, validate
from sluice.sources import sinks
from sluice.sources.sites import Site, site_records

ITEMS = "file int, page int, item_idx int, str string, x double, y double, width double, font_size double"


def plain_clusters(items):
    """Items of a page in order, one after the other, in plain Python."""
    out, last = [], None
    for it in sorted(items, key=lambda i: (i[5], i[4], i[2])):
        if last is not None and abs(it[5] - last[5]) <= 4 and it[4] - (last[4] + (last[6] or 0)) <= max(8, last[7] or 12):
            out[-1].append(it[3] or "")
        else:
            out.append([it[3] or ""])
        last = it
    return [("".join(c).strip(" "), len(c)) for c in out]


def test_clusters_by_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for page in range(30):
        for i in range(rng.randrange(1, 25)):
            rows.append((page % 4, page, i, rng.choice(["A", "-1", "0", " b ", None, "word"]), float(rng.randrange(0, 120)), float(rng.randrange(0, 5) * 3), rng.choice([None, 4.0, 9.0]), rng.choice([None, 0.0, 6.0, 20.0])))
    got = {}
    for r in page_text.clusters(spark.createDataFrame(rows, ITEMS).repartition(3)).orderBy("cluster").collect():
        got.setdefault((r["file"], r["page"]), []).append((r["token"], r["parts"]))
    want = {}
    for r in rows:
        want.setdefault((r[0], r[1]), []).append(r)
    assert got == {k: plain_clusters(v) for k, v in want.items()}
    assert page_text.clusters(spark.createDataFrame([], ITEMS)).count() == 0


def test_sheets_written_glyph_by_glyph(spark):
    row = lambda file, i, s, x, y: (file, 1, i, s, float(x), float(y), 6.0, 10.0)
    rows = [row(1, 0, "S-", 700, 900), row(1, 1, "1", 707, 900), row(1, 2, "04", 714, 900), row(2, 0, "FP-12", 700, 900), row(3, 0, "S101", 10, 10), row(4, 0, "no", 800, 800)]
    got = {r["file"]: (r["sheet"], r["found_in"]) for r in page_text.sheet_identity(spark.createDataFrame(rows, ITEMS).withColumns({"w": F.lit(1000.0), "h": F.lit(1000.0)}), "w", "h").collect()}
    assert got == {1: ("S104", "cluster"), 2: ("FP12", "line")}


def test_the_first_note_of_a_code_counts(spark):
    row = lambda page, i, s, x, y: (1, page, i, s, float(x), float(y), 6.0, 10.0)
    rows = [row(2, 0, "A1.08", 5, 10), row(2, 1, "another thing entirely", 50, 12), row(1, 0, " A1.08 ", 5, 100), row(1, 1, "new  steel", 60, 103), row(1, 2, "railing", 90, 101), row(1, 3, "A1.09", 5, 200), row(1, 4, "short", 60, 200), row(1, 5, "A101", 5, 300), row(1, 6, "a sheet is no note", 60, 300)]
    found = page_text.glossary(spark.createDataFrame(rows, ITEMS)).collect()
    assert [(r["code"], r["description"], r["page"]) for r in found] == [("A1.08", "new steel railing", 1)]
    said = spark.createDataFrame([(1, 7, "see A1.08, A9.9 and A1.08")], "file int, page int, t string")
    assert [(r["place"], r["code"]) for r in page_text.resolved(said, "t", page_text.glossary(spark.createDataFrame(rows, ITEMS))).collect()] == [(0, "A1.08")]


def test_sources_in_order_field_by_field(spark):
    kind = "k int, ref string, title string, page int"
    first = spark.createDataFrame([(1, "a", None, 3), (1, "a", None, 2), (1, "b", "B", None)], kind)
    second = spark.createDataFrame([(1, "a", "A2", 9), (1, "c", "C2", 1), (None, "x", "y", 1)], kind)
    third = spark.createDataFrame([(1, "b", "B3", 7), (1, "a", "A3", 1)], kind)
    got = {r["ref"]: (r["source"], r["title"], r["page"]) for r in coverage.cascade([first, second, third], ["k", "ref"]).collect()}
    assert got == {"a": (1, "A2", 2), "b": (1, "B", 7), "c": (2, "C2", 1)}


def test_references_by_context(spark):
    text = "see 3/A400 and 12 / S5.1, S101, FP-102; ASTM A572, A992, A123/A123M, A036, AWS  D112, Q404, section 05 50 00"
    df = spark.createDataFrame([(text, None), (text, "specification"), (None, None)], "t string, kind string")
    r, spec, none = df.select(layout.references(F.col("t"), F.col("kind")).alias("r")).collect()
    assert r["r"]["callouts"] == ["12/S5.1", "3/A400"] and r["r"]["sheets"] == ["A400", "FP102", "S101", "S5.1"]
    assert r["r"]["disciplines"] == ["architectural", "fire_protection", "structural"]
    assert spec["r"]["sheets"] == [] and spec["r"]["callouts"] == [] and spec["r"]["sections"] == ["05 50 00"]
    covered = spark.createDataFrame([(1, "a-400"), (2, "S101")], "k int, sheet string")
    asked = spark.createDataFrame([(1, "A400"), (1, "S101"), (1, "S101")], "k int, sheet string")
    assert [tuple(x) for x in layout.missing_sheets(asked, covered, "k").collect()] == [(1, "S101")]


def test_mail_rules_in_order(spark):
    kind = "s string, j string, b string, a array<struct<name:string,size:int>>"
    big = [("x", 5000), ("y", 5000)]
    rows = [("bids@procore.com", "Save $20", "", None), ("a@aol.com", "RFP 3", "", None), ("a@b.c", "weekly digest, RFP", "", None), ("a@b.c", "hello", "x" * 1990 + " rfp", None), ("a@b.c", "hello", "x" * 2000 + " rfp", None), ("a@b.c", "Steel", "", None), ("x@oakbuilders.example", None, None, big), ("x@oakbuilders.example", None, None, [("x", 5000), ("y", 10)]), (None, None, None, None)]
    got = [(r["verdict"], r["reason"]) for r in sorting.sort_mail(spark.createDataFrame(rows, kind).coalesce(1), "s", "j", "b", "a").collect()]
    assert got == [("bid", "known_portal"), ("spam", "spam_sender"), ("spam", "spam_subject"), ("bid", "bid_keyword"), ("unclear", "no_signal"), ("bid", "construction_subject"), ("bid", "attachments_from_industry_domain"), ("unclear", "no_signal"), ("unclear", "no_signal")]


def test_notice_rules_in_order(spark):
    rows = [("VALVE,GATE", None, "1999-01-01", None), ("VALVE,GATE", "", None, "USA"), ("a sole source", "sources sought", None, None), ("a sole source", None, None, "DEU"), ("Chairs", None, None, "DEU"), ("Chairs", "<b>rail</b>ing", None, "DEU"), ("Junk vehicle", None, "1999-01-01", None), ("RFP #1", None, None, None), (None, None, None, None)]
    df = spark.createDataFrame(rows, "t string, d string, e string, c string").withColumn("e", F.col("e").cast("timestamp_ntz")).coalesce(1)
    got = [(r["outcome"], r["business"], r["reason"]) for r in sorting.sort_notices(df, F.lit("2000-01-01").cast("timestamp_ntz"), title="t", description="d", deadline="e", country="c").collect()]
    assert got == [("passed", None, "expired"), ("passed", None, "catalog_title"), ("open", None, None), ("passed", None, "sole_source"), ("passed", None, "overseas"), ("review", "fabrication", None), ("review", "salvage", None), ("passed", None, "opaque_title"), ("open", None, None)]


def test_stages_and_kinds(spark):
    rows = [(1, "RFP draft.pdf", "drawing", "IFC"), (2, "bidding set.pdf", "qa_log", "please carry a reasonable assumption"), (3, "x.pdf", "qa_log", "as IFC"), (4, "x.pdf", "drawing", "as IFC"), (5, "IFB.pdf", None, None), (5, "rfp.pdf", None, None)]
    got = {r["k"]: (r["stage"], r["confidence"]) for r in documents.stage(spark.createDataFrame(rows, "k int, n string, kind string, t string"), "k", "n", "kind", "t").collect()}
    assert got == {1: ("pre_gmp_rfp", 66), 2: ("final_cd", 66), 3: ("final_cd", 40), 4: ("unknown", 0), 5: ("pre_gmp_rfp", 40)}
    files = spark.createDataFrame([("Geotech.pdf", None, "Division 05 of", False), ("Geotech.pdf", None, "Division 05 of", True), ("photo.jpg", "form", "", False), ("photo.jpg", "general", None, True), (None, None, None, False)], "n string, h string, t string, r boolean").coalesce(1)
    kinds = [tuple(r["k"]) for r in files.select(documents.document_kind(F.col("n"), F.col("h"), F.col("t"), F.col("r")).alias("k")).collect()]
    assert kinds == [("specification", 70), ("geotech", 60), ("form", 50), ("raster_scan", 0), ("unknown", 0)]


def test_brackets_choose_a_prior(spark):
    lines = spark.createDataFrame([(1, "stair", 0.0, 5.0), (2, "stair", 2.0, 9.0), (3, "stair", 100.0, 1.0), (4, "rail", 2.0, 1.0)], "line_no int, category string, quantity double, iron_hrs double")
    priors = spark.createDataFrame([("stair", None, 1000.0, 2000.0, None, None), ("stair", "school", 900.0, 950.0, None, None), ("stair", "shop", 10.0, 20.0, 0.5, 1.0)], "category string, building_type string, low double, high double, hours_low double, hours_high double")
    found = lambda b: {r["line_no"]: [f["category"] for f in r["findings"]] for r in validate.bracket(validate.begin(lines), priors, b).collect()}
    assert found("shop") == {1: [], 2: ["below_bracket", "labor_above_bracket"], 3: ["above_bracket", "labor_below_bracket"], 4: []}
    assert found("hotel") == {1: [], 2: ["below_bracket"], 3: ["below_bracket"], 4: []}


def test_a_deletion_leaves_its_audit_first(spark, tmp_path):
    path, audit, now = str(tmp_path / "t"), str(tmp_path / "a"), F.lit("2024-01-01").cast("timestamp_ntz")
    rows = spark.range(200).selectExpr("id", "cast(id % 10 as int) as run")
    sinks.upsert_version(spark, rows, path, 1, ["id"], [F.lit(0)], 16)
    for _ in range(2):  # a repeated version changes nothing
        gone = sinks.delete_rows(spark, rows.where("run = 3"), path, audit, 2, ["id"], now, 16)
        assert gone.count() == 20 and sinks.latest(spark, path).count() == 180
    assert sinks.latest(spark, path, before=2).count() == 200
    assert spark.read.parquet(f"{audit}/v=000000002").where("deleted_at is not null").count() == 20
    # all rows of a bucket may go, and the next version starts from there
    assert sinks.delete_rows(spark, rows, path, audit, 3, ["id"], now, 16).count() == 180
    assert sinks.latest(spark, path) is None
    sinks.upsert_version(spark, rows.where("id < 5"), path, 4, ["id"], [F.lit(0)], 16)
    assert sinks.latest(spark, path).count() == 5


def test_sites_by_rules(spark):
    sites = (Site(r"^a\.", "A", "Town A", r"(?is)<li>.*?</li>", noise="(?i)^home", years="2023"), Site(r".", "B", "Town B", r"(?is)<p>.*?</p>", least=3))
    pages = [(1, "http://a.x/1", '<li>Home of the town</li><li><a href="/g">Gate work 1/2/2031</a></li><li>Gate awarded to all</li><li>Fence of 2023, long</li><li>short</li>'), (2, "http://a.x/2", "<li>Gate work 1/2/2031</li>"), (3, "https://b.x/", "<p>abc</p><li>no rule for this here</li>"), (4, "none", "<p>abc</p>"), (5, "http://a.x/", None)]
    got = [tuple(r) for r in site_records(spark.createDataFrame(pages, "page_id int, url string, html string"), sites).orderBy("id").collect()]
    assert [(r[0], r[3], r[4], str(r[5])) for r in got] == [("A-Gatework122031", "Gate work 1/2/2031", "/g", "2031-01-02"), ("B-abc", "abc", None, "None")]


def test_clusters_and_phases_bucket_by_bucket(spark):
    from sluice.operators import windows

    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "a", "a", None, "b"]), float(rng.randrange(0, 400)), rng.choice(["h", "t", "x", "x"])) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, k string, v double, kind string").repartition(4)
    bucket = F.floor(F.col("v") / 20)
    for made in (lambda b: windows.gap_clusters(df, ["k"], F.col("v"), 3.0, ["id"], bucket=b), lambda b: windows.phases(df, ["k"], ["v", "id"], F.col("kind") == "h", F.col("kind") == "t", b)):
        whole, parts = (sorted(map(tuple, made(b).collect())) for b in (None, bucket))
        assert whole == parts and len(whole) > 50
    # numbers by hand
    got = {r["id"]: r["cluster"] for r in windows.gap_clusters(df, ["k"], F.col("v"), 3.0, ["id"], bucket=bucket).collect()}
    for key in ("a", "b", None):
        own = sorted((v, i) for i, k, v, _ in rows if k == key)
        cluster, last = 0, own[0][0]
        for v, i in own:
            cluster, last = cluster + (v - last > 3.0), v
            assert got[i] == cluster


def test_a_deletion_shuffles_its_table_once(spark, tmp_path):
    path, audit = str(tmp_path / "t"), str(tmp_path / "a")
    rows = spark.range(20_000).selectExpr("id", "if(id % 100 = 1, null, id % 7) as run", "sha2(cast(id as string), 256) as v")
    tracker, seen = spark.sparkContext.statusTracker(), spark.sparkContext.setJobGroup

    def shuffled(group, work):
        seen(group, group)
        found = work()
        stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
        store = spark._jsc.sc().statusStore()
        return found, sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages)

    key = ["id", "run"]
    doomed = rows.where("id % 10 = 1").select(*key)
    plain = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where the keys are many
    try:
        _, first = shuffled("upsert", lambda: sinks.upsert_version(spark, rows, path, 1, key, [F.lit(0)], 8))
        gone, second = shuffled("delete", lambda: sinks.delete_rows(spark, doomed, path, audit, 2, key, F.lit("2024-01-01").cast("timestamp_ntz"), 8))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", plain)
        seen("", "")
    assert first <= 20_100 and second <= 22_500
    # a key with a null is equal to nothing, so those rows stay
    assert gone.count() == 1_800 and sinks.latest(spark, path).count() == 18_200
    assert sinks.latest(spark, path).where("run is null").count() == 200 and set(gone.columns) == {"id", "run", "v", "deleted_at"}
