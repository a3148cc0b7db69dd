from pyspark.sql import functions as F

from sluice.operators import coverage, layout, windows
from sluice.sources import readers, sinks


def test_schedule_from_items(spark):
    grid = [["Mark", "Width", "Height", "Frame", "Hardware"], ["D1", "3-0", "7-0", "HM", "H1"], ["D2", "6-0", "7-0", "AL", "H2"]]
    items = [("a.pdf", 1, 10 * y + x, s, 100.0 * x + y, 50.0 + 20 * y) for y, row in enumerate(grid) for x, s in enumerate(row)]
    items += [("a.pdf", 1, 99, "title", 900.0, 5.0), ("b.pdf", 1, 1, "no table", 1.0, 1.0)]
    df = spark.createDataFrame(items, "file string, page int, item_idx int, str string, x double, y double")
    rows = layout.schedule_rows(df).orderBy("row").collect()
    assert [(r["kind"], r["cells"]["mark"], r["cells"]["frame"]) for r in rows] == [("door_schedule", "D1", "HM"), ("door_schedule", "D2", "AL")]
    kept = layout.quality(layout.schedule_rows(df), {"door_schedule": r"^D\d"})
    assert kept.count() == 2 and layout.quality(layout.schedule_rows(df), {"door_schedule": r"^Z"}).count() == 0


def test_references_and_revisions(spark):
    text = "See A-101 and S201, ASTM A572 steel, A992, A123/A123M. SECTION 05 50 00 - METAL. REV 3 dated 1/2/2024, about 12 tons of steel"
    df = spark.createDataFrame([(text,)], "t string")
    r = df.select(layout.sheet_references(F.col("t")), layout.section_headers(F.col("t")), layout.revision(F.col("t"))["value"], layout.tonnage(F.col("t")), layout.discipline_of(F.lit("S201"))).first()
    assert tuple(r) == (["A101", "S201"], ["05 50 00"], "3", 24000.0, "structural")


def test_manifest_and_coverage(spark):
    sections = spark.createDataFrame([(1, "055000"), (1, "05 50 00"), (1, "08 41 13"), (1, "11 00 00")], "pkg int, code string")
    sheets = spark.createDataFrame([(1, "S-101", 10, False), (1, "E-1", 500, False)], "pkg int, sheet string, items int, raster boolean")
    schedules = spark.createDataFrame([(1, "door")], "pkg int, schedule string")
    entries = coverage.manifest(sections, sheets, schedules, "pkg")
    tags = {(r["kind"], r["ref"]): (r["tag"], r["needs_vision"]) for r in entries.collect()}
    assert tags == {("section", "05 50 00"): ("included", False), ("section", "08 41 13"): ("excluded", False), ("section", "11 00 00"): ("judgment", False), ("sheet", "S-101"): ("included", True), ("sheet", "E-1"): ("excluded", False), ("schedule", "door"): ("included", False)}
    assert coverage.expected_categories(entries, "pkg").first()["categories"] == ["lintel", "misc_metal"]
    covered = spark.createDataFrame([(1, "section", "05 50 00")], "pkg int, kind string, ref string")
    why = spark.createDataFrame([(1, "sheet", "S-101", "too short"), (1, "schedule", "door", "supplied by the owner")], "pkg int, kind string, ref string, reason string")
    assert [r["ref"] for r in coverage.uncovered(entries, covered, why, "pkg").collect()] == ["S-101"]


def test_greedy_budget(spark):
    df = spark.createDataFrame([([(60.0,), (50.0,), (30.0,), (10.0,)],)], "items array<struct<size:double>>")
    assert [x["size"] for x in df.select(windows.greedy_budget(F.col("items"), "size", 100, 3)).first()[0]] == [60.0, 30.0, 10.0]


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": 1, "name": "x"}')
    (tmp_path / "b.json").write_text('{"id": ')
    good, bad = readers.json_records(spark, str(tmp_path), spark.createDataFrame([], "id int, name string").schema)
    assert [r["id"] for r in good.collect()] == [1] and bad.count() == 1
    html = "<table><tr><th>No</th></tr><tr><td>B-1</td><td>Steel <b>stairs</b></td></tr><tr><td>None</td><td></td></tr></table>"
    rows = readers.table_rows(spark.createDataFrame([(html,)], "html string")).collect()
    assert [r["cells"] for r in rows] == [["B-1", "Steel stairs"]]
    xml = '<rows><row id="7"><cell>a</cell><cell><![CDATA[b & c]]></cell><cell>01/31/2024</cell><cell>d</cell><cell>e</cell></row></rows>'
    r = readers.xml_grid(spark.createDataFrame([(xml,)], "xml string")).first()
    assert r["id"] == "7" and r["cells"][1:3] == ["b & c", "2024-01-31"]
    r = readers.json_grid(spark.createDataFrame([('{"data": [["<a>x</a>", "y"]]}',)], "body string")).first()
    assert r["cells"] == ["x", "y"]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id int, v string")
    assert sinks.append_absent(spark, rows, str(tmp_path / "t"), ["id"]) == 2
    assert sinks.append_absent(spark, rows, str(tmp_path / "t"), ["id"]) == 0
    for _ in range(2):  # a repeated version changes nothing
        sinks.upsert_version(spark, rows, str(tmp_path / "v"), 1, ["id"], [F.desc("v")])
    assert sinks.latest(spark, str(tmp_path / "v")).count() == 2
    df = spark.createDataFrame([("won", [("p",)], None), ("new", [("q",)], None)], "s string, docs array<struct<path:string>>, gone timestamp")
    out = sinks.purge(df, F.col("s") == "won", "docs", "gone", F.lit("2024-01-01").cast("timestamp")).orderBy("s").collect()
    assert [len(r["docs"]) for r in out] == [1, 0] and out[1]["gone"] is not None


def test_as_of_by_days(spark):
    from sluice.operators import joins

    versions = spark.createDataFrame([(1, "1990-01-01", "1996-06-01"), (2, "1996-06-01", "1998-01-01"), (3, "1998-01-01", None), (4, "2050-01-01", None)], "version int, start string, end string").withColumns({c: F.col(c).cast("date") for c in ("start", "end")})
    facts = spark.createDataFrame([(1, "1996-05-31", None), (2, "1996-06-01", None), (3, "2001-01-01", None), (4, "1980-01-01", None), (5, "1990-01-01", 3), (6, "1990-01-01", 9)], "id int, d string, pin int").withColumn("d", F.col("d").cast("date"))
    want = {1: 1, 2: 2, 3: 3, 4: None, 5: 3, 6: None}
    assert {r["id"]: r["version"] for r in joins.as_of_version(facts, versions, "d", "start", "end", "pin").collect()} == want
    assert joins.as_of_version(facts.where("false"), versions, "d", "start", "end", "pin").count() == 0


def test_numbers_and_marks_over_buckets(spark):
    from sluice.operators import windows

    rows = [(i, "a" if i % 3 else None, (i * 7) % 40) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, k string, v int").repartition(4)
    got = {r["id"]: r["n"] for r in windows.numbered_in_buckets(df, ["k"], F.floor(F.col("v") / 8), ["v", "id"]).collect()}
    for key in ("a", None):
        own = sorted((v, i) for i, k, v in rows if k == key)
        assert [got[i] for _, i in own] == list(range(1, len(own) + 1))
    marks = [("a", 5, 1), ("a", 5, 2), ("a", 17, 3), (None, 0, 9), ("a", 100, 4), ("b", 1, 5)]
    found = windows.last_before(df, spark.createDataFrame(marks, "k string, v int, mark int"), "k", "v", "mark", F.floor(F.col("v") / 8)).collect()
    assert len(found) == 60
    for r in found:
        before = [(at, m) for k, at, m in marks if k == r["k"] and at <= r["v"]]
        assert r["mark"] == (max(before)[1] if before else None)


def test_upper_median_over_ranges(spark):
    from sluice.operators import aggregates

    rows = [("x", float(i % 17) / 4) for i in range(101)] + [("y", 3.0), ("y", 9.5), ("z", None)]
    got = {r["k"]: (r["n"], r["median"]) for r in aggregates.upper_median_by(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    assert got == {"x": (101, sorted(v for k, v in rows if k == "x")[50]), "y": (2, 9.5)}


def test_schedules_shuffle_only_order_lines(spark):
    from sluice.plans import details
    from tests.conftest import SF

    plan = details.frame_schedules(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Join" not in plan
    # a word under a label, cells of two items, equally near columns, a missing text and a row of too few items
    items = [(0, "Mark", 0.0, 10.0), (1, "FRAME ", 100.0, 10.0), (2, "size", 200.0, 12.0), (3, "type", 300.0, 10.0), (4, "jamb", 400.0, 10.0), (5, "in", 210.0, 25.0), (6, "by", 330.0, 25.0)]
    items += [(7, "F1", 2.0, 40.0), (8, "b", 60.0, 40.0), (9, "a", 50.0, 40.0), (10, None, 190.0, 40.0), (11, "9", 210.0, 40.0), (12, "far", 451.0, 40.0), (13, "F2", 2.0, 60.0), (14, "x", 400.0, 60.0)]
    df = spark.createDataFrame([("f", 1, *i) for i in items], "file string, page int, item_idx int, str string, x double, y double")
    got = [(r["kind"], r["row"], r["cells"]) for r in layout.schedule_rows(df).collect()]
    assert got == [("frame_schedule", 2, {"mark": "F1 a", "frame": "b", "size in": "9"})]


def test_schedules_are_worked_out_by_batch(spark, monkeypatch):
    import pyarrow as pa

    from sluice.operators import schedules
    from sluice.plans import details
    from tests.conftest import SF

    plan = details.frame_schedules(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython ") == 1 and "Window" not in plan
    nan, inf = float("nan"), float("inf")
    head = [(0.0, 0.0, 0, "Mark"), (0.0, 100.0, 1, " frame"), (1.0, 200.0, 2, "size"), (1.0, 250.0, 3, "JAMB \u00c4")]
    pages = [
        [*head, (20.0, 1.0, 4, "F1"), (20.0, 150.0, 5, "b"), (20.0, 150.0, 6, "a"), (20.0, nan, 7, "x"), (20.0, inf, 8, "x"), (40.0, -51.0, 9, "x"), (60.0, None, 10, "x"), (60.0, 300.0, 11, None)],
        None,
        [],
        [(0.0, 0.0, 0, "mark"), *[(20.0 + y, x, 1 + i, t) for i, (y, x, _, t) in enumerate(head)], (nan, 0.0, 9, "F2")],
        [(None, 0.0, 0, "no table")],
    ]
    # the same row names a lintel and a frame schedule: the first kind counts
    pages.append([(0.0, 10.0 * i, i, t) for i, t in enumerate(["mark", "lintel", "size", "frame", "jamb"])] + [(20.0, 10.0 * i, 9 + i, t) for i, t in enumerate(["a1", "b1", "c1"])])
    kind = pa.list_(pa.struct([("y", pa.float64()), ("x", pa.float64()), ("item_idx", pa.int32()), ("str", pa.string())]))
    items = pa.array([p and [dict(zip(("y", "x", "item_idx", "str"), i, strict=True)) for i in p] for p in pages], kind)
    find = lambda a: schedules.rows_of_schedules(a, layout.HEADERS, layout.ROW_GAP, layout.UNDER, 50.0, layout.SHARE).to_pylist()
    rows = [[(r["kind"], r["row"], {c["label"]: c["cell"] for c in r["cells"]}) for r in page] for page in find(items)]
    frame = "frame_schedule"
    assert rows == [[(frame, 1, {"mark": "F1", "frame": "b a"}), (frame, 3, {"jamb \u00e4": ""})], [], [], [(frame, 2, {"mark": "F2"})], [], [("lintel_schedule", 1, {"mark": "a1", "lintel": "b1", "size": "c1"})]]
    whole = find(items)
    monkeypatch.setattr(schedules, "ITEMS", 4)
    assert find(items) == whole and find(items.slice(2)) == whole[2:] and find(items[:0]) == []
    # schedules without marks go, as by quality
    df = spark.createDataFrame([("f", n, p) for n, p in enumerate(pages)], "file string, page int, items array<struct<y:double,x:double,item_idx:int,str:string>>")
    for marks in ({frame: "^F1"}, {frame: "^F[12]", "lintel_schedule": "^d1"}, {"door_schedule": "x"}):
        got, want = layout.page_schedules(df, marks=marks), layout.quality(layout.page_schedules(df), marks)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
