"""Each check on lines that were planted to be caught, and a clean line that must not be."""

import pytest

from sluice.operators import pricing, validate

SCHEMA = "run int, line_no int, category string, description string, source_kind string, source_section string, source_evidence string, quantity double, quantity_band string, fab_hrs double, ironworker_hrs double, material_grade string, steel_shape_designation string, total_weight_lbs double, in_scope boolean, flagged boolean, confidence double, page_text string"
CLEAN = dict(run=1, line_no=1, category="lintel", description="steel lintel L1", source_kind="spec", source_section="05 50 00", source_evidence="lintel schedule: L1 six required", quantity=6.0, quantity_band="point", fab_hrs=4.0, ironworker_hrs=2.0, material_grade="A36", steel_shape_designation="L4x4x1/4", total_weight_lbs=500.0, in_scope=True, flagged=False, confidence=0.8, page_text="see lintel schedule: L1 six required at openings")


@pytest.fixture
def run(spark):
    def go(*changes, **options):
        rows = [tuple((CLEAN | c)[n.split()[0]] for n in SCHEMA.split(", ")) for c in changes]
        return validate.validate_lines(spark.createDataFrame(rows, SCHEMA), **options).orderBy("line_no").collect()

    return go


def categories(row):
    return [f["category"] for f in row["findings"]]


def test_clean_line_has_no_finding(run):
    assert categories(run({})[0]) == []


@pytest.mark.parametrize(
    "change, category",
    [
        (dict(source_evidence="a quotation that nobody ever wrote anywhere"), "fabricated_quote"),
        (dict(source_evidence="lintels at openings", page_text="lintels at openings"), "band_downgrade"),
        (dict(description="existing to remain railing"), "etr_in_scope"),
        (dict(source_section="D-101"), "demolition_sheet"),
        (dict(steel_shape_designation="W12x26", material_grade="A36"), "grade_mismatch"),
        (dict(description="600S162-54 stud"), "cold_formed"),
        (dict(description="field verify the length"), "field_verify"),
    ],
)
def test_planted(run, change, category):
    assert category in categories(run(change)[0])


def test_band_and_scope_change(run):
    weak, existing, unsure = run(dict(line_no=1, source_evidence="lintels at openings", page_text="lintels at openings"), dict(line_no=2, description="existing to remain"), dict(line_no=3, description="verify in field", confidence=None))
    assert weak["quantity_band"] == "range"
    assert existing["in_scope"] is False and existing["flagged"]
    assert unsure["confidence"] == 0.0


def test_replacement_undoes_earlier_flags(run):
    row = run(dict(description="to be removed and replaced"), equipment=["lintel"])[0]
    assert categories(row) == ["etr_in_scope", "demo_replaced"] and row["in_scope"] and not row["flagged"]


def test_hours_and_brackets(run, spark):
    usual = spark.createDataFrame([("lintel", 20.0, 2.0)], "category string, usual_fab_hrs double, usual_ironworker_hrs double")
    prior = spark.createDataFrame([("lintel", 1.0, 3.0)], "category string, low double, high double")
    row = run({}, usual_hours=usual, brackets=prior)[0]
    assert row["fab_hrs"] == 10.0 and categories(row) == ["labor_floor", "above_bracket"]


def test_run_level(run, spark):
    lines = spark.createDataFrame([(1, 1, "lintel", "lintel L1", True, 100.0), (1, 2, "lintel", "lintel L1 again", True, 100.0)], "run int, line_no int, category string, description string, in_scope boolean, total_weight_lbs double")
    assert validate.overlaps(lines, "run").count() == 1
    sections = spark.createDataFrame([(1, "05 51 00"), (1, "05 50 00")], "run int, section string")
    expected = spark.createDataFrame([("05 51 00", "stair"), ("05 50 00", "lintel")], "section string, category string")
    assert [r["finding"] for r in validate.section_coverage(lines, sections, expected, "run").collect()] == ["no line for section 05 51 00"]
    area = spark.createDataFrame([(1, 1000.0, "school")], "run int, area double, building string")
    assert [r["category"] for r in validate.density(lines, area, "run").collect()] == ["density_below"]


def test_confidence(spark):
    rows = [("from_schedule", "point", 1, None, None, 5.0), ("assumption", "assumed_typical", 1, 1.0, 9.0, 5.0)]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "s string, b string, n int, low double, high double, q double")
    sure, guess = (r[0] for r in df.select(pricing.confidence("s", "b", F.col("n"), "low", "high", "q")).collect())
    assert sure >= 0.9 and 0.3 <= guess <= 0.55
