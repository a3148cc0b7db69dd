"""Scores and classes of opportunities and messages from rule tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A rule table of our own; callers give theirs.
CONFIG = {
    "codes": ("332312", "332323", "238120"),
    "low": 10_000.0,
    "high": 300_000.0,
    "primary": ("welding", "handrail", "steel fabrication"),
    "secondary": ("ladder", "canopy"),
    "disqualify": ("nadcap",),
    "near_bonus": 15,
    "far_penalty": 20,
}
#: Words of places abroad or off the mainland, and of cities and states that are near.
OVERSEAS = ("japan", "korea", "germany", "overseas", "foreign", "oconus", "far east", "pacific", "europe", "middle east", "guam", "puerto rico", "hawaii", "alaska")
NEAR_CITIES = (
    "chicago", "milwaukee", "madison", "green bay", "racine", "kenosha", "rockford", "peoria", "springfield", "indianapolis", "detroit",
    "grand rapids", "minneapolis", "st. paul", "des moines", "st. louis", "fort wayne", "south bend", "gary", "joliet", "aurora", "naperville",
    "great lakes", "waukegan", "duluth", "lansing", "ann arbor", "davenport", "quad cities", "dubuque", "cedar rapids", "champaign", "kalamazoo",
    "bloomington", "normal", "elgin", "cicero", "evanston", "oak park",
)
NEAR_STATES = ("wisconsin", "wi", "illinois", "il", "indiana", "in", "michigan", "mi", "iowa", "ia", "minnesota", "mn", "missouri", "mo", "ohio", "oh", "kentucky", "ky")
#: What texts say about wages, supply, parts, visits, drawings and other trades.
PAYROLL = ("davis-bacon", "davis bacon", "certified payroll", "prevailing wage")
SUPPLY = ("supply only", "supply-only", "supplies only", "material supply")
PARTS = ("proposed procurement for nsn", "national stock number", "dla troop support", "dla land and maritime", "dla aviation", "in repair/modification of")
CATALOG_NUMBER, CATALOG_TITLE = r"^\d{2}--", r"^[A-Z][A-Z ,\-/]{3,}$"
VISIT = ("site visit", "pre-bid conference", "pre-proposal conference", "mandatory walk", "mandatory inspection")
DRAWINGS = ("drawings", "prints", "blueprints", "shop drawings", "specifications attached", "see attached", "per plans", "per specification", "scope of work attached", "sow attached")
OTHER_TRADES = (
    "concrete pour", "repaving", "asphalt", "roofing", "roof replacement", "hvac", "plumbing", "electrical contractor", "painting services",
    "janitorial", "landscaping", "mowing", "demolition only", "fall protection engineering", "fall protection program",
)


def holds(lowered: Column, words: Sequence[str]) -> Column:
    """Whether a text in lower case holds any of words, which are too."""
    return reduce(Column.__or__, (F.contains(lowered, F.lit(w)) for w in words), F.lit(False))


def any_of(text: Column, words: Sequence[str]) -> Column:
    """Whether text holds any of words, in any case; false for null."""
    return holds(F.lower(F.coalesce(text, F.lit(""))), [w.lower() for w in words])


def once(df: DataFrame, **values: Column) -> DataFrame:
    """df with values as columns that are worked out once, however often they are used: a generator keeps projections from being merged."""
    return df.select("*", F.inline(F.array(F.struct(*(v.alias(name) for name, v in values.items())))))


def _near(lowered: Column, tokens: Sequence[str]) -> Column:
    looks_like_one = F.contains(lowered, F.lit(",")) | lowered.rlike(r"\b[a-z]{2}\b")
    return F.when(lowered == "", F.lit(None).cast("boolean")).when(holds(lowered, tokens), F.lit(True)).when(looks_like_one, F.lit(False))


def near(place: Column, tokens: Sequence[str] = (*NEAR_CITIES, *NEAR_STATES)) -> Column:
    """True for a place that holds a token anywhere, false for another that looks like a place (a comma, or two letters alone), null otherwise."""
    return _near(F.lower(F.coalesce(place, F.lit(""))), tokens)


def signals(df: DataFrame, config: Mapping = CONFIG, *, code: str, low: str, high: str, title: str, description: str, place: str) -> DataFrame:
    """df with signals, an array of struct<label, delta, fired> in a fixed order, and score: the fired deltas' sum within 0 and 100.

    Texts are a title and a description; nulls say nothing, a null place counts as
    on the mainland and as unknown. Text and place are put in lower case once.
    """
    lowered = once(df, __text=F.lower(F.concat_ws(" ", title, description)), __place=F.lower(F.coalesce(F.col(place), F.lit(""))), __name=F.trim(F.coalesce(F.col(title), F.lit(""))))
    text, name = F.col("__text"), F.col("__name")
    found = once(lowered, __near=_near(F.col("__place"), (*NEAR_CITIES, *NEAR_STATES)), __home=~holds(F.col("__place"), OVERSEAS), __visit=holds(text, VISIT), __drawn=holds(text, DRAWINGS))
    is_near, domestic, visit, drawn = (F.col(c) for c in ("__near", "__home", "__visit", "__drawn"))
    far = F.coalesce(~is_near, F.lit(False))
    vmax, vmin = F.coalesce(high, low), F.coalesce(low, high)
    catalog = name.rlike(CATALOG_NUMBER) | (name.rlike(CATALOG_TITLE) & (F.length(name) < 40))
    own = {k: [w.lower() for w in config[k]] for k in ("primary", "secondary", "disqualify")}
    rules = [
        ("code", 30, F.col(code).isin(*config["codes"])),
        ("value", 20, vmax.between(config["low"], config["high"])),
        ("primary", 20, holds(text, own["primary"])),
        ("secondary", 10, holds(text, own["secondary"])),
        ("domestic", 10, domestic),
        ("near", config["near_bonus"], is_near),
        ("out_of_region", -config["far_penalty"], far & domestic),
        ("payroll", -15, holds(text, PAYROLL)),
        ("too_small", -25, vmax < 5000),
        ("too_large", -20, vmin > 2_000_000),
        ("supply_only", -20, holds(text, SUPPLY)),
        ("disqualified", -15, holds(text, own["disqualify"])),
        ("parts", -30, holds(text, PARTS) | catalog),
        ("far_site_visit", -20, far & visit & ~drawn),
        ("far_with_drawings", -5, far & visit & drawn),
        ("far", -5, far & ~visit),
        ("other_trade", -20, holds(text, OTHER_TRADES)),
    ]
    each = F.array(*(F.struct(F.lit(label).alias("label"), F.lit(delta).alias("delta"), F.coalesce(fired, F.lit(False)).alias("fired")) for label, delta, fired in rules))
    summed = once(found, signals=each)
    total = F.aggregate("signals", F.lit(0), lambda acc, s: acc + F.when(s["fired"], s["delta"]).otherwise(0))
    return summed.select(*df.columns, "signals", F.greatest(F.lit(0), F.least(F.lit(100), total)).alias("score"))


def changed(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows in which any of the (old, new) pairs differ, null equal to null."""
    differs = F.lit(False)
    for old, new in pairs:
        differs = differs | ~F.col(old).eqNullSafe(F.col(new))
    return df.where(differs)


def triage(reasons: Sequence[tuple[str, Column]], keep: Column) -> Column:
    """review if keep holds, whatever else does; else the first reason that does; else open."""
    return F.when(keep, "review").otherwise(F.coalesce(*(F.when(r, F.lit(name)) for name, r in reasons), F.lit("open")))


def weighted_class(text: Column, patterns: Sequence[tuple[str, Sequence[tuple[str, int]]]], least: int = 2) -> Column:
    """struct(class, confidence): the class of most weight over its patterns, the first of equals, if it reaches least.

    Confidence is 50 and ten for each weight, 95 at most.
    """
    sums = [(name, sum((F.when(text.rlike(p), w).otherwise(0) for p, w in rules), F.lit(0))) for name, rules in patterns]
    best = F.greatest(*(s for _, s in sums), F.lit(0))
    name = F.coalesce(*(F.when(s == best, F.lit(n)) for n, s in sums))
    return F.when(best >= least, F.struct(name.alias("name"), F.least(F.lit(95), 50 + 10 * best).alias("confidence")))


def similarity(shared: Column, asked: Column, confidence: Column) -> Column:
    """0.7 of the share of the asked tokens that are shared, and 0.3 of the confidence, raised by 0.3 up to 1; an unknown confidence, or 0, is 0.5."""
    share = F.when(asked > 0, shared / asked).otherwise(0.0)
    return 0.7 * share + 0.3 * F.least(F.lit(1.0), F.coalesce(F.nullif(confidence, F.lit(0.0)), F.lit(0.5)) + 0.3)


def auto_pass(df: DataFrame, old: str, status: str, other_trade: Column) -> DataFrame:
    """Scored notices whose score differs from the old one, or that are passed over now: status is passed where a new notice is for parts, or of another trade and under 30.

    Notices that are not new keep their status.
    """
    fired = lambda label: F.exists("signals", lambda s: (s["label"] == label) & s["fired"])
    over = (F.col(status) == "new") & (fired("parts") | ((other_trade | fired("other_trade")) & (F.col("score") < 30)))
    out = df.withColumn("new_status", F.when(F.coalesce(over, F.lit(False)), "passed").otherwise(F.col(status)))
    return changed(out, [(old, "score"), (status, "new_status")])
