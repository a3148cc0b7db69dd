"""What comes in, sorted by ordered rules: messages as bids or spam, notices by why they are not for us.

A rule is a condition with what it says; the first one that holds counts. Texts are
put in lower case once, and word lists are parameters, so a house has its own.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.operators.intake import opaque
from sluice.operators.scoring import CATALOG_NUMBER, CATALOG_TITLE, holds, once

#: Addresses of bid portals and builders, with the source they stand for; the first that fits counts.
PORTALS = (
    (r"bidnetdirect|bidnet|sovra\.com", "email-bidnet"), (r"demandstar", "email-demandstar"), (r"buildingconnected|autodesk", "email-buildingconnected"), (r"panteratools|cullenbids|cullen", "email-cullen"),
    (r"cdsmith|reproconnect", "email-cdsmith"), (r"stenstrom", "email-stenstrom"), (r"scherrer", "email-scherrer"), (r"stevens", "email-stevens"), (r"questcdn", "email-questcdn"),
    (r"bonfirehub|gobonfire|bonfire", "email-bonfire"), (r"sam\.gov|gsa|sam-noreply", "email-samgov"), (r"milwaukee\.gov|cityofmilwaukee", "email-milwaukee"),
    (r"racinecounty|racine\.gov", "email-racine"), (r"procore", "email-procore"), (r"isqft|constructconnect", "email-constructconnect"), (r"smartbidnet", "email-smartbidnet"),
    (r"plan\.?room|planswift|blueprintbox", "email-planroom"), (r"onvia|govwin", "email-govwin"), (r"kraemerbrothers", "email-kraemer"), (r"copperrockconstruction", "email-copperrock"),
)
#: Senders of promotions and notices.
SPAM_SENDERS = (
    r"@aol\.com$", r"constantcontact|mailchimp|sendgrid\.net|sendgrid\.com|aweber|substack", r"newsletters?@|marketing@|promo@|promotions@|deals@|offers@",
    r"linkedin\.com|facebook(mail|)?\.com|instagram\.com|twitter\.com|x\.com", r"googleads|google\.com/ads|adwords", r"survey|surveymonkey|typeform",
    r"homeadvisor|angi\.com|thumbtack", r"yelp\.com", r"groupon|livingsocial", r"amazon\.com.*shipment|order@amazon|auto-confirm@amazon", r"ebay\.com|paypal\.com.*receipt", r"dropbox\.com|docusign\.(?!.*bid)",
)
#: Subjects of promotions, and what subjects and the beginnings of texts say about bids.
SPAM_SUBJECTS = (
    r"\boff\s+today\b|\bsave\s+\$?\d+", r"flash\s+sale|limited\s+time|expires\s+(today|tomorrow)", r"unsubscribe|opt\s+out",
    r"password\s+reset|verify\s+your\s+email|login\s+code|otp|one[-\s]?time\s+password", r"your\s+order|shipping\s+confirmation|shipment\s+arrived|delivered",
    r"statement\s+available|invoice\s+#\d+", r"newsletter|weekly\s+digest|monthly\s+digest",
)
BID_WORDS = (
    r"invitation\s+to\s+(bid|quote)", r"\brfp\b|\brfq\b|\bitb\b|\brfi\b", r"request\s+for\s+(proposal|quotation|quote|information)", r"solicitation",
    r"bid\s+(invitation|opportunity|notice|posted|alert)", r"new\s+project\s+posted", r"plan\s+room|planroom", r"addend(um|a)", r"procurement", r"subcontract\s+opportunity", r"tender|prequalif",
)
TRADE_WORDS = r"\b(bid|proposal|subcontract|construction|steel|metal|fabric|railing|handrail|stair|fence|canopy|weld|shop\s+drawing|takeoff|prequalif|general\s+contractor|\bgc\b)\b"
TRADE_DOMAINS = r"\.gov|\.us|\.edu|construction|builders|contracting|engineers?|architects?"
#: How much of a text is read, how large an attachment counts, and how many of them tell.
HEAD, LEAST_SIZE, LEAST_ATTACHMENTS = 2000, 1000, 2

#: Words of notices that are meant for one seller, of places abroad, and of parks.
ONE_SELLER = ("intent to sole source", "notice of intent to award", "restricted to qualified source")
ABROAD = ("guatemala", "cambodia", "phnom penh", "madagascar", "antananarivo", "india", "new delhi", "south africa", "pretoria", "japan", "korea", "germany", "oconus", "foreign", "overseas", "apo, ae")
PARKS = ("campground", "park ranger", "guided interpretive", "saddle and pack")
#: Words of what is for us whatever else is said, by the business that it is for.
OURS = {
    "fabrication": (
        "handrail", "hand rail", "railing", "stair", "guardrail", "guard rail", "bollard", "metal gate", "security gate", "vehicle gate", "slide gate", "swing gate", "roll up gate",
        "miter gate", "spillway gate", "gate fabricat", "metal fence", "security fence", "chain link", "ornamental metal", "ornamental iron", "structural steel fabricat", "steel fabricat",
        "metal fabricat", "welding", "misc metals", "miscellaneous metals", "canopy", "awning", "metal platform", "steel platform", "ladder", "grating", "metal door", "hollow metal",
        "roll up door", "rollup door", "overhead door", "metal ramp", "ada ramp", "steel repair", "weld repair", "ironwork", "wrought iron", "hatch", "watertight", "metal roof", "steel pole",
        "pole foundation", "metal stair", "fire escape", "steel beam", "structural steel", "misc. metal", "misc metal", "miscellaneous metal", "metal panel", "metal deck", "steel deck",
        "metal cladding", "dumpster enclosure", "trash enclosure", "equipment screen", "pipe support", "pipe hanger", "pipe rack", "fences & gates", "fences and gates", "fence and gate",
        "spreader beam", "lifting beam", "columbari", "tap box", "monument sign", "fence", "fencing",
    ),
    "salvage": (
        "towing service", "tow service", "tow contract", "vehicle tow", "impound", "vehicle impound", "vehicle disposal", "vehicle removal", "junk vehicle", "junked vehicle", "abandon vehicle",
        "abandoned vehicle", "scrap metal", "scrap vehicle", "scrap car", "scrap auto", "salvage vehicle", "salvage auto", "auto salvage", "surplus vehicle", "sale of surplus", "fleet disposal",
        "vehicle auction", "auto auction", "recycled auto part", "used auto part", "recycled part", "auto part", "vehicle part", "crushing", "vehicle crushing", "car crusher",
        "fleet maintenance", "vehicle maintenance", "body shop", "auto body", "collision repair",
    ),
}
#: A short list of our own of what is not our work; a house gives its own, of any length.
NOT_OURS = ("software", "catering", "janitorial", "roof replacement", "roofing", "hvac", "mowing", "landscaping", "asphalt", "paving", "insurance", "helicopter", "laboratory")
#: How much of a description is read.
DESCRIPTION = 5000


def any_pattern(text: Column, patterns: Sequence[str]) -> Column:
    """Whether one of the patterns fits, in any case; false for null."""
    return F.coalesce(text.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns)), F.lit(False))


def first_of(rules: Sequence[tuple[Column, Column]], otherwise: Column) -> Column:
    """What the first rule whose condition is true says."""
    return F.coalesce(*(F.when(F.coalesce(condition, F.lit(False)), says) for condition, says in rules), otherwise)


def sort_mail(df: DataFrame, sender: str, subject: str, body: str, attachments: str) -> DataFrame:
    """df with verdict (bid, spam or unclear), reason and source, by sender, subject, the beginning of the text and attachments.

    attachments is an array of structs with a size. Nulls are empty. source names the
    portal of the sender; email for others.
    """
    plain = lambda c: F.coalesce(F.col(c), F.lit(""))
    said = once(df, __from=F.lower(plain(sender)), __subject=plain(subject), __text=F.concat(plain(subject), F.lit(" "), F.substring(plain(body), 1, HEAD)))
    come_from, topic = F.col("__from"), F.col("__subject")
    portal = F.coalesce(*(F.when(come_from.rlike(p), F.lit(s)) for p, s in PORTALS))
    large = F.size(F.filter(F.coalesce(F.col(attachments), F.array().cast(df.schema[attachments].dataType)), lambda a: F.coalesce(a["size"], F.lit(0)) > LEAST_SIZE))
    domain = F.substring_index(F.when(F.contains(come_from, F.lit("@")), come_from), "@", -1)
    marked = once(said, __portal=portal)
    verdict = lambda v, reason: F.struct(F.lit(v).alias("verdict"), F.lit(reason).alias("reason"))
    rules = [
        (F.col("__portal").isNotNull(), verdict("bid", "known_portal")),
        (any_pattern(come_from, SPAM_SENDERS), verdict("spam", "spam_sender")),
        (any_pattern(topic, SPAM_SUBJECTS), verdict("spam", "spam_subject")),
        (any_pattern(F.col("__text"), BID_WORDS), verdict("bid", "bid_keyword")),
        (any_pattern(topic, [TRADE_WORDS]), verdict("bid", "construction_subject")),
        ((large >= LEAST_ATTACHMENTS) & any_pattern(domain, [TRADE_DOMAINS]), verdict("bid", "attachments_from_industry_domain")),
    ]
    found = marked.withColumn("__v", first_of(rules, verdict("unclear", "no_signal")))
    return found.select(*df.columns, "__v.verdict", "__v.reason", F.coalesce("__portal", F.lit("email")).alias("source"))


def sort_notices(df: DataFrame, now: Column, *, title: str, description: str, deadline: str, country: str, ours: Mapping[str, Sequence[str]] = OURS, not_ours: Sequence[str] = NOT_OURS) -> DataFrame:
    """df with outcome (review, passed or open), business and reason.

    What holds a word of ours is for review and names the business, the first in
    order, whatever else it says. Otherwise the first of ten reasons passes it over;
    the rest is open. Tags in a description are no text, and its beginning counts.
    Nulls are empty; a null deadline never ends.
    """
    plain = lambda c: F.coalesce(F.col(c), F.lit(""))
    bare = F.substring(F.regexp_replace(plain(description), "<[^>]*>", ""), 1, DESCRIPTION)
    said = once(df, __name=F.trim(plain(title)), __text=F.lower(F.concat(plain(title), F.lit(" "), bare)))
    text, name = F.col("__text"), F.col("__name")
    where = F.upper(plain(country))
    seller = (F.contains(text, F.lit("sole source")) & ~F.contains(text, F.lit("sources sought"))) | holds(text, ONE_SELLER) | text.rlike(r"restricted to .+ \(cage")
    reasons = [
        ("expired", F.col(deadline) < now),
        ("catalog_title", name.rlike(CATALOG_TITLE) & (F.length(name) < 40)),
        ("supply_class_title", name.rlike(CATALOG_NUMBER)),
        ("class_code_title", name.rlike(r"^\d{4}--")),
        ("gate_attendant", F.contains(F.lower(name), F.lit("gate attendant"))),
        ("sole_source", seller),
        ("overseas", holds(text, ABROAD) | ~where.isin("", "US", "USA")),
        ("park_services", holds(text, PARKS)),
        ("opaque_title", opaque(name)),
        ("not_ours", holds(text, [w.lower() for w in not_ours])),
    ]
    business = F.coalesce(*(F.when(holds(text, words), F.lit(b)) for b, words in ours.items()))
    found = said.withColumns({"business": business, "reason": first_of([(c, F.lit(r)) for r, c in reasons], F.lit(None).cast("string"))})
    outcome = F.when(F.col("business").isNotNull(), "review").when(F.col("reason").isNotNull(), "passed").otherwise("open")
    return found.select(*df.columns, outcome.alias("outcome"), "business", F.when(F.col("business").isNull(), F.col("reason")).alias("reason"))
