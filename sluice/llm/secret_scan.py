"""Secret scans in DataFrame functions alone.

Three fixed patterns give the base spans. On top of them, candidate strings are
scanned with a sliding window: the counts of the characters in the window are
kept as the window moves, and with them its Shannon entropy. Base spans are cut
out of candidates first. A piece whose highest window passes the bar of its
character class, and that no allow-list entry covers, is a span of kind entropy.

Work grows in proportion to a text, however long a candidate is and however many
spans there are: places are running sums over blocks, spans that touch are found
by binary search, and no array or string grows one element at a time.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import load

#: Kind, pattern, the group whose length counts and its least length. Letters of the keywords in either case, ASCII only.
KINDS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
#: What a text must hold for a kind's matching to be worth while; each matches wherever the kind does.
HINTS = {"assign": r"(?i:passw|secret|token|api_?key)", "access": "AKIA[A-Z0-9]{16}", "hex": "[0-9a-f]{24}"}
ENTROPY = "entropy"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
LEAST = 20
#: Fixed-point units of c * log2(c), so that sums do not drift; bits that hold a count, and counts in a 64-bit word.
UNITS, COUNT_BITS, PER_WORD = 1 << 40, 5, 12
#: Elements that are run through one after the other, and code points that substrings are taken from.
BLOCK, TEXT_BLOCK = 256, 4096
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{LEAST},}}"
WINDOW = 20
#: Character class, its pattern and the bits that the window must reach. The first class that fits counts.
CLASSES = (("hex", r"^[0-9a-fA-F]+$", 3.0), ("upper", r"^[A-Z0-9]+$", 3.6), ("mixed", r"^[A-Za-z0-9+/_=-]+$", 3.7))
#: Candidates that are none: no digit, no letter, a UUID, a path or dashed words, dates and numbers, and well-known samples.
ALLOW = (
    r"^[^0-9]*$",
    r"^[^A-Za-z]*$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^(?!.*([A-Za-z][0-9]|[0-9][A-Za-z]|\+))/?[A-Za-z0-9]",
    r"(?i:EXAMPLE|0123456789abcdef|abcdefghijklmnop|xxxxxxxx)",
)


SPANS = "array<struct<kind:string,start:int,end:int,hit:string>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def _scan(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """What join makes, from 0 on, of all elements before each element, and at last of all: in blocks, then over the blocks."""

    def through(block: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(block, start, lambda acc, x: F.struct(join(acc["at"], x).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")))

    def blocks(v: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda b: through(F.slice(v, b * BLOCK + 1, BLOCK)))
        return F.when(F.size(v) > 0, _let(cut, whole)).otherwise(F.array(F.lit(0)))

    def whole(done: Column) -> Column:
        lifted = lambda over: F.array_append(F.flatten(F.zip_with(done, over["out"], lambda d, o: F.transform(d["out"], lambda x: join(o, x)))), over["at"])
        return _let(through(F.transform(done, lambda d: d["at"])), lifted)

    return _let(values, blocks)


def _running(values: Column) -> Column:
    return _scan(values, lambda a, b: a + b)


def _up_to(ascending: Column, x: Column) -> Column:
    """How many elements are x or less, by binary search."""

    def half(acc: Column, _: Column) -> Column:
        middle = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        right = F.get(ascending, middle) <= x
        open_ = acc["lo"] < acc["hi"]
        return F.struct(F.when(open_ & right, middle + 1).otherwise(acc["lo"]).alias("lo"), F.when(open_ & ~right, middle).otherwise(acc["hi"]).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.size(ascending).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.length(F.bin(F.size(ascending)))), start, half, lambda acc: acc["lo"])


def _matches(text: str, kind: str, pattern: str, group: int, least: int) -> Column:
    """Matches of one kind, in order: the pieces between the matches and the matches themselves give the places."""
    regex = F.lit(pattern)
    whole = F.regexp_extract_all(F.col(text), regex, F.lit(0))
    sized = whole if group == 0 else F.regexp_extract_all(F.col(text), regex, F.lit(group))

    def placed(x: Column) -> Column:
        # the piece after the last match has no match of its own
        gaps = F.zip_with(x["gaps"], x["hits"], lambda gap, hit: F.when(hit.isNotNull(), gap + F.length(hit)).otherwise(0))
        before = F.zip_with(_running(gaps), x["gaps"], lambda at, gap: at + gap)
        starts = F.zip_with(F.zip_with(x["hits"], before, lambda hit, at: F.struct(hit.alias("hit"), at.alias("at"))), x["sized"], lambda m, of: F.struct(F.when(F.length(of) >= least, m["hit"]).alias("hit"), m["at"].alias("at")))
        kept = F.filter(starts, lambda m: m["hit"].isNotNull())
        return F.transform(kept, lambda m: F.struct(F.lit(kind).alias("kind"), m["at"].alias("start"), (m["at"] + F.length(m["hit"])).alias("end"), m["hit"].alias("hit")))

    parts = F.struct(F.transform(F.split(F.col(text), pattern, -1), F.length).alias("gaps"), whole.alias("hits"), sized.alias("sized"))
    return F.when(F.col(text).rlike(HINTS.get(kind, pattern)), _let(parts, placed)).otherwise(F.array().cast(SPANS))


def window_entropy(candidate: Column, window: int = WINDOW) -> Column:
    """The highest Shannon entropy, in bits, of any window of the candidate; a shorter candidate is one window.

    A step adds the character that enters to its count, takes one off that of the
    character that leaves, and corrects the sum of c * log2(c), in whole units, by
    these two. Counts are packed in a few 64-bit words. The window holds fewer
    than 32 characters.
    """
    if not 0 < window < 1 << COUNT_BITS:
        raise ValueError("window must be from 1 to 31")
    weight = F.array(*(F.lit(round(c * math.log2(c) * UNITS) if c > 1 else 0).cast("long") for c in range(window + 2)))
    places = F.transform(F.split(candidate, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)

    def packed(places: Column) -> Column:
        """Where each character's count is: its word, its lowest bit's number, and that bit."""
        shifts = F.transform(places, lambda p: COUNT_BITS * (p % PER_WORD))
        words = F.transform(places, lambda p: F.floor(p / PER_WORD).cast("int"))
        bits = F.transform(shifts, lambda s: F.call_function("shiftleft", F.lit(1).cast("long"), s))
        return F.struct(places.alias("places"), words.alias("words"), shifts.alias("shifts"), bits.alias("bits"), weight.alias("weight"))

    def highest(x: Column) -> Column:
        size = F.least(F.size(x["places"]), F.lit(window))
        zero = F.lit(0).cast("long")
        start = F.struct(F.array(*[zero] * -(-len(ALPHABET) // PER_WORD)).alias("counts"), zero.alias("total"), F.lit((1 << 62)).cast("long").alias("least"))
        count = lambda counts, i: F.call_function("shiftright", F.get(counts, F.get(x["words"], i)), F.get(x["shifts"], i)).bitwiseAND(F.lit((1 << COUNT_BITS) - 1)).cast("int")
        change = lambda c, by: F.get(x["weight"], c + by) - F.get(x["weight"], c)

        def step(acc: Column, i: Column) -> Column:
            old = i - window
            full, same = i >= window, F.get(x["places"], i) == F.get(x["places"], old)
            left = lambda c, k: F.when(full & (k == F.get(x["words"], old)), c - F.get(x["bits"], old)).otherwise(c)
            counts = F.transform(acc["counts"], lambda c, k: left(F.when(k == F.get(x["words"], i), c + F.get(x["bits"], i)).otherwise(c), k))
            total = acc["total"] + change(count(acc["counts"], i), 1) + F.when(full, change(count(acc["counts"], old), -1)).otherwise(zero)
            moved = F.struct(counts.alias("counts"), total.alias("total"), F.when(i >= size - 1, F.least(acc["least"], total)).otherwise(acc["least"]).alias("least"))
            return F.when(full & same, acc).otherwise(moved)

        least = F.aggregate(F.sequence(F.lit(0), F.size(x["places"]) - 1), start, step, lambda acc: acc["least"])
        return F.log2(size.cast("double")) - least / float(UNITS) / size

    return _let(_let(places, packed), highest)


def _suspicious(candidate: Column) -> Column:
    allowed = F.lit(False)
    for pattern in ALLOW:
        allowed = allowed | candidate.rlike(pattern)
    bar = F.lit(99.0)
    for _, pattern, bits in reversed(CLASSES):
        bar = F.when(candidate.rlike(pattern), F.lit(bits)).otherwise(bar)
    return F.when(allowed, F.lit(False)).otherwise(window_entropy(candidate) >= bar)


def _pieces(candidates: Column, kinds: list[Column]) -> Column:
    """array<struct<start,end,hit>>: what base spans, a sorted array for each kind, leave of candidates, in pieces of LEAST characters or more.

    A piece begins where a candidate does or where a base span in it ends, if no
    base span covers that place, and goes to the next base span or the candidate's end.
    """
    bound = F.struct(candidates.alias("c"), F.transform(candidates, lambda c: c["end"]).alias("c_ends"), *(k.alias(f"k{i}") for i, k in enumerate(kinds)), *(F.transform(k, lambda s: s["end"]).alias(f"e{i}") for i, k in enumerate(kinds)))

    def cut(x: Column) -> Column:
        begins = F.transform(x["c"], lambda c: F.struct(c["start"].alias("at"), c.alias("c")))
        after = [F.transform(x[f"e{i}"], lambda e: F.struct(e.alias("at"), F.get(x["c"], _up_to(x["c_ends"], e)).alias("c"))) for i in range(len(kinds))]
        inside = F.filter(F.array_distinct(F.concat(begins, *after)), lambda p: p["c"]["start"] <= p["at"])

        def piece(p: Column) -> Column:
            # of each kind the first span that ends behind the place: it covers the place or is the next one
            nexts = [F.get(x[f"k{i}"], _up_to(x[f"e{i}"], p["at"]))["start"] for i in range(len(kinds))]
            nearest = F.least(p["c"]["end"], *(F.coalesce(n, p["c"]["end"]) for n in nexts))
            return F.struct(p["at"].alias("start"), nearest.alias("end"), p["c"].alias("c"))

        long_ones = F.filter(F.transform(inside, piece), lambda p: p["end"] - p["start"] >= LEAST)
        return F.transform(long_ones, lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), F.when(p["end"] - p["start"] == F.length(p["c"]["hit"]), p["c"]["hit"]).otherwise(F.substring(p["c"]["hit"], p["start"] - p["c"]["start"] + 1, p["end"] - p["start"])).alias("hit")))

    return _let(bound, cut)


def scan_secrets(df: DataFrame, text: str = "text") -> DataFrame:
    """df with base_spans and spans, arrays of struct<kind, start, end> in code points, end exclusive.

    Both are ordered by start and then by kind (assign, access, hex, entropy). A
    null or empty text has none. Entropy spans do not overlap base spans: what
    those leave of a candidate is tested piece by piece. df may not have columns of these names; nothing else of it changes.
    """
    kinds = [f"__secret_{kind}" for kind, *_ in KINDS]
    if clash := {"base_spans", "spans", "__secret_text", "__secret_candidates", *kinds} & set(df.columns):
        raise ValueError(f"df may not have {sorted(clash)}")
    source = df.withColumn("__secret_text", F.coalesce(F.col(text), F.lit("")))
    # most texts have no run that long, and are not split
    candidates = F.when(F.col("__secret_text").rlike(rf"[A-Za-z0-9+/_=-]{{{LEAST}}}"), _matches("__secret_text", "candidate", CANDIDATE, 0, LEAST)).otherwise(F.array().cast(SPANS))
    found = source.withColumns({"__secret_candidates": candidates} | {name: _matches("__secret_text", *k) for name, k in zip(kinds, KINDS, strict=True)})
    plain = lambda spans: F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    base = found.withColumn("base_spans", _ordered(F.concat(*map(plain, kinds))))
    pieces = F.filter(_pieces(F.col("__secret_candidates"), [F.col(k) for k in kinds]), lambda p: _suspicious(p["hit"]))
    extra = F.when(F.size("__secret_candidates") > 0, F.transform(pieces, lambda p: F.struct(F.lit(ENTROPY).alias("kind"), p["start"].alias("start"), p["end"].alias("end"))))
    both = base.withColumn("spans", F.when(F.size(extra) > 0, _ordered(F.concat("base_spans", extra))).otherwise(F.col("base_spans")))
    return both.drop("__secret_text", "__secret_candidates", *kinds)


def _ordered(spans: Column) -> Column:
    place = F.create_map(*(x for i, k in enumerate([*(k[0] for k in KINDS), ENTROPY]) for x in (F.lit(k), F.lit(i))))
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), place[s["kind"]].alias("place"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def redact(df: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """df with each span of its text replaced by [kind]. Spans are in order of their start; where they overlap, the first one's name stands for all. A null text stays null."""

    def between(blocks: Column, begin: Column, end: Column) -> Column:
        """Code points begin to end, from blocks of TEXT_BLOCK of them."""
        first, last = (F.floor(x / TEXT_BLOCK).cast("int") for x in (begin, end))
        part = lambda block, a, b: F.coalesce(F.substring(F.get(blocks, block), a + 1, b - a), F.lit(""))
        head = part(first, begin % TEXT_BLOCK, F.when(first == last, end % TEXT_BLOCK).otherwise(F.lit(TEXT_BLOCK)))
        middle = F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
        return F.concat(head, F.when(first < last, F.concat(middle, part(last, F.lit(0), end % TEXT_BLOCK))).otherwise(F.lit("")))

    def clean(x: Column) -> Column:
        # where what earlier spans cover ends
        covered = _scan(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b))
        named = F.zip_with(spans, F.slice(covered, F.lit(1), F.size(spans)), lambda s, c: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), c.alias("after")))
        leading = F.filter(named, lambda s: s["start"] >= s["after"])
        parts = F.transform(leading, lambda s: F.concat(between(x["blocks"], s["after"], s["start"]), F.lit("["), s["kind"], F.lit("]")))
        return F.concat(F.array_join(parts, ""), between(x["blocks"], F.element_at(covered, -1), F.length(F.col(text))))

    blocks = F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{TEXT_BLOCK}}}"), F.lit(0))
    return df.withColumn(text, F.when(F.size(spans) > 0, _let(F.struct(blocks.alias("blocks")), clean)).otherwise(F.col(text)))


def listed(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of(kind: str):
    return lambda s: s["kind"] == kind


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(load(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(F.filter("base_spans", _of(kind))).cast("long").alias(f"n_{kind}") for kind, *_ in KINDS]
    return found.select("doc_id", *counts, F.sha2(listed("base_spans").cast("binary"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def _kind_sql(place: int, kind: str, pattern: str, group: int, least: int) -> str:
    p = "'" + pattern.replace("'", "''") + "'"
    return f"SELECT doc_id, {place} AS place, '{kind}' AS kind, {least} AS least, regexp_extract_all(t, {p}, 0) AS hits, regexp_extract_all(t, {p}, {group}) AS sized, string_split_regex(t, {p}) AS gaps FROM d WHERE regexp_matches(t, {p})"


QUERIES = {"op5_secret_scan": op5_secret_scan}
ORACLE_SQL = {
    "op5_secret_scan": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents
), m AS ({" UNION ALL ".join(_kind_sql(i, *k) for i, k in enumerate((*KINDS, ("candidate", CANDIDATE, 0, LEAST))))}
), e AS (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM m
), s AS (
  SELECT doc_id, place, kind, hits[i] AS hit,
         CAST(list_sum(list_transform(gaps[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s
  FROM e WHERE length(sized[i]) >= least
), base AS (SELECT *, s + length(hit) AS e FROM s WHERE kind <> 'candidate'
), cand AS (SELECT *, s + length(hit) AS e FROM s WHERE kind = 'candidate'
), points AS (
  SELECT doc_id, s AS c_start, e AS c_end, hit, s AS pos FROM cand
  UNION SELECT c.doc_id, c.s, c.e, c.hit, b.e FROM cand c JOIN base b ON b.doc_id = c.doc_id AND b.e >= c.s AND b.e < c.e
), cut AS (
  SELECT p.doc_id, p.pos, p.c_start, p.hit, least(any_value(p.c_end), coalesce(min(b.s), any_value(p.c_end))) AS e
  FROM points p LEFT JOIN base b ON b.doc_id = p.doc_id AND b.e > p.pos
  GROUP BY p.doc_id, p.pos, p.c_start, p.hit
  HAVING coalesce(min(b.s) > p.pos, true)
), piece AS (
  SELECT doc_id, pos AS s, e, substr(hit, CAST(pos - c_start + 1 AS BIGINT), CAST(e - pos AS BIGINT)) AS w FROM cut WHERE e - pos >= {LEAST}
), odd AS (
  SELECT * FROM piece
  WHERE regexp_matches(w, '[0-9]') AND regexp_matches(w, '[A-Za-z]')
    AND NOT regexp_matches(w, '{ALLOW[2]}') AND NOT regexp_matches(w, '{ALLOW[4]}')
    AND NOT (regexp_matches(w, '^/?[A-Za-z0-9]') AND NOT regexp_matches(w, '[A-Za-z][0-9]|[0-9][A-Za-z]|\\+'))
), entropy AS (
  SELECT doc_id, s, e FROM odd
  WHERE list_max(list_transform(range(1, length(w) - {WINDOW} + 2), lambda i: list_aggregate(string_split(substr(w, i, {WINDOW}), ''), 'entropy')))
        >= CASE {" ".join(f"WHEN regexp_matches(w, '{pattern}') THEN {bits}" for _, pattern, bits in CLASSES)} ELSE 99 END
), whole AS (
  SELECT doc_id, place, kind, s, e FROM base UNION ALL SELECT doc_id, 9, '{ENTROPY}', s, e FROM entropy
), listed AS (
  SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k[0]}') AS n_{k[0]}" for k in KINDS)},
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, place) FILTER (place < 9) AS base,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, place) AS spans
  FROM whole GROUP BY doc_id
)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k[0]}, 0) AS n_{k[0]}" for k in KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN listed l ON l.doc_id = d.doc_id
"""
}
