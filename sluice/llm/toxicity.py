"""Toxicity by weak supervision.

Many voters look at each text: word lists, word lists and word beginnings mined
from labelled rows, and patterns. A generative label model, fitted by expectation
maximisation on how often each combination of votes occurs in the whole corpus,
estimates each voter's accuracy and, given the class, the voters' correlations,
which discount voters that say the same; a human label is one more vote, of estimated
accuracy. The posterior labels of texts with and without a human label train a
linear classifier, which scores every whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import few_rows, give_back, load, remainder, slices, written
from sluice.llm.words import BASE, SLICE, _power, mix

#: The bound: so many distinct labelled texts, and as many of all texts, those that hash lowest, train the classifier. All are mined and counted.
SAMPLE = 16_000
#: Slots of the bitmap of labelled ids, which bounds what is broadcast: 64 in a row. Where they fill up, more texts than labelled ones meet the labels.
SLOTS = 1 << 23
#: Features kept of those rows, in how many of them one must occur, and how many standard errors its log-odds must be from 0.
FEATURES, SUPPORT, ERRORS = 4000, 5, 3.0
#: The same for beginnings that a text has often: there are few of them, so chance makes few that tell, and few labels will do.
OFTEN_SUPPORT, OFTEN_ERRORS = 4, 2.7
#: Log-odds from which a feature counts as mined for a voter, and from which a beginning stands for the words that begin so.
MINED_ODDS, PURE_ODDS = 2.0, 4.0
ROUNDS, STEPS, RATE, DECAY = 30, 1500, 1.0, 0.1
#: Steps end when no weight moves by more.
STILL = 2e-4
#: How often a human label is right, to begin with, and the range in which the estimate stays.
HUMAN, HUMAN_RANGE = 0.99, (0.98, 0.995)
#: What a text without a label weighs beside one with a label, in estimates and in training.
UNLABELLED = 0.1

#: Seed word lists, in lower case, by what they say.
LEXICONS = {
    "stupidity": "idiot idiots idiotic moron morons moronic stupid stupidity dumb dumbass imbecile imbeciles fool fools halfwit cretin dimwit brainless",
    "contempt": "pathetic worthless disgusting loser losers useless despicable repulsive vile contemptible hopeless laughable ugly",
    "dehumanising": "scum trash clown clowns vermin garbage filth filthy parasite parasites pig pigs rat rats subhuman cockroach",
    "abuse": "bitch bastard asshole jerk creep whore slut prick shut hate kill",
    "german": "idiot dummkopf trottel arschloch abschaum versager wertlos dreck drecksau miststück schwachkopf vollidiot hure",
    "french": "idiot imbécile connard connasse salaud salope crétin abruti ordure raclure minable pourriture",
    "spanish": "idiota imbécil estúpido estúpida basura escoria inútil cabrón puta asqueroso asquerosa patético payaso mierda",
}
#: Mined features are dealt to so many voters for each kind.
MINED_VOTERS = 2
#: Words, their first 4 and 5 bytes, and first 4 bytes that a text has in two and in four words at least.
KINDS = ("word", "begins4", "begins5", "twice", "often")
TWICE, OFTEN = 2, 4
#: The last one votes for clean: no list and no pattern has a hit.
PATTERNS = ("several", "shouting", "exclaiming", "nothing")
VOTERS = (*LEXICONS, *(f"{k}{i}" for k in KINDS for i in range(MINED_VOTERS)), *PATTERNS)
EXCLAIM = re.compile(r"!\s?!\s?!")


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, parent): hashes of words of letters, in lower case, of how they begin, and of beginnings that come again.

    The three lowest bits are the kind; the parent of a word is its first four
    bytes, that of what comes again is itself.
    """
    raw = np.frombuffer(("\n".join(texts) + "\n").lower().encode("utf-8", "replace"), np.uint8)
    letter = ((raw >= 97) & (raw <= 122)) | (raw >= 128)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], letter, [False]])))
    starts, ends = edges[::2], edges[1::2]
    # texts hold line ends of their own, so their lengths place them
    sizes = np.cumsum([len(t.lower().encode("utf-8", "replace")) + 1 for t in texts])
    rows = np.searchsorted(sizes, starts, "right")
    power, inverse = _power(len(raw) + 1)
    table = np.random.default_rng(int(BASE) & 0xFFFFFFFF).integers(1, 1 << 63, 256, np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(table[raw] * power[: len(raw)], dtype=np.uint64)])
    out = []
    for kind, most in enumerate((None, 4, 5)):
        stop = ends if most is None else np.minimum(starts + most, ends)
        out.append((mix((sums[stop] - sums[starts]) * inverse[starts] + (stop - starts).astype(np.uint64)) & ~np.uint64(7)) | np.uint64(kind))
    order = np.lexsort((out[1], rows))
    r, begins = rows[order], out[1][order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(r)), bool), (r[1:] != r[:-1]) | (begins[1:] != begins[:-1])]))
    counts = np.diff(np.concatenate([first, [len(r)]]))
    again = [(r[first][counts >= least], (begins[first][counts >= least] & ~np.uint64(7)) | np.uint64(KINDS.index(kind))) for kind, least in (("twice", TWICE), ("often", OFTEN))]
    return np.concatenate([np.tile(rows, 3), *(x for x, _ in again)]), np.concatenate([*out, *(k for _, k in again)]), np.concatenate([np.tile(out[1], 3), *(k for _, k in again)])


def _hash(word: str) -> int:
    return int(features([word])[1][0])


@dataclass
class Toxicity:
    """What is learned: features in order, with their weights and the voters that hold them, and a bias."""

    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    voters: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -3.0
    accuracy: dict = field(default_factory=dict)

    def hits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(text, place of a known feature), each once."""
        rows, keys, _ = features(texts)
        if not len(self.keys):
            return rows[:0], rows[:0]
        marked = np.zeros(1 << 18, bool)
        marked[(self.keys >> np.uint64(40)).astype(np.int64) & 0x3FFFF] = True
        maybe = marked[(keys >> np.uint64(40)).astype(np.int64) & 0x3FFFF]
        rows, keys = rows[maybe], keys[maybe]
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        same = self.keys[at] == keys
        both = np.unique(rows[same] * len(self.keys) + at[same])
        return both // len(self.keys), both % len(self.keys)

    def votes(self, texts: list[str]) -> np.ndarray:
        """A bit for each voter that speaks: others abstain."""
        rows, at = self.hits(texts)
        votes = np.zeros(len(texts), np.int64)
        np.bitwise_or.at(votes, rows, self.voters[at])
        flag = {p: 1 << VOTERS.index(p) for p in PATTERNS}
        votes[np.bincount(rows[self.voters[at] > 0], minlength=len(texts)) >= 3] |= flag["several"]
        for i, text in enumerate(texts):
            if EXCLAIM.search(text):
                votes[i] |= flag["exclaiming"]
            if len(text) >= 20 and text.isupper():
                votes[i] |= flag["shouting"]
        votes[votes == 0] = flag["nothing"]
        return votes

    def scores(self, texts: list[str]) -> np.ndarray:
        rows, at = self.hits(texts)
        return 1 / (1 + np.exp(-np.clip(self.bias + np.bincount(rows, self.weights[at], len(texts)), -30, 30)))


def seeds() -> dict[int, int]:
    """The voters of each seed word's feature."""
    out: dict[int, int] = {}
    for name, words in LEXICONS.items():
        for word in words.split():
            out[_hash(word)] = out.get(_hash(word), 0) | 1 << VOTERS.index(name)
    return out


def mine(labelled: DataFrame) -> list:
    """(feature, the first four bytes' feature, rows that hold it, toxic ones among them, log-odds) of the labelled rows' most telling features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            rows, keys, parents = features(batch.column("text").to_pylist())
            toxic = np.array(batch.column("toxic").to_pylist(), np.int64)
            order = np.lexsort((keys, rows))
            rows, keys, parents = rows[order], keys[order], parents[order]
            once = np.concatenate([np.ones(min(1, len(keys)), bool), (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])])
            names, first, of = np.unique(keys[once], return_index=True, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(parents[once][first].view(np.int64)), pa.array(np.bincount(of, minlength=len(names))), pa.array(np.bincount(of, toxic[rows[once]], len(names)).astype(np.int64))], names=["feature", "parent", "n", "toxic"])

    total, bad = labelled.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    counted = labelled.select("text", "toxic").mapInArrow(run, "feature long, parent long, n long, toxic long").groupBy("feature", "parent").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    often = F.col("feature").bitwiseAND(F.lit(7)) == KINDS.index("often")
    odds = F.log((F.col("toxic") + 0.5) / (F.lit(bad) + 1.0)) - F.log((F.col("n") - F.col("toxic") + 0.5) / (F.lit(total - bad) + 1.0))
    # by how many standard errors the log-odds differ from none
    sure = F.abs("odds") / F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("n") - F.col("toxic") + 0.5))
    enough = F.when(often, (F.col("n") >= OFTEN_SUPPORT) & (F.col("sure") >= OFTEN_ERRORS)).otherwise((F.col("n") >= SUPPORT) & (F.col("sure") >= ERRORS))
    return counted.withColumn("odds", odds).withColumn("sure", sure).where(enough).orderBy(F.desc("sure"), "feature").limit(FEATURES).collect()


def label_model(counts: dict[int, int], gold: dict[tuple[int, int], int], n: int) -> tuple[dict[tuple[int, int], float], dict]:
    """The probability of toxic for each combination of votes and label, -1 for none, and what was estimated.

    counts: how often each combination occurs in the corpus; gold: how often with
    each human label. The human is one more voter, whose two accuracies are
    estimated with the others; it abstains where there is no label.
    """
    known: dict[int, int] = {}
    for (mask, _), times in gold.items():
        known[mask] = known.get(mask, 0) + times
    rows = {(m, -1): max(0, times - known.get(m, 0)) for m, times in (counts or {0: 1}).items()} | gold
    masks, labels, weight = (np.array(c) for c in zip(*((m, y, times) for (m, y), times in sorted(rows.items())), strict=True))
    weight = np.where(labels < 0, UNLABELLED if gold else 1.0, 1.0) * weight
    votes = ((masks[:, None] >> np.arange(n)) & 1).astype(np.float64)
    # a start: labelled combinations by their labels, others by whether more than one voter speaks
    q = np.select([labels == 1, labels == 0], [HUMAN, 1 - HUMAN], np.where(votes.sum(axis=1) >= 2, 0.9, 0.02))
    rates, discount, prior, human = np.zeros((2, n)), np.ones(n), 0.1, [HUMAN, HUMAN]
    correlation = np.eye(n)
    for _ in range(ROUNDS):
        of = np.stack([1 - q, q]) * weight
        prior = float(np.clip(of[1].sum() / max(1.0, of.sum()), 1e-4, 0.9))
        rates = (of @ votes + 0.5) / (of.sum(axis=1, keepdims=True) + 1)
        correlation = np.zeros((n, n))
        for y in (0, 1):
            mean = of[y] @ votes / max(1.0, of[y].sum())
            cov = (votes * of[y][:, None]).T @ votes / max(1.0, of[y].sum()) - np.outer(mean, rates[y]) - np.outer(rates[y], mean) + np.outer(rates[y], rates[y])
            spread = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            correlation += np.clip(cov / np.outer(spread, spread), -1, 1) * of[y].sum() / max(1.0, of.sum())
        np.fill_diagonal(correlation, 1)
        discount = 1 / np.maximum(correlation, 0).sum(axis=0)
        # ten more labels, HUMAN of them right, steady the human's two accuracies
        human = [float(np.clip((of[y][labels == y].sum() + 10 * HUMAN) / (of[y][labels >= 0].sum() + 10), *HUMAN_RANGE)) for y in (0, 1)]
        # a voter's silence is evidence for clean at most: that the one for clean is silent, others say already. A human's is none
        silence = np.minimum(0, np.log((1 - rates[1]) / (1 - rates[0]))) * discount
        evidence = np.log(prior / (1 - prior)) + silence.sum() + votes @ (np.log(rates[1] / rates[0]) * discount - silence)
        evidence += np.select([labels == 1, labels == 0], [np.log(human[1] / (1 - human[0])), np.log((1 - human[1]) / human[0])], 0)
        q = 1 / (1 + np.exp(-np.clip(evidence, -30, 30)))
    found = dict(zip(zip(masks.tolist(), labels.tolist(), strict=True), q.tolist(), strict=True))
    return found, {"prior": prior, "rates": rates, "correlation": correlation, "discount": discount, "human": human}


def fit_linear(rows: np.ndarray, at: np.ndarray, target: np.ndarray, weight: np.ndarray, width: int) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels of weighted texts by accelerated gradient steps, until they hardly move; rows, in order, and at place the features that are there."""
    n, mean = weight.sum(), np.average(target, weights=weight)
    weights, bias = np.zeros(width), float(np.log(np.clip(mean, 1e-3, 0.999) / np.clip(1 - mean, 1e-3, 0.999)))
    moved, moved_bias = np.zeros(width), 0.0
    # sums over runs of one text, and of one feature; one buffer holds what is summed
    begins = lambda runs: np.flatnonzero(np.concatenate([np.ones(min(1, len(runs)), bool), runs[1:] != runs[:-1]]))
    text_starts = begins(rows)
    texts = rows[text_starts]
    order = np.argsort(at, kind="stable")
    of_feature, in_order = rows[order], at[order]
    del order
    feature_starts = begins(in_order)
    features_here = in_order[feature_starts]
    del in_order
    buffer = np.empty(len(rows))
    for _ in range(STEPS):
        linear = np.full(len(target), bias)
        gradient = DECAY * weights
        if len(rows):
            linear[texts] += np.add.reduceat(np.take(weights, at, out=buffer, mode="clip"), text_starts)
        error = (1 / (1 + np.exp(-np.clip(linear, -30, 30))) - target) * weight
        if len(rows):
            gradient[features_here] += np.add.reduceat(np.take(error, of_feature, out=buffer, mode="clip"), feature_starts)
        moved = 0.9 * moved - RATE * gradient / n
        moved_bias = 0.9 * moved_bias - RATE * error.sum() / n
        weights, bias = weights + moved, bias + moved_bias
        if max(np.abs(moved).max(initial=0), abs(moved_bias)) < STILL:
            break
    return weights, bias


def draw(rows: DataFrame) -> DataFrame:
    """SAMPLE distinct rows of doc_id and text, those that hash lowest; only hashes are ordered and sent around."""
    hashed = rows.withColumn("h", F.xxhash64("doc_id", "text"))
    lowest = hashed.select("h").distinct().orderBy("h").limit(SAMPLE)
    return hashed.join(F.broadcast(lowest), "h").dropDuplicates(["h"]).drop("h")


def with_labels(texts: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, text and toxic of labelled texts. A bitmap of the labelled ids, of at most SLOTS / 64 rows, keeps the other texts out of the shuffle."""
    slot = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(SLOTS))
    word, bit = F.floor(slot / 64).cast("int"), (slot % 64).cast("int")
    marked = known.groupBy(word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("marks"))
    likely = texts.withColumn("word", word).join(F.broadcast(marked), "word").where(F.call_function("bit_get", "marks", bit) == 1)
    # a merge join at every size: texts are never broadcast, and labels grow with them
    return likely.select("doc_id", "text").hint("merge").join(known, "doc_id").select("doc_id", "text", "toxic")


def train(documents: DataFrame, labels: DataFrame, text: str = "text") -> Toxicity:
    """What documents (doc_id, text) and labels (doc_id, toxic 0 or 1) teach. Votes are counted over all documents.

    Labelled rows are mined, and their votes counted by label, in full. The label
    model's posteriors of two samples train the classifier: of labelled texts, whose
    label is one vote among the others, and of all texts, by their voters alone.
    Rows with a null id, text or label teach nothing; of labels that repeat an id
    the largest counts. Without labels, the seed lists and patterns vote alone.
    Without any text, seed words have a fixed weight.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("long").alias("toxic"))
    texts = few_rows(documents).select("doc_id", F.col(text).alias("text")).where("text is not null")
    labelled = written(with_labels(texts, known), "toxicity-labelled")

    held = seeds()
    told = mine(labelled)
    # a beginning that tells stands for the words that begin so: they would only share its weight
    telling = {r["feature"] for r in told if r["odds"] >= PURE_ODDS}
    told = [r for r in told if r["parent"] == r["feature"] or r["parent"] not in telling]
    # seed words are features too, however few labels there are
    own = set(held) | {int(r["feature"]) & 0xFFFFFFFFFFFFFFFF for r in told}
    for r in told:
        key = int(r["feature"]) & 0xFFFFFFFFFFFFFFFF
        if r["odds"] >= MINED_ODDS:
            voter = VOTERS.index(f"{KINDS[key & 7]}{(key >> 8) % MINED_VOTERS}")
            held[key] = held.get(key, 0) | 1 << voter
        else:
            held.setdefault(key, 0)
    keys = np.array(sorted(held), np.uint64)
    learned = Toxicity(keys, np.array([held[int(k)] for k in keys], np.int64), np.zeros(len(keys)))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            masks, counts = np.unique(learned.votes(batch.column("text").to_pylist()), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(masks), pa.array(counts)], names=["mask", "n"])

    def vote_by_label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            masks, toxic = learned.votes(batch.column("text").to_pylist()), batch.column("toxic").to_numpy()
            (masks, toxic), counts = np.unique(np.stack([masks, toxic]), axis=1, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(masks), pa.array(toxic), pa.array(counts)], names=["mask", "toxic", "n"])

    # at most 2 ** len(VOTERS) combinations, whatever the corpus holds
    combined = texts.select("text").mapInArrow(vote, "mask long, n long").groupBy("mask").agg(F.sum("n").alias("n")).collect()
    judged = labelled.select("text", "toxic").mapInArrow(vote_by_label, "mask long, toxic long, n long").groupBy("mask", "toxic").agg(F.sum("n").alias("n")).collect()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            own = batch.column("text").to_pylist()
            rows, at = learned.hits(own)
            cuts = np.searchsorted(rows, np.arange(len(own) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(learned.votes(own)), pa.ListArray.from_arrays(pa.array(cuts), pa.array(at.astype(np.int32)))], names=["toxic", "mask", "at"])

    def placed_in(rows: DataFrame) -> pa.Table:
        return rows.select("toxic", "text").mapInArrow(place, "toxic long, mask long, at array<int>").toArrow().combine_chunks()

    # those of all texts have the posterior of their votes alone: -1 for no label
    placed = pa.concat_tables([placed_in(draw(labelled)), placed_in(draw(texts).withColumn("toxic", F.lit(-1).cast("long")))]).combine_chunks()
    masks, toxic = placed["mask"].to_numpy(), placed["toxic"].to_numpy()
    gold = {(r["mask"], r["toxic"]): r["n"] for r in judged}
    posterior, learned.accuracy = label_model({r["mask"]: r["n"] for r in combined}, gold, len(VOTERS))
    if not len(masks):
        spoken = learned.voters > 0
        learned.weights, learned.bias = np.where(spoken, 4.0, 0.0), -2.0
        return learned
    target = np.array([posterior[key] for key in zip(masks.tolist(), toxic.tolist(), strict=True)])
    lists = placed["at"].combine_chunks() if isinstance(placed["at"], pa.ChunkedArray) else placed["at"]
    at = lists.flatten().to_numpy()
    rows = np.repeat(np.arange(len(masks), dtype=np.int32), lists.value_lengths().to_numpy())
    weight = np.where(toxic < 0, UNLABELLED if gold else 1.0, 1.0)
    del placed, lists, masks, toxic
    trained = np.array([int(k) in own for k in keys])[at]
    rows, at = rows[trained], at[trained]
    learned.weights, learned.bias = fit_linear(rows, at, target, weight, len(keys))
    del rows, at, trained
    give_back()
    return learned


def score_toxicity(df: DataFrame, learned: Toxicity, text: str = "text", *, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns keep, then score double in 0 to 1 and predicted int, 1 from a score of 0.5.

    A null or empty text has the score of a text without any feature. Whole texts
    count, whatever their length. Columns outside keep are left out.
    """
    if clash := set(keep) & {"score", "predicted"}:
        raise ValueError(f"keep may not name {sorted(clash)}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text", SLICE):
            score = learned.scores(batch.column("__text").to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=[*keep, "score", "predicted"])

    source = few_rows(df).select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{fields}, score double, predicted int")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", (remainder("doc_id", 5) == 0).alias("held_out"))
    labels = load(spark, sf_dir, "labels").where(remainder("doc_id", 5) != 0)
    return score_toxicity(docs, train(docs, labels), keep=("doc_id", "held_out"))


QUERIES = {"op1_toxicity": op1_toxicity}
