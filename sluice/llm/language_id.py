"""Language identification with hyperdimensional profiles.

Each letter owns a random vector of +1 and -1. An n-gram is bound as the product
of its letters' vectors, each rotated by its place; a text is the sum of its
n-grams, and so is a language's prototype over all its training texts. A text is
compared with the prototypes by cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import few_rows, load, remainder, slices
from sluice.llm.words import mix

DIMENSIONS, GRAM, SEED = 1024, 3, 20240607
#: Bits of a code point; 0 is a word's edge.
POINT_BITS = 21
#: The length that a training text's bundle is given, about.
SCALE = 256
#: How sharply cosines become a score.
SHARPNESS = 40.0
UNKNOWN = "und"


@lru_cache
def letters() -> np.ndarray:
    """Each code point if it is a letter, else 0."""
    is_letter = np.fromiter((chr(p).isalpha() for p in range(0x110000)), bool, 0x110000)
    return np.where(is_letter, np.arange(0x110000), 0)


def letter_vectors(points: np.ndarray) -> np.ndarray:
    """letter x dimension: a vector of +1 and -1 of its own for each code point, from hashed bits."""
    words = mix(mix(points.astype(np.uint64) + np.uint64(SEED))[:, None] + np.arange(DIMENSIONS // 64, dtype=np.uint64))
    return np.unpackbits(words.astype("<u8").view(np.uint8).reshape(len(points), -1), axis=1).astype(np.int8) * 2 - 1


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows, codes, counts) of the n-grams of each text, and which texts have a letter."""
    joined = "".join(f"\n{t}\n" for t in texts)
    points = np.frombuffer(joined.lower().encode("utf-32-le", "replace"), np.uint32)
    # lower-casing may change a text's length, so lengths are taken afterwards
    lengths = np.array([len(t.lower()) + 2 for t in texts])
    rows = np.repeat(np.arange(len(texts)), lengths)
    slots = letters()[points]
    has = np.bincount(rows, slots > 0, minlength=len(texts)) > 0
    # an edge at a text's start and after each word, however much stands between words
    keep = np.concatenate([[True], (slots[1:] > 0) | (slots[:-1] > 0) | (rows[1:] != rows[:-1])])
    slots, rows = slots[keep], rows[keep]
    n = len(slots) - GRAM + 1
    if n <= 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, has
    code = np.zeros(n, np.int64)
    for place in range(GRAM):
        code = code << POINT_BITS | slots[place : place + n]
    inside = (slots[1 : 1 + n] > 0) & (rows[:n] == rows[GRAM - 1 :])
    return *counted(rows[:n][inside], code[inside], np.ones(int(inside.sum()))), has


def counted(rows: np.ndarray, codes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (row, code) with their summed weights."""
    names, at = np.unique(codes, return_inverse=True)
    both, of = np.unique(rows * max(1, len(names)) + at, return_inverse=True)
    return both // max(1, len(names)), names[both % max(1, len(names))], np.bincount(of, weights, len(both))


def bound(codes: np.ndarray) -> np.ndarray:
    """The vector of each n-gram: the product of its letters' vectors, each rotated by its place."""
    out = np.ones((len(codes), DIMENSIONS), np.int8)
    for place in range(GRAM):
        points, at = np.unique(codes >> POINT_BITS * (GRAM - 1 - place) & ((1 << POINT_BITS) - 1), return_inverse=True)
        out *= np.roll(letter_vectors(points), GRAM - 1 - place, axis=1)[at]
    return out


def bundle(rows: np.ndarray, codes: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """The summed n-gram vectors of each of n texts."""
    out = np.zeros((n, DIMENSIONS), np.float32)
    distinct, at = np.unique(codes, return_inverse=True)
    for a in range(0, len(distinct), 8192):
        part = (at >= a) & (at < a + 8192)
        weights = np.zeros((n, len(distinct[a : a + 8192])), np.float32)
        weights[rows[part], at[part] - a] = counts[part]
        out += weights @ bound(distinct[a : a + 8192]).astype(np.float32)
    return out


def language_prototypes(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, dimension int, value long: each language's bundle over all rows of df with a non-null lang.

    Null, empty and letterless texts add nothing. Sums are whole numbers, so the
    result does not depend on how rows are partitioned.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in slices(batches, "text", 1 << 20):
            langs = np.array(batch.column("lang").to_pylist(), object)
            rows, codes, counts, _ = grams(batch.column("text").to_pylist())
            # n-grams' vectors are all but orthogonal: so scaled, texts count alike whatever their length
            size = np.sqrt(np.bincount(rows, counts.astype(np.float64) ** 2, batch.num_rows))
            counts = np.rint(SCALE * counts / np.maximum(size, 1)[rows])
            names, of = np.unique(langs, return_inverse=True)
            summed = bundle(*counted(of[rows], codes, counts), len(names))
            for name, vector in zip(names, summed, strict=True):
                totals[name] = totals.get(name, 0) + np.rint(vector).astype(np.int64)
        for name, vector in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * DIMENSIONS), pa.array(np.arange(DIMENSIONS, dtype=np.int32)), pa.array(vector)], names=["lang", "dimension", "value"])

    source = few_rows(df).select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    parts = source.mapInArrow(run, "lang string, dimension int, value long")
    return parts.groupBy("lang", "dimension").agg(F.sum("value").alias("value"))


def collect_prototypes(prototypes: DataFrame) -> tuple[list[str], np.ndarray]:
    """Names and unit vectors. Their size is languages x DIMENSIONS, whatever the corpus holds."""
    found: dict[str, np.ndarray] = {}
    for row in prototypes.collect():
        found.setdefault(row["lang"], np.zeros(DIMENSIONS))[row["dimension"]] = row["value"]
    names = sorted(k for k, v in found.items() if v.any())
    if not names:
        return [], np.zeros((0, DIMENSIONS), np.float32)
    units = np.stack([found[k] / np.linalg.norm(found[k]) for k in names])
    if len(names) > 1:
        # what all languages share says nothing about which it is
        units = units - units.mean(axis=0)
        units /= np.maximum(np.linalg.norm(units, axis=1, keepdims=True), 1e-9)
    return names, units.astype(np.float32)


def identify_language(df: DataFrame, prototypes: tuple[list[str], np.ndarray], text: str = "text", *, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns keep, then lang_pred string and score double in 0 to 1.

    A null text, or one without a letter, is "und" with score 0; so is every
    text if there are no prototypes. Equal cosines go to the name that sorts
    first. Texts of any length count whole. Columns outside keep are left out.
    """
    if clash := set(keep) & {"lang_pred", "score"}:
        raise ValueError(f"keep may not name {sorted(clash)}")
    names, units = prototypes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = np.array([*names, UNKNOWN], object)
        for batch in slices(batches, "__text", 256 << 10):
            rows, codes, counts, has = grams(batch.column("__text").to_pylist())
            best, score = np.full(batch.num_rows, len(names)), np.zeros(batch.num_rows)
            if names and has.any():
                vectors = bundle(rows, codes, counts, batch.num_rows)
                cosines = (vectors @ units.T) / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
                shares = np.exp(SHARPNESS * (cosines - cosines.max(axis=1, keepdims=True)).astype(np.float64))
                best = np.where(has, cosines.argmax(axis=1), best)
                score = np.where(has, 1 / shares.sum(axis=1), 0.0)
            made = [pa.array(labels[best], pa.string()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *made], names=[*keep, "lang_pred", "score"])

    source = few_rows(df).select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{fields}, lang_pred string, score double")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    learned = collect_prototypes(language_prototypes(docs.where(remainder("doc_id", 4) != 2)))
    held_out = docs.select("doc_id", "text", (remainder("doc_id", 4) == 2).alias("held_out"))
    return identify_language(held_out, learned, keep=("doc_id", "held_out"))


QUERIES = {"op10_language_id": op10_language_id}
