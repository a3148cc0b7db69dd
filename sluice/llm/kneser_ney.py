"""Interpolated modified Kneser-Ney model of any order from 2: counted in Spark, kept as sorted hash arrays, memory-mapped for scoring.

One pass over the training texts counts n-grams in chunks. A chunk's n-grams go
out as one packed run for each shard: its distinct words once, places among them
and counts, compressed. A shard merges its runs, writes its n-grams as an array of
sorted 64-bit hashes with their counts and, from order 3, what follows each of
their contexts, and sends on the distinct shorter n-grams behind the first word,
counted by the words before them. That repeats down to pairs, whose shards send on
what they know of each word: its count, its numbers of followers seen once, twice
or more, and the number of distinct words before it. Word shards add these up and
write sorted arrays too. Workers map the files and look up a batch's n-grams.

Neither a chunk, a shard nor a batch grows with the corpus; their number does. A
word's pairs are spread over an eighth of all shards, so that frequent words do
not gather in one; so are longer n-grams with the same middle, by their first
word. Only what follows one context of two or more words stays together.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import few_rows, file_system, fresh_path, load, remainder, slices
from sluice.llm.words import SLICE, mix, word_hashes

#: Tokens that a task counts together, and about the most pairs in a shard.
CHUNK_TOKENS, SHARD_PAIRS = 2_000_000, 4_000_000
BASE_ADD = 0.1
START, END = (np.uint64(mix(np.array([k], np.uint64))[0]) for k in (0xB0, 0xE0))


def pair_hashes(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(u * np.uint64(0x9FB21C651E98DF25) + (w ^ (w >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93))


def pair_shards(u: np.ndarray, w: np.ndarray, shards: int) -> np.ndarray:
    """A word's pairs are in an eighth of the shards, by the second word."""
    spread = np.uint64(-(-shards // 8))
    return (((u >> np.uint64(20)) + (w >> np.uint64(20)) % spread * np.uint64(8)) % np.uint64(shards)).astype(np.int64)


def word_shards(w: np.ndarray, shards: int) -> np.ndarray:
    return ((w >> np.uint64(24)) % np.uint64(shards)).astype(np.int64)


def gram_keys(columns: list[np.ndarray]) -> np.ndarray:
    return reduce(pair_hashes, columns)


def gram_shards(columns: list[np.ndarray], shards: int) -> np.ndarray:
    """From three words on, whatever follows a context is in its shard."""
    if len(columns) == 2:
        return pair_shards(*columns, shards)
    return pair_shards(gram_keys(columns[1:-1]), columns[0], shards)


def tokens_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Every token of the texts, a text's end included, and how many each has."""
    words, counts = word_hashes(texts)
    lengths = counts + 1
    ends = np.cumsum(lengths)
    tokens = np.full(int(ends[-1]) if len(ends) else 0, END, np.uint64)
    inside = np.ones(len(tokens), bool)
    inside[ends - 1] = False
    tokens[inside] = words
    return tokens, lengths


def grams(tokens: np.ndarray, lengths: np.ndarray, order: int, start: int) -> list[np.ndarray]:
    """The words before every token, the farthest first, and the tokens; before a text there are starts only."""
    columns = [tokens]
    for _ in range(order - 1):
        before = np.roll(columns[0], 1)
        before[np.cumsum(lengths) - lengths] = start
        columns.insert(0, before)
    return columns


def distinct(columns: list[np.ndarray], size: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows of columns of numbers below size, in order, and how often each is there."""
    if size ** len(columns) < 1 << 64:
        keys, counts = np.unique(reduce(lambda a, b: a * np.uint64(size) + b, (c.astype(np.uint64) for c in columns)), return_counts=True)
        out: list[np.ndarray] = []
        for _ in columns[1:]:
            keys, last = np.divmod(keys, np.uint64(size))
            out.insert(0, last)
        return [keys, *out], counts
    order, first = _rows(columns)
    return [c[order][first] for c in columns], np.diff(np.append(first, len(order)))


def _rows(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows, and where in it each distinct one begins."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(max(0, len(order) - 1), bool)
    for c in columns:
        new |= c[order][1:] != c[order][:-1]
    return order, np.flatnonzero(np.concatenate([np.ones(min(1, len(order)), bool), new]))


def squeezed(arrays: list[np.ndarray]) -> bytes:
    """Arrays of equal length, compressed byte by byte of their numbers: high bytes are mostly 0."""
    planes = np.stack(arrays).astype("<u8").view(np.uint8).reshape(len(arrays), -1, 8)
    return pa.compress(np.ascontiguousarray(planes.transpose(0, 2, 1)), codec="zstd", asbytes=True)


def stretched(data: bytes, arrays: int, length: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, decompressed_size=arrays * length * 8, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(arrays, 8, length).transpose(0, 2, 1)).view("<u8").reshape(arrays, length)


def merged(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, with the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
    return (keys[first], *(np.add.reduceat(v[order], first) if len(first) else v[:0] for v in values))


def _cut(shard: np.ndarray, order: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each shard with the places that order gives it."""
    own, starts = np.unique(shard[order], return_index=True)
    yield from zip(own.tolist(), np.split(order, starts[1:]), strict=False)


#: n-grams of a chunk: its distinct words; places of each n-gram's words, the first as steps, and values.
RUN = "shard int, size long, words binary, grams binary, times array<long>"
RUN_KINDS = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())]


def packed(words: np.ndarray, columns: list[np.ndarray], values: list[np.ndarray], shards: int, times: list[int]) -> Iterator[tuple]:
    """A run for each shard of n-grams, whose columns are places in words and in order; the first one takes times."""
    shard = gram_shards([words[c] for c in columns], shards)
    for s, own in _cut(shard, np.argsort(shard, kind="stable")):
        used, places = np.unique(np.concatenate([c[own] for c in columns]), return_inverse=True)
        first, *rest = places.reshape(len(columns), -1)
        yield s, len(own), words[used].tobytes(), squeezed([np.diff(first, prepend=0), *rest, *(v[own] for v in values)]), times
        times = [0] * len(times)


def unpacked(group: list[dict], order: int, values: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The words of the n-grams of all runs, and their values."""
    parts = []
    for r in group:
        arrays = stretched(r["grams"], order + values, r["size"])
        own = np.frombuffer(r["words"], "<u8")
        parts.append([own[np.cumsum(arrays[0])], *(own[a] for a in arrays[1:order]), *arrays[order:].astype(np.int64)])
    whole = [np.concatenate(c) for c in zip(*parts, strict=True)]
    return whole[:order], whole[order:]


def count_grams(texts: DataFrame, order: int, shards: int) -> DataFrame:
    """Packed runs of the n-grams of text with their counts, a run for each chunk and shard."""

    def of(held: list[tuple]) -> pa.RecordBatch:
        tokens, lengths = (np.concatenate(x) for x in zip(*held, strict=True))
        words, places = np.unique(np.append(tokens, START), return_inverse=True)
        columns, counts = distinct(grams(places[:-1], lengths, order, places[-1]), len(words))
        return _batch(packed(words, columns, [counts], shards, []), RUN, RUN_KINDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tokens = [], 0
        for batch in slices(batches, "text", SLICE):
            held.append(tokens_of(batch.column("text").cast(pa.binary()).to_pylist()))
            tokens += len(held[-1][0])
            if tokens >= CHUNK_TOKENS:
                yield of(held)
                held, tokens = [], 0
        if tokens:
            yield of(held)

    return texts.mapInArrow(run, RUN)


def store(folder: str, name: str, arrays: list[np.ndarray]) -> None:
    """Writes arrays, one after the other behind their lengths, then gives the file its name: a repeated attempt puts the same in its place."""
    files, base = file_system(folder)
    files.create_dir(base, recursive=True)
    attempt = f"{base}/{name}.{TaskContext.get().taskAttemptId()}"
    with files.open_output_stream(attempt, compression=None) as out:
        out.write(np.array([len(arrays), *(len(a) for a in arrays)], "<i8").tobytes())
        for a in arrays:
            out.write(a.tobytes() + b"\0" * (-a.nbytes % 8))
    files.move(attempt, f"{base}/{name}")


#: What a worker has mapped of the model that it scores with.
_mapped: dict[str, dict[str, list[np.ndarray]]] = {}


def mapped(folder: str, name: str, kinds: tuple[str, ...]) -> list[np.ndarray]:
    """The arrays of a stored file, memory-mapped once for each worker and model; another model's are let go."""
    if folder not in _mapped:
        _mapped.clear()
        _mapped[folder] = {}
    if name not in _mapped[folder]:
        _mapped[folder][name] = _map(folder, name, kinds)
    return _mapped[folder][name]


def _map(folder: str, name: str, kinds: tuple[str, ...]) -> list[np.ndarray]:
    """A file that is not local is copied first, and the copy has no name once it is mapped."""
    from pyarrow import fs

    files, base = file_system(folder)
    path = f"{base}/{name}"
    if not isinstance(files, fs.LocalFileSystem):
        with tempfile.NamedTemporaryFile(delete=False) as copy, files.open_input_stream(path, compression=None) as source:
            while block := source.read(8 << 20):
                copy.write(block)
        path = copy.name
    whole = np.memmap(path, np.uint8, "r")
    if not isinstance(files, fs.LocalFileSystem):
        os.unlink(path)
    n = int(whole[:8].view("<i8")[0])
    at, out = 8 * (n + 1), []
    for length, kind in zip(whole[8:at].view("<i8").tolist(), kinds, strict=True):
        size = length * np.dtype(kind).itemsize
        out.append(whole[at : at + size].view(kind))
        at += size + -size % 8
    return out


PAIR_KINDS = ("<u8", "|u1", "<i8", "<i8")
CONTEXT_KINDS = ("<u8", *["|u1"] * 4, *["<i8"] * 5)
WORD_KINDS = ("<u8", *["<i8"] * 6)
PARTIAL = "shard int, is_context boolean, words binary, stats binary, times array<long>"


def merged_runs(group: list[dict], order: int, values: int, folder: str) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, list[int]]:
    """Writes a shard's n-grams in the order of their hashes: columns, counts, counts as they stand in texts, and how many counts of each order down to this are 1, 2, 3 and 4."""
    columns, (counts, *raw) = unpacked(group, order, values)
    keys = gram_keys(columns)
    at = np.argsort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[at][1:] != keys[at][:-1]]))
    keys, columns = keys[at][first], [c[at][first] for c in columns]
    counts, stand = (np.add.reduceat(v[at], first) for v in (counts, raw[0] if raw else counts))
    many = np.flatnonzero(counts >= 255)
    store(folder, f"{order}-grams-{group[0]['shard']:06d}", [keys, np.minimum(counts, 255).astype(np.uint8), many, counts[many]])
    times = np.sum([r["times"] for r in group], axis=0).astype(int).tolist()
    return columns, counts, stand, times + [int((counts == k).sum()) for k in (1, 2, 3, 4)]


def merge_grams(runs: DataFrame, folder: str, order: int, values: int, shards: int) -> DataFrame:
    """Writes each shard's n-grams and what follows their contexts, and returns packed runs of the n-grams behind the first words, with how many words are before them."""

    def of(group: list[dict]) -> Iterator[tuple]:
        columns, counts, stand, times = merged_runs(group, order, values, folder)
        keys, *stats = merged(gram_keys(columns[:-1]), counts, counts == 1, counts == 2, counts >= 3)
        many = np.flatnonzero(stats[0] >= 255)
        store(folder, f"{order}-contexts-{group[0]['shard']:06d}", [keys, *(np.minimum(x, 255).astype(np.uint8) for x in stats), many, *(x[many].astype(np.int64) for x in stats)])
        words, places = np.unique(np.concatenate(columns[1:]), return_inverse=True)
        shorter = list(places.reshape(order - 1, -1))
        at, first = _rows(shorter)
        before = np.diff(np.append(first, len(at)))
        yield from packed(words, [c[at][first] for c in shorter], [before, np.add.reduceat(stand[at], first)], shards, times)

    return _by_shard(runs, shards, of, RUN, RUN_KINDS)


def merge_pairs(runs: DataFrame, folder: str, values: int, shards: int, words: int) -> DataFrame:
    """Writes each shard's pairs in the order of their hashes, and returns packed parts of what they tell of words."""

    def of(group: list[dict]) -> Iterator[tuple]:
        (u, w), counts, stand, times = merged_runs(group, 2, values, folder)
        context = merged(u, counts, counts == 1, counts == 2, counts >= 3)
        following = merged(w, np.ones(len(w), np.int64), stand)
        for is_context, table in ((True, context), (False, following)):
            shard = word_shards(table[0], words)
            for s, own in _cut(shard, np.argsort(shard, kind="stable")):
                yield s, is_context, table[0][own].tobytes(), squeezed([c[own] for c in table[1:]]), times
                times = [0] * len(times)

    return _by_shard(runs, shards, of, PARTIAL, [pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.list_(pa.int64())])


def _by_shard(rows: DataFrame, shards: int, of: Callable, schema: str, kinds: list[pa.DataType]) -> DataFrame:
    return rows.repartitionById(shards, "shard").sortWithinPartitions("shard").mapInArrow(_grouped(of, schema, kinds), schema)


def _batch(rows: Iterator[tuple], schema: str, kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in schema.split(", ")])


def _grouped(of: Callable, schema: str, kinds: list[pa.DataType]) -> Callable:
    """A function for mapInArrow that calls of with the rows of each shard; they come one shard after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if group and row["shard"] != group[0]["shard"]:
                    yield _batch(of(group), schema, kinds)
                    group = []
                group.append(row)
        if group:
            yield _batch(of(group), schema, kinds)

    return run


SUMMARY = "shard int, tokens long, words long, pairs long, before_counts array<long>, times array<long>"


def merge_words(parts: DataFrame, folder: str, words: int) -> DataFrame:
    """Writes each word shard's table in the order of the words' hashes; returns one row of sums for each."""

    def of(group: list[dict]) -> Iterator[tuple]:
        columns: list[list[np.ndarray]] = [[] for _ in range(7)]
        for r in group:
            own = np.frombuffer(r["words"], "<u8")
            stats = stretched(r["stats"], 4 if r["is_context"] else 2, len(own)).astype(np.int64)
            zero = np.zeros(len(own), np.int64)
            for k, c in enumerate([own, *stats, zero, zero] if r["is_context"] else [own, zero, zero, zero, zero, *stats]):
                columns[k].append(c)
        table = merged(*(np.concatenate(c) for c in columns))
        store(folder, f"words-{group[0]['shard']:06d}", list(table))
        *_, before, count = table
        # the start is a context only; each text's end is a token
        yield group[0]["shard"], int(count.sum()), int((before > 0).sum()), int(before.sum()), [int((before == k).sum()) for k in (1, 2, 3, 4)] + [int((before >= 3).sum())], np.sum([r["times"] for r in group], axis=0).tolist()

    return _by_shard(parts, words, of, SUMMARY, [pa.int32(), *[pa.int64()] * 3, pa.list_(pa.int64()), pa.list_(pa.int64())])


def discounts(n: list[int]) -> np.ndarray:
    """What is taken off counts of 0, 1, 2 and 3 or more, from how many counts are 1, 2, 3 and 4."""
    n1, n2, n3, n4 = n
    if not (n1 and n2):
        return np.array([0.0, 0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.array([0.0, *(min(max(d, 0.1), k) for k, d in zip((1, 2, 3), raw, strict=True))])


@dataclass(frozen=True)
class Model:
    """Where the arrays lie, and the sums over the training texts."""

    folder: str
    order: int
    shards: int
    held: dict[str, frozenset[int]]
    tokens: int
    words: int
    pairs: int
    before_counts: tuple[int, ...]
    #: How many counts are 1, 2, 3 and 4, the highest order first.
    times: tuple[int, ...]

    def lookup(self, kind: str, shard: np.ndarray, keys: np.ndarray, kinds: tuple[str, ...]) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
        """For each shard: which of keys it holds, their places in its arrays, and the arrays."""
        for s, own in _cut(shard, np.lexsort((keys, shard))):
            if s not in self.held[kind]:
                continue
            arrays = mapped(self.folder, f"{kind}-{s:06d}", kinds)
            at = np.minimum(np.searchsorted(arrays[0], keys[own]), len(arrays[0]) - 1)
            hit = arrays[0][at] == keys[own]
            yield own[hit], at[hit], arrays

    def word_stats(self, keys: np.ndarray) -> np.ndarray:
        """stat x word: followers counted, seen once, twice, more often, distinct words before, and the count."""
        out = np.zeros((6, len(keys)), np.int64)
        for own, at, arrays in self.lookup("words", word_shards(keys, self.shards), keys, WORD_KINDS):
            for k in range(6):
                out[k, own] = arrays[k + 1][at]
        return out

    def gram_count(self, shard: np.ndarray, keys: np.ndarray, order: int) -> np.ndarray:
        out = np.zeros(len(keys), np.int64)
        for own, at, (_, counts, many, more) in self.lookup(f"{order}-grams", shard, keys, PAIR_KINDS):
            found = counts[at].astype(np.int64)
            high = found == 255
            found[high] = more[np.searchsorted(many, at[high])]
            out[own] = found
        return out

    def context_stats(self, shard: np.ndarray, keys: np.ndarray, order: int) -> np.ndarray:
        """stat x context: followers counted, seen once, twice and more often."""
        out = np.zeros((4, len(keys)), np.int64)
        for own, at, (_, *small, many, total, once, twice, often) in self.lookup(f"{order}-contexts", shard, keys, CONTEXT_KINDS):
            high = np.flatnonzero(small[0][at] == 255)
            place = np.searchsorted(many, at[high])
            for k, more in enumerate((total, once, twice, often)):
                found = small[k][at].astype(np.int64)
                found[high] = more[place]
                out[k, own] = found
        return out

    def interpolated(self, order: int, seen: np.ndarray, stats: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """The probability at an order; where the context is new, that of the lower order."""
        at = 4 * (self.order - order)
        high = discounts(list(self.times[at : at + 4]))
        total, once, twice, often = stats
        rest = high[1] * once + high[2] * twice + high[3] * often
        return np.where(total > 0, (seen - high[np.minimum(seen, 3)] + rest * lower) / np.maximum(total, 1), lower)

    def score(self, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log10 probability, base log10 probability and training count of each token, the last of columns."""
        before, after = columns[-2:]
        words, place = np.unique(np.concatenate([before, after]), return_inverse=True)
        stats = self.word_stats(words)
        u, w = place[: len(before)], place[len(before) :]
        count = stats[5]
        low = discounts(list(self.before_counts[:4]))
        uniform = 1 / (self.words + 1)
        kept = stats[4] - low[np.minimum(stats[4], 3)]
        spare = low[1] * self.before_counts[0] + low[2] * self.before_counts[1] + low[3] * self.before_counts[4]
        continued = (kept + spare * uniform) / self.pairs if self.pairs else np.full(len(words), uniform)
        pairs, at, inverse = np.unique(u.astype(np.int64) * len(words) + w, return_index=True, return_inverse=True)
        seen = self.gram_count(pair_shards(before[at], after[at], self.shards), pair_hashes(before[at], after[at]), 2)
        p = self.interpolated(2, seen, stats[:4, pairs // len(words)], continued[pairs % len(words)])[inverse]
        for order in range(3, self.order + 1):
            own = columns[-order:]
            shard, context = gram_shards(own, self.shards), gram_keys(own[:-1])
            p = self.interpolated(order, self.gram_count(shard, pair_hashes(context, own[-1]), order), self.context_stats(shard, context, order), p)
        base = np.log10((count + BASE_ADD) / (self.tokens + BASE_ADD * (self.words + 1)))
        return np.log10(p), base[w], count[w]


def train(texts: DataFrame, text: str = "text", order: int = 2) -> Model:
    """The model of all rows of texts; null counts as empty, which is an end after a start. Files stay in the shared folder."""
    if order < 2:
        raise ValueError("order must be 2 or more")
    spark = texts.sparkSession
    plain = few_rows(texts).select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    folder = fresh_path(spark, "kneser-ney")
    # an upper bound of the tokens, from the size of the texts alone
    size = plain.agg(F.sum(F.octet_length("text") / 2 + 1)).first()[0] or 0
    shards = max(1, -(-int(size) // (3 * SHARD_PAIRS // 2)))
    runs, values = count_grams(plain, order, shards), 1
    for longer in range(order, 2, -1):
        runs, values = merge_grams(runs, folder, longer, values, shards), 2
    parts = merge_pairs(runs, folder, values, shards, shards)
    sums = merge_words(parts, folder, shards).collect()  # a row for each shard
    add = lambda c: sum(r[c] for r in sums)
    each = lambda c, n: tuple(sum(r[c][k] for r in sums) for k in range(n))
    kinds = ["words", "2-grams", *(f"{n}-{kind}" for n in range(3, order + 1) for kind in ("grams", "contexts"))]
    held = {kind: frozenset(stored_shards(folder, f"{kind}-")) for kind in kinds}
    return Model(folder, order, shards, held, add("tokens"), add("words"), add("pairs"), each("before_counts", 5), each("times", 4 * (order - 1)))


def stored_shards(folder: str, prefix: str) -> list[int]:
    """Numbers of the shards whose files are in folder."""
    from pyarrow import fs

    files, base = file_system(folder)
    found = files.get_file_info(fs.FileSelector(base, allow_not_found=True))
    return [int(f.base_name.removeprefix(prefix)) for f in found if f.base_name.startswith(prefix) and "." not in f.base_name]


def score_texts(df: DataFrame, model: Model, text: str = "text", *, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns keep, then n_tokens, n_known, train_tokens, base_score and score of each whole text.

    score is the sum of the model's log10 probabilities, base_score that of the
    smoothed word frequencies. A null text counts as empty: its end alone. With no
    training text every token has the same probability. Columns outside keep are
    left out.
    """
    names = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    if clash := set(keep) & set(names):
        raise ValueError(f"keep may not name {sorted(clash)}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text", SLICE):
            tokens, lengths = tokens_of(batch.column("__text").cast(pa.binary()).to_pylist())
            score, base, count = model.score(grams(tokens, lengths, model.order, START))
            starts = np.cumsum(lengths) - lengths
            sums = [pa.array(lengths), pa.array(np.add.reduceat((count > 0).astype(np.int64), starts)), pa.array(np.full(len(lengths), model.tokens)), pa.array(np.add.reduceat(base, starts)), pa.array(np.add.reduceat(score, starts))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *sums], names=[*keep, *names])

    source = few_rows(df).select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{fields}, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op3_kneser_ney(spark: SparkSession, sf_dir: str, order: int = 2) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", (remainder("doc_id", 10) == 0).alias("held_out"))
    return score_texts(docs, train(docs.where("not held_out"), order=order), keep=("doc_id", "held_out"))


QUERIES = {"op3_kneser_ney": op3_kneser_ney, "op3_kneser_ney_3": partial(op3_kneser_ney, order=3)}
