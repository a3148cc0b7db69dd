"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Each merge rank owns a bucket of positions in a doubly linked list of tokens. A
bitmap marks the ranks whose bucket holds anything; bitmaps over its 64-bit
words lead up to a single word, so find-first-set on one word per level gives
the lowest rank. A bucket entry whose pair has changed since is stale and is
skipped. Many pre-tokens share one list, with separators that never merge, so
the work is linear in their bytes however long a pre-token is.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import few_rows, load, slices, tokenizer_file

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: A pair of ids is one integer; the largest low half marks a separator.
PAIR_BITS = 20
SEPARATOR = (1 << PAIR_BITS) - 1
#: Pre-tokens kept with their ids in a generation of a worker's. Longer ones than KEEP_CHARS are encoded each time.
KEEP, KEEP_CHARS = 400_000, 48


class RankQueue:
    """Buckets of positions by rank, with find-first-set over a hierarchy of 64-bit words."""

    def __init__(self, ranks: int) -> None:
        self.levels: list[list[int]] = []
        size = max(1, ranks)
        while not self.levels or size > 1:
            size = (size + 63) >> 6
            self.levels.append([0] * size)
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(position)
            return
        self.buckets[rank] = [position]
        self._mark(rank)

    def put(self, rank: int, positions: list[int]) -> None:
        if rank in self.buckets:
            self.buckets[rank] += positions
        else:
            self.buckets[rank] = positions
            self._mark(rank)

    def _mark(self, i: int) -> None:
        for words in self.levels:
            before = words[i >> 6]
            words[i >> 6] = before | 1 << (i & 63)
            if before:
                return
            i >>= 6

    def pop(self) -> tuple[int, list[int]] | None:
        """The lowest rank and its positions from left to right, both taken out."""
        i = 0
        for words in reversed(self.levels):
            word = words[i]
            if not word:
                return None
            i = (i << 6) + (word & -word).bit_length() - 1
        rank = i
        for words in self.levels:
            words[i >> 6] &= ~(1 << (i & 63))
            if words[i >> 6]:
                break
            i >>= 6
        bucket = self.buckets.pop(rank)
        bucket.sort()
        return rank, bucket


class ByteBPE:
    """Encodes as the tiktoken library does: a pre-token in the vocabulary is one id, others merge by rank."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex

        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.n = max(self.ranks.values()) + 1
        self.bytes: list[bytes] = [b""] * self.n
        for token, rank in self.ranks.items():
            self.bytes[rank] = token
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    self.pairs[a << PAIR_BITS | b] = rank
        self.first = np.full((256, 256), -1, np.int64)
        for token, rank in self.ranks.items():
            if len(token) == 2:
                self.first[token[0], token[1]] = rank
        self.find = regex.compile(pattern).findall
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.sizes = np.array([len(b) for b in self.bytes], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of each piece by merges alone."""
        if not pieces:
            return []
        raw = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
        ends = np.cumsum([len(p) + 1 for p in pieces]) - 1
        ids = self.single[raw]
        ids[ends] = SEPARATOR
        ranks = np.full(len(raw), -1, np.int64)
        ranks[:-1] = self.first[raw[:-1], raw[1:]]
        ranks[ends] = -1
        ranks[ends[ends > 0] - 1] = -1
        token, now = ids.tolist(), ranks.tolist()
        n = len(token)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = RankQueue(self.n)
        live = np.flatnonzero(ranks >= 0)
        live = live[np.argsort(ranks[live], kind="stable")]
        of, starts = np.unique(ranks[live], return_index=True)
        for rank, positions in zip(of.tolist(), np.split(live, starts[1:]), strict=False):
            queue.put(rank, positions.tolist())
        pairs, bucket_of = self.pairs.get, queue.buckets.get
        while (found := queue.pop()) is not None:
            rank, positions = found
            high = rank << PAIR_BITS
            for k, at in enumerate(positions):
                if now[at] != rank:
                    continue  # stale: its pair has changed
                gone = after[at]
                right = after[gone]
                token[at] = rank
                after[at], now[gone] = right, -1
                before[right] = at
                lowest = rank
                now[at] = new = pairs(high | token[right], -1)
                if new >= 0:
                    if (bucket := bucket_of(new)) is None:
                        queue.push(new, at)
                    else:
                        bucket.append(at)
                    if new < lowest:
                        lowest = new
                left = before[at]
                if left >= 0:
                    now[left] = new = pairs(token[left] << PAIR_BITS | rank, -1)
                    if new >= 0:
                        if (bucket := bucket_of(new)) is None:
                            queue.push(new, left)
                        else:
                            bucket.append(left)
                        if new < lowest:
                            lowest = new
                if lowest < rank:
                    if k + 1 < len(positions):
                        queue.put(rank, positions[k + 1 :])
                    break
        out, own, i = [], [], 0
        while i < n:
            if token[i] == SEPARATOR:
                out.append(own)
                own = []
            else:
                own.append(token[i])
            i = after[i]
        return out

    def encode_pieces(self, pieces: Iterable[str]) -> dict[str, list[int]]:
        """The ids of each distinct pre-token."""
        out, todo = {}, []
        for piece in pieces:
            raw = piece.encode()
            if (rank := self.ranks.get(raw)) is not None:
                out[piece] = [rank]
            else:
                todo.append((piece, raw))
        for (piece, _), ids in zip(todo, self.merge([raw for _, raw in todo]), strict=True):
            out[piece] = ids
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. What is known of pre-tokens is kept in two generations: when the younger is full it becomes the older."""
        found = [self.find(t) for t in texts]
        distinct = set().union(*found)
        new = distinct.difference(self.kept)
        known = self.kept
        again = {p: self.older[p] for p in new if p in self.older}
        coded = {p: np.array(ids, np.int32).tobytes() for p, ids in self.encode_pieces(new.difference(again)).items()}
        known.update(again)
        known.update(coded)
        out = [np.frombuffer(b"".join([known[p] for p in ps]), np.int32) for ps in found]
        for p in coded:
            if len(p) > KEEP_CHARS:
                del known[p]
        if len(known) > KEEP:
            self.older, self.kept = known, {}
        return out

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes that ids stand for, each id's after the other."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        if not len(ids):
            return np.zeros(0, np.uint8)
        return self.flat[np.repeat(self.starts[ids] - (ends - sizes), sizes) + np.arange(ends[-1])]


_coders: dict[tuple[str, str], ByteBPE] = {}


def coder(path: str, pattern: str) -> ByteBPE:
    """One coder per worker and vocabulary."""
    if (path, pattern) not in _coders:
        _coders[path, pattern] = ByteBPE(path, pattern)
    return _coders[path, pattern]


def encode_bpe(df: DataFrame, text: str = "text", *, path: str | None = None, pattern: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns keep, then ids array<int> and decoded binary, the bytes that the ids stand for.

    A null text counts as empty: no ids, no bytes. Texts of any length are
    encoded whole. A column of df that is not in keep is left out, so names
    such as ids or decoded there do no harm; repeated rows give repeated rows.
    """
    import public_tokenizers

    path, pattern = path or tokenizer_file(VOCABULARY), pattern or public_tokenizers.PATTERN
    clash = [c for c in keep if c in ("ids", "decoded")]
    if clash:
        raise ValueError(f"keep may not name {clash}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for batch in slices(batches, "__text"):
            coded = bpe.encode(batch.column("__text").to_pylist())
            values = np.concatenate(coded)
            ends = np.cumsum([0, *map(len, coded)])
            read = bpe.decode(values)
            cuts = np.concatenate([[0], np.cumsum(bpe.sizes[values])])[ends]
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))
            decoded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(coded), [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(read)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), ids, decoded], names=[*keep, "ids", "decoded"])

    source = few_rows(df).select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{fields}, ids array<int>, decoded binary")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_bpe(load(spark, sf_dir, "documents"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES = {"op8_byte_bpe": op8_byte_bpe}
