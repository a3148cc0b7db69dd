"""Cost-balanced packing of tokenised documents into sequences of one capacity.

A piece of n tokens costs LINEAR * n + QUADRATIC * n * n: attention within a
document grows with its square. Pieces in descending order go to the sequence of
lowest cost that still has room for them. There are only as many sequences as the
tokens of a window fill, so a window pads less than one sequence; a piece that
fits nowhere is cut into what is free.

Everything happens where a document is read: no shuffle, and a task holds one
window of tokens at a time, however many documents there are or how long one is.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import few_rows, give_back, load, slices, tokenizer_file

CAPACITY, END = 2048, 1
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
#: Tokens that are packed together.
WINDOW = 1 << 20
VOCABULARY = "word_bpe_49k.json"
#: Words kept with their ids by a worker; longer ones than KEEP_CHARS are encoded each time.
KEEP, KEEP_CHARS = 300_000, 64
#: Words that a tokenizer gets at a time.
AT_ONCE = 16_000
#: A tokenizer of nothing, from which a cut into words is taken.
EMPTY = {"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "post_processor": None, "decoder": None, "model": {"type": "BPE", "vocab": {}, "merges": []}}
#: The normalizer and the cut into words that are known: words of Latin-1 letters need no more of them than str.lower() does.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
LETTERS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
LATIN = re.compile("[\x21-\x7e\xa1-\xff]+").fullmatch
#: A word of its own to the tokenizer, one id.
MARK = "\x01"
#: Where the known cut into words cuts anyhow, a space may stand: fewer words differ then.
BEFORE_TAIL = r"([a-zA-Z\x{df}-\x{f6}\x{f8}-\x{ff}])([!-&(-/:;=?@\[-`{}~])"
#: White space to Unicode beyond what Arrow splits at.
WHITE = re.compile(r"[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


class Known:
    """Words and the ids of each, in arrays: a dict of them takes several times the memory."""

    def __init__(self) -> None:
        self.words = pa.array([], pa.large_string())
        self.ids, self.sizes = np.zeros(0, "<u4"), np.zeros(0, np.int64)

    def add(self, words: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.words = pa.concat_arrays([self.words, words])
        self.ids, self.sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes])

    def places(self, words: pa.Array) -> np.ndarray:
        """Where each word is, or -1."""
        return pc.index_in(words, value_set=self.words).fill_null(-1).to_numpy()


def taken(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ids, one after the other, and where each begins, with the end of the last."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return ids[np.arange(ends[-1]) + np.repeat(starts - ends[:-1], sizes)], ends


class WordIds:
    """Token ids of whole texts. No token of this vocabulary holds or depends on white space, so each word is encoded once."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.encoder = Tokenizer.from_file(path)

        def plain(cut: pre_tokenizers.PreTokenizer | None) -> Tokenizer:
            """Without normalizer; the vocabulary is in memory once for all."""
            own = Tokenizer(self.encoder.model)
            if cut is not None:
                own.pre_tokenizer = cut
            return own

        known = spec["normalizer"] == NORMALIZER and all("<|" in t["content"] for t in spec["added_tokens"])
        self.plain = plain(self.encoder.pre_tokenizer) if known else None
        first, *rest = (spec["pre_tokenizer"] or {}).get("pretokenizers", [None])
        self.lettered = None
        if known and first == {"type": "Split", "pattern": {"Regex": LETTERS}, "behavior": "Removed", "invert": True}:
            cut = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, *rest]}
            self.lettered = plain(Tokenizer.from_str(json.dumps(EMPTY | {"pre_tokenizer": cut})).pre_tokenizer)
        (self.mark,) = self.encoder.encode(MARK, add_special_tokens=False).ids
        # words in two generations: when the younger is full it becomes the older
        self.kept, self.older = Known(), Known()
        del spec
        give_back()

    def encode_words(self, words: list[str], out: dict[str, bytes]) -> None:
        """Puts the ids of words into out. Many are encoded at a time, with a mark between each two."""
        letters, latin, rest = [], [], []
        for w in words:
            if not w or MARK in w:
                out[w] = np.array(self.encoder.encode(w, add_special_tokens=False).ids, "<u4").tobytes()
            elif self.plain is not None and (w.isascii() or LATIN(w)) and "<|" not in w:
                (letters if self.lettered is not None and w.isalpha() else latin).append(w)
            else:
                rest.append(w)
        for encoder, own, lower in ((self.lettered, letters, True), (self.plain, latin, True), (self.encoder, rest, False)):
            parts = [own[i : i + 1000] for i in range(0, len(own), 1000)]
            joined = [f" {MARK} ".join(p) for p in parts]
            for part, coded in zip(parts, encoder.encode_batch_fast([j.lower() for j in joined] if lower else joined, add_special_tokens=False) if parts else (), strict=True):
                ids = np.array(coded.ids, "<u4")
                cuts = 4 * np.flatnonzero(ids == self.mark)
                raw = ids.tobytes()
                out.update(zip(part, map(raw.__getitem__, map(slice, [0, *(cuts + 4).tolist()], [*cuts.tolist(), len(raw)])), strict=True))

    def _folded(self, text: str) -> str:
        """A Latin-1 text in lower case, so that fewer words differ; any other as it is. White space is what Arrow splits at."""
        if text.isascii():
            return text if self.plain is None or "<|" in text else text.lower()
        text = WHITE.sub(" ", text)
        if self.plain is None or "<|" in text:
            return text
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text
        return text.lower()

    def new_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, and how many each has. So many words are encoded at a time that what they take does not add up."""
        ids, sizes = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        for start in range(0, len(words), AT_ONCE):
            own = words[start : start + AT_ONCE].to_pylist()
            out: dict[str, bytes] = {}
            self.encode_words(own, out)
            coded = list(map(out.__getitem__, own))
            ids.append(np.frombuffer(b"".join(coded), "<u4"))
            sizes.append(np.fromiter(map(len, coded), np.int64, len(coded)) // 4)
        return np.concatenate(ids), np.concatenate(sizes)

    def learn(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and for each of these different words where its own begin there, and how many they are. Keeps them in the younger generation."""
        at = self.kept.places(words)
        absent = at < 0
        seen = self.older.places(words)
        new = absent & (seen < 0)
        fresh, count = self.new_ids(words.filter(pa.array(new)))
        at = np.where(absent, len(self.kept.sizes) + seen, at)
        at[new] = len(self.kept.sizes) + len(self.older.sizes) + np.arange(len(count))
        pool, sizes = np.concatenate([self.kept.ids, self.older.ids, fresh]), np.concatenate([self.kept.sizes, self.older.sizes, count])
        starts, sizes = (np.cumsum(sizes) - sizes)[at], sizes[at]
        keep = absent & (pc.utf8_length(words).to_numpy() <= KEEP_CHARS)
        self.kept.add(words.filter(pa.array(keep)), taken(pool, starts[keep], sizes[keep])[0], sizes[keep])
        if len(self.kept.sizes) > KEEP:
            self.older, self.kept = self.kept, Known()
        return pool, starts, sizes

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one text after the other, and how many each has."""
        folded = pa.array([self._folded(t) for t in texts], pa.large_string())
        if self.lettered is not None:
            folded = pc.replace_substring_regex(folded, BEFORE_TAIL, r"\1 \2")
        split = pc.ascii_split_whitespace(folded)
        words = split.flatten().dictionary_encode()
        pool, starts, sizes = self.learn(words.dictionary)
        at = words.indices.to_numpy()
        ids, ends = taken(pool, starts[at], sizes[at])
        return ids, np.diff(ends[split.offsets.to_numpy()])


_encoders: dict[str, WordIds] = {}


def assign(lengths: np.ndarray, capacity: int = CAPACITY, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """(item, start in the item, length, sequence, offset) for each piece; items are at most capacity long.

    The sequences are as few as the items' tokens fill; ties go to the earlier
    item and sequence.
    """
    total = int(lengths.sum())
    count = -(-total // capacity)
    room, cost = np.full(count, capacity), np.zeros(count)
    out, left = [], []
    for item in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[item])
        if not n:
            continue
        open_cost = np.where(room >= n, cost, np.inf)
        at = int(open_cost.argmin())
        if room[at] < n:
            left.append(item)
            continue
        out.append((item, 0, n, at, capacity - int(room[at])))
        room[at] -= n
        cost[at] += linear * n + quadratic * n * n
    free = iter(np.argsort(-room, kind="stable").tolist())
    at = next(free, None)
    for item in left:
        start, n = 0, int(lengths[item])
        while start < n:
            while not room[at]:
                at = next(free)
            take = min(n - start, int(room[at]))
            out.append((item, start, take, at, capacity - int(room[at])))
            room[at] -= take
            start += take
    return out


def pack_documents(df: DataFrame, text: str = "text", *, key: str = "doc_id", path: str | None = None, capacity: int = CAPACITY, end: int = END, window: int = WINDOW, linear: float = LINEAR, quadratic: float = QUADRATIC) -> DataFrame:
    """key, start, length, doc_tokens, sequence_id, offset, ids: a row for each piece; ids are little-endian unsigned 32-bit.

    A document is its token ids and then the id end, so a null or empty text is
    one token. Tokens of a document beyond the last multiple of capacity are
    packed with others; those before fill sequences of their own. Cost is balanced
    among the sequences of one window of tokens of a task, which is what is packed
    together, not among all sequences. Rows with equal or null keys are packed each by itself. Other columns are left out.
    """
    path = path or tokenizer_file(VOCABULARY)
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:
            _encoders[path] = WordIds(path)
        encoder = _encoders[path]
        base, made = TaskContext.get().partitionId() << 36, 0
        # keys, first places, lengths, and ids of what waits to be packed together
        waiting: list[tuple] = []
        held = 0

        def out(keys: pa.Array, start: np.ndarray, n: np.ndarray, tokens: np.ndarray, sequence: np.ndarray, offset: np.ndarray, ids: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Pieces of n ids from the place at in ids."""
            for a in range(0, len(n), 4096):
                own = slice(a, a + 4096)
                ends = np.concatenate([[0], np.cumsum(n[own])])
                part = ids[np.arange(ends[-1]) + np.repeat(at[own] - ends[:-1], n[own])]
                binary = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((4 * ends).astype(np.int32)), pa.py_buffer(part)])
                columns = [keys[a : a + 4096], *(pa.array(c[own]) for c in (start, n, tokens, sequence, offset)), binary]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal made, held
            keys = pa.concat_arrays([w[0] for w in waiting])
            first, tokens, n = (np.concatenate([w[k] for w in waiting]) for k in (1, 2, 3))
            ids = np.concatenate([w[4] for w in waiting])
            places = np.cumsum(n) - n
            pieces = np.array(assign(n, capacity, linear, quadratic), np.int64).reshape(-1, 5)
            item, start, size, sequence, offset = pieces[np.lexsort((pieces[:, 4], pieces[:, 3]))].T
            yield from out(keys.take(pa.array(item)), first[item] + start, size, tokens[item], base + made + sequence, offset, ids, places[item] + start)
            made += 1 + int(sequence.max(initial=-1))
            waiting.clear()
            held = 0

        for batch in slices(batches, "__text", 4 << 20):
            keys = batch.column(0)
            # what the batch before took goes back first: two workers and a full heap are close to an executor's limit
            give_back()
            ids, counts = encoder.encode(batch.column("__text").to_numpy(zero_copy_only=False).tolist())
            ids = np.insert(ids, np.cumsum(counts), np.uint32(end))
            tokens = counts + 1
            places = np.cumsum(tokens) - tokens
            whole = tokens // capacity
            if whole.any():
                item = np.repeat(np.arange(len(tokens)), whole)
                start = (np.arange(len(item)) - np.repeat(np.cumsum(whole) - whole, whole)) * capacity
                same = np.full(len(item), capacity, np.int64)
                yield from out(keys.take(pa.array(item)), start, same, tokens[item], base + made + np.arange(len(item)), same * 0, ids, places[item] + start)
                made += len(item)
            begin = 0
            rest = tokens % capacity
            while begin < len(tokens):
                # up to the document that fills the window
                stop = min(len(tokens), begin + 1 + int(np.searchsorted(np.cumsum(rest[begin:]), window - held)))
                own = np.flatnonzero(rest[begin:stop]) + begin
                if len(own):
                    n = rest[own]
                    ends = np.cumsum(n)
                    at = places[own] + whole[own] * capacity
                    waiting.append((keys.take(pa.array(own)), whole[own] * capacity, tokens[own], n, ids[np.arange(ends[-1]) + np.repeat(at - ends + n, n)]))
                    held += int(ends[-1])
                if held >= window:
                    yield from flush()
                begin = stop
        if waiting:
            yield from flush()

    source = few_rows(df).select(key, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    return source.mapInArrow(run, f"`{key}` {kind.simpleString()}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(load(spark, sf_dir, "documents")).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = {"op2_packing": op2_packing}
