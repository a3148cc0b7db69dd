"""64-bit hashes of words and word n-grams of whole batches of texts, in numpy.

Words are maximal runs of anything but ASCII white space, A-Z lower-cased. The
prefix sums of a polynomial over all bytes give the hash of any run of bytes as a
difference, so there is no loop over words.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

SEED = 0x5EED
#: Bytes of text to hash at a time: with line ends, just under a power of two, the size of the tables of powers.
SLICE = (1 << 20) - (1 << 13)
#: An odd base and its inverse modulo 2 ** 64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


@lru_cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """A random number for each byte, A-Z as a-z, and which bytes are white space."""
    values = np.random.default_rng(SEED).integers(1, 1 << 63, 256, np.uint64)
    values[65:91] = values[97:123]
    white = np.zeros(256, bool)
    white[[0x20, *range(0x09, 0x0E)]] = True
    return values, white


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse for i < n at least."""
    if len(_powers[0]) < n:
        for k, base in enumerate((BASE, INVERSE)):
            steps = np.full(1 << (n - 1).bit_length(), base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit over all bits; one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of the texts in turn, and how many words each text has."""
    values, white = _tables()
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    power, inverse = _power(len(raw) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values[raw] * power[: len(raw)], dtype=np.uint64)])
    gap = white[raw]
    edges = np.flatnonzero(np.diff(np.concatenate([[True], gap])))
    starts, ends = edges[::2], edges[1::2]
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.diff(np.searchsorted(starts, text_ends), prepend=0)


@lru_cache
def _places(n: int) -> np.ndarray:
    return np.random.default_rng(SEED + n).integers(1, 1 << 63, n, np.uint64) | np.uint64(1)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of n words; runs that cross texts are for the caller to leave out."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(count, n, np.uint64)
    for k, place in enumerate(_places(n)):
        total += words[k : k + count] * place
    return mix(total)


def shingles(texts: list[bytes], n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-word shingles of each text, sorted, one text after the other, and how many each has.

    A text of fewer words has its whole sequence as one shingle; without words it has none.
    """
    words, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    starts = ends - counts
    rows = np.repeat(np.arange(len(texts)), counts)
    grams = gram_hashes(words, n)
    inside = rows[: len(grams)] == rows[n - 1 :] if len(grams) else np.zeros(0, bool)
    hashes, of = [grams[inside]], [rows[: len(grams)][inside]]
    for short in range(1, n):
        at = np.flatnonzero(counts == short)
        if len(at):
            hashes.append(gram_hashes(words, short)[starts[at]])
            of.append(at)
    h, r = np.concatenate(hashes), np.concatenate(of)
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return h[first], np.bincount(r[first], minlength=len(texts))
