"""Words of Arrow text batches as 64-bit hashes, computed on whole byte buffers with numpy.

The hash of a word is a sum over its bytes, each times a random number of its place in the word, taken from
running sums modulo 2**64, so that no loop runs over words.  (Powers of one base would not do: modulo 2**64 they
give some long words of two letters equal sums whatever the base.)  Runs of words need a hash that can be moved
along the text; theirs are polynomials modulo two primes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15
#: Bytes worked on at once; a longer text is worked on alone.
SLICE_BYTES = 1 << 18


def byte_set(characters: bytes) -> np.ndarray:
    flags = np.zeros(256, dtype=bool)
    flags[list(characters)] = True
    return flags


#: Space and U+0009 to U+000D.
WHITE = byte_set(b" \t\n\x0b\x0c\r")
#: Everything in ASCII but letters and digits; bytes of other characters belong to words.
NOT_ALNUM = byte_set(bytes(b for b in range(128) if not chr(b).isalnum()))
#: A-Z to a-z, other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A finaliser that spreads every input bit over the output."""
    x = x + np.uint64((salt * _BASE + 0x632BE59BD9B4E019) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_VALUES = mix(np.arange(256, dtype=np.uint64), 1)
_places = np.zeros(0, np.uint64)


def _place_values(n: int) -> np.ndarray:
    """A random odd number for each of the first ``n`` places of a word."""
    global _places
    if len(_places) >= n:
        return _places[:n]
    values = mix(np.arange(max(n, 1024), dtype=np.uint64), 3) | np.uint64(1)
    if len(values) <= 4 * SLICE_BYTES:
        _places = values
    return values[:n]


@dataclass
class Words:
    """The words of some consecutive texts.  Words of text i: first[i] to first[i + 1]."""

    row: int  # number of the first text in its batch
    first: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray  # byte places in ``data``
    ends: np.ndarray
    data: np.ndarray
    text_starts: np.ndarray
    sums: np.ndarray  # running sums of the bytes' values

    def prefixes(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the first ``n`` bytes of the words longer than that, and the words' numbers."""
        longer = np.flatnonzero(self.ends - self.starts > n)
        at = self.starts[longer]
        return mix(self.sums[at + n] - self.sums[at], 100 + n), longer

    @property
    def texts(self) -> int:
        return len(self.first) - 1

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(self.texts), np.diff(self.first))


def split_words(
    texts: pa.Array, separators: np.ndarray, lower: bool, slice_bytes: int = SLICE_BYTES
) -> Iterator[Words]:
    """Hash the words of each text; nulls are empty texts."""
    texts = texts.fill_null("").cast(pa.large_string())
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    buffer = texts.buffers()[2]
    everything = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + slice_bytes, side="right")) - 1
        end = min(n, max(end, row + 1))
        bounds = offsets[row : end + 1] - offsets[row]
        data = everything[offsets[row] : offsets[end]]
        if lower:
            data = LOWER[data]
        size = len(data)
        inside = ~separators[data]
        # Word edges: where the state changes, and wherever a text begins or ends.
        edge = np.zeros(size + 1, dtype=bool)
        edge[1:size] = inside[1:] != inside[:-1]
        edge[bounds] = True
        places = np.flatnonzero(edge)
        if size:
            begins, finishes = places[:-1], places[1:]
            keep = inside[begins]
            starts, ends = begins[keep], finishes[keep]
        else:
            starts = ends = np.zeros(0, np.int64)
        sums = np.zeros(size + 1, dtype=np.uint64)
        if size:
            lengths = np.diff(places)
            # 32-bit places halve the memory that is moved; a text may be longer than they reach.
            kind = np.int32 if size < 1 << 31 else np.int64
            place = np.arange(size, dtype=kind)
            place -= np.repeat(places[:-1].astype(kind), lengths)
            values = _place_values(int(lengths.max())).take(place)
            values *= _BYTE_VALUES.take(data)
            np.cumsum(values, out=sums[1:])
        hashes = mix(sums[ends] - sums[starts] + mix((ends - starts).astype(np.uint64), 5))
        first = np.searchsorted(starts, bounds)
        yield Words(row, first, hashes, starts, ends, data, bounds, sums)
        row = end


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of two hashes in order."""
    return mix(a * np.uint64(0xD6E8FEB86659FD93) + (b ^ (b >> np.uint64(29))))


def windows(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words within a text, and the number of the first word of each."""
    n = len(words.hashes)
    if n < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hashes = words.hashes[: n - k + 1]
    for j in range(1, k):
        hashes = pair(hashes, words.hashes[j : n - k + 1 + j])
    last = np.repeat(words.first[1:], np.diff(words.first))[: n - k + 1]
    places = np.flatnonzero(np.arange(n - k + 1) + k <= last)
    return hashes[places], places


def shingle_sets(words: Words, k: int) -> Iterator[np.ndarray]:
    """For each text, its distinct ``k``-word shingles, sorted; fewer words make one shingle."""
    hashes, places = windows(words, k)
    cuts = np.searchsorted(places, words.first)
    for i in range(words.texts):
        a, b = words.first[i], words.first[i + 1]
        if 0 < b - a < k:
            whole = words.hashes[a : a + 1]
            for j in range(a + 1, b):
                whole = pair(whole, words.hashes[j : j + 1])
            yield mix(whole, int(b - a))
        else:
            yield np.unique(hashes[cuts[i] : cuts[i + 1]])


#: Primes and bases of the hashes of runs.
_FIELDS = ((2147483647, 1103515245), (2147483629, 747796405))


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    out = np.ones(max(n, 1), dtype=np.uint64)
    have = 1
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * np.uint64(pow(base, have, prime)) % np.uint64(prime)
        have += more
    return out[:n]


class Runs:
    """Hashes of runs of words that begin anywhere, from running sums of the words' hashes."""

    def __init__(self, hashes: np.ndarray) -> None:
        n = len(hashes)
        self.sums, self.back = [], []
        for prime, base in _FIELDS:
            p = np.uint64(prime)
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(hashes % p * _powers(base, prime, n) % p, out=sums[1:])
            self.sums.append(sums)
            self.back.append(_powers(pow(base, -1, prime), prime, n + 1))

    def __call__(self, places: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        parts = [
            (sums[places + sizes] - sums[places]) % np.uint64(prime) * back[places] % np.uint64(prime)
            for (prime, _), sums, back in zip(_FIELDS, self.sums, self.back, strict=True)
        ]
        return mix((parts[0] << np.uint64(32) | parts[1]) ^ mix(sizes.astype(np.uint64), 7))
