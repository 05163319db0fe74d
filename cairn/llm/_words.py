"""Words of many texts at once: boundaries and 64-bit hashes by numpy over whole Arrow buffers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
BYTE_VALUE = np.random.default_rng(20260102).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    return _mix(h + np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1))


class _Powers:
    """Powers of BASE and of its inverse, as far as were needed."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            for name, base in (("up", BASE), ("down", BASE_INVERSE)):
                values = np.full(n, base, np.uint64)
                values[0] = 1
                setattr(cls, name, np.multiply.accumulate(values))
        return cls.up[:n], cls.down[:n]


@dataclass
class Alphabet:
    """Which bytes belong to words and what each counts as."""

    word: np.ndarray
    value: np.ndarray
    unspaced: bool = False


def alphabet(letters: str, unspaced: bool = False) -> Alphabet:
    """``alnum``: ASCII letters and digits and all beyond ASCII, A-Z as a-z. ``black``: all but ASCII white space, likewise folded.

    ``unspaced``: each character of a script without spaces is a word of its own.
    """
    codes = np.arange(256)
    if letters == "alnum":
        word = (codes >= 128) | np.isin(codes, [*b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"])
    else:
        word = ~np.isin(codes, [*b" \t\n\x0b\x0c\r"])
    folded = np.where((codes >= 65) & (codes <= 90), codes + 32, codes)
    return Alphabet(word, np.where(word, BYTE_VALUE[folded], np.uint64(0)), unspaced)


@dataclass
class Words:
    """The words of texts ``first`` up to ``first + len(offsets) - 1`` of a batch.

    ``hashes, starts, ends``: by word, places in ``data``. ``offsets``: of the
    texts in ``data``. ``bounds``: word numbers at which texts begin and end.
    ``mass``: what each byte adds to a hash.
    """

    first: int
    data: np.ndarray
    offsets: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray
    mass: np.ndarray

    def prefix_hashes(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words of more than ``size`` bytes, and a hash of each one's first ``size``."""
        longer = np.flatnonzero(self.ends - self.starts > size)
        running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.mass, dtype=np.uint64)]) if len(longer) else self.mass
        at = self.starts[longer]
        return longer, mix((running[at + size] - running[at]) * _Powers.to(len(self.data))[1][at], size)

    def __len__(self) -> int:
        return len(self.offsets) - 1


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the texts' offsets in them; nulls are empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8))[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(texts: pa.Array, letters: Alphabet, slice_bytes: int = SLICE_BYTES) -> Iterator[Words]:
    """Slices of whole texts, about ``slice_bytes`` each: memory follows the slice or the longest text."""
    data, offsets = buffers(texts)
    first = 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + slice_bytes, "right")) - 1)
        yield _slice(first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], letters)
        first = last


def _slice(first: int, data: np.ndarray, offsets: np.ndarray, letters: Alphabet) -> Words:
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(first, data, offsets, np.zeros(0, np.uint64), none, none, np.zeros(len(offsets), np.int64), np.zeros(0, np.uint64))
    inside = letters.word[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    finishes = inside.copy()
    finishes[:-1] &= ~inside[1:]
    cut = offsets[(offsets > 0) & (offsets < n)]
    begins[cut] |= inside[cut]
    finishes[cut - 1] |= inside[cut - 1]
    if letters.unspaced:
        at, size = unspaced_characters(data)
        begins[at] = finishes[at + size - 1] = True
        finishes[at[at > 0] - 1] |= inside[at[at > 0] - 1]
        after = (at + size)[at + size < n]
        begins[after] |= inside[after]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
    up, down = _Powers.to(n)
    mass = letters.value[data] * up
    hashes = _mix(np.add.reduceat(mass, starts) * down[starts]) if len(starts) else np.zeros(0, np.uint64)
    return Words(first, data, offsets, hashes, starts, ends, np.searchsorted(starts, offsets), mass)


def unspaced_characters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and sizes in UTF-8 of characters of scripts written without spaces.

    Han, kana, bopomofo, their punctuation and full-width forms; Thai, Lao,
    Tibetan, Myanmar, Khmer.
    """
    at = np.flatnonzero(data >= 0xE0)
    at = at[at + 2 < len(data)]
    lead, second = data[at], data[at + 1]
    between = lambda x, low, high: (x >= low) & (x <= high)
    three = between(lead, 0xE3, 0xE9) | (lead == 0xEF) | ((lead == 0xE2) & (second >= 0xBA)) | ((lead == 0xE0) & between(second, 0xB8, 0xBF))
    three |= (lead == 0xE1) & (between(second, 0x80, 0x81) | (second == 0x82) & (data[at + 2] < 0xA0) | between(second, 0x9E, 0x9F))
    four = (lead == 0xF0) & between(second, 0xA0, 0xBF)
    return at[three | four], np.where(four, 4, 3)[three | four]


def hash_word(word: str, letters: Alphabet) -> int:
    """The hash that ``words`` gives to a word."""
    return int(next(words(pa.array([word]), letters)).hashes[0])


def shingles(found: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``width`` words within a text, and the runs' bounds by text.

    A text of fewer words, but at least one, has a single run of all of them.
    """
    counts = np.diff(found.bounds)
    runs = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    bounds = np.concatenate([[0], np.cumsum(runs)])
    at = np.repeat(found.bounds[:-1] - bounds[:-1], runs) + np.arange(bounds[-1])
    stop = np.repeat(found.bounds[1:], runs)
    h = np.zeros(len(at), np.uint64)
    for k in range(width):
        here = at + k
        ok = here < stop
        part = np.zeros(len(at), np.uint64)
        part[ok] = found.hashes[here[ok]]
        h = _mix(h * np.uint64(31) + part + np.uint64(k + 1))
    return h, bounds
