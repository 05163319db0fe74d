"""Token ids of many texts at once.

Byte-pair merges never cross pre-tokens, so a batch is split into pre-tokens by
numpy over code points, and only those not met before go to the tokenizer. The
split is that of the byte-level pattern (contractions, letters, numbers, other
marks, white space); texts with characters outside well-known ranges or with an
added token's string go to the tokenizer whole, so ids are always its own.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np

from cairn.llm._words import BASE, BASE_INVERSE, _mix

OTHER, LETTER, NUMBER, SPACE = range(4)
#: Code points up to which categories are the same in all Unicode versions in use, and the blocks beyond that are.
STABLE = [(0x0000, 0x0378), (0x0400, 0x0530), (0x2000, 0x2065), (0x20A0, 0x20AD), (0x2100, 0x214E), (0x3000, 0x3040), (0x3041, 0x3097), (0x4E00, 0x9FA6), (0xAC00, 0xD7A4), (0xFF01, 0xFFBF)]
WHITE = [0x9, 0xA, 0xB, 0xC, 0xD, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SLICE_CHARS = 1 << 20
MOST_HELD = 1000000


def _classes() -> np.ndarray:
    kind = np.full(0x110000, 255, np.uint8)
    for low, high in STABLE:
        for c in range(low, high):
            kind[c] = {"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(c))[0], OTHER)
    kind[[c for c in WHITE if kind[c] != 255]] = SPACE
    return kind


class Encoder:
    """A byte-level tokenizer of the ``tokenizers`` library, with the pre-tokens it has met."""

    _open: dict[str, Encoder] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = re.compile("|".join(map(re.escape, added))) if added else None
        self.dtype = "<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
        self.kind = _classes()
        self.value = np.random.default_rng(20260103).integers(1, 1 << 62, 0x110000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.up = self.down = np.ones(1, np.uint64)
        self._forget()

    def _forget(self) -> None:
        self.keys, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For slices of the texts in order: all ids, and the texts' bounds in them."""
        first = 0
        while first < len(texts):
            last, chars = first, 0
            while last < len(texts) and (last == first or chars + len(texts[last]) <= SLICE_CHARS):
                chars += len(texts[last])
                last += 1
            yield self._slice(texts[first:last])
            first = last

    def _slice(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = "".join(texts)
        chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        kind = self.kind[chars]
        odd = {int(i) for i in np.unique(np.searchsorted(bounds, np.flatnonzero(kind == 255), "right") - 1)}
        if self.whole is not None:
            odd |= {i for i, t in enumerate(texts) if self.whole.search(t)}
        starts = self._starts(chars, kind, bounds)
        if not len(starts):
            ids, sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        else:
            ids, sizes = self._looked_up(joined, chars, starts, odd, bounds)
        token_bounds = np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(starts, bounds)]
        if not odd:
            return ids, token_bounds
        parts = [ids[token_bounds[i] : token_bounds[i + 1]] for i in range(len(texts))]
        for i, own in zip(sorted(odd), self._whole([texts[i] for i in sorted(odd)]), strict=True):
            parts[i] = own
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    @staticmethod
    def _starts(chars: np.ndarray, kind: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Where pre-tokens begin."""
        n = len(chars)
        if not n:
            return np.zeros(0, np.int64)
        begins = np.ones(n, bool)
        begins[1:] = kind[1:] != kind[:-1]
        opens = np.zeros(n + 1, bool)
        opens[bounds] = True
        begins |= opens[:n]
        white = kind == SPACE
        # the last white character before something else stands alone, or leads it if it is a space
        edge = np.flatnonzero(white[:-1] & ~white[1:] & ~opens[1:n])
        begins[edge] = True
        begins[edge[chars[edge] == 0x20] + 1] = False
        mark = np.flatnonzero((chars[:-1] == 0x27) & begins[:-1] & (kind[1:] == LETTER) & ~opens[1:n])
        if len(mark):
            one = chars[mark + 1]
            two = np.where((mark + 2 < n) & ~opens[np.minimum(mark + 2, n)], chars[np.minimum(mark + 2, n - 1)], 0)
            size = np.where(np.isin(one, [*map(ord, "stmd")]), 1, 0)
            for a, b in ("re", "ve", "ll"):
                size[(one == ord(a)) & (two == ord(b))] = 2
            mark, size = mark[size > 0], size[size > 0]
            begins[mark + 1] = False
            after = mark + 1 + size
            begins[after[(after < n)]] = True
        return np.flatnonzero(begins)

    def _looked_up(self, joined: str, chars: np.ndarray, starts: np.ndarray, odd: set[int], bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(chars)
        if len(self.up) < n:
            self.up, self.down = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)])) for b in (BASE, BASE_INVERSE))
        ends = np.append(starts[1:], n)
        hashes = _mix(np.add.reduceat(self.value[chars] * self.up[:n], starts) * self.down[starts] + (ends - starts).astype(np.uint64))
        distinct, sample, place = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) > MOST_HELD:
            self._forget()
        known = np.searchsorted(self.keys, distinct)
        fresh = np.flatnonzero(self.keys[np.minimum(known, len(self.keys) - 1)] != distinct) if len(self.keys) else np.arange(len(distinct))
        if len(fresh):
            self._learn(distinct[fresh], [joined[a:b] for a, b in zip(starts[sample[fresh]].tolist(), ends[sample[fresh]].tolist(), strict=True)])
            known = np.searchsorted(self.keys, distinct)
        at, size = self.at[known][place], self.size[known][place]
        if odd:
            size = size.copy()
            size[np.isin(np.searchsorted(bounds, starts, "right") - 1, [*odd])] = 0
        total = np.cumsum(size)
        return self.ids[np.repeat(at - (total - size), size) + np.arange(total[-1])], size

    def _learn(self, keys: np.ndarray, tokens: list[str]) -> None:
        got = [e.ids for e in self.tokenizer.encode_batch_fast(tokens, add_special_tokens=False)]
        size = np.fromiter(map(len, got), np.int64, len(got))
        flat = np.fromiter(chain.from_iterable(got), np.uint32, int(size.sum()))
        at = len(self.ids) + np.cumsum(size) - size
        order = np.argsort(merged := np.concatenate([self.keys, keys]), kind="stable")
        self.keys, self.at, self.size = merged[order], np.concatenate([self.at, at])[order], np.concatenate([self.size, size])[order]
        self.ids = np.concatenate([self.ids, flat])
