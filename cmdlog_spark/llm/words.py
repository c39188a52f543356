"""64-bit hashes of all words of many texts at once, without a Python step per word.

Texts are bytes; words are runs of other bytes than ASCII white space. A word's hash
is a polynomial of the random numbers of its bytes, taken from running sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

# Bytes hashed together; longer texts are cut at white space.
GROUP = 1 << 21
# Where only the words count, not their places, smaller groups do: a byte costs some 60 bytes.
PART = 8
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
# ASCII capitals in lower case, all other bytes as they are.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of SplitMix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


VALUE = mix(np.arange(1, 257, dtype=np.uint64) * BASE)
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: int, size: int) -> np.ndarray:
    if name not in _powers or len(_powers[name]) < size:
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        _powers[name] = np.cumprod(steps)
    return _powers[name]


@dataclass
class Words:
    """text: the number of the text of each word; start and end in ``buffer``."""

    buffer: bytes
    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    sums: np.ndarray

    def at(self, chosen: np.ndarray) -> Words:
        """Some of the words."""
        return Words(self.buffer, self.text[chosen], self.start[chosen], self.end[chosen], self.sums)

    def hashes(self, longest: int | None = None) -> np.ndarray:
        """Of the words, or of their first ``longest`` bytes."""
        end = self.end if longest is None else np.minimum(self.end, self.start + longest)
        inverse = _power("inverse", pow(int(BASE), -1, 1 << 64), len(self.sums))
        return mix((self.sums[end] - self.sums[self.start]) * inverse[self.start] + (end - self.start).astype(np.uint64))


def segments(data: list[bytes], most: int | None = None) -> Iterator[list[tuple[int, bytes]]]:
    most = most or GROUP
    group, size = [], 0
    for n, one in enumerate(data):
        start = 0
        while True:
            end = min(len(one), start + most)
            while end < len(one) and not BLANK[one[end]]:
                end += 1
            group.append((n, one[start:end] if start or end < len(one) else one))
            size += end - start + 1
            if size >= most:
                yield group
                group, size = [], 0
            start = end
            if start >= len(one):
                break
    if group:
        yield group


def join_pieces(group: list[tuple[int, bytes]]) -> tuple[bytes, tuple[np.ndarray, np.ndarray]]:
    """One buffer with a blank after each piece; the numbers of the texts and where their pieces end."""
    buffer = b" ".join(piece for _, piece in group) + b" "
    lengths = np.array([len(piece) + 1 for _, piece in group])
    return buffer, (np.array([n for n, _ in group]), np.cumsum(lengths))


def make_words(buffer: bytes, owners: tuple[np.ndarray, np.ndarray], start: np.ndarray, end: np.ndarray) -> Words:
    array = np.frombuffer(buffer, np.uint8)
    sums = np.zeros(len(array) + 1, np.uint64)
    np.cumsum(VALUE[array] * _power("forward", int(BASE), len(array))[: len(array)], out=sums[1:])
    numbers, ends = owners
    return Words(buffer, numbers[np.searchsorted(ends, start, side="right")], start, end, sums)


def word_groups(data: list[bytes]) -> Iterator[Words]:
    """The words of all texts in order, some texts at a time."""
    for group in segments(data, max(1, GROUP // PART)):
        buffer, owners = join_pieces(group)
        blank = BLANK[np.frombuffer(buffer, np.uint8)]
        change = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        if not blank[0]:
            change = np.concatenate([[0], change])
        yield make_words(buffer, owners, change[::2], change[1::2])


def ragged(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers begin, begin + 1, ... of each run, one run after the other."""
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(begin - (ends - count), count) + np.arange(total)


def word_hashes(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the place of each text's first word (one more at the end)."""
    parts = [(w.hashes(), w.text) for w in word_groups(data)]
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    hashes, text = (np.concatenate(x) for x in zip(*parts, strict=True))
    return hashes, np.searchsorted(text, np.arange(len(data) + 1))


def shingle_hashes(data: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of runs of ``size`` words for each text, ascending, and where each text begins.

    A text with fewer words has one shingle, the whole; one without words has none.
    """
    words, cuts = word_hashes(data)
    counts = np.diff(cuts)
    n = np.maximum(counts - size + 1, 0)
    first = ragged(cuts[:-1], n)
    codes = np.full(len(first), size, np.uint64)
    for step in range(size):
        codes = mix(codes * BASE + words[first + step])
    ends = np.cumsum(n)
    parts = []
    for i, (a, b) in enumerate(zip((ends - n).tolist(), ends.tolist(), strict=True)):
        if b > a:
            one = np.sort(codes[a:b])
            new = np.ones(len(one), bool)
            np.not_equal(one[1:], one[:-1], out=new[1:])
            parts.append(one[new])
        elif counts[i]:
            parts.append(_whole(words[cuts[i] : cuts[i + 1]]))
        else:
            parts.append(words[:0])
    lengths = np.array([len(p) for p in parts], np.int64)
    return np.concatenate([words[:0], *parts]), np.concatenate([[0], np.cumsum(lengths)])


def _whole(words: np.ndarray) -> np.ndarray:
    code = np.array([len(words)], np.uint64)
    for word in words:
        code = mix(code * BASE + word)
    return code
