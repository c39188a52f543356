"""Token groups shared by two tokenizers, aligned unit by unit.

A unit is white space and the run of other characters behind it. No token of the two
kinds of vocabulary served here reaches over the beginning of a unit, so that units are
encoded and aligned once and remembered. ``Aligner`` checks the second vocabulary for
this: before a blank that it joins to other characters no unit begins.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np

from cmdlog_spark.llm.tokens import _byte_letters
from cmdlog_spark.llm.words import ragged

# Bits of an id in a pair code: a << BITS | b.
BITS = 20
# Characters handled at a time; longer texts are cut where a unit begins.
PIECE = 1_000_000
# Units and their characters kept in memory before those that came once are forgotten.
REMEMBERED, REMEMBERED_CHARS = 250_000, 24_000_000

BLANKS = "\t\n\x0b\x0c\r "
# White space to some regular expressions and not to others: no cut beside it.
UNSURE = "\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f\u2060\u3000\ufeff"
UNIT = re.compile(f"[{BLANKS}]+[^{BLANKS}]*")
# Units that are encoded in one go: where one ends and the next begins is plain.
JOINED = re.compile(f"[{BLANKS}]+[^{BLANKS}{UNSURE}]{{1,500}}")
# Fixed value: the public pattern by which byte-level vocabularies of this kind split texts.
WORDS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@dataclass
class Aligned:
    """Texts from number ``first`` on, and the distinct pairs of ids that each links.

    owner: the place of a pair's text among these; times: how often it is linked there.
    """

    first: int
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    digest: list[str]
    groups: list[bytes | None]
    owner: np.ndarray
    code: np.ndarray
    times: np.ndarray


def _sums(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sum of each one's values."""
    order = np.argsort(key, kind="stable")
    key, value = key[order], value[order]
    new = np.ones(len(key), bool)
    np.not_equal(key[1:], key[:-1], out=new[1:])
    at = np.flatnonzero(new)
    return key[at], np.add.reduceat(value, at) if len(at) else value


def _starts(count: np.ndarray) -> np.ndarray:
    return np.cumsum(count) - count


def _table(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes, and where those of each token begin and how many they are."""
    length = np.array([len(t) for t in tokens], np.int64)
    return np.frombuffer(b"".join(tokens), np.uint8), _starts(length), length


def _gives_back(table: tuple, ids: np.ndarray, n: np.ndarray, data: list[bytes]) -> np.ndarray:
    """Whether the bytes of each unit's tokens are its own; ``n``: how many tokens it has."""
    flat, begin, length = table
    owner = np.repeat(np.arange(len(data)), n)
    size = np.zeros(len(data), np.int64)
    np.add.at(size, owner, length[ids])
    own = np.fromiter(map(len, data), np.int64, len(data))
    good = size == own
    ids = ids[good[owner]]
    got = flat[ragged(begin[ids], length[ids])]
    want = np.frombuffer(b"".join(data), np.uint8)[np.repeat(good, own)]
    wrong = np.repeat(np.arange(len(data)), np.where(good, own, 0))[got != want]
    good[wrong] = False
    return good


class Aligner:
    """Tokens of A: a byte-level vocabulary in the JSON form of ``tokenizers``; of B: a
    ``sentencepiece`` model that puts a blank before a text. Short units of A are merged by
    ``tiktoken`` over the same vocabulary, which is faster."""

    def __init__(self, a_path: str, b_path: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=b_path)
        letters = _byte_letters()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, number in self.a.get_vocab().items():
            plain = all(c in letters for c in token)
            self.a_bytes[number] = bytes(letters[c] for c in token) if plain else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        as_byte = [self.b.is_byte(i) for i in range(len(pieces))]
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if byte else p.replace("▁", " ").encode()
            for p, byte in zip(pieces, as_byte, strict=True)
        ]
        if max(len(self.a_bytes), len(pieces)) > 1 << BITS:
            raise ValueError("vocabulary too large")
        # Blanks that no piece of B holds behind another character, or behind its own blank.
        ordinary = [p.replace("▁", " ") for p, byte in zip(pieces, as_byte, strict=True) if not byte]
        held = {c for p in ordinary for c in re.findall(f"(?<=[^{BLANKS}])[{BLANKS}]|(?<= )[{BLANKS[:-1]}]", p)}
        sure = "".join(c for c in BLANKS if c not in held)
        self.by_units = " " in sure
        unsure = UNSURE + "".join(held)
        self.doubt = re.compile(f"[{unsure}]")
        self.cut = re.compile(f"(?<=[^{BLANKS}{unsure}])(?=[{sure}])")
        # The id of B with the same bytes: a piece before a single byte; -1 for none.
        ids: dict[bytes, int] = {}
        for number in sorted(range(len(pieces)), key=lambda i: (as_byte[i], i)):
            if not self.b.is_control(number) and not self.b.is_unknown(number):
                ids.setdefault(self.b_bytes[number], number)
        self.same = np.array([ids.get(x, -1) if x else -1 for x in self.a_bytes], np.int64)
        self.a_table, self.b_table = _table(self.a_bytes), _table(self.b_bytes)
        # Ids in decimal digits, one row each, with room for what stands behind.
        digits = [str(i).encode() for i in range(max(len(self.a_bytes), len(pieces)))]
        self.width = len(digits[-1]) + 1
        rows = b"".join(d.ljust(self.width, b" ") for d in digits)
        self.digits = np.frombuffer(rows, np.uint8).reshape(-1, self.width)
        self.n_digits = np.array([len(d) for d in digits], np.int64)
        self.merger = self._merger(a_path)
        self._forget()

    def _merger(self, path: str):
        """The vocabulary as byte ranks; None if it has no such form."""
        import tiktoken

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, split = spec["model"], spec["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and not any(
            model.get(k) for k in ("continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "dropout")
        )
        whole = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
        letters = _byte_letters()
        if not plain or not whole or spec["normalizer"] or any(c not in model["vocab"] for c in letters):
            return None
        ranks = {bytes([b]): b for b in range(256)}
        ids = np.zeros(256 + len(model["merges"]), np.int64)
        for letter, byte in letters.items():
            ids[byte] = model["vocab"][letter]
        for rank, merge in enumerate(model["merges"], 256):
            token = "".join(merge if isinstance(merge, list) else merge.split(" "))
            ranks[bytes(letters[c] for c in token)] = rank
            ids[rank] = model["vocab"][token]
        if len(ranks) != len(ids):
            return None
        self.rank_ids = ids
        return tiktoken.Encoding("bytes", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})

    def _forget(self) -> None:
        self.memory: dict[str, int] = {}
        self.chars = 0
        # The groups of each unit as text, a semicolon behind each.
        self.text: list[bytes] = []
        self.good = np.zeros(0, bool)
        self.used = np.zeros(0, np.int64)
        # n_a, n_b, n_groups, n_links of each unit; its pairs begin at ``begin``.
        self.sizes = np.zeros((0, 4), np.int64)
        self.begin, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.code, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _shrink(self) -> None:
        """Forget units that have not come again, and the rarer ones of too many others."""
        keep = np.flatnonzero(self.used > 1)
        if len(keep) > REMEMBERED // 2:
            often = np.argpartition(-self.used[keep], REMEMBERED // 2)[: REMEMBERED // 2]
            keep = np.sort(keep[often])
        units, text = list(self.memory), self.text
        chosen = [units[i] for i in keep.tolist()]
        chars = sum(map(len, chosen))
        if chars > REMEMBERED_CHARS // 2:
            return self._forget()
        self.memory, self.chars = {u: i for i, u in enumerate(chosen)}, chars
        self.text = [text[i] for i in keep.tolist()]
        at = ragged(self.begin[keep], self.count[keep])
        self.code, self.times = self.code[at], self.times[at]
        self.count = self.count[keep]
        self.begin = _starts(self.count)
        self.good, self.sizes = self.good[keep], self.sizes[keep]
        # What was common long ago must come again to stay.
        self.used = self.used[keep] // 4

    def pieces(self, text: str) -> Iterator[str]:
        """A blank and the text, in pieces that begin with a unit."""
        text = " " + text
        start = 0
        while self.by_units and len(text) - start > PIECE:
            cut = self.cut.search(text, start + PIECE)
            if cut is None:
                break
            yield text[start : cut.start()]
            start = cut.start()
        yield text[start:]

    def units(self, piece: str) -> list[str]:
        if not self.by_units:
            return [piece]
        return self.cut.split(piece) if self.doubt.search(piece) else UNIT.findall(piece)

    def _encode_a(self, units: list[str], data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units, one after the other, and how many each has."""
        ids, n = np.zeros(0, np.int64), np.zeros(len(units), np.int64)
        fast = np.array([bool(self.merger and JOINED.fullmatch(u)) for u in units])
        if fast.any():
            ids = self.rank_ids[self.merger.encode_ordinary("".join([u for u, f in zip(units, fast, strict=True) if f]))]
            ends = np.cumsum(self.a_table[2][ids])
            own = np.cumsum([len(d) for d, f in zip(data, fast, strict=True) if f])
            last = np.searchsorted(ends, own)
            if (ends[np.minimum(last, len(ends) - 1)] == own).all():
                n[fast] = np.diff(last + 1, prepend=0)
            else:
                fast[:] = False
        rest = [u for u, f in zip(units, fast, strict=True) if not f]
        found = [x.ids for x in self.a.encode_batch(rest, add_special_tokens=False)]
        n[~fast] = [len(x) for x in found]
        out, start = np.zeros(int(n.sum()), np.int64), _starts(n)
        if fast.any():
            out[ragged(start[fast], n[fast])] = ids
        out[ragged(start[~fast], n[~fast])] = np.fromiter(chain.from_iterable(found), np.int64)
        return out, n

    def _encode_b(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.b.encode([u[1:] if u[0] == " " else u for u in units], num_threads=1)
        # B has put its own blank before a unit that begins with other white space.
        # Of nothing behind it B makes nothing; at the end of a text it is a token.
        blank = [self.b.piece_to_id("▁")]
        found = [blank if u == " " else ids if u[0] == " " else ids[1:] for u, ids in zip(units, found, strict=True)]
        n = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int64, int(n.sum())), n

    def _learn(self, units: list[str]) -> None:
        """Encode and align new units."""
        data = [u.encode() for u in units]
        n = len(units)
        (a, n_a), (b, n_b) = self._encode_a(units, data), self._encode_b(units)
        good = _gives_back(self.a_table, a, n_a, data) & _gives_back(self.b_table, b, n_b, data)
        if not good.all():
            a, b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)]
            n_a, n_b = np.where(good, n_a, 0), np.where(good, n_b, 0)
        a_end, b_end = (np.cumsum(t[2][x]) for t, x in ((self.a_table, a), (self.b_table, b)))
        both = np.intersect1d(a_end, b_end, assume_unique=True)
        a_group, b_group = np.searchsorted(both, a_end), np.searchsorted(both, b_end)
        in_a, in_b = np.bincount(a_group, minlength=len(both)), np.bincount(b_group, minlength=len(both))
        a_from, b_from = _starts(in_a), _starts(in_b)
        unit_of = np.repeat(np.arange(n), n_a)[a_from]  # of each group
        n_groups = np.bincount(unit_of, minlength=n)
        links = np.zeros(n, np.int64)
        np.add.at(links, unit_of, in_a * in_b)

        # Pairs of small groups at once; of a large one by distinct ids.
        large = in_a * in_b > 10_000
        each = np.where(large, 0, in_a * in_b)
        group = np.repeat(np.arange(len(both)), each)
        step = ragged(np.zeros(len(both), np.int64), each)
        left, right = a[a_from[group] + step // in_b[group]], b[b_from[group] + step % in_b[group]]
        owner, code, times = [unit_of[group]], [left << BITS | right], [np.ones(len(group), np.int64)]
        for g in np.flatnonzero(large).tolist():
            x, x_n = np.unique(a[a_from[g] : a_from[g] + in_a[g]], return_counts=True)
            y, y_n = np.unique(b[b_from[g] : b_from[g] + in_b[g]], return_counts=True)
            code.append((x[:, None] << BITS | y[None, :]).ravel())
            times.append((x_n[:, None] * y_n[None, :]).ravel())
            owner.append(np.full(len(code[-1]), unit_of[g]))
        owner, code, times = _distinct(np.concatenate(owner), np.concatenate(code), np.concatenate(times))

        self.text += self._shown(a, b, in_a, in_b, n_a + n_b)
        known = len(self.good)
        for i, unit in enumerate(units):
            self.memory[unit] = known + i
        self.chars += sum(map(len, units))
        pairs = np.bincount(owner, minlength=len(units))
        self.good = np.concatenate([self.good, good])
        self.used = np.concatenate([self.used, np.zeros(n, np.int64)])
        self.sizes = np.concatenate([self.sizes, np.stack([n_a, n_b, n_groups, links], axis=1)])
        self.begin = np.concatenate([self.begin, len(self.code) + _starts(pairs)])
        self.count = np.concatenate([self.count, pairs])
        self.code, self.times = np.concatenate([self.code, code]), np.concatenate([self.times, times])

    def _shown(self, a, b, in_a, in_b, tokens) -> list[bytes]:
        """'a1,a2|b1;a3|b2,b3;' of each unit; ``tokens``: how many each has."""
        a_from, b_from = _starts(in_a), _starts(in_b)
        ids, mark = np.zeros(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        ids[np.arange(len(a)) + np.repeat(b_from, in_a)] = a
        ids[np.arange(len(b)) + np.repeat(a_from + in_a, in_b)] = b
        mark[a_from + b_from + in_a - 1] = ord("|")
        mark[a_from + b_from + in_a + in_b - 1] = ord(";")
        size = self.n_digits[ids]
        rows = self.digits[ids]
        rows[np.arange(len(ids)), size] = mark
        blob = rows[np.arange(self.width)[None, :] <= size[:, None]].tobytes()
        ends = np.concatenate([[0], np.cumsum(size + 1)])[np.concatenate([[0], np.cumsum(tokens)])].tolist()
        return [blob[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True)]

    def _numbers(self, units: list[str]) -> np.ndarray:
        numbers = np.fromiter((self.memory.get(u, -1) for u in units), np.int64, len(units))
        if len(numbers) and numbers.min() < 0:
            if len(self.good) > REMEMBERED or self.chars > REMEMBERED_CHARS:
                self._shrink()
            self._learn([u for u in dict.fromkeys(units) if u not in self.memory])
            numbers = np.fromiter(map(self.memory.__getitem__, units), np.int64, len(units))
        self.used += np.bincount(numbers, minlength=len(self.used))
        return numbers

    def _read(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, list[bytes], tuple]:
        """Of each piece: sizes, whether all its units are good, its groups; and all pairs."""
        split = [self.units(p) for p in pieces]
        numbers = self._numbers(list(chain.from_iterable(split)))
        n = np.array([len(x) for x in split], np.int64)
        owner = np.repeat(np.arange(len(pieces)), n)
        start = _starts(n)
        good = np.logical_and.reduceat(self.good[numbers], start)
        sizes = np.add.reduceat(self.sizes[numbers], start, axis=0)
        listed = numbers.tolist()
        text = [
            b"".join([self.text[u] for u in listed[s : s + k]])[:-1] if ok else b""
            for s, k, ok in zip(start.tolist(), n.tolist(), good.tolist(), strict=True)
        ]
        right = good[owner]
        unit_key, often = _sums((owner << 32 | numbers)[right], np.ones(int(right.sum()), np.int64))
        owner, unit = unit_key >> 32, unit_key & 0xFFFFFFFF
        count = self.count[unit]
        at = ragged(self.begin[unit], count)
        pairs = _distinct(np.repeat(owner, count), self.code[at], self.times[at] * np.repeat(often, count))
        return np.where(good[:, None], sizes, 0), good, text, pairs

    def _long(self, text: str, first: int, keep: bool) -> Aligned:
        """One text, piece by piece; its distinct pairs and its digest are carried on."""
        sizes, sha, kept = np.zeros(4, np.int64), hashlib.sha256(), []
        code, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for i, piece in enumerate(self.pieces(text)):
            more, good, groups, pairs = self._read([piece])
            if not good[0]:
                return self._block(first, np.zeros((1, 4), np.int64), [False], [""], [b""], (code[:0],) * 3)
            sha.update((b";" if i else b"") + groups[0])
            kept += groups if keep else []
            sizes = sizes + more[0]
            code, times = _sums(np.concatenate([code, pairs[1]]), np.concatenate([times, pairs[2]]))
        pairs = (np.zeros(len(code), np.int64), code, times)
        return self._block(first, sizes[None, :], [True], [sha.hexdigest()], [b";".join(kept) if keep else None], pairs)

    @staticmethod
    def _block(first, sizes, good, digest, groups, pairs) -> Aligned:
        return Aligned(first, *sizes.T, [d if ok else "" for d, ok in zip(digest, good, strict=True)], groups, *pairs)

    def read(self, texts: list[str | None], keep: bool = False) -> Iterator[Aligned]:
        """All texts in order, some at a time; ``keep``: with their groups as text."""
        first, some, size = 0, [], 0
        for i, text in enumerate([*texts, None]):
            text = text or ""
            if some and (i == len(texts) or size + len(text) > PIECE):
                yield self._some(first, some, keep)
                some, size = [], 0
            if i == len(texts):
                break
            if len(text) > PIECE:
                yield self._long(text, i, keep)
                continue
            first = first if some else i
            some.append(text)
            size += len(text)

    def _some(self, first: int, texts: list[str], keep: bool) -> Aligned:
        sizes, good, groups, pairs = self._read([" " + t if t else "\t" for t in texts])
        empty = np.array([not t for t in texts])
        sizes[empty] = 0
        good &= ~empty
        right = ~empty[pairs[0]]
        digest = [hashlib.sha256(g).hexdigest() for g in groups]
        shown = [(g if ok else b"") if keep else None for g, ok in zip(groups, good.tolist(), strict=True)]
        return self._block(first, sizes, good.tolist(), digest, shown, tuple(p[right] for p in pairs))


def _distinct(owner: np.ndarray, code: np.ndarray, times: np.ndarray):
    """One row for each owner and code, with the sum of the times."""
    rank = np.unique(code)
    place = np.searchsorted(rank, code)
    key, total = _sums(owner * max(1, len(rank)) + place, times)
    return key // max(1, len(rank)), rank[key % max(1, len(rank))], total


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """One per worker and pair of vocabularies, with its memory of units."""
    if (a_path, b_path) not in _aligners:
        _aligners[a_path, b_path] = Aligner(a_path, b_path)
    return _aligners[a_path, b_path]
