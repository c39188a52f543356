"""Token ids of whole texts, word by word, with a bounded memory of words.

Serves vocabularies in the JSON form of the ``tokenizers`` library whose
pre-tokeniser never joins characters across white space and whose words end in a
suffix. The ids are those of the library; plain Latin words, which are most, are
merged by ``tiktoken`` over the same vocabulary, which is faster.
"""

from __future__ import annotations

import json

import numpy as np

from cmdlog_spark.llm.words import BLANK, Words, join_pieces, make_words, ragged, segments

END_OF_TEXT = 1
# Units kept in memory before it is cleared.
REMEMBERED = 1_500_000
MARK = b"|"
# Latin-1: its letters in lower case are Latin-1 again and need no normalisation.
LETTERS = bytes(b for b in range(256) if chr(b).isalpha() and b not in (0xAA, 0xB5, 0xBA))
LOWER = bytes(ord(chr(b).lower()) if b in LETTERS and b != 0xFF else b for b in range(256))
# A run of letters, one digit and a run of marks are units of the pre-tokeniser, whatever
# is beside them. The rest (apostrophes, other Latin-1) decides with its neighbours.
BLANKS, LETTER, DIGIT, POINT, OTHER = range(5)
KIND = np.full(256, OTHER, np.uint8)
KIND[list(LETTERS)] = LETTER
KIND[BLANK] = BLANKS
KIND[48:58] = DIGIT
KIND[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) != "'"]] = POINT


def units(group: list[tuple[int, bytes]]) -> tuple[Words, np.ndarray]:
    """The units of some texts in Latin-1 and lower case, and the kind of each.

    A run of other characters than white space that holds an OTHER is one unit.
    """
    buffer, owners = join_pieces(group)
    kind = KIND[np.frombuffer(buffer, np.uint8)]
    solid = kind != BLANKS
    before = np.concatenate([[np.uint8(BLANKS)], kind[:-1]])
    run_start = solid & (before == BLANKS)
    run = np.cumsum(run_start)
    mixed = np.zeros(int(run[-1]) + 1 if len(run) else 1, bool)
    mixed[run[kind == OTHER]] = True
    whole = mixed[run]
    start = np.flatnonzero(run_start | (solid & ~whole & ((kind != before) | (kind == DIGIT))))
    # A unit ends where the next begins or at a blank.
    stops = np.flatnonzero(~solid)
    following = np.append(start[1:], len(buffer))
    end = np.minimum(following, stops[np.searchsorted(stops, start)]) if len(start) else following[:0]
    kinds = np.where(whole[start], OTHER, kind[start])
    return make_words(buffer, owners, start, end), kinds


class WordTokenizer:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.path = path
        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            self.spec = json.load(file)
        self.fast = self._merger()
        self._forget()

    def _forget(self) -> None:
        """Memory: hashes of units in order, and where their ids lie in ``flat``."""
        self.hashes = np.zeros(0, np.uint64)
        self.begin, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, "<u4")

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        found = self.whole.encode_batch(texts, add_special_tokens=False)
        return [np.array(one.ids, "<u4") for one in found]

    def _merger(self):
        """The vocabulary as byte ranks, a mark standing for the end of a word; None if it has no such form."""
        import tiktoken

        model = self.spec["model"]
        suffix = model.get("end_of_word_suffix")
        if not suffix or model["type"] != "BPE" or model.get("ignore_merges"):
            return None
        letters = _byte_letters()

        def as_bytes(token: str) -> bytes | None:
            ended = token.endswith(suffix)
            body = token[: -len(suffix)] if ended else token
            if any(c not in letters for c in body):
                return None
            return bytes(letters[c] for c in body) + (MARK if ended else b"")

        vocab, mark = model["vocab"], MARK
        ranks = {bytes([b]): b for b in range(256)}
        ids = np.zeros(len(vocab) + 1024, np.int64)
        for b in range(256):  # a last letter and the mark join before all else
            ranks[bytes([b]) + mark] = 256 + b
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            token = as_bytes(left + right)
            if token is None or token in ranks:
                return None
            ranks[token] = 512 + rank
            ids[512 + rank] = vocab[left + right]
        for token, number in vocab.items():
            spelled = as_bytes(token)
            if spelled is not None and spelled in ranks and ranks[spelled] < 512:
                ids[ranks[spelled]] = number
        ends = np.zeros(len(ids), bool)
        for token, rank in ranks.items():
            ends[rank] = token.endswith(mark)
        self.ids, self.ends = ids, ends
        return tiktoken.Encoding(
            "words", pat_str=r"[^ ]+", mergeable_ranks=ranks, special_tokens={}, explicit_n_vocab=None
        )

    def _merge(self, words: Words, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and their number for each, of units that are words of letters."""
        length = words.end[chosen] - words.start[chosen]
        text = np.full(int((length + 2).sum()), 32, np.uint8)
        ends = np.cumsum(length + 2)
        source = np.frombuffer(words.buffer, np.uint8)
        text[ragged(ends - 2 - length, length)] = source[ragged(words.start[chosen], length)]
        text[ends - 2] = MARK[0]
        ranks = np.array(self.fast.encode_ordinary(text.tobytes().decode("latin-1")), np.int64)
        last = np.flatnonzero(self.ends[ranks])
        return self.ids[ranks].astype("<u4"), np.diff(last, prepend=-1)

    def _learn(self, words: Words, kinds: np.ndarray, hashes: np.ndarray) -> None:
        """Put units, one of each, into memory."""
        if len(self.hashes) > REMEMBERED:
            self._forget()
        plain = (kinds == LETTER) if self.fast else np.zeros(len(kinds), bool)
        at, rest = np.flatnonzero(plain), np.flatnonzero(~plain)
        flat, count = self._merge(words, at) if len(at) else (np.zeros(0, "<u4"), np.zeros(0, np.int64))
        if len(rest):
            spans = zip(words.start[rest].tolist(), words.end[rest].tolist(), strict=True)
            found = self._library([words.buffer[a:b].decode("latin-1") for a, b in spans])
            flat = np.concatenate([flat, *found])
            count = np.concatenate([count, [len(x) for x in found]])
        begin = len(self.flat) + np.cumsum(count) - count
        hashes = hashes[np.concatenate([at, rest])]
        order = np.argsort(hashes)
        place = np.searchsorted(self.hashes, hashes[order])
        self.hashes = np.insert(self.hashes, place, hashes[order])
        self.begin = np.insert(self.begin, place, begin[order])
        self.count = np.insert(self.count, place, count[order])
        self.flat = np.concatenate([self.flat, flat])

    def _find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = np.minimum(np.searchsorted(self.hashes, hashes), max(0, len(self.hashes) - 1))
        known = self.hashes[place] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)
        return place, known

    @staticmethod
    def _simple(text: str) -> bytes | None:
        """In Latin-1 and lower case; None if not Latin-1, or if special tokens may be in it."""
        try:
            return None if "<|" in text else text.encode("latin-1").translate(LOWER)
        except UnicodeEncodeError:
            return None

    def _encode_group(self, words: Words, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units of a group, and their number for each."""
        hashes, first, unit = np.unique(words.hashes(), return_index=True, return_inverse=True)
        _, known = self._find(hashes)
        if not known.all():
            new = first[~known]
            forgets = len(self.hashes) > REMEMBERED
            new = first if forgets else new
            self._learn(words.at(new), kinds[new], hashes if forgets else hashes[~known])
        place, _ = self._find(hashes)
        count = self.count[place][unit]
        return self.flat[ragged(self.begin[place][unit], count)], count

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """For each text its ids as unsigned 32-bit integers."""
        simple = [self._simple(t) for t in texts]
        pieces: list[list[np.ndarray]] = [[] for _ in texts]
        for group in segments([d or b"" for d in simple]):
            words, kinds = units(group)
            if not len(kinds):
                continue
            ids, count = self._encode_group(words, kinds)
            numbers, begin = np.unique(words.text, return_index=True)
            cuts = np.concatenate([[0], np.cumsum(count)])[np.append(begin, len(count))]
            for n, a, b in zip(numbers.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                pieces[n].append(ids[a:b])
        others = [n for n, data in enumerate(simple) if data is None]
        for n, ids in zip(others, self._library([texts[n] for n in others]), strict=True):
            pieces[n] = [ids]
        none = np.zeros(0, "<u4")
        return [x[0] if len(x) == 1 else np.concatenate(x) if x else none for x in pieces]


def _byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves, the others from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One per worker and vocabulary, with its memory of words."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]
