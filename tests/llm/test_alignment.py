import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cmdlog_spark.llm import cross_tokens
from cmdlog_spark.llm.queries import vocabularies
from cmdlog_spark.llm.token_align import Aligner

ZERO = (0, 0, 0, 0, 0, 0, "")


def byte_letters():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def brute_alignment(texts):
    """Whole texts, token by token, without units or vectors."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    names = vocabularies()
    a_lib, b_lib = Tokenizer.from_file(names.a), SentencePieceProcessor(model_file=names.b)
    a_lib.encode_special_tokens = True
    letters = byte_letters()

    def a_bytes(i):
        return bytes(letters[c] for c in a_lib.id_to_token(i))

    def b_bytes(i):
        piece = b_lib.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b_lib.is_byte(i) else piece.replace("▁", " ").encode()

    documents, linked = [], []
    for text in texts:
        tokens = None
        if text:
            a = a_lib.encode(" " + text, add_special_tokens=False).ids
            b = b_lib.encode(text)
            whole = (" " + text).encode()
            if b"".join(map(a_bytes, a)) == whole and b"".join(map(b_bytes, b)) == whole:
                tokens = a, b
        if not tokens:
            documents.append(None)
            linked.append(Counter())
            continue
        a, b = tokens
        groups, x, y, left, right = [], 0, 0, [], []
        i = j = 0
        while i < len(a) or j < len(b):
            if x <= y and i < len(a) and not (x == y and left):
                left.append(a[i])
                x += len(a_bytes(a[i]))
                i += 1
            else:
                right.append(b[j])
                y += len(b_bytes(b[j]))
                j += 1
            if x == y and left and right:
                groups.append((left, right))
                left, right = [], []
        documents.append((a, b, groups))
        linked.append(Counter((p, q) for l, r in groups for p in l for q in r))
    count = Counter(pair for links in linked for pair in links)
    best = defaultdict(int)
    for (p, _), n in count.items():
        best[p] = max(best[p], n)
    out = []
    for one, links in zip(documents, linked, strict=True):
        if one is None:
            out.append(ZERO)
            continue
        a, b, groups = one
        shown = ";".join(",".join(map(str, l)) + "|" + ",".join(map(str, r)) for l, r in groups)
        out.append(
            (
                len(a), len(b), len(groups), sum(links.values()),
                sum(t for pair, t in links.items() if count[pair] == best[pair[0]]),
                sum(t * count[pair] for pair, t in links.items()),
                hashlib.sha256(shown.encode()).hexdigest(),
            )
        )
    return out, count


TEXTS = [
    "The quick brown fox, unbelievably, jumped over the lazy dog.",
    "The quick brown fox, unbelievably, jumped over the lazy dog.",
    "  two  blanks\n\nand lines\r\n\ttabs \n mixed \t\n",
    "code {\r\n  x = 1;\r\n} );\r end\r\n\r\n  */\r",
    "café naïve übermäßig 日本語のテキスト \U0001f600 สวัสดี",
    "no break space\x1cand\x85others   x　y ​ z᠎",
    "<|endoftext|> <s> </s> <unk> <0x41> plain",
    "a ▁ block",
    "", None, " ", "\n", "x" * 3000, "=" * 500 + "\n" + "-" * 77, "1234567890123 0x1F don't I'll THEY'VE",
    "hahahahaha ahahahaha nanananana", "a\0b", "word " * 400 + "\nend", "\ttab first", "end \n",
]


def rows_of(df):
    cols = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return {r.doc_id: tuple(r[c] for c in cols) for r in df.collect()}


@pytest.mark.parametrize("most_pairs", [0, 5, 1 << 18])
def test_alignment_equals_brute_force(make_docs, most_pairs):
    docs = make_docs(*enumerate(TEXTS))
    want, _ = brute_alignment(TEXTS)
    got = rows_of(cross_tokens.align(docs.repartition(4), vocabularies(), most_pairs=most_pairs))
    assert got == dict(enumerate(want))
    assert want[7] == ZERO == want[8]  # a mark that stands for a blank; an empty text


def test_pair_counts_and_group_texts(make_docs):
    docs = make_docs(*enumerate(TEXTS))
    _, count = brute_alignment(TEXTS)
    got = {(r.a, r.b): r.documents for r in cross_tokens.pair_counts(docs, vocabularies()).collect()}
    assert got == dict(count)
    shown = cross_tokens.align(docs, vocabularies(), with_groups=True)
    right = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups"), 256)) == F.col("groups_sha256")
    assert shown.filter(right).count() == len(TEXTS)


def test_long_texts_in_pieces(make_docs, monkeypatch):
    monkeypatch.setattr("cmdlog_spark.llm.token_align.PIECE", 40)
    names = vocabularies()
    reader = Aligner(names.a, names.b)
    want, _ = brute_alignment(TEXTS)
    got = [
        (int(a), int(b), int(g), int(n), d)
        for block in reader.read(TEXTS, keep=True)
        for a, b, g, n, d in zip(block.n_a, block.n_b, block.n_groups, block.n_links, block.digest, strict=True)
    ]
    assert got == [(*w[:4], w[6]) for w in want]
    assert reader.merger is not None
    assert reader.units(" a b\nc  d e\r\nf \rg") == [" a", " b", "\nc", "  d", " e\r\nf", " \rg"]
    # A memory that is cleared between texts changes nothing.
    monkeypatch.setattr("cmdlog_spark.llm.token_align.REMEMBERED", 3)
    again = [d for block in Aligner(names.a, names.b).read(TEXTS) for d in block.digest]
    assert again == [w[6] for w in want]


def test_empty_table_and_repeated_ids(make_docs):
    assert cross_tokens.align(make_docs((1, "a")).limit(0), vocabularies()).count() == 0
    docs = make_docs((1, "same words"), (1, "same words"), (None, "other words"), (None, None))
    got = sorted((r.doc_id or -1, r.n_a) for r in cross_tokens.align(docs, vocabularies()).collect())
    assert got == [(-1, 0), (-1, 2), (1, 2), (1, 2)]


def test_joined_units_are_encoded_as_alone(monkeypatch):
    rng = random.Random(7)
    bits = ["a", "Word", "'s", "'ll", " ", "\n", "\t", "12", "é", "ß", "日", ".", "--", "</s>", "\x1c", "\xa0", "x" * 600]
    texts = ["".join(rng.choices(bits, k=rng.randrange(1, 40))) for _ in range(300)]
    names = vocabularies()
    fast, slow = Aligner(names.a, names.b), Aligner(names.a, names.b)
    slow.merger = None
    monkeypatch.setattr("cmdlog_spark.llm.token_align.REMEMBERED", 60)
    one, two = ([d for i in range(0, 300, 20) for b in r.read(texts[i : i + 20]) for d in b.digest] for r in (fast, slow))
    want, _ = brute_alignment(texts)
    assert one == two == [w[6] for w in want]
