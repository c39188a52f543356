import random
import re
import zlib
from collections import Counter

from xxhash import xxh64_intdigest

from cmdlog_spark.llm import simhash, spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(u, v):
    if abs(len(u) - len(v)) > 1 or u == v:
        return False
    if len(u) == len(v):
        return sum(x != y for x, y in zip(u, v, strict=True)) == 1
    u, v = sorted((u, v), key=len)
    return any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


def brute_words(rows, typos):
    total = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % typos == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 6 and n >= 5}


def brute_variants(rows, typos):
    words = brute_words(rows, typos)
    out = {}
    for w, n in words.items():
        near = [v for v in words if one_edit(w, v)]
        top = min(near, key=lambda v: (-words[v], v), default=None)
        form = top if top is not None and words[top] >= 5 * n else None
        out[w] = (n, len(near), form, words[form] if form else None)
    roots = {}
    for w in words:
        root = w
        while out[root][2]:
            root = out[root][2]
        roots[w] = root
    return {w: (*x, roots[w]) for w, x in out.items()}


def variants_of(df):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()}


def family(rng, word, alphabet="abcdé"):
    at = rng.randrange(len(word))
    kind = rng.randrange(3)
    return word[:at] + ("" if kind == 0 else rng.choice(alphabet)) + word[at + (kind != 1) :]


def test_variants_equal_brute_force(make_docs):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdé") for _ in range(rng.randrange(6, 11))) for _ in range(30)]
    pool = base + [family(rng, w) for w in base for _ in range(6)]
    pool += [family(rng, w) for w in pool]
    rows = [
        (i, " ".join(rng.choices(pool, k=40) + rng.choices(base, k=60 if i % 3 else 0)).title()) for i in range(300)
    ]
    rows += [(None, "Ignored " * 9), (1000, None), (1001, ""), (1002, "12 34"), (1003, "×÷" * 5000 + " x")]
    want = brute_variants(rows, 7)
    got = variants_of(spelling.spelling_variants(make_docs(*rows), spelling.Settings(typos=7)))
    assert got == want
    assert any(x[2] for x in want.values()) and len({x[4] for x in want.values()}) < len(want)


def test_crowded_halves_are_cut_into_blocks(spark):
    rng = random.Random(6)
    words = list({"common" + "".join(rng.choice("ab") for _ in range(9)) for _ in range(400)})
    words += ["outside", "outsides", "outsidess", "z" * 5000, "z" * 5001]
    table = spark.createDataFrame([(w, i + 5) for i, w in enumerate(words)], "word string, n long")
    counts = {w: i + 5 for i, w in enumerate(words)}
    want = {(u, v, counts[v]) for u in words for v in words if one_edit(u, v)}
    for tile, block in ((64, 50), (100_000, 100_000)):
        got = spelling.near_words(table, tile, block).collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_no_words(make_docs):
    assert spelling.spelling_variants(make_docs((1, "a b")).limit(0)).count() == 0
    assert spelling.spelling_variants(make_docs((1, "short few"))).count() == 0


def brute_fingerprint(text, size=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    size = min(size, len(words))
    codes = [xxh64_intdigest(" ".join(words[i : i + size]).encode(), 42) for i in range(len(words) - size + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(c >> b & 1 for c in codes) > len(codes))


def brute_simhash(rows, radius=2):
    prints = [brute_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        own = [d for j, (d, _) in enumerate(rows) if find(j) == find(i) and d is not None]
        out.append((doc_id, f"{prints[i]:016x}", min(own, default=None)))
    return out


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r))


def test_simhash_equals_brute_force(make_docs):
    rng = random.Random(8)
    texts = []
    for i in range(150):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(1, 400))]
        texts.append(" ".join(words))
        for _ in range(rng.randrange(3)):
            other = words[:]
            other[rng.randrange(len(other))] = "Changed"
            texts.append("\t ".join(other))
    texts += ["", None, " \n", "one", "ONE", "two words", "two  words", "the same " * 70_000, "a b c a b c"]
    rows = [(3 * i % 509, t) for i, t in enumerate(texts)] + [(None, "two words"), (None, "lonely")]
    got = [tuple(r) for r in simhash.simhash_components(make_docs(*rows)).collect()]
    assert in_order(got) == in_order(brute_simhash(rows))
    assert simhash.simhash_components(make_docs(*rows).limit(0)).count() == 0


def test_all_pairs_within_the_radius(spark):
    rng = random.Random(9)
    codes = {rng.getrandbits(64) for _ in range(400)} | {0, (1 << 64) - 1}
    for code in list(codes)[:200]:
        for bits in (1, 2, 3):
            other = code
            for b in rng.sample(range(64), bits):
                other ^= 1 << b
            codes.add(other)
    crowd = {0b1111 << (16 * 3) | 1 << a | 1 << b for a in range(16) for b in range(a)}  # one cell
    codes = sorted(codes | crowd)
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    table = spark.createDataFrame([(c,) for c in signed], "code long")
    for radius, block in ((2, 16), (1, 2_048), (0, 8)):
        got = [(r.a, r.b) for r in simhash.links(table, radius, block).collect()]
        want = {
            frozenset((x, y))
            for i, x in enumerate(signed)
            for y in signed[:i]
            if ((x ^ y) & (1 << 64) - 1).bit_count() <= radius
        }
        assert len(got) == len(want) and {frozenset(p) for p in got} == want
