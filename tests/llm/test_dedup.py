import hashlib
import random
import re
from collections import Counter, defaultdict

from cmdlog_spark.llm import exact_dedup, ngram_join, paragraph_dedup
from cmdlog_spark.llm.common import pick
from cmdlog_spark.llm.components import components
from cmdlog_spark.llm.cuckoo import CuckooIndex

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_cuckoo_inserts_deletes_and_grows():
    index, live = CuckooIndex(4), Counter()
    rng = random.Random(1)
    for step in range(20_000):
        digest = hashlib.sha256(str(rng.randrange(3_000)).encode()).digest()
        if rng.random() < 0.6:
            assert index.insert(digest, step) == (live[digest] == 0)
            live[digest] += 1
        elif live[digest]:
            live[digest] -= 1
            assert index.delete(digest) == (live[digest] == 0)
        else:
            assert not index.delete(digest)
    assert {e[0]: e[2] for e in index.entries()} == {d: n for d, n in live.items() if n}
    assert index.live == len(list(index.entries()))


def test_exact_groups(make_docs):
    docs = make_docs((5, "a  b"), (3, "a\nb"), (9, None), (8, ""), (7, "A b"), (3, "a b"), (None, "a b"), (4, " a b"))
    got = sorted((r.doc_id or -1, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs, 2).collect())
    assert got == [
        (-1, 3, 4, False), (3, 3, 4, False), (3, 3, 4, True), (4, 4, 1, True), (5, 3, 4, False),
        (7, 7, 1, True), (8, 8, 2, True), (9, 8, 2, False),
    ]
    kept = exact_dedup.keep_exact_firsts(docs)
    assert kept.columns == docs.columns
    assert sorted(r[0] for r in kept.collect()) == [3, 4, 7, 8]
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0


def test_index_changes(spark):
    kinds = "digest binary, doc_id long, copies long"
    live = spark.createDataFrame([(bytearray(b"a" * 32), 1, 2), (bytearray(b"b" * 32), 5, 1)], kinds)
    two = "digest binary, doc_id long"
    gone = spark.createDataFrame([(bytearray(b"b" * 32), 5), (bytearray(b"z" * 32), 5)], two)
    new = spark.createDataFrame([(bytearray(b"c" * 32), 9), (bytearray(b"a" * 32), 0)], two)
    got = exact_dedup.apply_changes(live, new, gone).collect()
    assert sorted((bytes(r.digest)[:1], r.doc_id, r.copies, r.was_live) for r in got) == [
        (b"a", 0, 3, True), (b"c", 9, 1, False),
    ]


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(i, i + 1) for i in range(300, 360)]
    parent = {x: x for link in links for x in link}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in links if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def brute_components(rows, size, percent):
    sets = [(i, shingles(t, size)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in sets:
        for j, b in sets:
            if i < j and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


def test_jaccard_components_equal_brute_force(make_docs):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for base in range(12):
        text = [rng.choice(words) for _ in range(rng.randrange(3, 90))]
        for _ in range(rng.randrange(1, 9)):
            copy = list(text)
            for _ in range(rng.randrange(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows), " ".join(copy).title() if rng.random() < 0.2 else "\n".join(copy)))
    rows += [(900, None), (901, ""), (902, "two words"), (903, "TWO words"), (904, "x " * 30_000)]
    for size, percent in ((4, 85), (5, 80)):
        got = ngram_join.jaccard_components(make_docs(*rows), ngram_join.Settings(size, percent)).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, size, percent)
    kept = ngram_join.keep_component_firsts(make_docs(*rows, (0, rows[0][1])))
    want = {c for i, (n, c) in brute_components(rows, 4, 85).items() if n} | {900, 901}
    assert sorted(r[0] for r in kept.collect()) == sorted(want)


def test_jaccard_of_nothing(make_docs):
    docs = make_docs((1, "a")).limit(0)
    assert ngram_join.jaccard_components(docs).count() == 0
    assert ngram_join.keep_component_firsts(docs).columns == docs.columns


def test_passages_are_found_and_clean_documents_left(make_docs):
    rng = random.Random(7)

    def text(n):
        return " ".join(f"{rng.choice('abcé')}{rng.randrange(10**6)}" for _ in range(n))

    passage, line = text(60), text(80)
    words = line.split()
    near = " ".join([*words[:40], "new", *words[41:]])
    rows = [
        (1, f"{text(70)} {passage} {text(50)}"), (2, f"{text(30)}\n{text(9)} {passage} {text(90)}"),
        (3, f"{text(5)}\n{line}\n{text(5)}"), (4, near), (5, text(200)), (6, None), (7, ""),
        (8, f"{(own := text(50))}\n{own}"), (None, passage), (9, text(20_000)),
    ]
    got = paragraph_dedup.repeated_passages(make_docs(*rows)).collect()
    assert {r.doc_id for r in got} == {1, 2, 3, 4}
    assert {r.doc_id for r in got if r.removed} == {2, 4}
    texts = dict(rows)
    for r in got:
        part = texts[r.doc_id][r.start : r.end]
        assert part in (passage if r.doc_id < 3 else texts[r.doc_id]), r
        assert len(part.split()) >= 32
    assert paragraph_dedup.repeated_passages(make_docs(*rows).limit(0)).count() == 0


def test_blocks_hit_every_long_passage():
    rng = random.Random(2)
    settings = paragraph_dedup.Settings()
    for _ in range(40):
        passage = " ".join(str(rng.random()) for _ in range(settings.block + settings.spacing - 1))
        codes = defaultdict(int)
        for _ in range(2):
            before = " ".join(str(rng.random()) for _ in range(rng.randrange(40)))
            after = " ".join(str(rng.random()) for _ in range(rng.randrange(40)))
            for group in paragraph_dedup.groups([f"{before} {passage} {after}"]):
                for code in set(group.blocks(settings)[1].tolist()):
                    codes[code] += 1
        assert max(codes.values()) == 2


def test_edits_of_one_line_link_as_brute_force_says(make_docs):
    rng = random.Random(11)
    base = [f"v{rng.randrange(10**6)}" for _ in range(60)]
    rows = []
    for _ in range(60):
        far = list(base)
        for at in rng.sample(range(60), 3):  # like the others of the bucket, but not similar to them
            far[at] = f"e{rng.randrange(10**6)}"
        for _ in range(rng.randrange(1, 4)):
            close = list(far)
            close[rng.randrange(60)] += "x"
            rows.append((len(rows), " ".join(close)))
    docs = pick(make_docs(*rows), doc_id="long", text="string")
    settings = paragraph_dedup.Settings()
    lines = paragraph_dedup.paragraphs(docs, settings).filter("bands IS NOT NULL")
    links = paragraph_dedup.similar_lines(docs, lines, settings)
    code_of = {r.doc_id: r.code for r in lines.collect()}
    roots = {r.node: r.root for r in components(links).collect()}
    got = defaultdict(set)
    for i, code in code_of.items():
        got[roots.get(code, code)].add(i)
    want = defaultdict(set)
    for i, (_, component) in brute_components(rows, 5, 80).items():
        want[component].add(i)
    assert len(want) > 20
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_passages_over_several_lines_are_found(make_docs):
    rng = random.Random(13)

    def words(n):
        return [f"{rng.choice('abcé')}{rng.randrange(10**6)}" for _ in range(n)]

    def wrapped(items, width):
        return "\n".join(" ".join(items[i : i + width]) for i in range(0, len(items), width))

    passage, other = words(60), words(60)
    rows = [
        (1, f"{wrapped(words(40), 9)}\n{wrapped(passage, 12)}\n{wrapped(words(30), 8)}"),
        (2, f"{wrapped(words(25), 7)} {wrapped(passage, 7)} {wrapped(words(25), 20)}"),
        (3, f"{' '.join(words(20))} {' '.join(passage)} {' '.join(words(20))}"),
        (4, wrapped(words(300), 10)),
        (5, "\n".join(other)), (6, wrapped(words(50) + other, 4)),
    ]
    got = paragraph_dedup.repeated_passages(make_docs(*rows)).collect()
    assert {r.doc_id for r in got} == {1, 2, 3, 5, 6}
    assert {r.doc_id for r in got if r.removed} == {2, 3, 6}
    texts = dict(rows)
    for r in got:
        part = texts[r.doc_id][r.start : r.end].split()
        assert " ".join(part) in " ".join(passage if r.doc_id < 4 else other)
        assert len(part) >= 32


def test_blocks_cross_the_pieces_of_a_long_text(monkeypatch):
    from cmdlog_spark.llm import words

    rng = random.Random(17)
    settings = paragraph_dedup.Settings()
    texts = ["é".join(str(rng.random()) for _ in range(3)) + "\n" + " ".join(str(rng.random()) for _ in range(n)) for n in (900, 3, 700)]
    want = set()
    for g in paragraph_dedup.groups(texts):
        at, code = g.blocks(settings)
        want |= set(zip(g.text[at].tolist(), code.tolist(), g.from_[at].tolist(), strict=True))
    for size in (50, 700, 2_000, 5_000):
        monkeypatch.setattr(words, "GROUP", size)
        found = []
        for g in paragraph_dedup.groups(texts):
            at, code = g.blocks(settings)
            found += zip(g.text[at].tolist(), code.tolist(), g.from_[at].tolist(), strict=True)
        assert len(found) == len(set(found))
        # Every 16 blocks in a row of a text have one that both ways of cutting take.
        for n in (0, 2):
            both = sorted(start for text, _, start in want & set(found) if text == n)
            words_of = [m.start() for m in re.finditer(r"\S+", texts[n])]
            place = [words_of.index(start) for start in both]
            assert place and all(b - a <= settings.spacing for a, b in zip(place, place[1:]))


def test_chains_of_overlapping_passages_survive_once(make_docs):
    rng = random.Random(19)
    words = [f"{rng.choice('abcé')}{rng.randrange(10**6)}" for _ in range(420)]
    line, long = words[:220], words[220:]
    parts = {1: line[:100], 2: line[:200], 3: line[49:210], 5: long[:120], 6: long[60:], 7: long}
    rows = [(i, " ".join(part)) for i, part in parts.items()]
    got = paragraph_dedup.repeated_passages(make_docs(*rows)).collect()
    texts, left = dict(rows), Counter()
    for i, text in rows:
        gone = [(r.start, r.end) for r in got if r.doc_id == i and r.removed]
        for m in re.finditer(r"\S+", text):
            left[m.group()] += not any(a <= m.start() and m.end() <= b for a, b in gone)
    covered = Counter(w for part in parts.values() for w in part)
    assert all(left[w] >= 1 for w in covered)
    # The ends of a passage may lie outside its blocks.
    assert sum(left.values()) <= len(covered) + 6 * 15
    kept = [texts[r.doc_id][r.start : r.end] for r in got if not r.removed]
    assert any(" ".join(line[115:185]) in part for part in kept)


def test_short_lines_and_edited_passages_inside_long_ones(make_docs):
    rng = random.Random(23)

    def words(n):
        return [f"{rng.choice('abcé')}{rng.randrange(10**6)}" for _ in range(n)]

    def inside(items):
        return " ".join([*words(30), *items, *words(30)])

    five, twenty, four = words(5), words(20), words(4)
    rows = [
        (1, "\n".join(map(" ".join, (words(9), five, words(7), twenty, four)))),
        (2, "\n".join(map(" ".join, (five, words(8))))),
        (3, "\n".join(map(" ".join, (words(8), [*twenty[:-1], "edited"])))),
        (4, "\n".join(map(" ".join, (words(8), four)))),
    ]
    edited = {}
    for i in range(10, 40, 3):
        passage = words(90)
        one, two = [*passage[:30], "new", *passage[31:60], "put", *passage[60:]], [*passage[:29], *passage[30:60], "x", *passage[61:]]
        rows += [(i, inside(passage)), (i + 1, inside(one)), (i + 2, inside(two).replace(" ", "\n"))]
        edited[i] = set(passage) | {"new", "put", "x"}
    got = paragraph_dedup.repeated_passages(make_docs(*rows)).collect()
    texts = dict(rows)
    assert sorted((r.doc_id, texts[r.doc_id][r.start : r.end], r.removed) for r in got if r.doc_id < 10) == sorted([
        (1, " ".join(five), False), (1, " ".join(twenty), False), (2, " ".join(five), True),
        (3, " ".join([*twenty[:-1], "edited"]), True),
    ])
    hit = Counter()
    for r in got:
        if r.doc_id >= 10:
            first = r.doc_id - (r.doc_id - 10) % 3
            assert set(texts[r.doc_id][r.start : r.end].split()) <= edited[first]
            hit[r.doc_id] |= r.removed
    assert sum(hit.values()) >= 14  # of 20; no block of theirs is equal


def test_parts_that_never_repeat_are_not_staged(make_docs, monkeypatch):
    from cmdlog_spark.llm import repeats

    rng = random.Random(29)

    def words(n):
        return [f"{rng.choice('abcé')}{rng.randrange(10**6)}" for _ in range(n)]

    passage, rows = words(120), []
    for i in range(-2, 30):
        edited = [*passage[: 40 + i], "new", *passage[41 + i :]] if i % 3 else passage
        rows.append((i * 7, " ".join([*words(200), *(edited if i % 2 else []), *words(100)])))
    docs = pick(make_docs(*rows, rows[3]), doc_id="long", text="string")
    settings = paragraph_dedup.Settings()
    windows, blocks = defaultdict(set), defaultdict(set)
    for i, text in rows:
        for g in paragraph_dedup.groups([text], settings):
            for code in g.blocks(settings)[1].view("int64").tolist():
                blocks[code].add(i)
            _, _, code, ends = g.windows(settings)
            for c, e in zip(code.view("int64").tolist(), ends.view("int64").tolist(), strict=True):
                windows[e].add((i, c))
    want_blocks = {(i, c) for c, ids in blocks.items() if len(ids) > 1 for i in ids}
    want_windows = {(i, c, e) for e, s in windows.items() if all(len(set(x)) > 1 for x in zip(*s, strict=True)) for i, c in s}
    assert want_blocks and want_windows
    for gathered in (1, 1 << 20):
        monkeypatch.setattr(repeats, "GATHERED", gathered)
        got = paragraph_dedup.repeated_blocks(docs, settings).collect()
        assert {(r.doc_id, r.code) for r in got} == want_blocks
        got = paragraph_dedup.open_windows(docs, settings).collect()
        assert {(r.doc_id, r.code, r.bands[0]) for r in got} == want_windows
    assert len(want_blocks) < sum(map(len, blocks.values())) / 2
