import re
from pathlib import Path
from zlib import crc32

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from cmdlog_spark.llm import fm, mixing, packing, quality, secrets_scan, toxicity, url_filter, vector_graph
from cmdlog_spark.llm.queries import table
from cmdlog_spark.llm.tokens import WordTokenizer

SF_DIR = "/root/testdata/sf0.01"
VOCABULARY = str(public_tokenizers.path("word_bpe_49k.json"))


def test_ids_are_those_of_the_library():
    texts = [
        "", "  ", "a<|endoftext|>b", "A<|ENDOFTEXT|> b", "İstanbul ΑΣ it's don't naïve", "½ ² 12,5 ..!! A.,B",
        "ß ÿ Ÿ ÀÉ.", "漢字 かな👍🏽", "a.b c.. x,1 ª º µ", "x\x1cy\xa0z\x85é", "'s x's  y", "word " * 5_000,
    ]
    own, library = WordTokenizer(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    for _ in range(2):
        got = [ids.tolist() for ids in own.encode(texts)]
        assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]


def check_pieces(pieces, texts):
    library = Tokenizer.from_file(VOCABULARY)
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in texts.items()}
    for doc_id, group in pieces.sort_values("start").groupby("doc_id"):
        assert group["start"].tolist() == [0, *group["length"].cumsum().tolist()[:-1]]
        assert group["length"].sum() == len(ids[doc_id])
        for p in group.itertuples():
            part = np.array(ids[doc_id][p.start : p.start + p.length], "<u4").tobytes()
            assert (crc32(part), p.doc_tokens, part) == (p.ids_crc32, len(ids[doc_id]), bytes(p.ids))
    sums = pieces.groupby("sequence_id")["length"].sum()
    full = sums[sums == 2048]
    rest = sums[sums < 2048]
    assert sums.max() <= 2048 and len(full) >= len(sums) - 11
    assert all(n & (n - 1) == 0 for n in rest)
    for _, group in pieces.sort_values("offset").groupby("sequence_id"):
        assert group["offset"].tolist() == [0, *group["length"].cumsum().tolist()[:-1]]


def test_packing_is_whole_and_mixed(make_docs):
    rows = [(i, f"word{i} and some more text " * (i % 40), f"s{i % 3}") for i in range(400)]
    rows += [(1000, None, None), (1001, "", "s1"), (1002, "long " * 30_000, "s2")]
    for targets in (None, {"s0": 0.6, "s1": 0.4}):
        pieces = packing.pack(make_docs(*rows), VOCABULARY, targets).toPandas()
        check_pieces(pieces, {r[0]: r[1] for r in rows})
        assert pieces["doc_id"].nunique() == len(rows)
        first = pieces[pieces["sequence_id"] == 1].groupby("source")["length"].sum() / 2048
        if targets:
            assert abs(first["s0"] - 0.6) < 0.05 and abs(first["s1"] - 0.4) < 0.05
    assert packing.pack(make_docs(*rows).limit(0), VOCABULARY).count() == 0


def test_mix_meets_targets_and_reruns_agree(spark):
    docs = table(spark, SF_DIR, "documents")
    got = mixing.mix(docs, doc_weight=mixing.length_band).toPandas()
    again = mixing.mix(docs.repartition(7), doc_weight=mixing.length_band).toPandas()
    columns = ["doc_id", "taken", "target"]
    assert got.sort_values("doc_id")[columns].values.tolist() == again.sort_values("doc_id")[columns].values.tolist()
    assert (got["copies"] <= 3).all()
    sources = got.groupby("source").agg({"size": "sum", "source_size": "first", "target": "first", "taken": "sum"})
    assert (sources["size"] == sources["source_size"]).all()
    assert (abs(sources["taken"] - sources["target"]) <= 0.03 * sources["target"]).all()
    assert sources["target"].sum() == pytest.approx(sources["size"].sum())


def test_targets_stop_and_reshare(make_docs):
    docs = make_docs((1, "a " * 10, "a"), (2, "b " * 100, "b"), (3, "c " * 5, None), (4, None, "d"), (5, " ", "b"))
    got = {r.doc_id: r for r in mixing.mix(docs).collect()}
    # a: weight 1, b: 2, d: 3 (without words), null: 1; 115 words.
    assert {i: got[i].target for i in got} == {1: 30.0, 2: 70.0, 3: 15.0, 4: 0.0, 5: 70.0}
    assert (got[1].taken, got[3].taken, got[4].taken, got[5].taken) == (30, 15, 0, 0)
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mix_documents(docs, doc_weight=mixing.length_band).columns == docs.columns


@pytest.mark.parametrize("name, threshold", [("toxic", 0.3), ("quality", 0.7)])
def test_classifiers_on_held_out_rows(spark, name, threshold):
    score = toxicity.score_toxicity if name == "toxic" else quality.score_quality
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    got = score(docs, labels).join(labels, "doc_id").toPandas()
    held = [crc32(str(i).encode()) % 4 == 2 for i in got["doc_id"]]
    assert (got["held_out"] == held).all() and got["score"].between(0, 1).all()
    assert (got["predicted"] == (got["score"] >= threshold)).all()
    assert (got["predicted"] == got[name])[held].mean() > 0.97


def test_classifiers_without_labels(spark, make_docs):
    docs = make_docs((1, "x y"), (None, None), (2, ""), (1, "z " * 50_000))
    none = spark.createDataFrame([(1, None, None)], "doc_id long, quality int, toxic int")
    for score in (toxicity.score_toxicity, quality.score_quality):
        assert {r.score for r in score(docs, none).collect()} == {0.5}
        assert score(docs.limit(0), none).count() == 0
    assert quality.keep_good(docs, none).columns == docs.columns


def test_pair_identity():
    model = fm.Model(0.2, np.arange(4, dtype=np.int32), np.array([0.1, 0.2, 0.3, 0.4]), np.arange(12.0).reshape(4, 3) / 9, 0)
    x = {0: 1.0, 2: 2.0, 3: 0.5}
    total = 0.2 + sum(model.weights[i] * v for i, v in x.items())
    total += sum(model.vectors[i] @ model.vectors[j] * x[i] * x[j] for i in x for j in x if i < j)
    got = model.scores(np.zeros(3, int), np.array(list(x)), np.array(list(x.values())), 1)
    assert got[0] == pytest.approx(1 / (1 + np.exp(-total)))


def test_secrets(make_docs):
    token = "kX9vQ2mZ7pL4rT8wB1nY6cD3fG5hJ0s"
    text = f"é Token = 'abcdefghij' AKIA{'ABCD1234' * 2} {'0123456789abcdef' * 2} password: token: abcdefghij {token}"
    rows = [(1, text), (2, None), (3, ""), (4, "plain words only " * 400), (4, "z" * 50_000), (None, "secret=short")]
    got = secrets_scan.scan(make_docs(*rows)).collect()
    assert len(got) == len(rows)
    one = next(r for r in got if r.doc_id == 1)
    assert (one.n_assign, one.n_access, one.n_hex) == (1, 1, 1)
    spans = [s.split(":") for s in one.spans.split(",")]
    found = {(k, text[int(a) : int(b)]) for k, a, b in spans}
    assert ("assign", "Token = 'abcdefghij") in found and ("random", token) in found
    assert all(r.spans == "" for r in got if r.doc_id != 1)
    assert secrets_scan.scan(make_docs((1, "a")).limit(0)).count() == 0


def test_url_rules_hold_in_their_time(spark):
    pages = spark.createDataFrame(
        [(1, "http://a.b.com/x/y", 5), (2, "https://u@A.B.com.:80/", 9), (3, "http://c.org/x", 5), (4, None, 5),
         (5, "no url", 5), (6, "http://b.com/q", None), (1, "http://a.b.com/x/y", 5), (7, "//a.b.com/xx", 100)],
        "page_id long, url string, day long",
    )
    entries = spark.createDataFrame(
        [("a.b.com", "add", 1), ("a.b.com", "remove", 9), (".com", "add", 0), (".com", "remove", 5), (".com", "add", 5),
         ("a.b.com/x", "add", 5), ("c.org", "remove", 1), ("c.org", "add", 6), (None, "add", 1)],
        "rule string, action string, day long",
    )
    got = sorted((r.page_id, r.n_rules, r.rule or "") for r in url_filter.filter_urls(pages, entries).collect())
    assert got == [
        (1, 3, "a.b.com/x"), (1, 3, "a.b.com/x"), (2, 1, ".com"), (3, 0, ""), (4, 0, ""), (5, 0, ""), (6, 0, ""), (7, 1, ".com"),
    ]
    assert url_filter.filter_urls(pages.limit(0), entries).count() == 0
    assert not any(r.blocked for r in url_filter.filter_urls(pages, entries.limit(0)).collect())


def test_graph_search_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(1_500, 16))
    vectors[100:140] = vectors[100]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(2_000, None), (2_020, [0.0] * 16), (2_040, [float("nan")] * 16), (2_060, [1.0, 2.0]), (2_080, []), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = vector_graph.nearest_neighbours(df, vector_graph.Settings(shard_rows=600, wave=40)).toPandas()
    hits = 0
    queries = [i for i in range(1_500) if i % 20 == 0]
    for q in queries:
        scores = (vectors * vectors[q]).sum(axis=1)
        scores[q] = -np.inf
        best = np.lexsort((np.arange(1_500), -scores))[:20]
        own = got[got["query_id"] == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21)) and own["score"].is_monotonic_decreasing
        hits += len(set(own["vec_id"]) & set(best))
    assert hits / len(queries) / 20 >= 0.9
    assert set(got["query_id"]) == set(queries)
    assert vector_graph.nearest_neighbours(df.limit(0)).count() == 0


def test_pipeline_equals_its_stages_in_plain_python(spark):
    """Good ones, each once, one of near copies; the rest of the stages have their own tests."""
    docs = table(spark, SF_DIR, "documents")
    good = quality.score_quality(docs, table(spark, SF_DIR, "labels")).filter("predicted = 1").select("doc_id")
    texts = {r.doc_id: r.text for r in docs.join(good, "doc_id").collect()}
    once = {}
    for i in sorted(texts):
        once.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", texts[i]), i)
    frame = docs
    for _, stage in corpus_pipeline.STAGES[:2]:
        frame = stage(spark, frame, SF_DIR)
        assert frame.columns == docs.columns
    assert sorted(r.doc_id for r in frame.collect()) == sorted(once.values())
    pieces = corpus_pipeline.run(spark, SF_DIR).toPandas()
    assert set(pieces["doc_id"]) <= set(once.values())
    for doc_id, group in pieces.groupby("doc_id"):
        assert group["length"].sum() % group["doc_tokens"].iloc[0] == 0
        assert group["length"].sum() <= 3 * group["doc_tokens"].iloc[0]


def test_url_rules_of_any_depth(spark):
    pages = spark.createDataFrame(
        [(1, "http://a.b.c.d.e.f.g.com/1/2/3/4/5/6/7", 5), (2, "http://h.com/1/2/3/4/5", 5), (3, "http://h.com/1/2/3/4", 5),
         (4, "http://b.c.d.e.f.g.com/", 5)],
        "page_id long, url string, day long",
    )
    rules = [".b.c.d.e.f.g.com", "a.b.c.d.e.f.g.com/1/2/3/4/5/6", "h.com/1/2/3/4/5"]
    entries = spark.createDataFrame([(r, "add", 1) for r in rules], "rule string, action string, day long")
    got = sorted((r.page_id, r.n_rules, r.rule) for r in url_filter.filter_urls(pages, entries).collect())
    assert got == [(1, 2, rules[1]), (2, 1, rules[2]), (3, 0, None), (4, 1, rules[0])]
    top = entries.filter("rule LIKE 'h.com%'")
    assert [r.page_id for r in url_filter.filter_urls(pages, top).collect() if r.blocked] == [2]


def test_underlined_headings_are_no_secrets(make_docs):
    docs = make_docs((1, "Heading\n" + "=" * 30), (2, "A" + "=" * 30), (3, "=" * 20), (4, "x" * 19 + "=" * 5), (5, "password=" + "=" * 9))
    got = {r.doc_id: (r.n_assign, r.spans) for r in secrets_scan.scan(docs).collect()}
    assert got == {1: (0, ""), 2: (0, ""), 3: (0, ""), 4: (0, ""), 5: (1, "assign:0:18")}


def test_pipeline_stages_delete_what_the_last_one_left(spark, tmp_path):
    from cmdlog_spark.functions.staging import staging_root

    rows = [(i, f"text {i} " + " ".join(f"w{(i * j) % 97}" for j in range(60)), "en", "s", 100) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    folder = Path(staging_root(spark).removeprefix("file://")) / "cmdlog"
    before = set(folder.iterdir()) if folder.exists() else set()
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    left = set()
    for i, (name, function) in enumerate(corpus_pipeline.STAGES):
        result = function(spark, docs, str(tmp_path))
        assert not left & set(folder.iterdir())
        result.write.parquet(str(tmp_path / f"out-{i}"))
        docs = spark.read.parquet(str(tmp_path / f"out-{i}"))
        left = set(folder.iterdir()) - before


def test_pipeline_hands_small_batches_to_python(spark, tmp_path):
    from cmdlog_spark.llm import common

    def sizes(batches):
        for batch in batches:
            yield pd.DataFrame({"n": [len(batch)], "size": [int(batch["text"].str.len().sum())]})

    def most():
        wide = spark.range(0, 6_000, numPartitions=1).selectExpr("repeat('x', 8000) AS text")
        return wide.mapInPandas(sizes, "n long, size long").agg(F.max("n"), F.max("size")).first()

    before = {key: spark.conf.get(key) for key in common.BATCH}
    try:
        with common.small_batches(spark):
            n, size = most()
            assert n <= common.SLICE and size <= 8 << 20
        assert {key: spark.conf.get(key) for key in common.BATCH} == before
        spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
        docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
        corpus_pipeline.STAGES[0][1](spark, docs, str(tmp_path))  # its result is not written yet
        n, size = most()
        assert n <= common.SLICE and size <= 8 << 20
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_word_hashes_of_many_texts_take_little_memory():
    import tracemalloc

    from cmdlog_spark.llm import words

    data = [b"some words " * 1_000] * 500
    words._powers.clear()
    tracemalloc.start()
    hashes, cuts = words.word_hashes(data)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert cuts.tolist() == list(range(0, 1_000_001, 2_000)) and len(set(hashes.tolist())) == 2
    assert peak < 64 << 20
