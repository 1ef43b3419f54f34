"""Every operator on nulls, empty and very long texts, ties, repeated rows, extra columns and empty tables."""

import re

import pytest
import public_tokenizers
from evidara.llm import bpe, embeddings, ftrl, gam, licenses, outliers, packing, pieces, quotes, simhash, token_files
from evidara.llm.runtime import new_path
from pyspark.sql import functions as F

FIELDS = "doc_id long, text string, lang string, source string, n_chars long, fp string, node string, label string, part string, key string"
BPE, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def docs(spark):
    words = " ".join(f"word{i % 977} and{i % 31}" for i in range(20_000))
    texts = [(1, "One two three four five six."), (1, "One two three four five six."), (2, None), (3, ""), (None, "No id here at all, none."), (4, words), (5, words + " end"), (6, " \n\t "), (7, "Ünï çødé — 漢字 👍 <|endoftext|> it's"), (8, None)]
    rows = [(i, x, None if i == 3 else "en", None if i == 2 else "s", 0, "a", "b", "c", "d", "e") for i, x in texts]
    return spark.createDataFrame(rows, FIELDS).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 0, 1), (None, 1, 1), (4, None, 0), (9, 1, 1)], "doc_id long, quality int, toxic int")


def empty(df):
    return df.limit(0)


def ids(df, name="doc_id"):
    return sorted((r[0] for r in df.select(name).collect()), key=lambda x: (x is None, x))


ALL = [1, 1, 2, 3, 4, 5, 6, 7, 8, None]


@pytest.mark.parametrize("apply", [
    simhash.near_duplicates, outliers.judged, lambda d: bpe.roundtrip(d, RANKS), lambda d: pieces.roundtrip(d, MODEL), lambda d: licenses.scanned(d, licenses.fit(["some line of text"])),
    lambda d: token_files.read_tokens(token_files.with_starts(token_files.write_tokens(d, new_path(d.sparkSession, "tokens"), BPE))),
], ids=["simhash", "outliers", "bpe", "pieces", "licenses", "token_files"])
def test_a_row_for_each_row(docs, apply):
    assert ids(apply(docs)) == ALL
    assert apply(empty(docs)).count() == 0


def test_packing(docs):
    rows = packing.packed(docs, BPE).collect()
    assert sorted({(r.doc_id is None, r.doc_id) for r in rows}, key=str) == sorted({(x is None, x) for x in ALL}, key=str)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.packed(empty(docs), BPE).count() == 0
    held = packing.packed(docs.where("doc_id = 7"), BPE, with_ids=True)
    assert packing.sequences(held).head().ids[-1] == 0


@pytest.mark.parametrize("module", [gam, ftrl])
def test_classifiers(docs, labels, module):
    model = module.learn(docs, labels)
    got = docs.select("doc_id", module.score(model).alias("score")).collect()
    assert len(got) == len(ALL) and all(0 <= r.score <= 1 for r in got)
    untaught = module.learn(empty(docs), empty(labels))
    assert {round(r.score, 6) for r in docs.select(module.score(untaught).alias("score")).collect()} == {0.5}
    assert empty(docs).select(module.score(model)).count() == 0
    assert module.kept(docs, labels).columns == docs.columns


def test_near_copies_stage(docs):
    got = simhash.one_of_each(docs)
    assert got.columns == docs.columns
    assert ids(got) == [1, 2, 4, 7, None]  # 2, 3, 6 and 8 have no words; 5 is nearly 4
    assert simhash.one_of_each(empty(docs)).count() == 0


def test_embeddings(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, None]), (8, [1.0, 0.0, 0.0]), (None, [0.0, 1.0]), (9, [])]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, node string")
    got = sorted(((r.vec_id is None, r.vec_id), r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df).collect())
    assert [g[1:] for g in got] == [(2, 1, True), (2, 1, False), (2, 1, False), *[(0, i, True) for i in range(3, 10)], (0, None, True)]
    assert embeddings.near_duplicates(empty(df)).count() == 0


def test_quotes(spark):
    rows = [(1, 0, "user", "A b c.\nSecond line."), (1, 1, "assistant", "On Monday user wrote:\n> A  B c.\nYes."), (1, 2, None, "> > Second line.\n> Yes.\nGood."), (1, 2, None, None), (None, 1, "user", "> A b c."), (2, None, "user", ""), (2, 3, "user", "> A b c.")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, row string, body2 string")
    got = {(r.conv_id, r.turn, r.body): (r.n_passages, r.n_linked, r.reply_to, r.thread, r.depth) for r in quotes.linked(df).collect()}
    assert got[1, 1, "Yes."] == (1, 1, 0, 0, 1)
    assert got[1, 2, "Good."] == (2, 2, 1, 0, 2)
    assert got[1, 2, ""] == (0, 0, None, 2, 0)
    assert got[2, 3, ""] == (1, 0, None, 3, 0) and got[None, 1, ""][:2] == (1, 0)
    rows = quotes.conversations(df).collect()
    threads = {(r.conv_id, r.thread): ([x.turn for x in r.replies], r.n_messages) for r in rows}
    assert threads[1, 0] == ([0, 1, 2], 3) and threads[1, 2] == ([2], 1)
    assert sum(r.n_messages for r in rows) == df.count()
    assert quotes.linked(empty(df)).count() == 0 and quotes.conversations(empty(df)).count() == 0


def test_components(spark):
    from evidara.llm.graph import connected_components

    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 100), (5, 5), (None, 1)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 200: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    _ = F


def test_components_of_hubs(spark, monkeypatch):
    """Stars, a chain, a link between hubs and random links, with many hubs and with none."""
    import random

    from evidara.llm import graph

    rng = random.Random(2)
    edges = [(i, 0) for i in range(1, 60)] + [(i, 1000) for i in range(1001, 1080)] + [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(300)]
    edges += [(59, 1050)] + [(3000 + i, 3001 + i) for i in range(40)]
    lead = {}

    def find(x):
        lead.setdefault(x, x)
        while lead[x] != x:
            x = lead[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            lead[max(x, y)] = min(x, y)
    for hub in (5, 1_000):
        monkeypatch.setattr(graph, "HUB", hub)
        got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == {x: find(x) for x in lead}


def test_columns_of_any_name_pass_through(spark, labels):
    """Names that the operators use themselves, in documents that go through the stages."""
    names = ["_row", "_ROW_", "node", "none", "same", "id", "rank", "fp", "fp2", "band", "least", "component", "part", "label", "group", "key", "start", "bin", "length", "place"]
    rows = [(i, f"some words of text number {i} and a few more of them", "en", "s", 0, *range(100 * i, 100 * i + len(names))) for i in (1, 2, 3)]
    rows += [(4, rows[0][1], "en", "s", 0, *range(400, 400 + len(names)))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} long" for n in names))
    want = {r[0]: tuple(r[5:]) for r in rows if r[0] != 4}
    got = {r.doc_id: tuple(r)[5:] for r in simhash.one_of_each(df).collect()}
    assert got == want
    for module in (gam, ftrl):
        assert module.kept(df, labels).columns == df.columns
    assert outliers.judged(df).count() == licenses.scanned(df, licenses.fit(["some line"])).count() == packing.packed(df, BPE).count() == 4


def test_repeated_labels_count_once(spark):
    from evidara.llm.labelled import sample

    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    known = spark.createDataFrame([(1, 0), (1, 1), (1, 1), (2, 0)], "doc_id long, quality int")
    got = sorted(tuple(r) for r in sample(docs, known, "quality", F.lit(True), 10).collect())
    assert got == [("a", 1), ("b", 0)]


def test_paths_for_token_files():
    assert token_files.as_uri("s3a://b/x") == "s3://b/x" and token_files.as_uri("/x/y") == "file:///x/y" and token_files.as_uri("file:///x") == "file:///x"


def test_operators_and_the_pipeline_are_registered():
    import __spark_entry__ as entry

    own = entry.queries()
    assert sorted(k.split("_")[0] for k in own if re.match(r"op\d+_", k)) == sorted(f"op{n}" for n in range(1, 14)) and "pipeline" in own
    assert {"op1_p_stable_embeddings", "op12_block_max_wand", "op13_anagram_variants"} <= set(entry.oracle_sql())


def test_pipeline_on_tables_of_any_content(spark, tmp_path):
    """The whole chain: empty tables, null texts and ids, repeated rows, no labels, and columns that stages use themselves."""
    import corpus_pipeline

    fields = "doc_id long, text string, lang string, source string, n_chars long, sequence_id long, piece long, label string, fp long, score double, kept boolean"
    words = " ".join(f"word{i % 977}" for i in range(3_000))
    texts = [(1, "One two three four five six."), (1, "One two three four five six."), (2, None), (3, ""), (None, "No id here at all, none."), (4, words), (5, words + " end")]
    full = spark.createDataFrame([(i, x, "en", None, 0, 7, 8, "x", 9, 0.5, True) for i, x in texts], fields)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for name, docs, want in (("none", full.limit(0), set()), ("some", full, {1, 2, 4, None})):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        assert {r.doc_id for r in corpus_pipeline.run(spark, f"{tmp_path}/{name}").select("doc_id").collect()} == want


def test_classifiers_without_labels(spark, tmp_path, docs):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for module in (gam, ftrl):
        rows = module.query(spark, str(tmp_path)).collect()
        assert len(rows) == len(ALL) and all(0 <= r.score <= 1 and r.predicted == (r.score >= module.THRESHOLD) for r in rows)


def test_a_common_fingerprint_is_sent(spark, monkeypatch):
    texts = [(i, "the same few words again and again") for i in range(40)] + [(100 + i, f"text number {i} of its own {i * 7} kind {i * 31}") for i in range(20)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    want = sorted(tuple(r) for r in simhash.near_duplicates(df).collect())
    monkeypatch.setattr(simhash, "HOT", 5)
    assert sorted(tuple(r) for r in simhash.near_duplicates(df).collect()) == want and sum(r[2] == 0 for r in want) == 40
