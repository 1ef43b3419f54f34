"""Block-max WAND against scores of all documents, and its blocks against all ways to cut a list."""

import math
import re
from collections import Counter

import numpy as np
from evidara.llm import lexical
from evidara.llm.runtime import table
from pyspark.sql import functions as F

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, queries, k):
    """docs: (id, text) rows; queries: {item: text}. Rows (item, rank, id, score)."""
    held = [(i, Counter(terms(x))) for i, x in docs]
    n, total = sum(1 for _, c in held if c), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in queries.items():
        found = []
        for i, c in held:
            m = 50 + (50 * sum(c.values()) * n) // max(1, total)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def got(docs, queries, k=lexical.BEST):
    return sorted((r.item_id, r["rank"], r.doc_id, r.score) for r in lexical.ranked(*lexical.build(docs), queries, k).collect())


def test_blocks_have_the_least_error():
    rng = np.random.default_rng(1)
    size = rng.integers(0, 40, 60)
    start = np.cumsum(size) - size
    impact = rng.integers(1, 1000, size.sum())
    begins = lexical.block_starts(impact, start, size, 7, 900)
    ends = np.append(begins[1:], len(impact))
    for s, z in zip(start.tolist(), size.tolist(), strict=True):
        own = [(a, b) for a, b in zip(begins.tolist(), ends.tolist(), strict=True) if s <= a < s + z]
        least = [0]
        for i in range(1, z + 1):
            least.append(min(least[i - n] + 900 + n * max(impact[s + i - n : s + i]) for n in range(1, min(7, i) + 1)))
        assert sum(900 + (b - a) * impact[a:b].max() for a, b in own) == least[-1]
        assert not own or (own[0][0], own[-1][1]) == (s, s + z)


def test_all_scores(spark):
    docs, items = (table(spark, "/root/testdata/sf0.01", n) for n in ("documents", "benchmark"))
    want = brute([(r.doc_id, r.text) for r in docs.collect()], {r.item_id: r.text for r in items.collect()}, 50)
    assert got(docs, items) == want


def test_shards_and_ranges_of_any_size(spark, monkeypatch):
    """Random texts in many small shards, ranges scored one by one, long blocks and short ones."""
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(60)]
    rows = [(int(i), " ".join(words[min(59, int(x))] for x in rng.zipf(1.3, rng.integers(0, 80)))) for i in rng.permutation(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    queries = {q: " ".join(rng.choice(words, 8)) for q in range(12)}
    asked = spark.createDataFrame(list(queries.items()), "item_id long, text string")
    want = brute(rows, queries, 7)
    for price in (0, 50_000, 1 << 40):
        found = lexical.ranked(*lexical.build(docs, price), asked, 7)
        assert sorted(tuple(r) for r in found.collect()) == want
    index = lexical.build(docs)
    monkeypatch.setattr(lexical, "QUERY_BYTES", 60)  # several blocks of queries
    assert sorted(tuple(r) for r in lexical.ranked(*index, asked, 7).collect()) == want


def test_a_searcher_skips_ranges_and_carries_its_bound():
    shard = lexical.Shard()
    rng = np.random.default_rng(4)
    for i in range(500):
        data = np.frombuffer(" ".join(["common"] * int(rng.integers(1, 9)) + ["rare"] * (i % 100 == 7)).encode(), np.uint8)
        shard.add([i], *lexical.terms_of(data, np.array([0, len(data)])))
    row = shard.row(0).to_pylist()[0]
    lists = lexical.Lists(row, 500, 3000)
    begins = lexical.block_starts(lists.impact, lists.start, lists.count)
    row |= {"blocks": lexical.packed(np.diff(begins, append=len(lists.impact))), "maxes": lexical.packed(np.maximum.reduceat(lists.impact, begins))}
    searcher = lexical.Searcher(row, 500, 3000)
    best = searcher.search({b"rare": 9000, b"common": 1}, 5, 1)
    assert sorted(d for d, _ in best) == [7, 107, 207, 307, 407]
    assert searcher.search({b"rare": 9000, b"common": 1}, 5, best[2][1]) == [x for x in best if x[1] >= best[2][1]]
    assert not searcher.score.any()


def test_edges(spark):
    rows = [(1, "Alpha beta"), (1, "Alpha beta"), (2, None), (3, ""), (None, "ALPHA beta"), (None, "alpha beta"), (4, "— ß漢字 alpha" + " filler" * 50_000), (5, "!? \n")]
    docs = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, item_id long, term string")
    queries = spark.createDataFrame([(1, "alpha", 0), (2, None, 0), (3, "nothing", 0), (None, "ß漢字", 0), (4, "Alpha", 0), (4, "beta ALPHA", 0)], "item_id long, text string, doc_id long")
    want = sorted(brute(rows, {1: "alpha", 4: "alpha beta"}, 50))
    have = [tuple(r) for r in lexical.ranked(*lexical.build(docs), queries).collect()]
    assert sorted(r for r in have if r[0] is not None) == want and [r[2] for r in have if r[0] is None] == [4]
    assert [r[2] for r in want if r[0] == 1][:4] == [1, 1, None, None]
    empty = lexical.build(docs.limit(0))
    assert empty[1:] == (0, 0) and lexical.ranked(*empty, queries).count() == 0
    assert lexical.ranked(*lexical.build(docs), queries.limit(0)).count() == 0
    assert docs.where(F.col("text").isNull()).count() == 1
