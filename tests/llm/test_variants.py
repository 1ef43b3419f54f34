"""Spelling variants against all pairs of words."""

import re
import zlib
from collections import Counter

import numpy as np
from evidara.llm import variants
from evidara.llm.runtime import table

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def lower(x):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)


def words(rows):
    n = Counter()
    for i, text in rows:
        for run in map(lower, RUN.findall(text or "")):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                n[run] += 1
    return {w: k for w, k in n.items() if k >= 2}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(n):
    form, rows = {}, {}
    for w in n:
        close = [x for x in n if near(w, x)]
        best = min(close, key=lambda x: (-n[x], x)) if close else None
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
        rows[w] = len(close)
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], rows[w], n[form[w]] if form[w] else None))
    return out


def got(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_words_and_variants_of_documents(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    n = words([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.word: r.n for r in variants.words(docs).collect()} == n
    found = variants.variants(docs)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert found.count() == len(n) and got(found) == brute(n)


def test_dense_words(spark):
    """Short alphabets make anagrams, words near in several ways, and chains of forms."""
    rng = np.random.default_rng(1)
    n = {}
    for _ in range(500):
        n["".join(rng.choice(list("abé"), rng.integers(7, 10)))] = int(10 ** rng.uniform(0.4, 4))
    n |= {"chainaaaa": 3, "chainbaaa": 40, "chainbbaa": 600, "chainbbba": 9000, "chainbbbb": 200_000, "aaaaaaa": 5, "aaaaaaaa": 5, "aaaaaaaaa": 70}
    df = spark.createDataFrame(list(n.items()), "word string, n long").repartition(3)
    found = got(variants.grouped(df))
    assert found == brute(n)
    assert {r[2] for r in found if r[0].startswith("chain")} == {"chainbbbb"}
    pairs = [(r.a, r.b) for r in variants.near_pairs(df).collect()]
    assert len(pairs) == len({frozenset(p) for p in pairs})  # each once


def test_edges(spark):
    rows = [(1, "Straße Überaus überaus ÜBERAUS überaus"), (1, "Straße Überaus überaus ÜBERAUS überaus"), (2, None), (3, ""), (None, "lengthy lengthy lengths"), (4, "lengthy " * 3000 + "x" * 50_000 + " " + "x" * 50_000), (5, "short a b lengths")]
    docs = spark.createDataFrame([(*r, "w", 1) for r in rows], "doc_id long, text string, word string, n int")
    n = words(rows)
    assert got(variants.variants(docs)) == brute(n) and any(len(w) >= 49_999 for w in n)
    assert variants.variants(docs.limit(0)).count() == 0
    assert variants.grouped(spark.createDataFrame([(None, 5), ("ordinary", 2)], "word string, n long")).collect()[0].root == "ordinary"
