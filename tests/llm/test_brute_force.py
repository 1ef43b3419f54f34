"""Operators against plain versions on small tables, round trips and held-out accuracy."""

import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from evidara.llm import bpe, embeddings, ftrl, gam, licenses, outliers, packing, registry, simhash, wavelet
from evidara.llm import kernels as K
from evidara.llm import pretokens as P
from evidara.llm.runtime import table
from pyspark.sql import functions as F

SMALL, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in table(spark, SMALL, "documents").collect()}


def words(x):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x))


def shingles(x, k):
    w = words(x)
    return [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []


def test_simhash(spark, texts):
    import xxhash

    prints = {}
    for i, x in texts.items():
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles(x, 4)]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))
    lead = {i: i for i in prints}

    def find(i):
        while lead[i] != i:
            i = lead[i]
        return i

    for i in prints:
        for j in prints:
            if j < i and (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                lead[max(a, b)] = min(a, b)
    got = registry.queries()["op7_simhash_tiles"](spark, SMALL).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{p:016x}", find(i)) for i, p in prints.items()}


def test_near_copies_stage(spark, texts):
    kept = {r.doc_id for r in simhash.one_of_each(table(spark, SMALL, "documents")).collect()}
    sets = {i: set(shingles(x, 5)) for i, x in texts.items()}
    like = lambda a, b: len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b])) if sets[a] or sets[b] else 1.0
    assert all(any(j != i and like(i, j) >= 0.7 for j in texts) for i in texts if i not in kept)
    assert not any(like(i, j) >= 0.85 for i in kept for j in kept if i < j)


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((150, 64))
    near = base[rng.integers(0, 40, 250)] + 0.06 * rng.standard_normal((250, 64))
    x = np.concatenate([base, near, near[:20]]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    link = unit @ unit.T >= 0.9
    np.fill_diagonal(link, False)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(df).collect()}
    lead = simhash.joined(np.arange(len(x)), *np.nonzero(link))
    assert got == {i: (int(link[i].sum()), int(lead[i])) for i in range(len(x))}


def test_hashing_finds_links_at_the_threshold():
    each, tables = embeddings.plan(100_000, 0.9)
    met = 1 - (1 - embeddings.share(np.sqrt(0.2)) ** each) ** tables
    assert met >= 0.999


def test_pre_tokens_and_ids():
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own.encode_special_tokens = True
    rng = np.random.default_rng(2)
    parts = ["a", "s", "t", "re", "ve", "ll", "'", " ", "  ", "\n", "\t", "1", "٣", "é", "!", "—", " ", "\u0085", "漢", "👍", "'s", "<|endoftext|>", "\r\n", ""]
    rows = ["".join(rng.choice(parts, rng.integers(0, 25))) for _ in range(3000)]
    import pyarrow as pa

    encode, at = P.encoder(public_tokenizers.path("byte_bpe_50k.json")), 0
    for piece in K.pieces(pa.record_batch({"text": pa.array(rows)}), limit=5000):
        ids, bounds = encode(*K.text_bytes(piece.column(0)))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            assert ids[a:b].tolist() == own.encode(rows[at], add_special_tokens=False).ids
            at += 1
    assert at == len(rows)


def test_wavelet_matrix():
    rng = np.random.default_rng(3)
    for n in (0, 1, 511, 512, 513, 4000):
        x = (rng.zipf(1.3, n) % 50_257).astype(np.uint32)
        m = wavelet.WaveletMatrix(wavelet.build(x, [None, 5], np.array([0, n])))
        assert (m.tokens() == x).all() and m.documents()[0] == [None, 5]
        for i in rng.integers(0, max(n, 1), 15 if n else 0):
            where = np.flatnonzero(x == x[i])
            assert m.access(int(i)) == x[i] and m.count(int(x[i])) == len(where) and m.count(int(x[i]), int(i)) == (where < i).sum()
            assert m.occurrence(int(x[i]), len(where) - 1) == where[-1]
        assert m.count(1 << 20) == 0


def test_token_files_and_packing(spark, texts):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    at, sizes = 0, []
    files = {r.doc_id: r for r in registry.queries()["op5_wavelet_token_files"](spark, SMALL).collect()}
    pieces = collections.defaultdict(list)
    packed = registry.queries()["op4_bin_completion_packing"](spark, SMALL).collect()
    for r in packed:
        pieces[r.doc_id].append(r)
    for i in sorted(texts):
        ids = own.encode(texts[i], add_special_tokens=False).ids
        raw = np.array([*ids, 2], "<u4")
        assert (files[i].start, files[i].n_tokens, files[i].ids_crc32) == (at, len(raw), zlib.crc32(raw.tobytes()))
        at += len(raw)
        raw[-1] = 0
        place = 0
        for r in sorted(pieces[i], key=lambda r: r.piece):
            assert r.start == place and r.ids_crc32 == zlib.crc32(raw[place : place + r.length].tobytes())
            place += r.length
            sizes.append(r.length)
        assert place == len(raw)
    counts = np.bincount(sizes, minlength=2049)
    assert len({r.sequence_id for r in packed}) == packing.lower_bound(counts)


def test_bin_completion_is_optimal_on_small_cases():
    rng = np.random.default_rng(4)

    def optimum(items, c):
        best = [len(items)]

        def place(k, bins):
            if len(bins) >= best[0]:
                return
            if k == len(items):
                best[0] = len(bins)
                return
            for j in range(len(bins)):
                if bins[j] + items[k] <= c:
                    place(k + 1, [*bins[:j], bins[j] + items[k], *bins[j + 1 :]])
            place(k + 1, [*bins, items[k]])

        place(0, [])
        return best[0]

    def held(found, counts):
        out = np.zeros_like(counts)
        for pattern, n in found:
            assert sum(pattern) <= len(counts) - 1
            for x in pattern:
                out[x] += n
        assert (out == counts).all()
        return packing.number(found)

    for case in range(150):
        most = 20 if case % 2 else 14
        items = sorted(rng.integers(4 if case % 2 else 1, most, rng.integers(0, 10)).tolist(), reverse=True)
        counts = np.bincount(np.array(items, dtype=int), minlength=31)
        want = optimum(items, 30)
        assert held(packing.pack(counts), counts) == want
        exact = packing.solve(counts, None, 0)
        assert exact.proved and exact.least <= want and held(exact.patterns, counts) == want
    # Six full bins that best-fit decreasing misses: the search alone finds them, with limits and without.
    counts = np.bincount([51] * 4 + [27] * 4 + [26] * 4 + [23] * 8, minlength=101)
    assert packing.number(packing.best_fit(counts)) > 6
    assert all(held(packing.solve(counts, nodes, 0).patterns, counts) == 6 for nodes in (packing.NODES, None))


def test_search_beats_best_fit_on_many_pieces(spark):
    """The lengths of sf0.01 twenty times over: best-fit has 9,620 sequences, the bound is 9,611."""
    cut = packing.pieces(table(spark, MORE, "documents"), public_tokenizers.path(packing.VOCABULARY))
    counts = np.zeros(packing.CAPACITY + 1, dtype=np.int64)
    for r in cut.groupBy("length").count().collect():
        counts[r.length] = 20 * r["count"]
    found = packing.solve(counts)
    assert packing.number(packing.best_fit(counts)) == 9_620 and found.least == 9_611
    assert packing.number(found.patterns) <= 9_613
    held = np.zeros_like(counts)
    for pattern, n in found.patterns:
        assert sum(pattern) <= packing.CAPACITY
        for x in pattern:
            held[x] += n
    assert (held == counts).all()


def test_bpe(spark, texts):
    import tiktoken

    path = public_tokenizers.path(bpe.VOCABULARY)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(path), special_tokens={})
    got = {r.doc_id: r for r in bpe.roundtrip(table(spark, SMALL, "documents"), path, with_ids=True).collect()}
    for i, x in texts.items():
        assert got[i].ids == own.encode_ordinary(x) and bytes(got[i].decoded) == x.encode()
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, got[i].ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(x.encode()).hexdigest()


def test_base_rules(spark, texts):
    got = {r.doc_id: r for r in registry.queries()["op6_robust_outliers"](spark, SMALL).collect()}
    for i, x in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", x)
        lines = [y for y in x.split("\n") if re.search(r"[^\x20\x09-\x0D]", y)]
        windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        n, covered = collections.Counter(windows), set()
        for k, y in enumerate(windows):
            if n[y] > 1:
                covered.update(range(k, k + 5))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in x), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w)) and not (r.base_failed and r.kept)


def plain_mcd(x):
    """Concentration steps from many random starts; of them the least determinant."""
    d, h = x.shape[1], int(np.ceil(outliers.SHARE * len(x)))
    floor = np.diag([v**2 for v in outliers.FLOOR.values()])
    consistent = outliers.SHARE / outliers.chi_square(outliers.chi_square_point(outliers.SHARE, d), d + 2)
    rng, best = np.random.default_rng(0), None
    for _ in range(30):
        own = x[rng.choice(len(x), 2 * d, replace=False)]
        for _ in range(30):
            m, c = own.mean(0), consistent * np.cov(own.T, bias=True) + floor
            far = ((x - m) @ np.linalg.inv(c) * (x - m)).sum(1)
            own = x[np.argsort(far)[:h]]
        if best is None or np.linalg.slogdet(c)[1] < best[0]:
            best = np.linalg.slogdet(c)[1], m, c
    return best


def test_estimates_are_those_of_a_plain_search(spark):
    """Centre and covariance against numpy's, with a tenth of gross outliers; distances under them; and what small groups lean on."""
    rng = np.random.default_rng(5)
    d = len(outliers.STATS)
    mix = np.eye(d) + 0.3 * rng.standard_normal((d, d))
    x = rng.standard_normal((2000, d)) @ mix * 2
    x[:200] = 40 + rng.standard_normal((200, d))
    few = rng.standard_normal((3, d)) + 1
    rows = [(["all", "l", "g"], *map(float, v)) for v in x] + [(["all", "l", "h"], *map(float, v)) for v in few]
    df = spark.createDataFrame(rows, "keys array<string>, " + ", ".join(f"{s} double" for s in outliers.STATS))
    got = {r.key: r for r in outliers.estimates(df).collect()}

    def of(r):
        factor = np.array([[r[f"l_{i}_{j}"] if j <= i else 0 for j in range(d)] for i in range(d)])
        return np.array([r[f"m_{i}"] for i in range(d)]), factor @ factor.T

    logdet, m, c = plain_mcd(x)
    own_m, own_c = of(got["g"])
    assert np.abs(own_m - m).max() < 0.1 and np.abs(own_c - c).max() < 0.08 * np.abs(c).max()
    assert abs(np.linalg.slogdet(own_c)[1] - logdet) < 0.1
    parent, small = of(got["l"]), of(got["h"])
    weight = 3 / (3 + outliers.PRIOR)
    assert np.abs(small[0] - parent[0]).max() < 2 * weight * np.abs(few - parent[0]).max() + 0.05
    keyed = df.select(*outliers.STATS, F.col("keys")[2].alias("key"))
    far = [r.d2 for r in outliers.with_distance(keyed.where("key = 'g'"), outliers.estimates(df)).collect()]
    y = np.linalg.solve(np.linalg.cholesky(own_c), (x - own_m).T)
    assert np.allclose(sorted(far), sorted((y * y).sum(0)), rtol=1e-6)
    limit = outliers.chi_square_point(1 - outliers.REJECT, d)
    assert sum(f > limit for f in far) == 200


@pytest.mark.parametrize(("name", "label", "least"), [("op8_additive_model_quality", "quality", 0.97), ("op2_ftrl_toxicity", "toxic", 0.9)])
def test_held_out_accuracy(spark, name, label, least):
    got = registry.queries()[name](spark, "/root/testdata/sf0.1")
    r = got.where("held_out").join(table(spark, "/root/testdata/sf0.1", "labels"), "doc_id").agg(F.avg((F.col("predicted") == F.col(label)).cast("int")).alias("right"), F.count("*").alias("n")).head()
    assert r.n > 500 and r.right >= least
    fold = {"quality": (5, 0), "toxic": (3, 1)}[label]
    assert all((zlib.crc32(str(r.doc_id).encode()) % fold[0] == fold[1]) == r.held_out for r in got.limit(200).collect())


def test_pair_tables_learn_what_single_ones_cannot():
    rng = np.random.default_rng(6)
    x = rng.uniform(-1, 1, (4000, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    model = gam.fit(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.9
    assert {(0, 1), (1, 0)} & {(a, b) for a, b, _ in model.pairs}


def test_l1_leaves_few_weights():
    rng = np.random.default_rng(7)
    rows = [np.unique(np.concatenate([[5] if k % 2 else [6], rng.integers(10, 5000, 60)])) for k in range(600)]
    model = ftrl.fit(rows, np.array([k % 2 for k in range(600)], dtype=float), bits=13)
    assert 5 in model.feature and len(model.feature) < 100


def test_licences(spark):
    noise = "Thnd erin hethed erster onble for theden"
    rows = [(i, f"{noise}\n{notice}\n{noise}", f) for i, (f, notice) in enumerate((f, x) for f, n in licenses.TEMPLATES.items() for x in n)]
    rows += [(100, noise, "none"), (101, "Released under the Quxly Gralto License, version 4.", "unknown"), (102, "the license of a driver is public", "none")]
    df = spark.createDataFrame(rows, "doc_id long, text string, want string")
    got = {r.doc_id: r for r in licenses.scanned(df, licenses.fit([noise] * 3)).collect()}
    wrong = [(w, got[i].family) for i, _, w in rows if got[i].family != w]
    assert len(wrong) <= 1, wrong
    assert all(got[i].confirmed == (got[i].family not in ("none", "unknown")) for i, *_ in rows)


def test_licences_of_documents(spark):
    docs = table(spark, MORE, "documents")
    got = licenses.scanned(docs).join(docs, "doc_id")
    want = F.when(F.col("text").contains("MIT License"), "MIT").when(F.col("text").contains("Apache License"), "Apache-2.0").when(F.col("text").contains("GNU General"), "GPL").when(F.col("text").contains("CC BY-NC"), "CC-BY-NC").otherwise("none")
    assert got.where(want != F.col("family")).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = table(spark, SMALL, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "packing"]
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, now, SMALL)
        assert after.columns == docs.columns, name
        after = spark.createDataFrame(after.collect(), docs.schema)
        assert 0 < after.count() <= now.count()
        now = after
    out = corpus_pipeline.STAGES[-1][1](spark, now, SMALL)
    assert {r.doc_id for r in out.select("doc_id").collect()} == {r.doc_id for r in now.collect()}
