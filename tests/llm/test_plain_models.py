"""The trained operators against plain versions of their learning and scoring, and held-out recall and precision."""

import bisect
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from evidara.llm import ftrl, gam, licenses, ngrams, registry
from evidara.llm.runtime import table


def test_ftrl_against_plain_steps():
    """FTRL-proximal one coordinate at a time, in dictionaries."""
    rng = np.random.default_rng(1)
    rows = [np.unique(np.concatenate([[k % 2], rng.integers(2, 60, 8)])) for k in range(120)]
    y = np.array([float(k % 2 and rng.random() < 0.9) for k in range(120)])
    model = ftrl.fit(rows, y, bits=6)
    count = Counter(int(f) for r in rows for f in r)
    z, n = Counter(), Counter()
    p = (y.sum() + 1) / (len(y) + 2)
    bias, seen = math.log(p / (1 - p)), 1.0

    def weight(f):
        return 0.0 if abs(z[f]) <= ftrl.L1 else (math.copysign(ftrl.L1, z[f]) - z[f]) / ((ftrl.BETA + math.sqrt(n[f])) / ftrl.ALPHA + ftrl.L2)

    order = np.random.default_rng(7)
    for _ in range(ftrl.EPOCHS):
        for i in order.permutation(len(rows)):
            own = [int(f) for f in rows[i] if count[int(f)] >= ftrl.LEAST]
            g = 1 / (1 + math.exp(-(bias + sum(weight(f) for f in own)))) - y[i]
            for f, w in [(f, weight(f)) for f in own]:
                z[f] += g - (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / ftrl.ALPHA * w
                n[f] += g * g
            seen += g * g
            bias -= ftrl.ALPHA * g / (ftrl.BETA + math.sqrt(seen))
    want = {f: weight(f) for f in count if weight(f)}
    assert set(model.feature.tolist()) == set(want) and want
    assert all(abs(want[f] - w) < 1e-4 for f, w in zip(model.feature.tolist(), model.weight.tolist(), strict=True)) and abs(model.base - bias) < 1e-6


def test_toxicity_scores_against_a_plain_sum(spark):
    """Scores by looking every gram of every text up by itself."""
    texts = ["you are a fool and a liar", "", "a quiet day in the park", "fool fool fool"]
    data = [ngrams.distinct(*ftrl.features(*next(ngrams.lowered(pa.array([t])))), ftrl.BITS)[1] for t in texts]
    model = ftrl.fit([data[0], data[2]] * 20, np.array([1.0, 0.0] * 20))
    weight = dict(zip(model.feature.tolist(), model.weight.tolist(), strict=True))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.s for r in df.select("doc_id", ftrl.score(model).alias("s")).collect()}
    for i, own in enumerate(data):
        assert abs(got[i] - 1 / (1 + math.exp(-(model.base + sum(weight.get(int(f), 0.0) for f in own))))) < 1e-5


def test_additive_scores_against_plain_lookups():
    """Each score summed entry by entry, from tables that were learned."""
    rng = np.random.default_rng(2)
    x = rng.uniform(-1, 1, (400, 4))
    model = gam.fit(x, (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float))
    for row, score in zip(x[:50], model.score(x[:50]), strict=True):
        total = model.base
        for j, t in enumerate(model.tables):
            total += t[sum(e <= row[j] for e in model.edges[j])]
        for a, b, t in model.pairs:
            total += t[sum(e <= row[a] for e in model.coarse[a])][sum(e <= row[b] for e in model.coarse[b])]
        assert abs(score - 1 / (1 + math.exp(-total))) < 1e-9


def test_best_cut_against_all_cuts():
    rng = np.random.default_rng(3)
    for _ in range(50):
        g, h = rng.standard_normal(9), rng.uniform(1, 3, 9)
        gain = lambda a, b: a * a / (b + gam.SMOOTH)
        plain = [gain(g[:k].sum(), h[:k].sum()) + gain(g[k:].sum(), h[k:].sum()) - gain(g.sum(), h.sum()) for k in range(1, 9)]
        found, k = gam.cut(g, h)
        assert k == (int(np.argmax(plain)) + 1 if max(plain) > 0 else 0) and abs(found - max(0, *plain)) < 1e-9


def test_licence_odds_against_a_plain_sum():
    model = licenses.fit(["Some other line of text."] * 3)
    lines = ["Released under the MIT License.", "Some other line of text.", "Licensed under the Gralto License, version 4."]
    (line, found), *_ = licenses.grams(lines)
    odds = model.log_odds(line, found, len(lines))
    known = {int(f): i for i, f in enumerate(model.feature)}
    for k in range(len(lines)):
        own = {int(f) for f in found[line == k]} & set(known)
        want = (model.base + sum((model.weight[known[f]] for f in own), np.zeros(len(licenses.CLASSES)))) / model.temperature
        assert np.allclose(odds[k], want)


def test_toxic_recall_and_precision(spark):
    d = "/root/testdata/sf0.1"
    got = registry.queries()["op2_ftrl_toxicity"](spark, d).where("held_out").join(table(spark, d, "labels"), "doc_id").select("predicted", "toxic").collect()
    hit = sum(r.predicted and r.toxic for r in got)
    # 305 toxic documents to learn from, 144 to find. The production sample finds 0.985 of check_s's (README).
    assert hit >= 0.75 * sum(r.toxic for r in got) and hit >= 0.95 * sum(r.predicted for r in got)


def plain_boosting(x, y, model, rounds, pair_rounds):
    """The log odds of every row after boosting two-level trees row by row, with cuts found by trying each."""
    bins = [[bisect.bisect_right(model.edges[j].tolist(), v) for v in x[:, j]] for j in range(x.shape[1])]
    rough = [[bisect.bisect_right(model.coarse[j].tolist(), v) for v in x[:, j]] for j in range(x.shape[1])]
    p = (y.sum() + 1) / (len(y) + 2)
    odds = [math.log(p / (1 - p))] * len(y)

    def slopes():
        q = [1 / (1 + math.exp(-o)) for o in odds]
        return [yi - qi for yi, qi in zip(y, q, strict=True)], [qi * (1 - qi) for qi in q]

    def best_cut(rows, key, first, last, g, h):
        """(gain, cut) among the cuts inside bins first to last."""
        worth = lambda some: sum(g[i] for i in some) ** 2 / (sum(h[i] for i in some) + gam.SMOOTH)
        best = (0.0, None)
        for k in range(first + 1, last):
            low, high = [i for i in rows if key[i] < k], [i for i in rows if key[i] >= k]
            if min(sum(h[i] for i in low), sum(h[i] for i in high)) >= gam.LEAST / 4:
                gain = worth(low) + worth(high) - worth(rows)
                if gain > best[0] + 1e-12:
                    best = gain, k
        return best

    def leaves(rows, first_key, n1, second_key, n2, g, h):
        """(gain, [(rows of a leaf, its value)]) of a cut by the first key, then of each half by the second."""
        gain, k = best_cut(rows, first_key, 0, n1, g, h)
        out = []
        for a, b in ((0, k), (k, n1)) if k else ((0, n1),):
            part = [i for i in rows if a <= first_key[i] < b]
            lo, hi = (a, b) if second_key is first_key else (0, n2)
            more, m = best_cut(part, second_key, lo, hi, g, h)
            gain += more
            for c, d in ((lo, m), (m, hi)) if m else ((lo, hi),):
                leaf = [i for i in part if c <= second_key[i] < d]
                out.append((leaf, gam.RATE * sum(g[i] for i in leaf) / (sum(h[i] for i in leaf) + gam.SMOOTH)))
        return gain, out, k

    rows = list(range(len(y)))
    for _ in range(rounds):
        for j in range(x.shape[1]):
            g, h = slopes()
            for leaf, value in leaves(rows, bins[j], len(model.edges[j]) + 1, bins[j], 0, g, h)[1]:
                for i in leaf:
                    odds[i] += value

    def pair(a, b):
        g, h = slopes()
        best = (0.0, [])
        for u, v in ((a, b), (b, a)):
            gain, found, k = leaves(rows, rough[u], len(model.coarse[u]) + 1, rough[v], len(model.coarse[v]) + 1, g, h)
            if k and gain > best[0]:
                best = gain, found
        return best

    gains = sorted(((pair(a, b)[0], a, b) for a in range(x.shape[1]) for b in range(a)), reverse=True)
    chosen = [(a, b) for gain, a, b in gains[: gam.PAIRS] if gain > 0]
    for _ in range(pair_rounds):
        for a, b in chosen:
            for leaf, value in pair(a, b)[1]:
                for i in leaf:
                    odds[i] += value
    return odds, chosen


def test_boosting_against_rows_and_all_cuts(monkeypatch):
    monkeypatch.setattr(gam, "ROUNDS", 4)
    monkeypatch.setattr(gam, "PAIR_ROUNDS", 3)
    monkeypatch.setattr(gam, "PAIRS", 2)
    monkeypatch.setattr(gam, "BINS", 7)
    rng = np.random.default_rng(8)
    x = rng.uniform(-1, 1, (160, 3))
    y = (x[:, 0] * x[:, 1] + 0.4 * x[:, 2] + rng.normal(0, 0.1, 160) > 0).astype(float)
    model = gam.fit(x, y)
    want, chosen = plain_boosting(x, y, model, 4, 3)
    assert [(a, b) for a, b, _ in model.pairs] == chosen and len(chosen) == 2
    assert np.allclose(model.log_odds(x), want, atol=1e-9)


def test_licence_learning_against_dense_steps():
    """Softmax regression with a rate for each weight and an L1 step, over dense rows."""
    lines = ["Some other line of text.", "Another line that says nothing of note.", "Released under the MIT License."]
    model = licenses.fit(lines)
    texts, y = licenses.examples(lines)
    rows = []
    for line, found in licenses.grams(texts):  # numbered over all pieces
        rows.append((line, found))
    notices = [t for n in licenses.TEMPLATES.values() for t in n] + [u.replace("{}", "") for u in licenses.UNKNOWN]
    known = np.unique(np.concatenate([f for _, f in licenses.grams(notices)]))
    place = {int(f): i for i, f in enumerate(known)}
    x = np.zeros((len(texts), len(known)))
    for line, found in rows:
        for i, f in zip(line.tolist(), found.tolist(), strict=True):
            if f in place:
                x[i, place[f]] = 1.0
    c = len(licenses.CLASSES)
    aside = np.random.default_rng(9).random(len(texts)) < 0.25
    own, right = x[~aside], np.eye(c)[y][~aside]
    w, b, seen, seen_base = np.zeros((len(known), c)), np.zeros(c), np.full((len(known), c), 1e-6), np.full(c, 1e-6)
    for _ in range(licenses.STEPS):
        e = np.exp(own @ w + b)
        slope = (e / e.sum(1, keepdims=True) - right) / len(own)
        g = own.T @ slope
        seen += g * g
        step = licenses.RATE / np.sqrt(seen)
        w -= step * g
        w = np.sign(w) * np.maximum(np.abs(w) - step * licenses.L1, 0)
        seen_base += slope.sum(0) ** 2
        b -= licenses.RATE / np.sqrt(seen_base) * slope.sum(0)
    used = np.abs(w).sum(1) > 0
    assert (model.feature == known[used]).all() and np.allclose(model.weight, w[used], atol=1e-6) and np.allclose(model.base, b, atol=1e-6)
    out, told = x[aside] @ w + b, y[aside]
    loss = {}
    for t in (0.5, 0.7, 1.0, 1.4, 2.0, 3.0):
        e = np.exp(out / t)
        loss[t] = -np.log(np.maximum((e / e.sum(1, keepdims=True))[np.arange(len(out)), told], 1e-12)).mean()
    assert model.temperature == min(loss, key=loss.get)
