"""Links at the threshold: recall of pairs of cosine 0.90 to 0.92, refusal of 0.88 to 0.90, against all pairs."""

import numpy as np
from evidara.llm import embeddings, simhash


def test_pairs_at_the_threshold(spark):
    rng = np.random.default_rng(11)
    base = rng.standard_normal((1500, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    off = rng.standard_normal((1500, 64))
    off -= (off * base).sum(1, keepdims=True) * base
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    cosine = np.concatenate([rng.uniform(0.9001, 0.92, 1000), rng.uniform(0.88, 0.8999, 500)])[:, None]
    x = np.concatenate([base, cosine * base + np.sqrt(1 - cosine**2) * off]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    link = unit @ unit.T >= 0.9
    np.fill_diagonal(link, False)
    got = {r.vec_id: r for r in embeddings.near_duplicates(df).collect()}
    want = link.sum(1)
    found = np.array([got[i].n_links for i in range(len(x))])
    assert (found <= want).all()
    assert want.sum() > 1900 and found.sum() >= 0.995 * want.sum()
    lead = simhash.joined(np.arange(len(x)), *np.nonzero(link))
    assert sum(got[i].component_id == lead[i] for i in got) >= 0.995 * len(x)
    assert all(got[i].kept == (got[i].component_id == i) for i in got)


def test_bytes_bound_the_error():
    rng = np.random.default_rng(12)
    x = rng.standard_normal((300, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q, scale, lost = embeddings.as_bytes(x)
    y = q * scale[:, None]
    assert (np.abs(x @ x.T - y @ y.T) <= lost[:, None] + 1.1 * lost[None]).all()


def test_many_equal_vectors(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "HOT", 5)
    rows = [(i, [1.0, 0.0, 0.5]) for i in range(40)] + [(100 + i, [0.0, 1.0, i / 10]) for i in range(5)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert all(got[i] == (39, 0) for i in range(40)) and all(got[100 + i] == (4, 100) for i in range(5))
