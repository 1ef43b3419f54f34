"""The near-copy stage against exact Jaccard similarities of 0.8 and nothing else."""

import numpy as np
from evidara.llm import simhash
from evidara.llm.runtime import table

#: Pairs of sf0.1 that are 0.80 to 0.82 alike and differ in more than 41 bits of 256.
FAR = (3, 3666, 4, 3330, 922, 8228, 1949, 5884, 2499, 6743, 4474, 6578)


def wanted(texts):
    """Of each component of links of 0.8 the smallest id."""
    sets = {i: set(simhash.shingle_hashes(x.encode(), 5).tolist()) for i, x in texts.items()}
    ids = sorted(sets)
    lead = {i: i for i in ids}
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                a, b = lead[i], lead[j]
                lead = {x: min(a, b) if y in (a, b) else y for x, y in lead.items()}
    return set(lead.values())


def kept(df):
    return {r.doc_id for r in simhash.one_of_each(df).collect()}


def test_pairs_at_the_threshold(spark):
    df = table(spark, "/root/testdata/sf0.1", "documents").where(f"doc_id in {FAR}")
    want = wanted({r.doc_id: r.text for r in df.collect()})
    assert len(want) == 6 and kept(df) == want


def family(rng, n):
    """Texts that share 60 words and differ in a tail of 5 to 25 words of their own: 0.5 to 0.85 alike."""
    start = [f"w{k}" for k in rng.integers(0, 10**6, 60)]
    return [" ".join([*start, *(f"t{k}" for k in rng.integers(0, 10**6, rng.integers(5, 26)))]) for _ in range(n)]


def test_half_alike_texts_stay_and_crowds_are_dealt_to_tiles(spark, monkeypatch):
    rng = np.random.default_rng(8)
    texts = dict(enumerate([*family(rng, 40), *family(rng, 3), "a b c d e f g", "a b c d e f g h", "a b c d"]))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = wanted(texts)
    assert 3 < len(want) < len(texts) - 3
    assert kept(df) == want
    monkeypatch.setattr(simhash, "TILE_ROWS", 6)
    assert kept(df) == want
