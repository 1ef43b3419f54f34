"""The agenda of symbol pairs against the sentencepiece library, and words that sums of codes take for one another."""

import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from evidara.llm import bpe, pieces
from evidara.llm import kernels as K
from evidara.llm import pretokens as P
from evidara.llm.runtime import table

PATH = public_tokenizers.path(pieces.MODEL)


def test_ids_are_the_librarys():
    agenda, store = pieces.encoder(PATH)
    rng = np.random.default_rng(2)
    parts = ["a", "s", "the", "ing", " ", "  ", "\n", "\t", "1", "é", "!", "▁", "漢字", "👍", "<s>", "<unk>", "<0x41>", "\r\n", "", "=====", "-" * 40, "ation", "\x00", "ﬁ", "日本", " " * 70, "abcdefghij" * 10]
    rows = ["".join(rng.choice(parts, rng.integers(0, 40))) for _ in range(1500)] + [None, " ", "▁"]
    at = 0
    for piece in K.pieces(pa.record_batch({"text": pa.array(rows)}), limit=20_000):
        ids, bounds = store(*pieces.spaced(*K.text_bytes(piece.column(0))))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            assert ids[a:b].tolist() == agenda.library.encode(rows[at] or "")
            at += 1
    assert at == len(rows)


def test_rounds_take_the_pairs_that_a_heap_takes():
    agenda, _ = pieces.encoder(PATH)
    rng = np.random.default_rng(3)
    words = [[agenda.symbol[c] for c in rng.choice(list("abcdefghinorst▁-="), rng.integers(1, 32))] for _ in range(2000)]
    flat, sizes = agenda.many(np.array([x for w in words for x in w]), np.array([len(w) for w in words]))
    for w, got in zip(words, np.split(flat, np.cumsum(sizes)[:-1]), strict=True):
        assert got.tolist() == agenda.one(w)


def test_a_difference_from_the_library_stops_the_task():
    agenda, _ = pieces.encoder(PATH)
    with pytest.raises(RuntimeError, match="otherwise"):
        agenda.check(["▁the"], np.array([5], np.uint32), np.array([0, 1]))


def test_round_trip(spark):
    agenda, _ = pieces.encoder(PATH)
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = pieces.roundtrip(docs, PATH, with_ids=True).collect()
    assert len(got) == len(texts)
    for r in got:
        want = agenda.library.encode(texts[r.doc_id])
        assert r.ids == want and r.decoded == agenda.library.decode(want) and r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()


def test_words_of_one_hash_keep_their_own_ids(spark):
    """Thue-Morse words over two letters, and the letters swapped: sums of codes times powers of an odd base are the same for both."""
    line = [bin(i).count("1") % 2 for i in range(4096)]
    texts = ["".join("ab"[x] for x in line), "".join("ba"[x] for x in line)]
    raw = [np.frombuffer(x.encode(), np.uint8) for x in texts]
    assert len({int(K.span_hash(K.BYTE_CODE[r], np.array([0]), np.array([len(r)]))[0]) for r in raw}) == 1
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    for apply, path in ((bpe.roundtrip, public_tokenizers.path(bpe.VOCABULARY)), (pieces.roundtrip, PATH)):
        got = {r.doc_id: r.decoded_sha256 for r in apply(docs, path).collect()}
        assert got == {i: hashlib.sha256(x.encode()).hexdigest() for i, x in enumerate(texts)}
    encode = P.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    ids, bounds = encode(*K.text_bytes(pa.array(texts)))
    assert (bounds[1], bounds[2]) != (0, 0) and not np.array_equal(ids[: bounds[1]], ids[bounds[1] :])
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("blocks")]
