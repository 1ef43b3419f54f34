"""Hashed word n-grams and skip-grams of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from evidara.llm import kernels as K

#: Bytes of a word: letters and digits after lower-casing, and whatever isn't ASCII.
WORD = np.zeros(256, dtype=bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True

_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def grams(data: np.ndarray, offsets: np.ndarray, bits: int, orders: tuple[tuple[int, ...], ...]) -> tuple[np.ndarray, np.ndarray]:
    """(document, hashed feature) of each gram, repeats included.

    orders: the words of a gram by their distance from its first, as (0,) for words, (0, 1) for pairs and
    (0, 2) for pairs that skip a word.
    """
    starts, ends = K.spans(WORD[data], offsets)
    doc = K.owner(np.searchsorted(starts, offsets))
    own = K.span_hash(K.BYTE_CODE[data], starts, ends)
    docs, found = [], []
    for k, order in enumerate(orders):
        n = len(own) - order[-1]
        if n <= 0:
            continue
        mixed = np.full(n, k + 1, dtype=np.uint64)
        for i, at in enumerate(order):
            mixed = mixed + own[at : at + n] * _ODD[i]
        whole = doc[:n] == doc[order[-1] : order[-1] + n]
        docs.append(doc[:n][whole])
        found.append((K.mix(mixed) >> np.uint64(64 - bits))[whole].astype(np.int64))
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(docs), np.concatenate(found)


def beginnings(data: np.ndarray, offsets: np.ndarray, bits: int, sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(document, hashed feature) of the first bytes of each word that is longer: one stem's words share them, whatever their endings."""
    starts, ends = K.spans(WORD[data], offsets)
    doc = K.owner(np.searchsorted(starts, offsets))
    docs, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for size in sizes:
        longer = ends - starts > size
        own = K.span_hash(K.BYTE_CODE[data], starts[longer], starts[longer] + size)
        docs.append(doc[longer])
        found.append((K.mix(own + np.uint64(1000 + size)) >> np.uint64(64 - bits)).astype(np.int64))
    return np.concatenate(docs), np.concatenate(found)


def lowered(col: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes and offsets of the lower-cased texts, in pieces of bounded size."""
    for p in K.pieces(pa.RecordBatch.from_arrays([col], names=["text"])):
        yield K.text_bytes(pc.utf8_lower(p.column(0)))


def distinct(doc: np.ndarray, found: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Each feature of a document once, ascending."""
    keys = np.unique((doc << bits) | found)
    return keys >> bits, keys & ((1 << bits) - 1)
