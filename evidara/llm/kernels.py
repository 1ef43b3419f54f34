"""Numpy kernels over the UTF-8 buffer of an Arrow text column: word spans, hashes, per-document sums.

They run inside Spark tasks on pieces of a batch of about CHUNK bytes, so that the memory of a task
is bounded by CHUNK or by its longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20

#: Space and \t\n\v\f\r, the white space of the word pattern [^\x20\x09-\x0D]+.
WHITE = np.zeros(256, dtype=bool)
WHITE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the word."""
    x = np.asarray(x, dtype=U64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


BYTE_CODE = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 12, 1 << (n - 1).bit_length())
        have = np.full(size, base, dtype=U64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 4 * CHUNK:
            _powers[base] = have
    return have[:n]


def span_hash(code: np.ndarray, starts: np.ndarray, ends: np.ndarray, tiled: bool = False) -> np.ndarray:
    """A 64-bit hash of each span of code (random words per symbol), whatever its place.

    Spans ascend; tiled: each begins where the one before it ends.
    """
    if not len(starts):
        return np.zeros(0, dtype=U64)
    weighted = code * powers(_BASE, len(code))
    if tiled:
        sums = np.add.reduceat(weighted, starts)
    else:
        both = np.empty(2 * len(starts), dtype=np.int64)
        both[::2], both[1::2] = starts, ends
        if both[-1] >= len(code):
            weighted = np.append(weighted, U64(0))
        sums = np.add.reduceat(weighted, both)[::2]
    sums = sums * powers(_INVERSE, int(starts[-1]) + 1)[starts]
    return mix(sums + (ends - starts).astype(U64))


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of at most limit text bytes, or of one row."""
    offsets = text_offsets(batch.column(column))
    start, n = 0, batch.num_rows
    while start < n:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        yield batch.slice(start, min(end, n) - start)
        start = end


def text_offsets(col: pa.Array) -> np.ndarray:
    """Byte offsets of a string column, from 0; null texts count as empty."""
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    raw = np.frombuffer(col.buffers()[1], dtype=np.int64 if wide else np.int32) if len(col) else np.zeros(1, np.int64)
    raw = raw[col.offset : col.offset + len(col) + 1].astype(np.int64)
    if col.null_count:
        valid = np.array(col.is_valid())
        lengths = np.where(valid, np.diff(raw), 0)
        if lengths.sum() != raw[-1] - raw[0]:
            raise ValueError("null texts with bytes")
    return raw - raw[0]


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after the other, and where each begins (and the last ends)."""
    offsets = text_offsets(col)
    if not len(col) or not offsets[-1]:
        return np.zeros(0, dtype=np.uint8), offsets
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    raw = np.frombuffer(col.buffers()[1], dtype=np.int64 if wide else np.int32)
    first = int(raw[col.offset])
    return np.frombuffer(col.buffers()[2], dtype=np.uint8)[first : first + int(offsets[-1])], offsets


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True; a run ends where a document does."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begins = np.empty(n + 1, dtype=bool)
    begins[0], begins[n] = True, True
    begins[1:n] = ~inside[:-1]
    begins[offsets] = True
    starts = np.flatnonzero(inside & begins[:n])
    closes = np.empty(n, dtype=bool)
    closes[-1] = True
    closes[:-1] = ~inside[1:] | begins[1:n] & inside[:-1] & inside[1:]
    ends = np.flatnonzero(inside & closes) + 1
    return starts, ends


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+, and the index of each document's first word."""
    starts, ends = spans(~WHITE[data], offsets)
    return starts, ends, np.searchsorted(starts, offsets)


def per_document(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive bounds, 0 where a document has none."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]


def owner(bounds: np.ndarray) -> np.ndarray:
    """The document index of each item, from the documents' bounds."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
