"""A succinct token file: the wavelet matrix of a sequence of ids, with its documents' ids and lengths.

Layout of a file: the 8 bytes MAGIC; a little-endian uint32 with the length of a JSON header; the
header; then zstd frames one after the other. The header has the number of tokens, of documents and
of levels, the zeros of every plane, and each frame's place: "docs" (int64), "valid" (one byte a
document, 0 where its id is null), "lengths" (int64), and for each level k, most significant bit
first, "bits<k>" (packed, least significant bit first) and "ranks<k>" (uint32: ones before each
block of BLOCK bits). Frames are read one by one as they are needed.
"""

from __future__ import annotations

import json
import struct

import numpy as np
import zstandard

MAGIC = b"EVIWMAT1"
BLOCK = 512


def build(tokens: np.ndarray, docs: list[int | None], lengths: np.ndarray) -> bytes:
    tokens = np.asarray(tokens)
    levels = max(1, int(tokens.max()).bit_length()) if len(tokens) else 1
    now = tokens.astype(np.uint16 if levels <= 16 else np.uint32)
    frames: dict[str, bytes] = {
        "docs": np.array([0 if d is None else d for d in docs], dtype="<i8").tobytes(),
        "valid": np.array([d is not None for d in docs], dtype=np.uint8).tobytes(),
        "lengths": np.asarray(lengths, dtype="<i8").tobytes(),
    }
    zeros = []
    for k in range(levels):
        if levels - k == 8:
            now = now.astype(np.uint8)  # what is above has been sorted on
        one = (now & now.dtype.type(1 << (levels - 1 - k))) != 0
        bits = np.packbits(one, bitorder="little")
        padded = np.zeros(-(-len(now) // BLOCK) * BLOCK // 8, dtype=np.uint8)
        padded[: len(bits)] = bits
        ones = np.bitwise_count(padded.view(np.uint64)).reshape(-1, BLOCK // 64).sum(1)
        frames[f"bits{k}"] = padded.tobytes()
        frames[f"ranks{k}"] = (np.cumsum(ones) - ones).astype("<u4").tobytes()
        low = now[~one]
        zeros.append(len(low))
        now = np.concatenate([low, now[one]])
    pack = zstandard.ZstdCompressor(level=1)
    places, body, at = {}, [], 0
    for name, raw in frames.items():
        body.append(pack.compress(raw))
        places[name] = [at, len(body[-1])]
        at += len(body[-1])
    header = json.dumps({"tokens": len(tokens), "documents": len(docs), "levels": levels, "zeros": zeros, "frames": places}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(header)), header, *body])


class WaveletMatrix:
    """A file's content: access, count, rank and occurrences without decoding the sequence; tokens() decodes all of it."""

    def __init__(self, raw: bytes):
        if raw[:8] != MAGIC:
            raise ValueError("not a wavelet token file")
        (size,) = struct.unpack("<I", raw[8:12])
        self.header = json.loads(raw[12 : 12 + size])
        self.raw, self.base = raw, 12 + size
        self.n, self.levels, self.zeros = (self.header[k] for k in ("tokens", "levels", "zeros"))
        self.planes: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def frame(self, name: str) -> bytes:
        at, size = self.header["frames"][name]
        return zstandard.ZstdDecompressor().decompress(self.raw[self.base + at : self.base + at + size])

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        ids, valid = np.frombuffer(self.frame("docs"), "<i8"), np.frombuffer(self.frame("valid"), np.uint8)
        return [int(i) if v else None for i, v in zip(ids, valid, strict=True)], np.frombuffer(self.frame("lengths"), "<i8")

    def plane(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        if k not in self.planes:
            self.planes[k] = np.frombuffer(self.frame(f"bits{k}"), np.uint8), np.frombuffer(self.frame(f"ranks{k}"), "<u4")
        return self.planes[k]

    def ones(self, k: int, i: int) -> int:
        """Ones among the first i bits of plane k."""
        bits, ranks = self.plane(k)
        if i >= self.n:
            return self.n - self.zeros[k]
        block = i // BLOCK
        part = bits[block * BLOCK // 8 : i // 8]
        rest = int(bits[i // 8]) & ((1 << (i % 8)) - 1)
        return int(ranks[block]) + int(np.bitwise_count(part).sum()) + rest.bit_count()

    def place(self, k: int, bit: int, j: int) -> int:
        """Where plane k has its bit number j (from 0) of this value: select, by bisection on rank."""
        low, high = 0, self.n
        while low < high:
            mid = (low + high) // 2
            ones = self.ones(k, mid + 1)
            if (ones if bit else mid + 1 - ones) > j:
                high = mid
            else:
                low = mid + 1
        return low

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        token = 0
        for k in range(self.levels):
            bit = int(self.plane(k)[0][i // 8]) >> (i % 8) & 1
            token = token << 1 | bit
            i = self.zeros[k] + self.ones(k, i) if bit else i - self.ones(k, i)
        return token

    def interval(self, token: int, end: int) -> tuple[int, int]:
        """The interval below the last plane of this token's occurrences before end."""
        a, b = 0, min(end, self.n)
        if token < 0 or token >> self.levels:
            return 0, 0
        for k in range(self.levels):
            x, y = self.ones(k, a), self.ones(k, b)
            a, b = (self.zeros[k] + x, self.zeros[k] + y) if token >> (self.levels - 1 - k) & 1 else (a - x, b - y)
        return a, b

    def count(self, token: int, end: int | None = None) -> int:
        """How often the token is among the first end ids (rank)."""
        a, b = self.interval(token, self.n if end is None else end)
        return b - a

    def occurrence(self, token: int, j: int) -> int:
        """Where the token is for the time number j, from 0 (select)."""
        a, b = self.interval(token, self.n)
        if not 0 <= j < b - a:
            raise IndexError(j)
        i = a + j
        for k in reversed(range(self.levels)):
            bit = token >> (self.levels - 1 - k) & 1
            i = self.place(k, bit, i - self.zeros[k] if bit else i)
        return i

    def tokens(self) -> np.ndarray:
        """All ids, from the last plane up: each plane says how to put its two halves back together."""
        now = np.zeros(self.n, dtype=np.uint8)
        for k in reversed(range(self.levels)):
            if self.levels - k == 9:
                now = now.astype(np.uint16 if self.levels <= 16 else np.uint32)
            kind = now.dtype.type
            one = np.unpackbits(self.plane(k)[0], count=self.n, bitorder="little").view(bool)
            before = np.empty_like(now)
            before[one] = now[self.zeros[k] :] | kind(1 << (self.levels - 1 - k))
            before[~one] = now[: self.zeros[k]]
            now = before
        return now
