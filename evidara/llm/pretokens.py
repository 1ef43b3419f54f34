"""The pre-token split of byte-level BPE, vectorised, and ids by the tokenizers library once per distinct pre-token.

The split pattern is public_tokenizers.PATTERN: contractions, letters, numbers and other marks each
with one leading space, white space up to the last one before a word.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex

LETTER, NUMBER, MARK, SPACE, UNKNOWN = range(5)
_classes = np.full(0x110000, UNKNOWN, dtype=np.uint8)
_kinds = [(regex.compile(p), k) for p, k in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", SPACE), (r"(?s).", MARK))]


def classes(points: np.ndarray) -> np.ndarray:
    """The class of each code point; a point is looked up in the regex library the first time it is seen."""
    found = _classes[points]
    if (found == UNKNOWN).any():
        for p in np.unique(points[found == UNKNOWN]):
            _classes[p] = next(k for r, k in _kinds if r.match(chr(p)))
        found = _classes[points]
    return found


def split(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pre-tokens start in the code points of documents that begin at offsets. Every code point is in one."""
    n = len(points)
    if not n:
        return np.zeros(0, dtype=np.int64)
    kind = classes(points)
    first = np.zeros(n + 1, dtype=bool)
    first[offsets] = True
    first[n] = True
    run = first.copy()
    run[1:n] |= kind[1:] != kind[:-1]
    start = run.copy()
    # White space before a word: its last character is a token of its own, or leads the word if it is a space.
    last = np.flatnonzero((kind == SPACE) & run[1:] & ~first[1:])
    start[last] = True
    start[last[points[last] == 32] + 1] = False
    # A contraction: an apostrophe alone that no space leads, and one of the fixed endings.
    for i in np.flatnonzero((points == 39) & run[:n] & run[1:] & start[:n] & ~first[1:]):
        room = n - i - 1
        ending = 0
        if room >= 1 and points[i + 1] in (115, 116, 109, 100):  # s t m d
            ending = 1
        elif room >= 2 and not first[i + 2] and (points[i + 1], points[i + 2]) in ((114, 101), (118, 101), (108, 108)):  # re ve ll
            ending = 2
        if ending:
            start[i + 1] = False
            start[i + 1 + ending] = True
    return np.flatnonzero(start[:n])


def points_of(data: np.ndarray, offsets: np.ndarray) -> tuple[str, np.ndarray, np.ndarray]:
    """The text, its code points and the documents' offsets in code points, from UTF-8 bytes and byte offsets."""
    text = data.tobytes().decode("utf-8", "replace")
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return text, np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32), heads[offsets]


def tokens(data: np.ndarray, offsets: np.ndarray, cut: Callable[[np.ndarray, np.ndarray], np.ndarray] = split) -> tuple[np.ndarray, np.ndarray]:
    """Where the spans that cut makes start in UTF-8 bytes, and the index of each document's first span (and of the last's end)."""
    _, points, at = points_of(data, offsets)
    starts = cut(points, at)
    heads = np.flatnonzero((data & 0xC0) != 0x80)
    return heads[starts], np.searchsorted(starts, at)


def distinct(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """For each of the spans, which tile data, its place among the different ones, and these. Spans are told apart by their bytes."""
    if not len(starts):
        return np.zeros(0, np.int64), []
    ends = pa.py_buffer(np.append(starts, len(data)).astype(np.int32))
    held = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, ends, pa.py_buffer(data)]).dictionary_encode()
    _, at, raw = held.dictionary.buffers()
    at, raw = np.frombuffer(at, np.int32)[: len(held.dictionary) + 1].tolist(), raw.to_pybytes()
    return held.indices.to_numpy(), [raw[a:b] for a, b in zip(at, at[1:], strict=False)]


def places(of: dict[bytes, int], words: list[bytes]) -> np.ndarray:
    """The number of each word, -1 where it has none."""
    return np.fromiter(map(of.get, words, repeat(-1)), np.int64, len(words))


class WordIds:
    """The ids of the spans that cut makes: a bounded store in front of encode(list of words) -> (ids one after the other, sizes).

    A word is encoded the first time that it is seen; beyond limit words the store starts afresh. Words are
    looked up by their bytes, so that no two share an entry.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], cut: Callable[[np.ndarray, np.ndarray], np.ndarray] = split, limit: int = 1_000_000):
        self.encode, self.cut, self.limit = encode, cut, limit
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.start, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        self.flat, self.used = np.zeros(1 << 17, np.uint32), 0

    def add(self, words: list[bytes]) -> np.ndarray:
        """The numbers of words that the store hasn't, in order."""
        flat, size = self.encode([w.decode() for w in words])
        n = len(self.place)
        self.flat = grown(self.flat, self.used + len(flat))
        self.start, self.size = grown(self.start, n + len(words)), grown(self.size, n + len(words))
        self.flat[self.used : self.used + len(flat)] = flat
        self.start[n : n + len(words)] = self.used + np.cumsum(size) - size
        self.size[n : n + len(words)] = size
        self.place.update(zip(words, range(n, n + len(words)), strict=True))
        self.used += len(flat)
        return np.arange(n, n + len(words))

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all documents one after the other, and where each document's begin (and the last ends)."""
        starts, bounds = tokens(data, offsets, self.cut)
        which, words = distinct(data, starts)
        place = places(self.place, words)
        new = np.flatnonzero(place < 0)
        if len(new):
            if len(self.place) + len(new) > self.limit:
                self.clear()
                new = np.arange(len(words))
            place[new] = self.add([words[i] for i in new.tolist()])
        flat, ends = gathered(self.flat, self.start, self.size, place[which])
        return flat, ends[bounds]


def grown(a: np.ndarray, n: int) -> np.ndarray:
    while n > len(a):
        a = np.concatenate([a, np.zeros_like(a)])
    return a


def gathered(flat: np.ndarray, start: np.ndarray, size: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces flat[start[i] : start[i] + size[i]] for i in which, one after the other, and their bounds."""
    sizes = size[which]
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(bounds[-1]) + np.repeat(start[which] - bounds[:-1], sizes)
    return flat[at], bounds


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level model: printable bytes for themselves, the rest from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


_encoders: dict[str, WordIds] = {}


def encoder(path: str) -> WordIds:
    """The store of this Python worker for a byte-level tokenizers file; strings of special tokens are ordinary text."""
    if path not in _encoders:
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        own.encode_special_tokens = True
        model, letters = own.model, byte_letters()
        line = own.encode("\n", add_special_tokens=False).ids

        def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
            # Words that end in a mark, letter or number stay pre-tokens with a line feed between them, and a line
            # feed is one id that none of them has: the library encodes hundreds of them in a call.
            plain = [i for i, w in enumerate(words) if not w[-1].isspace() and "\n" not in w] if len(line) == 1 else []
            parts: list = [None] * len(words)
            for k in range(0, len(plain), 500):
                some = plain[k : k + 500]
                ids = np.array(own.encode_batch_fast(["\n".join([words[i] for i in some])], add_special_tokens=False)[0].ids, dtype=np.uint32)
                cuts = np.flatnonzero(ids == line[0])
                if len(cuts) != len(some) - 1:
                    break
                for i, a, b in zip(some, [0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)], strict=True):
                    parts[i] = ids[a:b]
            for i, x in enumerate(parts):
                if x is None:
                    parts[i] = np.array([t.id for t in model.tokenize(words[i].encode().decode("latin-1").translate(letters))], dtype=np.uint32)
            return np.concatenate(parts), np.array([len(x) for x in parts], dtype=np.int64)

        _encoders[path] = WordIds(encode)
    return _encoders[path]
