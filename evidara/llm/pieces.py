"""SentencePiece encoding and decoding of merge-type vocabularies by a score-ordered agenda of adjacent symbol pairs.

A text is cut where no piece of the vocabulary holds the two characters that meet: no merge can cross such a
place, so that segments are encoded apart and each different one once per worker, until its store is full. In a segment the
adjacent pair of the highest score merges first, of equal ones the leftmost, until no two neighbours make a piece. Short segments
go through the agenda together, in rounds of numpy; long ones have a heap. The sentencepiece library encodes the new
segments of each Arrow batch as well, and a difference stops the task; decoding is the library's.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidara.llm import kernels as K
from evidara.llm.pretokens import WordIds, gathered
from evidara.llm.runtime import ship, table

MODEL = "piece_bpe_32k.model"
#: The mark that stands for a space in pieces.
SPACE = "▁"
#: Segments of more characters than this have a heap of their own.
SHORT = 32
#: Above every rank: no piece.
NO_RANK = np.iinfo(np.int32).max
#: Segments that the library is given in one text, to compare with.
CHECKED = 500
#: Texts that are decoded at a time.
DECODED = 512


class Agenda:
    """The merges of a vocabulary: symbols are its pieces and the single characters in them, pairs are looked up in a sorted table."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        plain = [i for i in range(n) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i))]
        self.bytes = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if any(not lib.is_byte(i) for i in self.bytes) or any(lib.is_unused(i) for i in plain):
            raise ValueError(f"{path}: a merge-type vocabulary with a piece for each byte and no unused ones is needed")
        probe = "ﬁ Å  ａ́ "
        if lib.normalize(probe) != SPACE + probe.replace(" ", SPACE):
            raise ValueError(f"{path}: texts must stay as they are but for spaces and one in front")
        names = [lib.id_to_piece(i) for i in plain]
        self.symbol = {p: k for k, p in enumerate(names)}
        # Characters that only longer pieces have are symbols too; alone they are bytes.
        for c in sorted({c for p in names for c in p}):
            self.symbol.setdefault(c, len(self.symbol))
        if "\n" in self.symbol:
            raise ValueError(f"{path}: line feeds must be bytes, they part what is checked")
        self.of = np.full(0x110000, -1, dtype=np.int64)
        for c, k in self.symbol.items():
            if len(c) == 1:
                self.of[ord(c)] = k
        ids = [np.array([i]) for i in plain] + [self.fallback(c) for c in list(self.symbol)[len(plain) :]]
        self.ids_size = np.array([len(x) for x in ids])
        self.ids, self.ids_start = np.concatenate(ids).astype(np.uint32), np.cumsum(self.ids_size) - self.ids_size
        scores = np.array([lib.get_score(i) for i in plain])
        rank = np.unique(-scores, return_inverse=True)[1]
        self.width = len(self.symbol)
        merges = {}
        for k, p in enumerate(names):
            for cut in range(1, len(p)):
                a, b = self.symbol.get(p[:cut]), self.symbol.get(p[cut:])
                if a is not None and b is not None:
                    merges[a * self.width + b] = k
        self.pairs = np.array(sorted(merges), dtype=np.int64)
        self.merged = np.array([merges[x] for x in self.pairs.tolist()], dtype=np.int64)
        self.rank = rank[self.merged].astype(np.int32)
        meets = {(ord(x) if x != SPACE else 32, ord(y) if y != SPACE else 32) for p in names for x, y in zip(p, p[1:], strict=False)}
        self.low = np.zeros((256, 256), dtype=bool)
        for x, y in meets:
            if x < 256 and y < 256:
                self.low[x, y] = True
        self.high = np.array(sorted(x << 21 | y for x, y in meets if x >= 256 or y >= 256), dtype=np.int64)

    def fallback(self, c: str) -> np.ndarray:
        return np.array([self.bytes[b] for b in c.encode()])

    def cut(self, points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where segments start: at a text's first character and wherever no piece holds the two characters that meet."""
        n = len(points)
        if not n:
            return np.zeros(0, dtype=np.int64)
        points = np.where(points == ord(SPACE), 32, points).astype(np.int64)
        x, y = points[:-1], points[1:]
        low = (x < 256) & (y < 256)
        meets = np.zeros(n - 1, dtype=bool)
        meets[low] = self.low[x[low], y[low]]
        rest = np.flatnonzero(~low)
        if len(rest) and len(self.high):
            key = x[rest] << 21 | y[rest]
            meets[rest] = self.high[np.minimum(np.searchsorted(self.high, key), len(self.high) - 1)] == key
        start = np.ones(n, dtype=bool)
        start[1:] = ~meets
        start[offsets[:-1][offsets[:-1] < n]] = True
        return np.flatnonzero(start)

    def look(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What each pair merges to and its rank, NO_RANK if it makes no piece."""
        key = a * self.width + b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return self.merged[at], np.where(self.pairs[at] == key, self.rank[at], NO_RANK)

    def one(self, symbols: list[int]) -> list[int]:
        """The symbols of a segment after all merges, by a heap of (rank, place): the agenda for segments of any length."""
        before, after = list(range(-1, len(symbols) - 1)), [*range(1, len(symbols)), -1]
        held: list[int | None] = list(symbols)
        agenda: list[tuple[int, int, int, int, int]] = []

        def put(left: int, right: int) -> None:
            if left >= 0 and right >= 0:
                key = held[left] * self.width + held[right]
                at = min(int(np.searchsorted(self.pairs, key)), len(self.pairs) - 1)
                if self.pairs[at] == key:
                    heapq.heappush(agenda, (int(self.rank[at]), left, held[left], held[right], int(self.merged[at])))

        for i in range(len(symbols) - 1):
            put(i, i + 1)
        while agenda:
            _, left, a, b, merged = heapq.heappop(agenda)
            right = after[left] if held[left] is not None else -1
            if right < 0 or held[left] != a or held[right] != b:
                continue  # one of the two has merged since
            held[left], held[right] = merged, None
            after[left] = after[right]
            if after[left] >= 0:
                before[after[left]] = left
            put(before[left], left)
            put(left, after[left])
        return [x for x in held if x is not None]

    def many(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of segments after all merges, one after the other, and their new sizes: in each round every segment takes its best pair."""
        number = np.arange(len(sizes))
        if not len(number):
            return symbols, sizes
        start = np.cumsum(sizes) - sizes
        last = np.zeros(len(symbols), dtype=bool)
        last[start + sizes - 1] = True

        def ranked(at: np.ndarray, symbols: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            merged, rank = self.look(symbols[at], symbols[np.minimum(at + 1, len(symbols) - 1)])
            return merged, np.where(last[at], NO_RANK, rank)

        merged, rank = ranked(np.arange(len(symbols)), symbols, last)
        done_symbols, done_number, done_sizes = [], [], []
        while len(number):
            best = np.minimum.reduceat(rank, start)
            going = best < NO_RANK
            if not going.all():
                keep = np.repeat(going, sizes)
                done_symbols.append(symbols[~keep])
                done_number.append(number[~going])
                done_sizes.append(sizes[~going])
                symbols, merged, rank, last = symbols[keep], merged[keep], rank[keep], last[keep]
                number, sizes, best = number[going], sizes[going], best[going]
                start = np.cumsum(sizes) - sizes
                if not len(number):
                    break
            hit = np.flatnonzero(rank == np.repeat(best, sizes))
            which = np.searchsorted(start, hit, "right") - 1
            place = hit[np.concatenate([[True], which[1:] != which[:-1]])]  # the leftmost in each segment
            symbols[place] = merged[place]
            last[place] = last[place + 1]
            keep = np.ones(len(symbols), dtype=bool)
            keep[place + 1] = False
            place = place - np.arange(len(place))  # each segment has lost one symbol
            symbols, merged, rank, last = symbols[keep], merged[keep], rank[keep], last[keep]
            sizes = sizes - 1
            start = np.cumsum(sizes) - sizes
            merged[place], rank[place] = ranked(place, symbols, last)
            left = (place - 1)[place > start]
            merged[left], rank[left] = ranked(left, symbols, last)
        flat, number, sizes = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (done_symbols, done_number, done_sizes))
        order = np.argsort(number, kind="stable")
        flat, _ = gathered(flat, np.cumsum(sizes) - sizes, sizes, order)
        return flat, sizes[order]

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of segments, one after the other, and their numbers of ids; checked against the library."""
        words = [w.replace(" ", SPACE) for w in words]
        size = np.fromiter(map(len, words), np.int64, len(words))
        start = np.cumsum(size) - size
        symbols = self.of[np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)]
        none = symbols[start] < 0  # a character that no piece has is a segment
        short = np.flatnonzero(~none & (size <= SHORT))
        flat, left = self.many(*gathered(symbols, start, size, short)[:1], size[short])
        ids, ends = gathered(self.ids, self.ids_start, self.ids_size, flat)
        ends = ends[np.concatenate([[0], np.cumsum(left)])]
        rest = np.flatnonzero(none | (size > SHORT))
        more = [self.fallback(words[i]) if none[i] else self.ids_of(np.array(self.one(symbols[start[i] : start[i] + size[i]].tolist()))) for i in rest.tolist()]
        count = np.zeros(len(words), dtype=np.int64)
        count[short], count[rest] = np.diff(ends), [len(x) for x in more]
        order = np.argsort(np.concatenate([short, rest]), kind="stable")
        held = count[np.concatenate([short, rest])]
        out, bounds = gathered(np.concatenate([ids, *more]).astype(np.uint32), np.cumsum(held) - held, held, order)
        self.check(words, out, bounds)
        return out, count

    def ids_of(self, symbols: np.ndarray) -> np.ndarray:
        return gathered(self.ids, self.ids_start, self.ids_size, symbols)[0]

    def check(self, words: list[str], ids: np.ndarray, bounds: np.ndarray) -> None:
        """Compare the ids of segments with the library's, which is given some hundred of them with a line feed in front of each: no merge reaches over one."""
        some = range(0, len(words), CHECKED)
        want = self.library.encode(["\n" + "\n".join(words[at : at + CHECKED]) for at in some], num_threads=1)
        want = np.array([x for w in want for x in w[1:]], dtype=np.uint32)  # without the space in front of each
        if len(want) != len(ids) + len(words) or (want != np.insert(ids, bounds[:-1], self.bytes[10])).any():
            wrong = [w for w, a, b in zip(words, bounds[:-1], bounds[1:], strict=True) if self.library.encode("\n" + w)[2:] != ids[a:b].tolist()]
            raise RuntimeError(f"segments that the library encodes otherwise: {wrong[:5]}")


_encoders: dict[str, tuple[Agenda, WordIds]] = {}


def encoder(path: str) -> tuple[Agenda, WordIds]:
    """The agenda and the store of this Python worker for a model file."""
    if path not in _encoders:
        own = Agenda(path)
        _encoders[path] = own, WordIds(own.encode, own.cut)
    return _encoders[path]


def spaced(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with a space in front, which every text that isn't empty gets."""
    filled = np.diff(offsets) > 0
    return np.insert(data, offsets[:-1][filled], 32), offsets + np.concatenate([[0], np.cumsum(filled)])


def roundtrip(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """Rows (doc_id, n_tokens, ids_sha256, decoded_sha256), and ids and decoded if asked for, for docs (doc_id, text).

    path is a sentencepiece model of the merge type. ids_sha256 is over the decimal ids joined by commas, decoded_sha256 over the
    text that the library decodes them to, in UTF-8. Nothing moves between tasks. Null texts are empty and have no ids; rows of one
    id, or of none, and repeated rows keep a row each; other columns take no part; an empty table gives none.
    """
    ship(docs.sparkSession)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * with_ids
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from evidara.llm.pieces import encoder, spaced

        agenda, store = encoder(path)
        for batch in batches:
            for piece in K.pieces(batch):
                ids, bounds = store(*spaced(*K.text_bytes(piece.column("text"))))
                rows: dict[str, list] = {n: [] for n in names}
                doc_ids = piece.column("doc_id").to_pylist()
                for at in range(0, len(doc_ids), DECODED):
                    stop = min(at + DECODED, len(doc_ids))
                    held = [ids[a:b].tolist() for a, b in zip(bounds[at:stop].tolist(), bounds[at + 1 : stop + 1].tolist(), strict=True)]
                    for d, own, text in zip(doc_ids[at:stop], held, agenda.library.decode(held), strict=True):
                        row = [d, len(own), hashlib.sha256(",".join(map(str, own)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()]
                        for n, v in zip(names, row + [own, text] * with_ids, strict=True):
                            rows[n].append(v)
                yield pa.RecordBatch.from_arrays([pa.array(rows[n], k) for n, k in zip(names, kinds, strict=False)], names=names)

    fields = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, fields)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: every text of documents encoded and decoded."""
    return roundtrip(table(spark, sf_dir, "documents"), public_tokenizers.path(MODEL))
