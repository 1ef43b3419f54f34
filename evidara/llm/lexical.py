"""Ranked lexical search: block-max WAND over shards whose posting blocks are of variable length.

Tasks turn documents into shards of a bounded number of terms, each one row of term-major postings. Once the corpus's
numbers are known each posting has an impact, and dynamic programming cuts every posting list into blocks so that the error of
the blocks' maxima, plus a price for each block, is least. A query's block maxima bound the score of every document between
two block borders; a shard scores the ranges of the highest bounds first and skips all whose bound is under the least score of
its best documents. Nothing is approximate: what is skipped can't be among them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidara.llm import kernels as K
from evidara.llm.bpe import packed
from evidara.llm.bpe import unpacked as unpack
from evidara.llm.ngrams import WORD
from evidara.llm.pretokens import distinct, gathered, places
from evidara.llm.runtime import remove, ship, table, written
from evidara.operators.dedup import top_k

BEST = 50
#: A shard ends at so many terms with repeats or documents, which bounds a task's memory.
SHARD_TERMS, SHARD_DOCS = 1 << 21, 1 << 14
#: Postings of a block at most, the price of a block in units of impact, and lists that are cut together.
LONGEST, PRICE, TOGETHER = 64, 300_000, 1 << 13
#: Text of the queries that are sent to every task at once; more queries come in several blocks.
QUERY_BYTES = 8 << 20
#: Ranges that are scored before the least score is looked at again; this doubles.
RANGES = 64
#: Fixed values of the score: impact is SCALE * tf over 1000 * tf + 20 * m, m is 50 percent for length and 50 for length over the mean.
SCALE = 1_000_000_000

POSTINGS = "shard long, doc_ids array<long>, sizes binary, terms binary, counts binary, docs binary, tfs binary, n_filled long, n_terms long"
INDEX = POSTINGS + ", blocks binary, maxes binary"


def unpacked(raw: bytes) -> np.ndarray:
    return unpack(raw).astype(np.int64)


def ranges(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """start[i], start[i] + 1, ... (size[i] of them) for all i, one after the other, and the bounds of each."""
    bounds = np.concatenate([[0], np.cumsum(size)])
    return np.arange(bounds[-1]) + np.repeat(start - bounds[:-1], size), bounds


def by_id(i: int | None) -> tuple[bool, int]:
    return i is None, i or 0


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(place of each term among the different ones, these, document of each term): runs of letters, digits and all but ASCII, A-Z lower-cased."""
    starts, ends = K.spans(WORD[data], offsets)
    flat, bounds = gathered(K.LOWER[data], starts, ends - starts, np.arange(len(starts)))
    which, found = distinct(flat, bounds[:-1])
    return which, found, K.owner(np.searchsorted(starts, offsets))


class Shard:
    """Documents of a task that become one row of postings."""

    def __init__(self) -> None:
        self.place: dict[bytes, int] = {}
        self.ids: list[int | None] = []
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.n = 0

    def add(self, ids: list[int | None], which: np.ndarray, found: list[bytes], owner: np.ndarray) -> None:
        place = places(self.place, found)
        new = np.flatnonzero(place < 0)
        place[new] = np.arange(len(self.place), len(self.place) + len(new))
        self.place.update((found[i], n) for i, n in zip(new.tolist(), place[new].tolist(), strict=True))
        self.held.append((place[which], owner + len(self.ids)))
        self.ids += ids
        self.n += len(which)

    def row(self, number: int) -> pa.RecordBatch:
        d = max(1, len(self.ids))
        order = sorted(range(len(self.ids)), key=lambda i: by_id(self.ids[i]))
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        term, doc = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*self.held, strict=True))
        doc = rank[doc]
        keys, tf = np.unique(term * d + doc, return_counts=True)
        count = np.bincount(keys // d, minlength=len(self.place))
        docs = keys % d
        size = np.bincount(doc, minlength=len(order))
        gap = np.diff(docs, prepend=0)
        gap[(np.cumsum(count) - count)[count > 0]] = docs[(np.cumsum(count) - count)[count > 0]]  # a list's first is whole
        cols = {
            "shard": pa.array([number], pa.int64()), "doc_ids": pa.array([[self.ids[i] for i in order]], pa.list_(pa.int64())), "sizes": pa.array([packed(size)], pa.binary()),
            "terms": pa.array([zstandard.ZstdCompressor(level=1).compress(b"\n".join(self.place))], pa.binary()), "counts": pa.array([packed(count)], pa.binary()),
            "docs": pa.array([packed(gap)], pa.binary()), "tfs": pa.array([packed(tf)], pa.binary()),
            "n_filled": pa.array([int((size > 0).sum())], pa.int64()), "n_terms": pa.array([int(size.sum())], pa.int64()),
        }
        return pa.RecordBatch.from_pydict(cols)


def postings(docs: DataFrame) -> DataFrame:
    """Shards of docs (doc_id, text), a row each: POSTINGS. Documents are in ascending doc_id in a shard, terms as they came."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from evidara.llm.lexical import Shard, terms_of

        shard, made, part = Shard(), 0, TaskContext.get().partitionId()
        for batch in batches:
            for piece in K.pieces(batch):
                which, found, owner = terms_of(*K.text_bytes(piece.column("text")))
                if shard.ids and (shard.n + len(which) > SHARD_TERMS or len(shard.ids) + piece.num_rows > SHARD_DOCS):
                    yield shard.row((part << 24) + made)
                    shard, made = Shard(), made + 1
                shard.add(piece.column("doc_id").to_pylist(), which, found, owner)
        if shard.ids:
            yield shard.row((part << 24) + made)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(split, POSTINGS)


def block_starts(impact: np.ndarray, start: np.ndarray, size: np.ndarray, longest: int = LONGEST, price: int = PRICE) -> np.ndarray:
    """Where blocks of the lists impact[start : start + size], which tile impact, begin: of all ways to cut a list into blocks of at most
    `longest` postings, one that makes the sum over blocks of price + size * maximum least. (The impacts' own sum is the same for all.)

    Lists of like size are cut together: step i has the best cost of the first i postings of every list.
    """
    begins = np.zeros(len(impact), dtype=bool)
    begins[start[size > 0]] = True
    order = np.flatnonzero(size > 1)
    order = order[np.argsort(-size[order], kind="stable")]
    like = np.ceil(np.log2(size[order]))  # sizes within a factor of two
    edges = np.flatnonzero(np.concatenate([[True], np.diff(like) != 0, [True]])) if len(order) else np.zeros(0, np.int64)
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        for at in range(a, b, TOGETHER):
            some = order[at : min(at + TOGETHER, b)]
            _cut(begins, impact, start[some], size[some], longest, price)
    return np.flatnonzero(begins)


def _cut(begins: np.ndarray, impact: np.ndarray, start: np.ndarray, size: np.ndarray, longest: int, price: int) -> None:
    """Mark where blocks of the lists begin; sizes descend."""
    steps, n = int(size[0]), len(size)
    width = min(longest, steps)
    # Rows from the newest on: the best cost before each of the last postings, and the maximum from it on.
    cost, top = np.zeros((3 * width, n), np.int64), np.zeros((3 * width, n), np.int64)
    back = np.zeros((steps + 1, n), np.int32)
    at = 3 * width
    lengths = np.arange(1, width + 1)[:, None]
    best = np.zeros(n, np.int64)
    active = np.searchsorted(-size, -np.arange(steps + 1), "right")  # lists of at least i postings
    for i in range(1, steps + 1):
        m = int(active[i])
        if not at:
            at = 2 * width
            cost[at:], top[at:] = cost[:width], top[:width]
        at -= 1
        w = min(i, width)
        x = impact[start[:m] + i - 1]
        cost[at, :m], top[at, :m] = best[:m], x
        np.maximum(top[at + 1 : at + w, :m], x, out=top[at + 1 : at + w, :m])
        total = cost[at : at + w, :m] + lengths[:w] * top[at : at + w, :m]
        pick = total.argmin(axis=0)
        best = total[pick, np.arange(m)] + price
        back[i, :m] = pick + 1
    left, going = size.copy(), np.arange(n)
    while len(going):
        left[going] -= back[left[going], going]
        begins[start[going] + left[going]] = True
        going = going[left[going] > 0]


class Lists:
    """The postings of a shard's row, unpacked: lists of documents and impacts one after the other."""

    def __init__(self, row: dict, n: int, total: int):
        self.ids = row["doc_ids"]
        self.count = unpacked(row["counts"])
        self.start = np.cumsum(self.count) - self.count
        gap = unpacked(row["docs"])
        docs = np.cumsum(gap)
        filled = self.count > 0
        base = docs[self.start[filled]] - gap[self.start[filled]]
        self.docs = docs - np.repeat(base, self.count[filled])
        size, tf = unpacked(row["sizes"]), unpacked(row["tfs"])
        m = 50 + (50 * size * n) // max(1, total)
        self.impact = (SCALE * tf) // (1000 * tf + 20 * m[self.docs])


def terms_in(row: dict) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(row["terms"])
    return raw.split(b"\n") if raw else []


def indexed(shards: DataFrame, n: int, total: int, price: int = PRICE) -> DataFrame:
    """The shards with their blocks and the blocks' maxima, for a corpus of n documents with terms and `total` terms: INDEX."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from evidara.llm.lexical import Lists, block_starts

        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                own = Lists(one.to_pylist()[0], n, total)
                begins = block_starts(own.impact, own.start, own.count, price=price)
                sizes, maxes = np.diff(begins, append=len(own.impact)), np.maximum.reduceat(own.impact, begins) if len(begins) else begins
                yield pa.RecordBatch.from_arrays([*one.columns, pa.array([packed(sizes)], pa.binary()), pa.array([packed(maxes)], pa.binary())], names=[*one.schema.names, "blocks", "maxes"])

    return shards.mapInArrow(cut, INDEX)


class Searcher:
    """A shard that is searched."""

    def __init__(self, row: dict, n: int, total: int):
        self.lists = Lists(row, n, total)
        self.place = {t: i for i, t in enumerate(terms_in(row))}
        self.d = len(self.lists.ids)
        # A posting's list and document in one number, ascending.
        self.key = np.repeat(np.arange(len(self.lists.count)), self.lists.count) * self.d + self.lists.docs
        sizes = unpacked(row["blocks"])
        ends = np.cumsum(sizes)
        self.first, self.last, self.top = self.lists.docs[ends - sizes], self.lists.docs[ends - 1], unpacked(row["maxes"])
        self.bounds = np.searchsorted(ends - sizes, np.append(self.lists.start, len(self.lists.docs)))  # a list's blocks
        self.score = np.zeros(self.d, np.int64)

    def search(self, weights: dict[bytes, int], k: int, least: int) -> list[tuple[int | None, int]]:
        """The k best (doc_id, score) by score, then doc_id, leaving out scores under `least`."""
        known = [(self.place[t], w) for t, w in weights.items() if w > 0 and t in self.place]
        if not known:
            return []
        lists, weight = (np.array(x, dtype=np.int64) for x in zip(*known, strict=True))
        blocks, cuts = ranges(self.bounds[lists], self.bounds[lists + 1] - self.bounds[lists])
        bound = self.top[blocks] * np.repeat(weight, np.diff(cuts))
        # The bound of a range between two borders of blocks is the sum of the maxima of the blocks over it.
        border = np.concatenate([self.first[blocks], self.last[blocks] + 1])
        order = np.argsort(border, kind="stable")
        border, height = border[order], np.cumsum(np.concatenate([bound, -bound])[order])
        ends = np.flatnonzero(np.append(border[1:] != border[:-1], True))
        begin, height = border[ends], height[ends]
        stop = np.append(begin[1:], self.d)
        order = np.argsort(-height, kind="stable")
        begin, stop, height = begin[order], stop[order], height[order]
        best_docs, best_scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, step, least = 0, RANGES, max(least, 1)
        while at < len(begin) and height[at] >= least:
            some = slice(at, min(at + step, int(np.searchsorted(-height, -least, "right"))))
            low = np.searchsorted(self.key, (lists[:, None] * self.d + begin[some]).ravel())
            high = np.searchsorted(self.key, (lists[:, None] * self.d + stop[some]).ravel())
            found, sizes = ranges(low, high - low)
            docs = self.lists.docs[found]
            np.add.at(self.score, docs, self.lists.impact[found] * np.repeat(np.repeat(weight, some.stop - some.start), np.diff(sizes)))
            docs = np.unique(docs)
            best_docs, best_scores = np.concatenate([best_docs, docs]), np.concatenate([best_scores, self.score[docs]])
            self.score[docs] = 0
            order = np.lexsort((best_docs, -best_scores))[:k]
            best_docs, best_scores = best_docs[order], best_scores[order]
            if len(best_docs) == k:
                least = max(least, int(best_scores[-1]))
            at, step = some.stop, 2 * step
        return [(self.lists.ids[d], s) for d, s in zip(best_docs.tolist(), best_scores.tolist(), strict=True) if s >= least]


def searched(index: DataFrame, queries: list[tuple[int | None, list[bytes]]], n: int, total: int, k: int) -> DataFrame:
    """Rows (item_id, doc_id, score): the best of what each task has read, for queries (item_id, terms) that every task is sent."""
    wanted = {t for _, terms in queries for t in terms}

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = [(t, c) for t, c in zip(terms_in(row), unpacked(row["counts"]).tolist(), strict=True) if t in wanted]
                yield pa.RecordBatch.from_pydict({"term": pa.array([t.decode() for t, _ in found], pa.string()), "df": pa.array([c for _, c in found], pa.int64())})

    # As many rows as the queries of this block have terms.
    df = {r.term.encode(): r.df for r in index.select("terms", "counts").mapInArrow(counted, "term string, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()}
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * c + 1))) for t, c in df.items()}
    asked = [(i, {t: weight[t] for t in terms if t in weight}) for i, terms in queries]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from evidara.llm.lexical import Searcher

        best: list[list[tuple[int | None, int]]] = [[] for _ in asked]
        for batch in batches:
            for i in range(batch.num_rows):
                shard = Searcher(batch.slice(i, 1).to_pylist()[0], n, total)
                for q, (_, weights) in enumerate(asked):
                    # What the task's earlier shards have found is a bound for this one.
                    found = shard.search(weights, k, best[q][-1][1] if len(best[q]) == k else 1)
                    if found:
                        best[q] = sorted(best[q] + found, key=lambda x: (-x[1], by_id(x[0])))[:k]
        rows = [(item, d, s) for (item, _), b in zip(asked, best, strict=True) for d, s in b]
        if rows:
            item, doc, score = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(doc, pa.int64()), pa.array(score, pa.int64())], names=["item_id", "doc_id", "score"])

    return index.mapInArrow(search, "item_id long, doc_id long, score long")


def build(docs: DataFrame, price: int = PRICE) -> tuple[DataFrame, int, int]:
    """(the index of docs (doc_id, text), written to the shared folder; its documents with terms; all their terms)."""
    spark = docs.sparkSession
    ship(spark)
    shards, path = written(postings(docs), "postings")
    n, total = shards.agg(F.coalesce(F.sum("n_filled"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).head()
    index, _ = written(indexed(shards, n, total, price), "index")
    remove(spark, path)
    return index, n, total


def ranked(index: DataFrame, n: int, total: int, queries: DataFrame, k: int = BEST) -> DataFrame:
    """Rows (item_id, rank, doc_id, score): the k best documents of each of queries (item_id, text), scores above 0, equal ones by ascending doc_id.

    Rows of one item_id are one query of all their terms; a query without terms, or whose terms no document has, has no rows. Queries are
    dealt into blocks of about QUERY_BYTES of text, each of which is sent to the tasks that read the index. Every row of the
    documents is a candidate: repeated rows are ranked each, null texts have no terms, a null doc_id comes after all others.
    """
    spark = queries.sparkSession
    ship(spark)
    texts = queries.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).head()[0]
    blocks = 1 + size // QUERY_BYTES
    found = []
    for b in range(blocks):
        own: dict[int | None, dict[str, None]] = {}
        for r in texts.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect():  # about QUERY_BYTES
            data = np.frombuffer(r.text.encode(), np.uint8)
            own.setdefault(r.item_id, {}).update(dict.fromkeys(terms_of(data, np.array([0, len(data)]))[1]))
        asked = sorted(((i, list(t)) for i, t in own.items()), key=lambda x: by_id(x[0]))
        if asked and total:
            best = top_k(searched(index, asked, n, total, k), ["item_id"], [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], k, "rank")
            found.append(written(best.select("item_id", "rank", "doc_id", "score"), "ranked")[0])
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for one in found:
        out = out.unionByName(one)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: the 50 best documents for each benchmark item."""
    index, n, total = build(table(spark, sf_dir, "documents"))
    return ranked(index, n, total, table(spark, sf_dir, "benchmark"))
