"""Byte-level BPE by a shuffle of distinct words: every pre-token of the corpus is encoded once.

Tasks split texts into pre-tokens and number those that differ within a block of documents. The
words of all blocks are dealt by word and sorted, so that each distinct word is encoded in one
place, once; its ids go back to the blocks, which put their documents together by position.
Decoding looks every id up in the table of token bytes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidara.llm import kernels as K
from evidara.llm.runtime import bucketed, remove, ship, table, written

VOCABULARY = "byte_bpe_50k.tiktoken"
#: A block ends at so many distinct words or pre-tokens, which bounds a task's memory.
BLOCK_WORDS, BLOCK_TOKENS = 1 << 19, 6 << 20
#: Encoded words that are sent back together.
SENT = 1 << 18


def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def packed(numbers: np.ndarray) -> bytes:
    """Numbers under 2 ** 32, low bytes first, then the next, and compressed."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def blocks(docs: DataFrame) -> DataFrame:
    """Rows (block, doc_ids, counts, places, words): documents with their numbers of pre-tokens, these as places in words."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from evidara.llm import pretokens as P

        made, part = 0, TaskContext.get().partitionId()
        store: dict[bytes, int] = {}
        ids, counts, places, held = [], [], [], 0

        def row() -> pa.RecordBatch:
            at = np.concatenate(places)
            order = np.argsort(-np.bincount(at, minlength=len(store)), kind="stable")  # frequent words get small places
            place, words = np.empty(len(store), dtype=np.int64), list(store)
            place[order] = np.arange(len(store))
            cols = {
                "block": pa.array([(part << 24) + made], pa.int64()), "doc_ids": pa.array([[d for x in ids for d in x]], pa.list_(pa.int64())),
                "counts": pa.array([packed(np.concatenate(counts))], pa.binary()), "places": pa.array([packed(place[at])], pa.binary()),
                "words": pa.array([[words[i] for i in order]], pa.list_(pa.string())),
            }
            return pa.RecordBatch.from_pydict(cols)

        for batch in batches:
            for piece in K.pieces(batch):
                data, offsets = K.text_bytes(piece.column("text"))
                starts, bounds = P.tokens(data, offsets)
                which, words = P.distinct(data, starts)
                place = P.places(store, words)
                new = np.flatnonzero(place < 0)
                if ids and (len(store) + len(new) > BLOCK_WORDS or held + len(starts) > BLOCK_TOKENS):
                    yield row()
                    made, store, ids, counts, places, held = made + 1, {}, [], [], [], 0
                    new = np.arange(len(words))
                place[new] = np.arange(len(store), len(store) + len(new))
                store.update((words[i], n) for i, n in zip(new.tolist(), place[new].tolist(), strict=True))
                ids.append(piece.column("doc_id").to_pylist())
                counts.append(np.diff(bounds))
                places.append(place[which])
                held += len(starts)
        if ids:
            yield row()

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(split, "block long, doc_ids array<long>, counts binary, places binary, words array<string>")


def encoded_words(split: DataFrame, path: str) -> DataFrame:
    """Rows (block, places, sizes, ids): ids of some of a block's words. Each distinct word is encoded once for all blocks."""
    n = int(split.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = split.select("block", F.posexplode("words").alias("place", "word")).repartition(n, "word").sortWithinPartitions("word")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(path), special_tokens={})
        last: tuple[str | None, list[int]] = (None, [])
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        count = 0

        def send() -> Iterator[pa.RecordBatch]:
            block, place, size = (np.concatenate([h[i] for h in held]) for i in range(3))
            flat = np.concatenate([h[3] for h in held])
            order = np.argsort(block, kind="stable")
            from evidara.llm.pretokens import gathered

            flat, bounds = gathered(flat, np.cumsum(size) - size, size, order)
            block, place, size = block[order], place[order], size[order]
            cuts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]]))
            out = {
                "block": pa.array(block[cuts[:-1]]), "places": pa.array([packed(place[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
                "sizes": pa.array([packed(size[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
                "ids": pa.array([packed(flat[bounds[a] : bounds[b]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
            }
            yield pa.RecordBatch.from_pydict(out)

        for batch in batches:
            runs = pc.run_end_encode(batch.column("word"))
            words, ends = runs.values.to_pylist(), runs.run_ends.to_numpy()
            ids = [last[1] if i == 0 and w == last[0] else own.encode_ordinary(w) for i, w in enumerate(words)]
            if words:
                last = words[-1], ids[-1]
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            which = np.repeat(np.arange(len(words)), np.diff(ends, prepend=0))
            from evidara.llm.pretokens import gathered

            flat, _ = gathered(np.fromiter((x for y in ids for x in y), np.uint32, int(size.sum())), np.cumsum(size) - size, size, which)
            held.append((batch.column("block").to_numpy(), batch.column("place").to_numpy(), size[which], flat))
            count += batch.num_rows
            if count >= SENT:
                yield from send()
                held, count = [], 0
        if count:
            yield from send()

    return rows.mapInArrow(encode, "block long, places binary, sizes binary, ids binary")


def roundtrip(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """Rows (doc_id, n_tokens, ids_sha256, decoded_sha256), and ids and decoded (binary) if asked for, for docs (doc_id, text).

    path is a file of token ranks. ids_sha256 is over the decimal ids joined by one space, decoded_sha256
    over the bytes that the ids decode to. Null texts are empty; rows of one id, or of none, and
    repeated rows keep a row each; an empty table gives none.
    """
    spark = docs.sparkSession
    ship(spark)
    split, name, path_of_split = bucketed(blocks(docs), "blocks", "block")
    words = encoded_words(split, path)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * with_ids

    def joined(left: pa.Table, right: pa.Table) -> pa.Table:
        from evidara.llm.pretokens import gathered

        token_bytes, decimals = tables(path)
        place = [np.zeros(0, np.int64), *[unpacked(x) for x in right.column("places").to_pylist()]]
        size = [np.zeros(0, np.int64), *[unpacked(x) for x in right.column("sizes").to_pylist()]]
        flat = [np.zeros(0, np.int64), *[unpacked(x) for x in right.column("ids").to_pylist()]]
        place, size, flat = (np.concatenate(x).astype(np.int64) for x in (place, size, flat))
        start, count = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        start[place], count[place] = np.cumsum(size) - size, size
        out: dict[str, list] = {n: [] for n in names}
        for i in range(left.num_rows):
            docs_of, ends = left.column("doc_ids")[i].as_py(), np.cumsum(unpacked(left.column("counts")[i].as_py()).astype(np.int64))
            places = unpacked(left.column("places")[i].as_py())
            step = 0
            while step < len(docs_of):  # some documents at a time
                base = int(ends[step - 1]) if step else 0
                stop = max(step + 1, int(np.searchsorted(ends, base + (1 << 18), "right")))
                ids, bounds = gathered(flat, start, count, places[base : ends[stop - 1]])
                cuts = bounds[np.concatenate([[base], ends[step:stop]]) - base]
                text, text_ends = gathered(*token_bytes, ids)
                line, line_ends = gathered(*decimals, ids)
                for d, a, b in zip(docs_of[step:stop], cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    decoded = text[text_ends[a] : text_ends[b]]
                    row = [d, b - a, hashlib.sha256(line[line_ends[a] : max(line_ends[a], line_ends[b] - 1)]).hexdigest(), hashlib.sha256(decoded).hexdigest()]
                    for n, v in zip(names, row + [ids[a:b].tolist(), decoded.tobytes()] * with_ids, strict=False):
                        out[n].append(v)
                step = stop
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.binary()]
        return pa.Table.from_arrays([pa.array(out[n], k) for n, k in zip(names, kinds, strict=False)], names=names)

    fields = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded binary" * with_ids
    out, _ = written(split.drop("words").groupBy("block").cogroup(words.groupBy("block")).applyInArrow(joined, fields), "encoded")
    spark.sql(f"DROP TABLE {name}")
    remove(spark, path_of_split)
    return out


_tables: dict[str, tuple] = {}


def tables(path: str) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], ...]:
    """The bytes of each token, and each id in decimal with a space behind: all in a row, starts, sizes."""
    if path not in _tables:
        of = {i: b for b, i in ranks(path).items()}
        rows = [[of.get(i, b"") for i in range(max(of) + 1)], [b"%d " % i for i in range(max(of) + 1)]]
        sizes = [np.array([len(x) for x in r], dtype=np.int64) for r in rows]
        _tables[path] = tuple((np.frombuffer(b"".join(r), np.uint8), np.cumsum(s) - s, s) for r, s in zip(rows, sizes, strict=True))
    return _tables[path]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: every text of documents encoded and decoded."""
    return roundtrip(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
