"""Token-ID output: texts encoded and written as wavelet-matrix files, one per shard, in order of document id.

Shards are written by the tasks with pyarrow's file systems into a shared folder under names that
only one attempt uses, then renamed; the manifest that Spark commits names the files of the
attempts that counted. Each file has whole documents, and about tokens_per_shard ids.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidara.llm import kernels as K
from evidara.llm.runtime import new_path, ship, table, written

VOCABULARY = "byte_bpe_50k.json"
MANIFEST = "part int, shard int, path string, documents long, tokens long"


#: Schemes of Spark's paths and what pyarrow calls the same stores.
SCHEMES = {"s3a": "s3", "s3n": "s3", "gs": "gs", "abfss": "abfss", "hdfs": "hdfs", "viewfs": "viewfs", "file": "file"}


def as_uri(path: str) -> str:
    """A path as pyarrow's file systems take it."""
    scheme, mark, rest = path.partition(":")
    if not mark or "/" in scheme:
        return f"file://{path}"
    return f"{SCHEMES.get(scheme, scheme)}:{rest}"


def file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(as_uri(path))


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = 2, tokens_per_shard: int = 1 << 20) -> DataFrame:
    """Encode docs (doc_id, text) with the tokenizers file, end_id after each, and write shards to folder; returns the manifest.

    Ids ascend over partitions and shards. Null texts are empty; a null id comes first; rows of one
    id, and repeated rows, each keep an entry. An empty table has an empty manifest and no files.
    """
    ship(docs.sparkSession)
    # Rows of one id and one text are told apart by a number, so that they may be dealt to several tasks.
    tie = F.xxhash64("text")
    docs = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row")).repartitionByRange("doc_id", tie, "row").sortWithinPartitions("doc_id", tie, "row").drop("row")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from evidara.llm.pretokens import encoder
        from evidara.llm.wavelet import build

        encode, part = encoder(tokenizer), TaskContext.get().partitionId()
        store, at = file_system(folder)
        store.create_dir(at)
        held: list[tuple[list, np.ndarray, np.ndarray]] = []
        made = size = 0

        def flush() -> pa.RecordBatch:
            ids = [d for x in held for d in x[0]]
            name = f"part-{part:06d}-{made:06d}-{uuid.uuid4().hex}"
            with store.open_output_stream(f"{at}/.{name}") as out:
                out.write(build(np.concatenate([x[2] for x in held]), ids, np.concatenate([x[1] for x in held])))
            store.move(f"{at}/.{name}", f"{at}/{name}.wm")
            row = {"part": [part], "shard": [made], "path": [f"{folder}/{name}.wm"], "documents": [len(ids)], "tokens": [size]}
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("path", pa.string()), ("documents", pa.int64()), ("tokens", pa.int64())]))

        for batch in batches:
            for piece in K.pieces(batch):
                flat, bounds = encode(*K.text_bytes(piece.column("text")))
                lengths = np.diff(bounds)
                if end_id is not None:
                    flat = np.insert(flat, bounds[1:], np.uint32(end_id))
                    lengths = lengths + 1
                held.append((piece.column("doc_id").to_pylist(), lengths, flat))
                size += len(flat)
                if size >= tokens_per_shard:
                    yield flush()
                    held, made, size = [], made + 1, 0
        if held:
            yield flush()

    return written(docs.mapInArrow(shards, MANIFEST), "manifest")[0]


def with_starts(manifest: DataFrame) -> DataFrame:
    """The manifest with each shard's first position in the whole sequence.

    Two levels of running sums: over the partitions' totals (as many rows as partitions), then within
    each partition.
    """
    parts = manifest.groupBy("part").agg(F.sum("tokens").alias("n"))
    before = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    own = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.join(before, "part").withColumn("first", F.col("base") + F.coalesce(F.sum("tokens").over(own), F.lit(0))).drop("base")


def read_tokens(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32), and the ids if asked for, from the files that the manifest names."""
    spark = manifest.sparkSession
    ship(spark)
    fields = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from evidara.llm.wavelet import WaveletMatrix

        for batch in batches:
            for path, first in zip(batch.column("path").to_pylist(), batch.column("first").to_pylist(), strict=True):
                store, at = file_system(path)
                with store.open_input_stream(at) as f:
                    shard = WaveletMatrix(f.read())
                tokens = shard.tokens().astype("<u4")
                ids, lengths = shard.documents()
                ends = np.cumsum(lengths)
                begins = ends - lengths
                crc = [zlib.crc32(tokens[a:b]) for a, b in zip(begins, ends, strict=True)]
                cols = [pa.array(ids, pa.int64()), pa.array(first + begins, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.append(begins, len(tokens)), pa.int32()), pa.array(tokens, pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])

    return manifest.select("path", "first").repartition(n, "path").mapInArrow(documents, fields)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: every text of documents encoded, written as wavelet-matrix files and read back."""
    docs = table(spark, sf_dir, "documents")
    manifest = write_tokens(docs, new_path(spark, "tokens"), public_tokenizers.path(VOCABULARY))
    return read_tokens(with_starts(manifest))
