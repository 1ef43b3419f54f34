"""Folds and bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(n: int) -> Column:
    """crc32(doc_id as text) mod n, which deals documents to folds."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, rows: int) -> DataFrame:
    """About `rows` labelled rows (text, label) to learn from, 5/4 of that at most.

    Labels are drawn by a hash of doc_id before any text is read; the drawn ones, a bounded table, are
    broadcast. Rows without id or label are left out, texts may be null. Of repeated labels of a document the
    larger counts, once; repeated documents each give a row. Extra columns take no part; empty tables give no rows.
    """
    known = labels.where(learn & F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))
    n = known.count()
    if n > rows:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) < int((1 << 30) * rows / n))
    # In the order of the hash, so that the same labels stay whatever the order of arrival.
    known = known.orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(rows + rows // 4)
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "label")
