"""Groups that may be large, met in tiles: every two rows of a group meet in some task, and no task holds more than two tiles."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidara.llm.runtime import written

#: More groups in tiles than this are joined by a shuffle, not sent to every task.
MOST_SENT = 100_000


def tile_size(least: int) -> Callable:
    """Tiles of a group of n: the root of n rows each, or least, so that rows sent and meetings grow alike."""
    return lambda n: F.ceil(n / F.greatest(F.lit(least), F.sqrt(n))).cast("int")


def dealt(rows: DataFrame, members: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Rows of groups over keys, each once for every meeting of two tiles of its group: columns own, a and b are added.

    A group of one tile meets itself. How many tiles a group has is counted first, over members:
    the same rows without what they carry. Rows have a column node.
    """
    large = members.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > least).select(*keys, tile_size(least)(F.col("n")).alias("tiles"))
    large, _ = written(large, "large")
    large = F.broadcast(large) if large.count() <= MOST_SENT else large
    tiles = F.coalesce("tiles", F.lit(1))
    rows = rows.join(large, keys, "left").withColumn("own", F.pmod(F.xxhash64("node", F.lit(3)), tiles).cast("int"))
    met = rows.withColumn("other", F.explode(F.sequence(F.lit(0), tiles - 1))).drop("tiles")
    return met.withColumns({"a": F.least("own", "other"), "b": F.greatest("own", "other")}).drop("other")


def gathered(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows dealt by keys and sorted by them, for meetings()."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, *keys).sortWithinPartitions(*keys)


def meetings(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The groups of batches that are sorted by keys, groups of one row left out."""
    rest: list[pa.RecordBatch] = []  # batches of the group that isn't over, or may not be
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows + 1, dtype=bool)
        new[0] = not rest or any(c[0] != rest[-1].column(k)[rest[-1].num_rows - 1].as_py() for k, c in zip(keys, cols, strict=True))
        new[-1] = True
        for c in cols:
            new[1:-1] |= c[1:] != c[:-1]
        bounds = np.flatnonzero(new)
        if bounds[0]:  # the group from before goes on
            rest.append(batch.slice(0, bounds[0]))
            if bounds[0] == batch.num_rows:
                continue
        whole = pa.concat_batches(rest) if rest else None
        if whole is not None and whole.num_rows > 1:
            yield whole
        for i in np.flatnonzero(np.diff(bounds[:-1]) > 1):
            yield batch.slice(bounds[i], bounds[i + 1] - bounds[i])
        rest = [batch.slice(bounds[-2])]
    if rest:
        whole = pa.concat_batches(rest)
        if whole.num_rows > 1:
            yield whole
