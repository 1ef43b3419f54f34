"""Folds over the ordered rows of each key: a state is carried from row to row.

Rows are dealt by key and sorted, and read as a stream of Arrow batches: a task holds one state and one batch, however
many rows a key has. The rows of one key stay in one task, as each depends on the one before it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType


def folded(rows: DataFrame, keys: list[str], order: list[Column], reads: list[str], start: Callable, step: Callable, adds: str) -> DataFrame:
    """rows with the columns that adds declares (DDL): step(state, *reads) -> (state, values) for each row of a key in order.

    start(*reads) gives a key's state before its first row. Both functions have to be defined inside another one, so that
    they are sent to the tasks by value. The order should be total, or results vary.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    added = StructType.fromDDL(adds)
    names, kinds = [f.name for f in added], [to_arrow_type(f.dataType) for f in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            out: list[tuple] = []
            for key, row in zip(zip(*[batch.column(k).to_pylist() for k in keys], strict=True), zip(*[batch.column(c).to_pylist() for c in reads], strict=True), strict=True):
                if last is None or key != last:
                    last, state = key, start(*row)
                state, made = step(state, *row)
                out.append(made)
            more = [pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *names])

    # By a hash of the keys: Spark drops a deal by the same columns as a join's before it, and may read that join's shuffle by its
    # writers, once it has turned to a broadcast; a key would be in several tasks.
    dealt = rows.repartition(n, F.xxhash64(*keys)).sortWithinPartitions(*[F.col(k) for k in keys], *order)
    return dealt.mapInArrow(run, StructType([*rows.schema.fields, *added.fields]))


def ordered_changes(old: DataFrame, changes: DataFrame, key: str, order: list[Column], version: str = "version", expected: str = "expected", create: bool = False) -> DataFrame:
    """changes with outcome (accepted, conflict or unknown) and new_version: optimistic changes, applied one after the other.

    A change that expects nothing (null or 0), or the version that its key has when its turn comes, is accepted and makes the next
    version; another one is a conflict and changes nothing. A key that old hasn't is unknown, or with create begins at
    version 1 with its first change. new_version is the key's version after the change, null while it is unknown.
    """

    def start(has: int | None, _: int | None) -> int | None:
        return has

    def step(state: int | None, _: int | None, wanted: int | None) -> tuple[int | None, tuple[str, int | None]]:
        if state is None:
            return (1, ("accepted", 1)) if create else (None, ("unknown", None))
        if not wanted or wanted == state:
            return state + 1, ("accepted", state + 1)
        return state, ("conflict", state)

    has = old.select(key, F.col(version).cast("long").alias("_has"))
    met = changes.join(has, key, "left").withColumn("_wanted", F.col(expected).cast("long"))
    return folded(met, [key], order, ["_has", "_wanted"], start, step, "outcome string, new_version long").drop("_has", "_wanted")


def after_changes(old: DataFrame, judged: DataFrame, key: str, order: Column, fields: list[str], version: str = "version") -> DataFrame:
    """old after the accepted changes of judged (from ordered_changes): the last value that each field was given, and the last version. Keys that were created are there."""
    last = [F.max_by(F.col(f), F.when(F.col(f).isNotNull(), order)).alias(f"_{f}") for f in fields]
    new = judged.where("outcome = 'accepted'").groupBy(key).agg(F.max("new_version").alias("_version"), *last)
    out = old.join(new, key, "full")
    kept = {f: F.coalesce(f"_{f}", f) for f in fields} | {version: F.coalesce(F.col("_version"), F.col(version).cast("long"))}
    return out.select(*[kept.get(c, F.col(c)).alias(c) for c in old.columns])


def first_event_windows(events: DataFrame, key: str, at: str, width_seconds: int, most: int, tie: str) -> DataFrame:
    """events with window_start, number and allowed: a key's window opens at its first event and takes all within its width; the next event after it opens another.

    number counts a window's events from 1; those above `most` aren't allowed. tie orders events of one time. Events without a
    time are left out.
    """
    width = width_seconds * 1_000_000

    def start(_: int) -> tuple[int | None, int]:
        return None, 0

    def step(state: tuple[int | None, int], now: int) -> tuple[tuple[int, int], tuple[int, int, bool]]:
        begin, n = state
        if begin is None or now >= begin + width:
            begin, n = now, 0
        return (begin, n + 1), (begin, n + 1, n < most)

    timed = events.where(F.col(at).isNotNull()).withColumn("_at", F.unix_micros(F.col(at).cast("timestamp")))
    out = folded(timed, [key], [F.col("_at").asc(), F.col(tie).asc()], ["_at"], start, step, "window_start long, number long, allowed boolean")
    return out.withColumn("window_start", F.timestamp_micros("window_start")).drop("_at")
