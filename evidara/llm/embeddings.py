"""Embedding near-duplicates by p-stable hashing: quantised random projections, then exact cosines.

Every distinct vector, made one long, is projected on random directions; floors of the shifted
projections, some of them together, name its bucket in each table. Vectors go to their buckets with a byte a
component, which is enough to rule out all pairs but those at the threshold or within a proven error of it;
buckets meet in tiles, where numpy returns a spanning forest of what is left. Exact vectors move once, to the
components of that forest: there all cosines are taken in double precision, for links and their numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidara.llm.graph import connected_components
from evidara.llm.kernels import mix
from evidara.llm.runtime import ship, table, written
from evidara.llm.simhash import joined
from evidara.llm.tiles import MOST_SENT, dealt, gathered, meetings

THRESHOLD = 0.9
#: The width of a projection's steps. Near the best for vectors of length one.
WIDTH = 2.5
#: The number of unrelated vectors that share a bucket on average, and the chance that two at the threshold meet. Products of
#: bytes are cheap beside rows that are sent: larger buckets need fewer tables.
CROWD, MET = 1_000, 0.999
SEED = 20_240_601
#: Rows of a tile of a bucket, and of a component.
TILE, TILE_EXACT = 1 << 11, 1 << 11
#: A vector with more copies than this, and than one in MOST_SENT of all rows, is joined by a broadcast: there are at most MOST_SENT.
HOT = 1_000


def share(distance: float) -> float:
    """The chance that a random projection puts two vectors this far apart in one step of WIDTH."""
    r = WIDTH / distance
    normal = 0.5 * (1 + math.erf(-r / math.sqrt(2)))
    return 1 - 2 * normal - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(n: int, threshold: float) -> tuple[int, int]:
    """Projections for a bucket, so that n unrelated (orthogonal) vectors leave CROWD in each; and tables, so that MET holds."""
    each = max(1, math.ceil(math.log(max(n / CROWD, 1.01)) / -math.log(share(math.sqrt(2)))))
    one = share(math.sqrt(max(2 - 2 * threshold, 1e-9))) ** each
    return each, max(1, math.ceil(math.log(1 - MET) / math.log(1 - one)))


def unit(raw: list[bytes], kind: str) -> np.ndarray:
    """Vectors of one dimension as rows of length one, in double precision."""
    x = np.frombuffer(b"".join(raw), dtype=kind).reshape(len(raw), -1).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def as_bytes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of length one as signed bytes, the scale of each, and the length of what rounding took from it."""
    scale = np.abs(x).max(axis=1, keepdims=True) / 127
    q = np.rint(x / scale)
    return q.astype(np.int8), scale[:, 0], np.sqrt(((x - q * scale) ** 2).sum(axis=1))


def links(x: np.ndarray, own: np.ndarray, a: int, b: int, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of linked vectors among two tiles, or within one if a is b; each link once, in pieces."""
    first, second = (np.arange(len(x)),) * 2 if a == b else (np.flatnonzero(own == a), np.flatnonzero(own == b))
    step = max(1, (1 << 22) // max(1, len(second)))
    for at in range(0, len(first), step):
        i, j = np.nonzero(x[first[at : at + step]] @ x[second].T >= threshold)
        i, j = first[at + i], second[j]
        yield (i[i < j], j[i < j]) if a == b else (i, j)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept) for vectors (vec_id, embedding).

    Links are pairs of rows of cosine >= threshold, taken in double precision. n_links counts the
    other rows linked directly (within what hashing has joined), component_id is
    the smallest vec_id reachable, kept marks its row. Null and zero vectors, and vectors that hold null or
    non-finite components, link with nothing, as do vectors of unlike dimensions. Equal vectors, told by
    96 bits of two hashes, are compared once. Repeated rows keep a row each; a null vec_id is no component's
    smallest unless it is alone. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    vectors = vectors.select("vec_id", "embedding")
    kind = "<f8" if vectors.schema["embedding"].dataType.elementType.typeName() == "double" else "<f4"
    vectors = vectors.withColumn("embedding", F.col("embedding").cast("array<double>" if kind == "<f8" else "array<float>"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    valid = F.coalesce(finite & F.exists("embedding", lambda v: v != 0), F.lit(False))
    same = ["h1", "h2", "dim"]
    hashes = [F.xxhash64("embedding").alias("h1"), F.hash("embedding").alias("h2"), F.size("embedding").alias("dim")]
    classes = vectors.where(valid).select("vec_id", "embedding", *hashes).groupBy(*same).agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
    classes, _ = written(classes.withColumn("node", F.monotonically_increasing_id()), "vectors")
    each, tables = plan(classes.count(), threshold)

    def hashed(full: bool):
        def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 1024):
                    batch = whole.slice(at, 1024)
                    node, col = batch.column("node").to_numpy(), batch.column("embedding")
                    values, ends = col.values.to_numpy().astype(kind), col.offsets.to_numpy()
                    for dim in np.unique(np.diff(ends)):
                        rows = np.flatnonzero(np.diff(ends) == dim)
                        x = unit([values[ends[r] : ends[r] + dim].tobytes() for r in rows], kind)
                        draw = np.random.default_rng([SEED, int(dim)])
                        steps = np.floor((x @ draw.standard_normal((dim, tables * each)) + draw.uniform(0, WIDTH, tables * each)) / WIDTH)
                        steps = steps.astype(np.int64).view(np.uint64).reshape(len(rows), tables, each)
                        key = np.zeros((len(rows), tables), dtype=np.uint64)
                        for k in range(each):
                            key = mix(key + steps[:, :, k])
                        out = {"tab": pa.array(np.tile(dim * tables + np.arange(tables), len(rows))), "key": pa.array(key.view(np.int64).ravel())}
                        if full:
                            q, scale, lost = as_bytes(x)
                            again = pa.array(np.repeat(np.arange(len(rows)), tables))
                            out["node"] = pa.array(node[rows]).take(again)
                            out["vec"] = pa.FixedSizeBinaryArray.from_buffers(pa.binary(int(dim)), len(rows), [None, pa.py_buffer(q.tobytes())]).cast(pa.binary()).take(again)
                            out |= {n: pa.array(v.astype(np.float32)).take(again) for n, v in (("scale", scale), ("lost", lost))}
                        yield pa.RecordBatch.from_pydict(out)

        return keys

    source = classes.select("node", "embedding")
    sizes = source.mapInArrow(hashed(False), "tab long, key long")
    rows = source.mapInArrow(hashed(True), "tab long, key long, node long, vec binary, scale float, lost float")
    keys = ["tab", "key", "a", "b"]
    met = gathered(dealt(rows, sizes, ["tab", "key"], TILE), keys)

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in meetings(batches, keys):
            node, own, lost = (g.column(c).to_numpy() for c in ("node", "own", "lost"))
            x = np.frombuffer(b"".join(g.column("vec").to_pylist()), np.int8).reshape(g.num_rows, -1) * g.column("scale").to_numpy()[:, None]
            # |xy - x'y'| <= |x - x'| + |x'| |y - y'|; the last term is for single precision.
            least = threshold - 2.1 * float(lost.max()) - 1e-4
            parent = np.arange(g.num_rows)
            for i, j in links(x, own, g.column("a")[0].as_py(), g.column("b")[0].as_py(), least):
                parent = joined(parent, i, j)
            moved = np.flatnonzero(parent != np.arange(len(parent)))
            if len(moved):
                yield pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[parent[moved]])], names=["a", "b"])

    component, _ = written(connected_components(met.mapInArrow(forest, "a long, b long")), "components")
    crowd = component.join(classes, "node").select("component", "node", "copies", "embedding")
    keys2 = ["component", "a", "b"]
    held = gathered(dealt(crowd, component.select("component"), ["component"], TILE_EXACT), keys2)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in meetings(batches, keys2):
            node, own, copies = (g.column(c).to_numpy() for c in ("node", "own", "copies"))
            x, total = unit([np.array(v, dtype=kind).tobytes() for v in g.column("embedding").to_pylist()], kind), np.zeros(g.num_rows, dtype=np.int64)
            parent = np.arange(g.num_rows)
            for i, j in links(x, own, g.column("a")[0].as_py(), g.column("b")[0].as_py(), threshold):
                total += np.bincount(i, copies[j], len(total)).astype(np.int64) + np.bincount(j, copies[i], len(total)).astype(np.int64)
                parent = joined(parent, i, j)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(total), pa.array(node[parent])], names=["node", "links", "parent"])

    found, _ = written(held.mapInArrow(counted, "node long, links long, parent long"), "links")
    total = found.groupBy("node").agg(F.sum("links").alias("links"))
    linked = connected_components(found.where("node <> parent"), "node", "parent").withColumnRenamed("component", "exact")
    known = classes.drop("embedding").join(linked, "node", "left").join(total, "node", "left").withColumn("exact", F.coalesce("exact", "node"))
    known, _ = written(known.select(*same, "least", "copies", "exact", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "known")
    least = known.groupBy("exact").agg(F.min("least").alias("component_id"))
    n = vectors.count()
    known, _ = written(known.join(least, "exact").select(*same, "copies", "n_links", "component_id"), "named")
    # Rows of a very common vector aren't moved: what is joined to them is sent, for at most MOST_SENT vectors.
    common = F.col("copies") > max(HOT, n // MOST_SENT)
    told = vectors.where(valid).select("vec_id", *hashes).join(F.broadcast(known.where(common).drop("copies")), same, "left")
    out = told.where("n_links is not null").select("vec_id", "n_links", "component_id")
    rest = told.where("n_links is null").select("vec_id", *same).join(known.where(~common), same).select("vec_id", "n_links", "component_id")
    alone = vectors.where(~valid).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(rest).unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: links and components of all embeddings."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
