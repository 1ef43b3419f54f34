"""SimHash near-duplicates: fingerprints of word shingles, compared exactly in tiles.

Distinct fingerprints are dealt to tiles of one population count each. A tile meets the tiles whose
population count differs by at most the radius; numpy takes the exclusive-or and counts bits. Each
meeting returns a spanning forest of its links, never its pairs, and connected components join them.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidara.llm import kernels as K
from evidara.llm.graph import connected_components
from evidara.llm.pretokens import distinct
from evidara.llm.pretokens import gathered as spread
from evidara.llm.runtime import ship, table, unused, written
from evidara.llm.tiles import MOST_SENT, dealt, gathered, meetings

WIDTH = 4
RADIUS = 4
#: Rows of a fingerprint from which it is common.
HOT = 1_000
SEED = 42
#: The pipeline's stage: shingles of five words, fingerprints of 256 bits. Texts of Jaccard similarity 0.8 differ in DIFFER of
#: the bits or fewer (39 with a deviation of 6; the smallest texts in up to 48), texts of 0.6 in 59, texts with nothing in
#: common in 128. Fingerprints only say which texts are compared: links are texts whose sets of shingles have STAGE_SIMILARITY.
STAGE_WIDTH = 5
STAGE_WORDS = 4
STAGE_RADIUS = 72
STAGE_SIMILARITY = 0.8
DIFFER = 0.1515
#: Distinct fingerprints that share a band on average, if nothing is alike; the least bits of a band; and the chance that
#: two texts at the similarity share no band.
CROWD, LEAST_BITS, MISSED = 1 << 13, 8, 1e-3
SEED_BANDS = 20_240_602
#: Fingerprints of a tile; texts and shingles that a task compares.
TILE_PRINTS, TILE_ROWS, TILE_SHINGLES = 1 << 12, 1 << 9, 1 << 19


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of each shingle of the lower-cased words, repeats included; a shorter text is one shingle, an empty one none."""
    from xxhash import xxh64_intdigest

    found = text.lower().split()  # on bytes: A-Z, and white space 20 09-0D
    if not found:
        return np.zeros(0, dtype=np.uint64)
    line = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    n = max(1, len(found) - width + 1)
    starts = np.concatenate([[0], ends[: n - 1]]).tolist()
    stops = (ends[min(width, len(found)) - 1 :][:n] - 1).tolist()
    return np.fromiter((xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, n)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit k is 1 if it is set in over half the hashes; 0 for none. Unsigned."""
    if not len(hashes):
        return 0
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 15):
        some = hashes[at : at + (1 << 15)]
        total += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view(np.uint64)[0])


_ODD = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def hashed_shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the shingles of lower-cased words of texts that begin at offsets, and each text's first.

    As shingle_hashes has them, but for the hash: XXH64 of each different word, times odd numbers, summed and mixed.
    """
    from xxhash import xxh64_intdigest

    data = K.LOWER[data]
    starts, ends, bounds = K.words(data, offsets)
    flat, at = spread(data, starts, ends - starts, np.arange(len(starts)))
    which, found = distinct(flat, at[:-1])
    own = np.fromiter((xxh64_intdigest(w, SEED) for w in found), np.uint64, len(found))[which]
    words = np.diff(bounds)
    count = np.where(words >= width, words - width + 1, words > 0)
    first = np.concatenate([[0], np.cumsum(count)])
    doc = np.repeat(np.arange(len(words)), count)
    at = bounds[doc] + np.arange(int(first[-1])) - first[doc]  # a shingle's first word
    size = np.minimum(words, width)[doc]
    total = size.astype(np.uint64)
    for k in range(width):
        more = own[np.minimum(at + k, len(own) - 1)] * (_ODD[k % len(_ODD)] + np.uint64(k))
        total += np.where(k < size, more, np.uint64(0))
    return K.mix(total), first


def wide_prints(hashes: np.ndarray, bounds: np.ndarray, words: int) -> np.ndarray:
    """Fingerprints of 64 times words bits, a column for each text: a bit is 1 if it is set in over half of the text's hashes."""
    mixed = np.empty((len(hashes), words), dtype=np.uint64)
    for w in range(words):
        mixed[:, w] = hashes if w == 0 else K.mix(mixed[:, w - 1] + np.uint64(w))
    raw, out = mixed.view(np.uint8).reshape(len(hashes), 8 * words), np.zeros((words, len(bounds) - 1), dtype=np.uint64)
    for i in np.flatnonzero(np.diff(bounds)):
        total = np.zeros(64 * words, dtype=np.int64)
        for at in range(bounds[i], bounds[i + 1], 255):  # sums of so many bits fit a byte
            total += np.add.reduce(np.unpackbits(raw[at : min(at + 255, bounds[i + 1])], axis=1, bitorder="little"), axis=0, dtype=np.uint8)
        out[:, i] = np.packbits(2 * total > bounds[i + 1] - bounds[i], bitorder="little").view(np.uint64)
    return out


def fingerprints(docs: DataFrame, key: str = "doc_id", width: int = WIDTH) -> DataFrame:
    """Rows (key, fp): 64 bits as a signed long. A null text has no words."""
    ship(docs.sparkSession)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(shingle_hashes(t.as_py() or b"", width)) for t in batch.column("text").cast(pa.binary())], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=[key, "fp"])

    kept = docs.select(key, "text")
    return kept.mapInArrow(found, f"{key} {kept.schema[key].dataType.simpleString()}, fp long")


def print_names(words: int) -> list[str]:
    return ["fp", *[f"fp{w}" for w in range(2, words + 1)]]


def joined(parent: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The forest with links (u, v) added: every node points at the smallest of its component."""
    while len(u):
        a, b = parent[u], parent[v]
        apart = a != b
        if not apart.any():
            break
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
    return parent


def ones_of(prints: np.ndarray) -> np.ndarray:
    return np.bitwise_count(prints).sum(0, dtype=np.int64)


def meeting(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links (place, smallest place of its component) among two tiles of fingerprints, one row of words each; b's places follow a's.

    Rows meet in blocks by population count; blocks whose counts differ beyond the radius don't meet.
    """
    shift = 0 if same else a.shape[1]
    parent = np.arange(shift + b.shape[1])
    ones_a, ones_b = ones_of(a), ones_of(b)
    order_a, order_b = np.argsort(ones_a, kind="stable"), np.argsort(ones_b, kind="stable")
    a, b, ones_a, ones_b = a[:, order_a], b[:, order_b], ones_a[order_a], ones_b[order_b]
    step = max(16, (1 << 18) // max(1, b.shape[1]))
    for at in range(0, a.shape[1], step):
        block = a[:, at : at + step]
        first = at if same else int(np.searchsorted(ones_b, ones_a[at] - radius))
        last = int(np.searchsorted(ones_b, ones_a[min(at + step, a.shape[1]) - 1] + radius, "right"))
        apart = np.bitwise_count(block[0, :, None] ^ b[0, None, first:last])
        for w in range(1, min(3, len(a))):
            apart += np.bitwise_count(block[w, :, None] ^ b[w, None, first:last])
        i, j = np.nonzero(apart <= radius)
        if len(a) > 3:  # the few pairs that three words leave
            far = apart[i, j].astype(np.int64)
            for w in range(3, len(a)):
                far += np.bitwise_count(block[w, i] ^ b[w, first + j])
            i, j = i[far <= radius], j[far <= radius]
        parent = joined(parent, order_a[i + at], order_b[j + first] + shift)
    moved = np.flatnonzero(parent != np.arange(len(parent)))
    return moved, parent[moved]


def links(classes: DataFrame, node: str, prints: list[str], radius: int) -> DataFrame:
    """Links (a, b) among the nodes of distinct fingerprints whose closure joins all that differ in at most radius bits."""
    spark = classes.sparkSession
    ship(spark)
    ones = sum((F.bit_count(p).cast("int") for p in prints[1:]), F.bit_count(prints[0]).cast("int"))
    classes = classes.select(F.col(node).alias("node"), F.array(*prints).alias("print"), ones.alias("ones"))
    counts = {r.ones: r.n for r in classes.groupBy("ones").agg(F.count("*").alias("n")).collect()}  # a row for each number of bits
    if not counts:
        return spark.createDataFrame([], "a long, b long")
    # Tiles grow with the root of the corpus, so that meetings and what is sent to them grow alike.
    size = max(1024, 8 * math.isqrt(sum(counts.values())))
    tiles = {k: -(-n // size) for k, n in sorted(counts.items())}
    first, total = {}, 0
    for k in tiles:
        first[k], total = total, total + tiles[k]
    last = {k: max(first[m] + tiles[m] for m in tiles if m <= k + radius) - 1 for k in tiles}

    def by_ones(values: dict[int, int]) -> Column:
        return F.create_map(*[F.lit(x) for item in values.items() for x in item])[F.col("ones")]

    own = classes.withColumn("tile", (by_ones(first) + F.pmod(F.xxhash64("print"), by_ones(tiles))).cast("int"))
    own, _ = written(own.groupBy("tile", "ones").agg(F.collect_list(F.struct("node", "print")).alias("members")), "tiles")
    own = own.select("tile", "ones", F.col("members.node").alias("nodes"), F.flatten("members.print").alias("prints"))
    # Tile t meets the tiles from t to the last one with ones + radius; the sum's parity says which of two is at home.
    met = own.select("tile", F.explode(F.sequence(F.col("tile"), by_ones(last))).alias("other"))
    even = (F.col("tile") + F.col("other")) % 2 == 0
    pairs = met.select(F.when(even, F.col("tile")).otherwise(F.col("other")).alias("home"), F.when(even, F.col("other")).otherwise(F.col("tile")).alias("guest"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    guests = own.select(F.col("tile").alias("guest"), F.col("nodes").alias("nodes2"), F.col("prints").alias("prints2")).join(pairs, "guest")
    deal = guests.repartition(n, "home").join(own.select(F.col("tile").alias("home"), "nodes", "prints").repartition(n, "home"), "home")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                nodes, more, a, b = (batch.column(c)[row].values.to_numpy() for c in ("nodes", "nodes2", "prints", "prints2"))
                a, b = (x.view(np.uint64).reshape(-1, len(prints)).T.copy() for x in (a, b))
                same = batch.column("home")[row] == batch.column("guest")[row]
                u, v = meeting(a, b, radius, same)
                nodes = nodes if same else np.concatenate([nodes, more])
                yield pa.RecordBatch.from_arrays([pa.array(nodes[u]), pa.array(nodes[v])], names=["a", "b"])

    return deal.mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """Rows (key, fp, component_id): component_id is the smallest key that links of at most radius bits reach.

    Every row of docs (key, text) has one; null and empty texts have fingerprint 0, which links like any
    other. Rows with a null key take part; a component of null keys alone has a null id. An empty
    table gives no rows.
    """
    prints, _ = written(fingerprints(docs, key, width), "fingerprints")
    classes, _ = written(prints.groupBy("fp").agg(F.min(key).alias("least"), F.count("*").alias("copies")), "classes")
    component = connected_components(links(classes, "fp", ["fp"], radius)).withColumnRenamed("node", "fp")
    named, _ = written(classes.join(component, "fp", "left").withColumn("component", F.coalesce("component", "fp")), "named")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_print, _ = written(named.join(least, "component").select("fp", "component_id", "copies"), "components")
    # Rows of a very common fingerprint aren't moved: what is joined to them is sent, for at most MOST_SENT fingerprints.
    common = F.col("copies") > max(HOT, prints.count() // MOST_SENT)
    sent = by_print.where(common).select("fp", "component_id", F.lit(True).alias("common"))
    told = prints.join(F.broadcast(sent), "fp", "left")
    rest = told.where("common is null").select(key, "fp").join(by_print.where(~common).select("fp", "component_id"), "fp")
    return told.where("common").select(key, "fp", "component_id").union(rest.select(key, "fp", "component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: SimHash components of all documents."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def bands(n: int, words: int, differ: float = DIFFER) -> list[list[int]]:
    """Masks of the bits of each band, one for each word, so that n fingerprints leave CROWD in a band and MISSED holds.

    A pair at the similarity differs in a binomial number of bits; bands are drawn apart from each other.
    """
    size = 64 * words
    bits = max(LEAST_BITS, math.ceil(math.log2(max(1.0, n / CROWD))))
    chances = [math.comb(size, d) * differ**d * (1 - differ) ** (size - d) for d in range(size + 1)]
    meets = [math.comb(size - d, bits) / math.comb(size, bits) for d in range(size + 1)]
    count = 1
    while sum(c * (1 - m) ** count for c, m in zip(chances, meets, strict=True)) > MISSED:
        count += 1
    draw, out, left = np.random.default_rng(SEED_BANDS), [], np.zeros(0, dtype=int)
    for _ in range(count):
        if len(left) < bits:
            left = draw.permutation(size)  # every bit is drawn once before any is drawn again
        own, left = left[:bits], left[bits:]
        out.append([sum(1 << int(b % 64) for b in own if b // 64 == w) for w in range(words)])
    return out


def banded_links(classes: DataFrame, node: str, prints: list[str], radius: int) -> DataFrame:
    """Links (a, b) among the nodes of distinct fingerprints that share a band; their closure joins those that differ in at most radius bits.

    What is sent grows with the number of bands, which grows with the power 0.24 of the number of fingerprints. A
    crowded band meets in tiles, each meeting returns a spanning forest.
    """
    ship(classes.sparkSession)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    masks = bands(classes.count(), len(prints))
    keys = [F.xxhash64(F.lit(t), *[F.col(p).bitwiseAND(F.lit(signed(m)).cast("long")) for p, m in zip(prints, own, strict=True)]) for t, own in enumerate(masks)]
    rows = classes.select(F.col(node).alias("node"), *prints, F.explode(F.array(*keys)).alias("band"))
    groups = ["band", "a", "b"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in meetings(batches, groups):
            nodes, own = g.column("node").to_numpy(), g.column("own").to_numpy()
            held = np.stack([g.column(p).to_numpy().view(np.uint64) for p in prints])
            a, b = g.column("a")[0].as_py(), g.column("b")[0].as_py()
            if a == b:
                u, v = meeting(held, held, radius, True)
            else:
                order = np.argsort(own != a, kind="stable")
                nodes, held, cut = nodes[order], held[:, order], int((own == a).sum())
                u, v = meeting(held[:, :cut], held[:, cut:], radius, False)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(nodes[u]), pa.array(nodes[v])], names=["a", "b"])

    met = gathered(dealt(rows, rows.select("band"), ["band"], TILE_PRINTS), groups)
    return met.mapInArrow(compare, "a long, b long")


def alike(sets: list[np.ndarray], known: np.ndarray, similarity: float, tile: np.ndarray | None = None) -> np.ndarray:
    """For each set (distinct numbers) the smallest place of its component of links of at least the Jaccard similarity.

    Sets of one known label are joined from the start; tile: sets of one tile aren't compared. Empty sets link with none.
    """
    n = len(sets)
    size = np.array([len(x) for x in sets])
    ends = np.cumsum(size)
    starts = ends - size
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    marked = np.zeros(int(flat.max(initial=0)) + 1, dtype=bool)
    _, first_of, label = np.unique(known, return_index=True, return_inverse=True)
    label = first_of[label]
    for i in range(n - 1):
        if not size[i]:
            continue
        rest = size[i + 1 :]
        near = (np.minimum(rest, size[i]) / np.maximum(rest, size[i]) >= similarity) & (label[i + 1 :] != label[i])
        if tile is not None:
            near &= tile[i + 1 :] != tile[i]
        j = np.flatnonzero(near) + i + 1
        if not len(j):
            continue
        own = flat[starts[i] : ends[i]]
        marked[own] = True
        lengths = size[j]
        first = np.cumsum(lengths) - lengths
        places = np.arange(int(lengths.sum())) + np.repeat(starts[j] - first, lengths)
        both = np.add.reduceat(marked[flat[places]].astype(np.int64), first)
        marked[own] = False
        hit = j[both / (size[i] + lengths - both) >= similarity]
        if len(hit):
            groups = np.unique(label[[i, *hit]])
            label[np.isin(label, groups)] = groups[0]
    return label


def verified(members: DataFrame, width: int, similarity: float) -> DataFrame:
    """Rows (node, group) of members (node, component, text): group is one for the rows of a component that links of `similarity` join.

    A component is dealt to parts. Each part has the component's first row besides its own, and finds the groups among
    these; a group with the first row reaches over all parts. Then only what isn't in that group meets
    the other parts, in tiles: a component of copies of one text costs one comparison a row.
    """
    ship(members.sparkSession)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in K.pieces(batch):
                hashes, bounds = hashed_shingles(*K.text_bytes(some.column("text")), width)
                found = [np.unique(hashes[i:j]).view(np.int64) for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
                n = pa.array([len(x) for x in found], pa.int32())
                yield pa.RecordBatch.from_arrays([some.column("node"), some.column("component"), n, pa.array(found, pa.list_(pa.int64()))], names=["node", "component", "n", "set"])

    def read(g: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray]]:
        """Nodes in ascending order, and their sets."""
        nodes, found = g.column("node").to_numpy(), g.column("set")
        ends, flat = found.offsets.to_numpy(), found.values.to_numpy()
        order = np.argsort(nodes, kind="stable")
        return order, [flat[ends[i] : ends[i + 1]] for i in order]

    held, _ = written(members.select("node", "component", "text").mapInArrow(sets, "node long, component long, n int, set array<long>"), "sets")
    crowd = held.groupBy("component").agg(F.count("*").alias("rows"), F.sum(F.col("n").cast("long")).alias("shingles"), F.min("node").alias("leader"))
    parts = F.greatest(F.ceil(F.col("rows") / TILE_ROWS), F.ceil(F.col("shingles") / TILE_SHINGLES)).cast("int")
    crowd, _ = written(crowd.select("component", "leader", parts.alias("parts")), "crowds")
    large = crowd.where("parts > 1")
    # At most one component in TILE_ROWS rows or TILE_SHINGLES shingles has parts; the others have one.
    large = F.broadcast(large) if large.count() <= MOST_SENT else large
    spread = held.join(large, "component", "left")
    own = F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1))).cast("int")
    part = F.when(F.col("node") == F.col("leader"), F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).otherwise(F.array(own))
    spread = spread.select("component", F.explode(part).alias("part"), "node", "set")

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in meetings(batches, ["component", "part"]):
            order, found = read(g)
            nodes = g.column("node").to_numpy()[order]
            label = alike(found, np.arange(len(found)), similarity)
            yield pa.RecordBatch.from_arrays([pa.array(nodes), g.column("component").take(pa.array(order)), pa.array(nodes[label])], names=["node", "component", "label"])

    first, _ = written(gathered(spread, ["component", "part"]).mapInArrow(within, "node long, component long, label long").distinct(), "labels")
    # The rows outside the leader's group, in components of more than one part, meet all others of theirs.
    many = crowd.where("parts > 1").select("component", "leader")
    loose = first.join(F.broadcast(many) if many.count() <= MOST_SENT else many, "component").withColumn("loose", F.col("label") != F.col("leader"))
    sides = loose.groupBy("component").agg(F.count_if("loose").alias("loose_rows"), F.count_if(~F.col("loose")).alias("others")).where("loose_rows > 0")
    tiles = lambda c: F.ceil(F.col(c) / TILE_ROWS).cast("int")
    sides, _ = written(sides.select("component", tiles("loose_rows").alias("first_tiles"), tiles("others").alias("more_tiles")), "sides")
    if sides.count() == 0:
        return first.select("node", F.col("label").alias("group"))
    sent = F.broadcast(sides) if sides.count() <= MOST_SENT else sides
    asked = held.join(loose.select("node", "label", "loose"), "node").join(sent, "component")
    by = F.xxhash64("node", F.lit(5))
    tile = F.when(F.col("loose"), F.pmod(by, "first_tiles")).otherwise(F.col("first_tiles") + F.pmod(by, F.greatest("more_tiles", F.lit(1)))).cast("int")
    last = F.when(F.col("loose"), F.col("first_tiles") + F.col("more_tiles")).otherwise(F.col("first_tiles")) - 1
    asked = asked.withColumn("tile", tile).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    asked = asked.select("component", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "node", "label", "tile", "set")
    keys = ["component", "low", "high"]

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in meetings(batches, keys):
            order, found = read(g)
            known, tile = g.column("label").to_numpy()[order], g.column("tile").to_numpy()[order]
            same = g.column("low")[0] == g.column("high")[0]
            label = alike(found, known, similarity, None if same else tile)
            moved = np.flatnonzero(known[label] != known)
            yield pa.RecordBatch.from_arrays([pa.array(known[moved]), pa.array(known[label[moved]])], names=["a", "b"])

    more = connected_components(gathered(asked, keys).mapInArrow(across, "a long, b long")).withColumnRenamed("node", "label").withColumnRenamed("component", "whole")
    return first.join(more, "label", "left").select("node", F.coalesce("whole", "label").alias("group"))


def measured(docs: DataFrame, row: str, width: int, words: int) -> DataFrame:
    """Rows (node, id, none, same, fp, ...): the row's number and id, whether it has none, a digest of its lower-cased words, its fingerprint."""
    ship(docs.sparkSession)
    names = print_names(words)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in K.pieces(batch):
                same = [hashlib.blake2b(b" ".join((t.as_py() or b"").lower().split()), digest_size=16).digest() for t in some.column("text").cast(pa.binary())]
                prints = wide_prints(*hashed_shingles(*K.text_bytes(some.column("text")), width), words)
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in ("node", "id", "none")), pa.array(same, pa.binary()), *[pa.array(p.view(np.int64)) for p in prints]], names=["node", "id", "none", "same", *names])

    kept = docs.select(F.col(row).alias("node"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("id"), F.col("doc_id").isNull().alias("none"), "text")
    return kept.mapInArrow(found, "node long, id long, none boolean, same binary, " + ", ".join(f"{n} long" for n in names))


def one_of_each(docs: DataFrame, width: int = STAGE_WIDTH, words: int = STAGE_WORDS, radius: int = STAGE_RADIUS, similarity: float = STAGE_SIMILARITY) -> DataFrame:
    """The rows of docs without near copies: of each group the row of the smallest (doc_id, arrival) stays.

    Groups are the components of links among texts whose sets of lower-cased shingles have at least
    the Jaccard similarity. Components of fingerprints of `words` times 64 bits say which texts are compared: those that
    share a band and differ in at most radius bits. Rows of equal lower-cased words are one class, of which one
    row is compared. Null and empty texts are copies of each other; null ids come last. Columns stay
    as they are, whatever their names; an empty table gives none.
    """
    names = docs.columns
    row = unused(names, "_row")
    held, _ = written(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    prints = print_names(words)
    seen, _ = written(measured(held, row, width, words), "fingerprints")
    rank = F.struct("none", "id", "node")
    firsts = seen.groupBy("same").agg(F.min(F.struct(rank.alias("rank"), *prints)).alias("m"))
    firsts, _ = written(firsts.select(F.col("m.rank.node").alias("node"), F.col("m.rank").alias("rank"), *[F.col(f"m.{p}") for p in prints]), "firsts")
    # Texts of one fingerprint are compared whatever their bands.
    classes, _ = written(firsts.groupBy(*prints).agg(F.min("node").alias("least"), F.count("*").alias("n")), "classes")
    near = connected_components(banded_links(classes, "least", prints, radius)).withColumnRenamed("node", "least")
    crowds = classes.join(near, "least", "left").where("component is not null or n > 1").select(*prints, F.coalesce("component", "least").alias("component"))
    crowds, _ = written(firsts.join(crowds, prints).select("node", "component"), "crowds")
    members = held.select(F.col(row).alias("node"), "text").join(crowds, "node")
    group, _ = written(verified(members, width, similarity), "groups")
    of_class = firsts.join(group, "node", "left").withColumn("group", F.coalesce("group", "node"))
    kept = of_class.groupBy("group").agg(F.min("rank").alias("rank")).select(F.col("rank.node").alias(row))
    return held.join(kept, row, "left_semi").select(*[F.col(f"`{n}`") for n in names])
