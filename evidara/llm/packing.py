"""Best-fit packing of documents into sequences, by bin completion over the histogram of piece lengths.

Pieces of one length are alike to a packing, so the search runs on how many pieces there are of each
length: at most `capacity` numbers, whatever the corpus. It returns patterns (lengths that share a
sequence) and how often each is used; the pieces then find their places by their rank among the
pieces of their length, which tasks count as they encode.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidara.llm import kernels as K
from evidara.llm.runtime import ship, table, written

CAPACITY = 2048
END_ID = 0
VOCABULARY = "byte_bpe_50k.json"

#: The search: nodes, the ways of a node and the walks that look for them, bins whose pieces it goes over; dives before it, and how
#: values of lengths grow in them (faster than lengths, so that longer pieces go first). None of them drops a piece.
NODES, WIDTH, TRIES, TAIL, DIVES, GROWTH = 4_000, 6, 48, 200, 3, 1.02

Pattern = tuple[tuple[int, ...], int]


def lower_bound(counts: np.ndarray) -> int:
    """Bins that any packing needs (Martello and Toth's L2). counts[x]: pieces of length x; len(counts) - 1: the capacity."""
    c = len(counts) - 1
    sizes = np.arange(c + 1)
    n, s = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * sizes)])
    best = -(-int(s[-1]) // c)
    half = c // 2
    for k in range(half + 1):
        above = int(n[c + 1] - n[c - k + 1])  # longer than c - k
        middle, held = int(n[c - k + 1] - n[half + 1]), int(s[c - k + 1] - s[half + 1])
        small = int(s[half + 1] - s[k])
        best = max(best, above + middle + max(0, -(-(small - (middle * c - held)) // c)))
    return best


def best_fit(counts: np.ndarray) -> list[Pattern]:
    """Best-fit decreasing, equal pieces and equal bins at a time."""
    c = len(counts) - 1
    room: dict[int, list[list]] = {}  # free room: [lengths, bins]
    open_ = np.zeros(c + 1, dtype=bool)
    for size in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[size])
        while left and open_[size:].any():
            free = size + int(np.argmax(open_[size:]))  # the tightest room that takes it
            groups, open_[free] = room.pop(free), False
            for group in groups:
                each = free // size
                full, rest = divmod(min(left, group[1] * each), each)
                for bins, k in ((full, each), (1 if rest else 0, rest)):
                    if bins:
                        room.setdefault(free - k * size, []).append([group[0] + (size,) * k, bins])
                        open_[free - k * size] = free > k * size
                        left -= bins * k
                        group[1] -= bins
                if group[1]:
                    room.setdefault(free, []).append(group)
                    open_[free] = True
        if left:
            each = c // size
            full, rest = divmod(left, each)
            for bins, k in ((full, each), (1 if rest else 0, rest)):
                if bins:
                    room.setdefault(c - k * size, []).append([(size,) * k, bins])
                    open_[c - k * size] = c > k * size
    return [(tuple(g[0]), g[1]) for groups in room.values() for g in groups]


def dominates(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether the pieces of b can be dealt to the pieces of a without any of these running over."""

    def fits(rest: tuple[int, ...], room: tuple[int, ...]) -> bool:
        if not rest:
            return True
        return any(fits(rest[1:], room[:i] + (r - rest[0],) + room[i + 1 :]) for i, r in enumerate(room) if r >= rest[0] and r not in room[:i])

    return sum(b) <= sum(a) and len(b) <= 6 and len(a) <= 6 and fits(b, a)


def fillings(counts: np.ndarray, largest: int, most_waste: int, width: int | None = WIDTH, tries: int | None = TRIES) -> list[tuple[int, ...]]:
    """Undominated ways to fill the room beside one piece of the largest length, least waste first.

    Ways that waste more than most_waste are left out. Fillings of one and two pieces are all looked
    at; longer ones by a depth-first walk from the longest piece down. tries bounds the walk, width the ways
    returned; None: all of them.
    """
    c = len(counts) - 1
    room = c - largest
    have = counts.copy()
    have[largest] -= 1
    floor = np.maximum.accumulate(np.where(have > 0, np.arange(c + 1), 0))  # the longest piece of at most x, 0: none
    if floor[room] in (0, room):
        return [(int(floor[room]),)] if floor[room] else [()] * (room <= most_waste)
    found: set[tuple[int, ...]] = {(int(floor[room]),)}
    first = np.flatnonzero(have[: room + 1] > 0)[::-1]
    second = floor[np.minimum(room - first, first)]
    good = (second > 0) & ((second != first) | (have[first] > 1))
    total = np.where(good, first + second, 0)
    for i in np.argsort(-total, kind="stable")[:width]:
        if total[i]:
            found.add((int(first[i]), int(second[i])))
    if tries is None or total.max(initial=0) < room:
        stack: list[tuple[tuple[int, ...], int, int]] = [((), room, room)]
        seen = 0
        while stack and (tries is None or seen < tries):
            items, left, top = stack.pop()
            x = int(floor[min(left, top)])
            while x and items.count(x) >= have[x]:
                x = int(floor[x - 1])
            if not x:
                found.add(items)
                seen += 1
                if left == 0 and tries is not None:
                    break
                continue
            if x > 1 and floor[x - 1]:
                stack.append((items, left, x - 1))
            stack.append(((*items, x), left - x, x))
    ways = sorted((w for w in found if room - sum(w) <= most_waste), key=lambda w: (-sum(w), len(w), w))
    kept: list[tuple[int, ...]] = []
    for w in ways:
        if not any(dominates(k, w) for k in kept):
            kept.append(w)
            if width is not None and (len(kept) == width or sum(w) == room):
                break
    return kept


def worths(have: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int, np.ndarray]]]:
    """The greatest value of a filling of each exact length up to the capacity, and the steps that led to it."""
    c = len(have) - 1
    best, steps = np.full(c + 1, -np.inf), []
    best[0] = 0
    for size in np.flatnonzero(have)[::-1].tolist():
        left, k = min(int(have[size]), c // size), 1
        while left > 0:  # one, two, four, ... pieces at a time
            n = min(k, left)
            w = size * n
            now = best[: c + 1 - w] + value[size] * n
            better = now > best[w:] + 1e-9
            best[w:][better] = now[better]
            steps.append((size, n, w, better))
            left, k = left - n, 2 * k
    return best, steps


def worthiest(table: tuple[np.ndarray, list[tuple[int, int, int, np.ndarray]]], room: int) -> tuple[int, ...]:
    """The filling of at most room of the greatest value. Where values grow faster than lengths, no other filling dominates it."""
    best, steps = table
    at, out = int(np.argmax(best[: room + 1])), []
    for size, n, w, better in reversed(steps):
        if at >= w and better[at - w]:
            out += [size] * n
            at -= w
    return tuple(out[::-1])


def sums(have: np.ndarray) -> tuple[list[int], list[int]]:
    """Lengths from the longest, and for each the sums of pieces of it and of shorter ones, as bits of a number; and 1 at the end."""
    c = len(have) - 1
    sizes, reach, mask = np.flatnonzero(have)[::-1].tolist(), [1], (1 << c + 1) - 1
    for size in reversed(sizes):
        now, left, k = reach[-1], min(int(have[size]), c // size), 1
        while left > 0:
            n = min(k, left)
            now |= now << size * n & mask
            left, k = left - n, 2 * k
        reach.append(now)
    return sizes, reach[::-1]


def fullest(table: tuple[list[int], list[int]], have: np.ndarray, room: int) -> tuple[int, ...]:
    """The filling of least waste, of such the one of the longest pieces."""
    sizes, reach = table
    left, out = (reach[0] & (1 << room + 1) - 1).bit_length() - 1, []
    for i, size in enumerate(sizes):
        if not left:
            break
        n = min(int(have[size]), left // size)
        while n > 0 and not reach[i + 1] >> left - n * size & 1:
            n -= 1
        out += [size] * n
        left -= n * size
    return tuple(out) if not left else ()


def dive(counts: np.ndarray, value: np.ndarray | None = None) -> list[Pattern]:
    """Bins completed around the longest piece left with the worthiest filling, or without values the fullest, as many at once as the pieces allow.

    Pieces only become fewer, so a filling that is still there is still the best; tables are made anew when one isn't.
    """
    left, c, out = counts.copy(), len(counts) - 1, []

    def filled(room: int, table: tuple) -> tuple[int, ...]:
        return fullest(table, left, room) if value is None else worthiest(table, room)

    def tabled() -> tuple:
        return sums(left) if value is None else worths(left, value)

    table, fresh = tabled(), True
    while left.any():
        top = int(np.flatnonzero(left)[-1])
        pattern = (top, *filled(c - top, table))
        n = min(int(left[x]) // pattern.count(x) for x in set(pattern))
        if not n and fresh:  # the filling takes the only piece that the bin is built around
            left[top] -= 1
            pattern = (top, *filled(c - top, tabled()))
            left[top] += 1
            n = min(int(left[x]) // pattern.count(x) for x in set(pattern))
        elif len(pattern) == 1 and top < c and not fresh:
            n = 0  # nothing fits as the table has it
        if not n:
            table, fresh = tabled(), True
            continue
        for x in pattern:
            left[x] -= n
        fresh = False
        out.append((pattern, n))
    return out


def number(patterns: list[Pattern]) -> int:
    return sum(n for _, n in patterns)


def completed(counts: np.ndarray, bins: int, least: int, nodes: int | None) -> tuple[list[Pattern] | None, bool]:
    """(a packing of fewer than `bins` bins, if one is found; whether the search was ended by nothing but its bounds).

    Branch and bound: each node completes bins around the longest piece left, fillings of least waste
    first, with one filling for as many bins as the pieces allow, then half as many, down to one. A branch ends when
    its waste so far rules out fewer bins than the incumbent has. Without a limit of nodes a node completes one bin,
    by every undominated filling.
    """
    c, best, whole = len(counts) - 1, None, True
    total = int((counts * np.arange(c + 1)).sum())
    left = counts.copy()
    used = waste = 0
    frames: list[list] = []  # per node: the steps still to try, best last, and the one that holds now

    def descend() -> None:
        spare = (bins - 1) * c - total - waste  # more waste than this can't beat the incumbent
        steps = []
        top = int(np.flatnonzero(left)[-1])
        for w in fillings(left, top, spare, *((None, None) if nodes is None else (WIDTH, TRIES))) if spare >= 0 else []:
            pattern = (top, *w)
            n = min(int(left[x]) // pattern.count(x) for x in set(pattern))
            lost = c - sum(pattern)
            n = max(1, min(n, spare // lost)) if lost else n
            while n > 1 and nodes is not None:
                steps.append((pattern, n))
                n //= 2
            steps.append((pattern, 1))
        frames.append([steps[::-1], None])

    if left.any():
        descend()
    while frames and bins > least:
        if nodes is not None and nodes <= 0:
            whole = False
            break
        frame = frames[-1]
        if frame[1]:
            pattern, n = frame[1]
            for x in pattern:
                left[x] += n
            used, waste, frame[1] = used - n, waste - n * (c - sum(pattern)), None
        if not frame[0]:
            frames.pop()
            continue
        pattern, n = frame[0].pop()
        lost = n * (c - sum(pattern))
        if waste + lost > (bins - 1) * c - total:
            continue
        for x in pattern:
            left[x] -= n
        used, waste, frame[1] = used + n, waste + lost, (pattern, n)
        if left.any():
            nodes = nodes if nodes is None else nodes - 1
            descend()
        elif used < bins:
            best, bins = [f[1] for f in frames], used
    return best, whole


@dataclass(frozen=True)
class Packing:
    """Patterns and how often each is used, the bins that no packing can do without, and whether no packing has fewer bins than this one."""

    patterns: list[Pattern]
    least: int
    proved: bool


def solve(counts: np.ndarray, nodes: int | None = NODES, dives: int = DIVES) -> Packing:
    """A packing of exactly the pieces that counts has (counts[x]: of length x), in as few bins as are found.

    Incumbents: best-fit decreasing, then dives of bin completion, whose values of lengths are corrected by what
    the bins of a length waste. Branch and bound then goes over the pieces of the last TAIL bins of the incumbent,
    the fuller ones before them being left, and ends at the lower bound or after `nodes` nodes. nodes=None:
    over all pieces, without limits, until nothing better can exist.
    """
    counts = np.asarray(counts, dtype=np.int64)
    sizes = np.arange(len(counts))
    least, best = lower_bound(counts), best_fit(counts)
    value = sizes**GROWTH
    for k in range(dives + 1 if dives else 0):  # the first without values, which is quick
        if number(best) <= least:
            break
        found = dive(counts, value if k else None)
        if number(found) < number(best):
            best = found
        if not k:
            continue
        worth, seen = np.zeros(len(counts)), np.zeros(len(counts))
        for pattern, n in found:
            for x in pattern:
                worth[x] += n * ((len(counts) - 1) / sum(pattern)) ** 1.3 * x**GROWTH
                seen[x] += n
        value = np.where(seen > 0, (value + worth / np.maximum(seen, 1)) / 2, value)
    body: list[Pattern] = []
    tail = [(p, n) for p, n in best]
    if nodes is not None:
        tail.sort(key=lambda t: (len(counts) - 1 - sum(t[0]), t[0]))  # the fullest first
        while tail and number(tail) - tail[0][1] >= TAIL:
            body.append(tail.pop(0))
        if tail and number(tail) > TAIL:
            pattern, n = tail.pop(0)
            rest = TAIL - number(tail)
            body.append((pattern, n - rest))
            tail.insert(0, (pattern, rest))
    proved = number(best) <= least
    if not proved and tail:
        own = np.zeros_like(counts)
        for pattern, n in tail:
            for x in pattern:
                own[x] += n
        found, whole = completed(own, number(tail), max(lower_bound(own), least - number(body)), nodes)
        best = body + (found or tail)
        proved = number(best) <= least or (nodes is None and whole)
    return Packing([(p, n) for p, n in best if n], least, proved)


def pack(counts: np.ndarray, nodes: int | None = NODES) -> list[Pattern]:
    return solve(counts, nodes).patterns


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, part, place) and ids if asked for; place: earlier pieces of this length in the part."""
    ship(docs.sparkSession)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "place"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from evidara.llm.pretokens import encoder

        encode, part = encoder(tokenizer), TaskContext.get().partitionId()
        met = np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            for some in K.pieces(batch):
                flat, bounds = encode(*K.text_bytes(some.column("text")))
                flat = np.insert(flat, bounds[1:], np.uint32(end_id)).astype("<u4")
                sizes = np.diff(bounds) + 1
                base = np.cumsum(sizes) - sizes
                number = -(-sizes // capacity)
                row = np.repeat(np.arange(len(sizes)), number)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
                head = (sizes - 1) % capacity + 1  # the first piece is the shorter one
                start = np.where(piece == 0, 0, head[row] + (piece - 1) * capacity)
                length = np.where(piece == 0, head[row], capacity)
                order = np.argsort(length, kind="stable")
                ranked = length[order]
                place = np.empty(len(row), dtype=np.int64)
                place[order] = met[ranked] + np.arange(len(row)) - np.searchsorted(ranked, ranked)
                met += np.bincount(length, minlength=capacity + 1)
                at = base[row] + start
                crc = [zlib.crc32(flat[a : a + n]) for a, n in zip(at, length, strict=True)]
                cols = [some.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(np.full(len(row), part), pa.int32()), pa.array(place, pa.int64())]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(flat)), pa.int32()), pa.array(flat, pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names=names + ["ids"] * with_ids)

    fields = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, fields)


def packed(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, nodes: int | None = NODES) -> DataFrame:
    """Pack docs (doc_id, text) into sequences of at most capacity ids, each document's ids closed by end_id.

    Rows (doc_id, piece, start, length, ids_crc32, sequence_id, offset, n_sequences, least_sequences), and the piece's ids if asked
    for; least_sequences: what no packing can do without. nodes: see solve(). A document longer than a sequence is cut into full pieces behind a first, shorter one.
    Null and empty texts are end_id alone; repeated rows are packed each; an empty table gives none.
    """
    cut, _ = written(pieces(docs, tokenizer, capacity, end_id, with_ids), "pieces")
    groups, _ = written(cut.groupBy("length", "part").count(), "lengths")
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for size, n in groups.groupBy("length").agg(F.sum("count")).collect():  # at most capacity rows
        counts[size] = n
    met = np.zeros(capacity + 1, dtype=np.int64)
    spans: list[tuple[int, int, int, int]] = []  # length, its first rank, first sequence, offset
    sequence = 0
    found = solve(counts, nodes)
    for pattern, n in found.patterns:
        at = 0
        for x in pattern:
            spans.append((x, int(met[x]), sequence, at))
            met[x] += n
            at += x
        sequence += n
    spans.sort()
    key = np.array([(x << 44) + r for x, r, _, _ in spans], dtype=np.int64)
    first, offset = np.array([s[2] for s in spans], dtype=np.int64), np.array([s[3] for s in spans], dtype=np.int64)

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = groups.select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    # One row a part, with what comes before it of each length.
    known = base.groupBy("part").agg(F.collect_list(F.struct("length", "base")).alias("known"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                held = some.column("known")
                row, flat = np.repeat(np.arange(some.num_rows), held.value_lengths().to_numpy()), held.flatten()
                all_ = np.zeros((some.num_rows, capacity + 1), dtype=np.int64)
                all_[row, flat.field("length").to_numpy()] = flat.field("base").to_numpy()
                ends = pa.array(np.arange(some.num_rows + 1) * (capacity + 1), pa.int32())
                yield pa.RecordBatch.from_arrays([some.column("part"), pa.ListArray.from_arrays(ends, pa.array(all_.ravel()))], names=["part", "bases"])

    bases, _ = written(known.mapInArrow(spread, "part int, bases array<long>"), "bases")
    ranked = cut.join(bases, "part").withColumn("place", F.col("place") + F.get("bases", F.col("length").cast("int")))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            want = (b.column("length").to_numpy() << 44) + b.column("place").to_numpy()
            at = np.searchsorted(key, want, "right") - 1
            cols = {n: b.column(n) for n in b.schema.names if n != "place"}
            cols |= {"sequence_id": pa.array(first[at] + want - key[at]), "offset": pa.array(offset[at])}
            yield pa.RecordBatch.from_pydict(cols)

    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    fields = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids + ", sequence_id long, offset long"
    out = ranked.select(*names, "place").mapInArrow(placed, fields)
    return out.withColumns({"n_sequences": F.lit(sequence).cast("long"), "least_sequences": F.lit(found.least).cast("long")})


def sequences(rows: DataFrame) -> DataFrame:
    """The sequences of packed(with_ids=True): rows (sequence_id, ids, doc_ids); a group holds one sequence."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return rows.groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: all documents packed into sequences of at most 2048 ids."""
    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
