"""Quality classifier: a generalised additive model with pairwise interactions over text statistics.

Boosting goes round the features; each step fits a tree of two levels to one feature's bins and adds
it to that feature's lookup table. The pairs with most left to gain get tables over two features'
coarse bins. A score is a sum of table entries.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidara.llm import kernels as K
from evidara.llm.labelled import remainder, sample
from evidara.llm.runtime import ship, table

SAMPLE = 20_000
BINS, COARSE = 32, 8
ROUNDS, PAIR_ROUNDS, PAIRS = 120, 60, 8
RATE, SMOOTH, LEAST = 0.15, 1.0, 4.0
THRESHOLD = 0.3

FEATURES = (
    "log_words", "word_bytes", "word_bytes_spread", "longest_word", "capitals", "symbols", "bangs", "bars", "digits", "stops", "commas",
    "line_feeds", "distinct_words", "distinct_triples", "same_as_before", "high_bytes",
)


def features(col: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text; null and empty texts have zeros."""
    batch = pa.RecordBatch.from_arrays([col], names=["text"])
    return np.concatenate([np.zeros((0, len(FEATURES)))] + [_features(*K.text_bytes(p.column(0))) for p in K.pieces(batch)])


def _lut(chars: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars.encode())] = True
    return out


_CAPITAL, _SMALL = _lut("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _lut("abcdefghijklmnopqrstuvwxyz")
_SYMBOL, _DIGIT = _lut("#*$%&<>@^~=+_{}[]\\/"), _lut("0123456789")
#: The class of each byte, for one count per document and class.
_KIND = np.zeros(256, dtype=np.int64)
for _k, _of in enumerate((_CAPITAL, _SMALL, _SYMBOL, _DIGIT, _lut("!"), _lut("|"), _lut(".?"), _lut(","), _lut("\n")), 1):
    _KIND[_of] = _k
_KIND[128:] = 10


def _features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    size = np.diff(offsets)
    kinds = np.bincount(np.repeat(np.arange(n) * 11, size) + _KIND[data], minlength=11 * n).reshape(n, 11).astype(float)
    starts, ends, bounds = K.words(data, offsets)
    doc, length = K.owner(bounds), ends - starts
    words = np.diff(bounds)
    least = np.maximum(words, 1)
    mean = K.per_document(length, bounds) / least
    spread = np.sqrt(np.maximum(K.per_document(length * length, bounds) / least - mean**2, 0))
    longest = np.zeros(n)
    np.maximum.at(longest, doc, length)
    own = K.span_hash(K.BYTE_CODE[data], starts, ends)
    same = np.zeros(len(own), dtype=bool)
    same[1:] = (own[1:] == own[:-1]) & (doc[1:] == doc[:-1])
    triple = K.mix(own[:-2] + own[1:-1] * np.uint64(0x9E3779B97F4A7C15) + own[2:] * np.uint64(0xC2B2AE3D27D4EB4F)) if len(own) > 2 else own[:0]
    whole = doc[:-2] == doc[2:] if len(own) > 2 else np.zeros(0, bool)
    letters = np.maximum(kinds[:, 1] + kinds[:, 2], 1)
    triples = np.maximum(np.bincount(doc[:-2][whole], minlength=n) if len(whole) else np.zeros(n), 1)
    out = (
        np.log1p(words), mean, spread, np.log1p(longest), kinds[:, 1] / letters, kinds[:, 3] / least, kinds[:, 5] / least, kinds[:, 6] / least,
        kinds[:, 4] / np.maximum(size, 1), kinds[:, 7] / least, kinds[:, 8] / least, kinds[:, 9] / least, distinct(doc, own, n) / least,
        distinct(doc[:-2][whole], triple[whole], n) / triples if len(whole) else np.zeros(n), K.per_document(same, bounds) / least, kinds[:, 10] / np.maximum(size, 1),
    )
    return np.stack(out, axis=1)


def distinct(doc: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """How many different hashes each of n documents has."""
    if not len(doc):
        return np.zeros(n)
    shift = np.uint64(64 - int(n).bit_length())
    keys = np.sort((doc.astype(np.uint64) << shift) | (hashes >> (np.uint64(64) - shift)))
    first = np.concatenate([[True], keys[1:] != keys[:-1]])
    return np.bincount((keys[first] >> shift).astype(np.int64), minlength=n).astype(float)


@dataclass
class Model:
    """Lookup tables: edges[j] bin feature j; tables[j] over its bins; pairs (a, b, table) over coarse bins."""

    base: float
    edges: list[np.ndarray]
    coarse: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, t in enumerate(self.tables):
            total += t[np.searchsorted(self.edges[j], x[:, j], "right")]
        for a, b, t in self.pairs:
            total += t[np.searchsorted(self.coarse[a], x[:, a], "right"), np.searchsorted(self.coarse[b], x[:, b], "right")]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x), -30, 30)))


def cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """The best place to cut bins with gradients g and weights h, and what it gains; place 0: no cut is allowed."""
    a, b = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(a):
        return 0.0, 0
    gain = a**2 / (b + SMOOTH) + (g.sum() - a) ** 2 / (h.sum() - b + SMOOTH) - g.sum() ** 2 / (h.sum() + SMOOTH)
    gain = np.where((b >= LEAST / 4) & (h.sum() - b >= LEAST / 4), gain, 0)
    k = int(np.argmax(gain))
    return float(gain[k]), k + 1 if gain[k] > 0 else 0


def leaf(g: np.ndarray, h: np.ndarray) -> float:
    return RATE * g.sum() / (h.sum() + SMOOTH)


def tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree of two levels over the bins of one feature, as a value for each bin."""
    out = np.zeros(len(g))
    _, k = cut(g, h)
    for a, b in ((0, k), (k, len(g))) if k else ((0, len(g)),):
        _, m = cut(g[a:b], h[a:b])
        for c, d in ((a, a + m), (a + m, b)) if m else ((a, b),):
            out[c:d] = leaf(g[c:d], h[c:d])
    return out


def pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The better of two trees over a grid that cut one axis, then each half along the other; and its gain."""
    best, out = 0.0, np.zeros(g.shape)
    for flip in (False, True):
        g2, h2 = (g.T, h.T) if flip else (g, h)
        gain, k = cut(g2.sum(1), h2.sum(1))
        if not k:
            continue
        own = np.zeros(g2.shape)
        for rows in (slice(0, k), slice(k, None)):
            more, m = cut(g2[rows].sum(0), h2[rows].sum(0))
            gain += more
            for cols in (slice(0, m), slice(m, None)) if m else (slice(None),):
                own[rows, cols] = leaf(g2[rows, cols], h2[rows, cols])
        if gain > best:
            best, out = gain, own.T if flip else own
    return best, out


def quantiles(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0)


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """The model of features x and labels y; without rows, or with one label only, it knows no more than their share."""
    d = x.shape[1]
    p = (y.sum() + 1) / (len(y) + 2)
    model = Model(float(np.log(p / (1 - p))), [quantiles(x[:, j], BINS) for j in range(d)], [quantiles(x[:, j], COARSE) for j in range(d)], [], [])
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    if len(np.unique(y)) < 2:
        return model
    bins = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.edges)]
    rough = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.coarse)]
    odds = np.full(len(y), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        q = 1 / (1 + np.exp(-odds))
        return y - q, q * (1 - q)

    for _ in range(ROUNDS):
        for j in range(d):
            g, h = slopes()
            n = len(model.tables[j])
            step = tree(np.bincount(bins[j], g, n), np.bincount(bins[j], h, n))
            model.tables[j] += step
            odds += step[bins[j]]

    def grid(a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shape = len(model.coarse[a]) + 1, len(model.coarse[b]) + 1
        at = rough[a] * shape[1] + rough[b]
        g, h = slopes()
        return at, np.bincount(at, g, shape[0] * shape[1]).reshape(shape), np.bincount(at, h, shape[0] * shape[1]).reshape(shape)

    gains = sorted(((pair_tree(*grid(a, b)[1:])[0], a, b) for a in range(d) for b in range(a)), reverse=True)
    model.pairs = [(a, b, np.zeros((len(model.coarse[a]) + 1, len(model.coarse[b]) + 1))) for gain, a, b in gains[:PAIRS] if gain > 0]
    for _ in range(PAIR_ROUNDS):
        for a, b, t in model.pairs:
            at, g, h = grid(a, b)
            step = pair_tree(g, h)[1]
            t += step
            odds += step.ravel()[at]
    return model


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> Model:
    """Fit to `quality` of about `rows` labelled documents outside the held-out fold."""
    ship(docs.sparkSession)
    drawn = sample(docs, labels, "quality", remainder(5) != 0, rows)

    def measured(batches):
        for b in batches:
            x = features(b.column("text"))
            yield pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64())), b.column("label")], names=["x", "label"])

    got = drawn.mapInArrow(measured, "x array<double>, label int").toPandas()
    x = np.array(got.x.tolist(), dtype=float).reshape(len(got), len(FEATURES))
    order = np.lexsort((*x.T, got.label))  # the model doesn't depend on the order of arrival
    return fit(x[order], got.label.to_numpy(float)[order])


def score(model: Model) -> Column:
    """The quality of the column text, from 0 to 1.

    Null texts count as empty ones, which have a score too; very long ones are read whole, in one piece. Equal
    texts have equal scores, so repeated rows do. An empty table gives no rows; other columns aren't read.
    """

    @F.arrow_udf("double")
    def quality(text: pa.Array) -> pa.Array:
        return pa.array(model.score(features(text)))

    return quality(F.col("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: the quality of all documents."""
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, table(spark, sf_dir, "labels"))
    held = F.coalesce(remainder(5) == 0, F.lit(False))
    scored = docs.select("doc_id", held.alias("held_out"), score(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier, learned from those of them that have labels, doesn't reject.

    Columns stay as they are, repeated rows stay or go together, and an empty table gives none.
    """
    model = learn(docs, labels)
    return docs.where(score(model) >= THRESHOLD)
