"""Toxicity: FTRL-proximal logistic regression over hashed words, word pairs, triples and skip-grams, and words' beginnings.

A document's features are the grams that it has, however often. Beginnings are there for words of one stem and many endings. Each coordinate has its own learning
rate; the L1 term leaves most weights at zero, so the model that goes to the tasks is small.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidara.llm import ngrams
from evidara.llm.labelled import remainder, sample
from evidara.llm.runtime import ship, table

SAMPLE = 12_000
BITS = 22
ORDERS = ((0,), (0, 1), (0, 2), (0, 1, 2))
#: Bytes of the beginnings of longer words that are features too.
BEGINNINGS = (5, 6, 7)
ALPHA, BETA, L1, L2, EPOCHS = 2.0, 1.0, 7.0, 0.01, 8
#: Grams of fewer learned documents than this are left out.
LEAST = 5
THRESHOLD = 0.7


_dense: list = [None, None]


@dataclass
class Model:
    """The weights that aren't zero, by ascending feature, and the intercept."""

    base: float
    feature: np.ndarray
    weight: np.ndarray
    bits: int = BITS

    def dense(self) -> np.ndarray:
        """The weight of every feature; filled once in a worker."""
        key = (self.bits, self.feature.tobytes(), self.weight.tobytes())
        if _dense[0] != key:
            out = np.zeros(1 << self.bits, dtype=np.float32)
            out[self.feature] = self.weight
            _dense[:] = [key, out]
        return _dense[1]


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(document, hashed feature) of all grams of lower-cased texts, repeats included."""
    parts = ngrams.grams(data, offsets, bits, ORDERS), ngrams.beginnings(data, offsets, bits, BEGINNINGS)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def fit(rows: list[np.ndarray], y: np.ndarray, bits: int = BITS) -> Model:
    """Weights from documents' distinct features, document by document; without both labels, the share of label 1 alone."""
    p = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(p / (1 - p)))
    if len(np.unique(y)) < 2:
        return Model(base, np.zeros(0, np.int64), np.zeros(0, np.float32), bits)
    count = np.zeros(1 << bits, dtype=np.int32)
    for r in rows:
        count[r] += 1
    feature = np.flatnonzero(count >= LEAST)
    place = np.full(1 << bits, -1, dtype=np.int32)
    place[feature] = np.arange(len(feature))
    rows = [(at := place[r])[at >= 0] for r in rows]
    z, n = np.zeros(len(feature)), np.zeros(len(feature))
    bias = np.array([base, 1.0])  # the intercept and its summed squares

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= L1, 0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            at = rows[i]
            own, seen = z[at], n[at]
            w = weights(own, seen)
            g = 1 / (1 + np.exp(-np.clip(bias[0] + w.sum(), -30, 30))) - y[i]
            z[at] = own + g - (np.sqrt(seen + g * g) - np.sqrt(seen)) / ALPHA * w
            n[at] = seen + g * g
            bias[1] += g * g
            bias[0] -= ALPHA * g / (BETA + np.sqrt(bias[1]))
    w = weights(z, n).astype(np.float32)
    return Model(float(bias[0]), feature[w != 0], w[w != 0], bits)


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> Model:
    """Fit to `toxic` of about `rows` labelled documents outside the held-out fold."""
    ship(docs.sparkSession)
    drawn = sample(docs, labels, "toxic", remainder(3) != 1, rows)

    def hashed(batches):
        for b in batches:
            at, label = 0, b.column("label")
            for data, offsets in ngrams.lowered(b.column("text")):
                n = len(offsets) - 1
                doc, found = ngrams.distinct(*features(data, offsets), BITS)
                bounds = np.searchsorted(doc, np.arange(n + 1))
                raw = [found[x:y].astype("<i4").tobytes() for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(raw, pa.binary()), label.slice(at, n)], names=["x", "label"])
                at += n

    def trained(batches):
        got = sorted((bytes(x), y) for b in batches for x, y in zip(b.column("x").to_pylist(), b.column("label").to_pylist(), strict=True))
        model = fit([np.frombuffer(x, "<i4") for x, _ in got], np.array([y for _, y in got], dtype=float))
        yield pa.RecordBatch.from_pydict({"base": [model.base], "feature": [model.feature.astype("<i8").tobytes()], "weight": [model.weight.astype("<f4").tobytes()]})

    # The sample is bounded: one task learns from it, in an order that doesn't depend on arrival.
    one = drawn.mapInArrow(hashed, "x binary, label int").repartition(1).mapInArrow(trained, "base double, feature binary, weight binary").head()
    if one is None:
        return fit([], np.zeros(0))
    return Model(one.base, np.frombuffer(one.feature, "<i8"), np.frombuffer(one.weight, "<f4"))


def score(model: Model) -> Column:
    """The toxicity of the column text, from 0 to 1.

    Null texts count as empty ones, which have a score too; very long ones are read whole, in one piece. Equal
    texts have equal scores, so repeated rows do. An empty table gives no rows; other columns aren't read.
    """

    @F.arrow_udf("double")
    def toxicity(text: pa.Array) -> pa.Array:
        weight = model.dense()
        out = [np.zeros(0)]
        for data, offsets in ngrams.lowered(text):
            doc, found = features(data, offsets, model.bits)
            heavy = np.flatnonzero(weight[found])
            doc, found = ngrams.distinct(doc[heavy], found[heavy], model.bits)
            odds = model.base + np.bincount(doc, weight[found], len(offsets) - 1)
            out.append(1 / (1 + np.exp(-np.clip(odds, -30, 30))))
        return pa.array(np.concatenate(out))

    return toxicity(F.col("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: the toxicity of all documents."""
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, table(spark, sf_dir, "labels"))
    held = F.coalesce(remainder(3) == 1, F.lit(False))
    scored = docs.select("doc_id", held.alias("held_out"), score(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier, learned from those of them that have labels, doesn't call toxic.

    Columns stay as they are, repeated rows stay or go together, and an empty table gives none.
    """
    model = learn(docs, labels)
    return docs.where(score(model) < THRESHOLD)
