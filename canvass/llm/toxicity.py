"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Each coordinate has its own learning rate, and the L1 term keeps only weights
that earn their place, so that the model is a short list of (slot, weight) pairs
of at most ``SLOTS`` and can be broadcast whatever the corpus holds.  The fit
uses a bounded sample of labelled rows: the ``MAX_FIT_ROWS`` ids with the smallest
hash, and of these in that order as many as have ``MAX_FIT_FEATURES`` features
together.  Ids are chosen before any text is read; the texts of the chosen ones
become features in a narrow map, and one task learns from them row by row, as the
method is sequential.  Scoring is one narrow map over all whole texts.

Words are runs of bytes other than ASCII punctuation and white space, A-Z in
lower case.  A document's features are the distinct slots of its words, its
pairs of neighbours and its pairs with one word between.

Defined results: a null or empty text gets the score of no feature; with no
labelled row every score is 0; ids labelled twice count as their largest label;
of several texts of one labelled id the fit takes the one whose features are the
least; repeated rows score alike; further columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canvass.llm import wordhash
from canvass.llm.storage import documents

MAX_FIT_ROWS, MAX_FIT_FEATURES, PASSES = 20_000, 40_000_000, 3
SLOTS = 1 << 20
#: L1 holds for a full sample and shrinks with smaller ones, down to L1_LEAST.
ALPHA, BETA, L1, L1_LEAST, L2 = 1.0, 1.0, 12.0, 1.0, 0.1
CUTOFF = 0.3

_U = np.uint64
_BREAKS = wordhash._SPACE.copy()
_BREAKS[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


def feature_slots(words: np.ndarray) -> np.ndarray:
    """Distinct slots of one text, given its word hashes."""
    with np.errstate(over="ignore"):
        parts = [words]
        if len(words) > 1:
            parts.append(wordhash.mix(words[:-1] * _U(3) + words[1:]))
        if len(words) > 2:
            parts.append(wordhash.mix(words[:-2] * _U(5) + words[2:] + _U(1)))
    return np.unique((np.concatenate(parts) >> _U(20)) & _U(SLOTS - 1)).astype(np.int64)


def _all_slots(texts: pa.Array) -> Iterator[np.ndarray]:
    for words in wordhash.hashed_texts(texts, fold=True, breaks=_BREAKS):
        yield feature_slots(words)


class Ftrl:
    """Per-coordinate FTRL-proximal with binary features; slot SLOTS is the intercept."""

    def __init__(self, rows: int) -> None:
        self.l1 = max(L1_LEAST, L1 * min(1.0, rows / MAX_FIT_ROWS))
        self.z = np.zeros(SLOTS + 1)
        self.n = np.zeros(SLOTS + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        l1 = np.where(at == SLOTS, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2))

    def learn(self, slots: np.ndarray, label: int) -> None:
        at = np.append(slots, SLOTS)
        w = self.weights(at)
        g = _sigmoid(w.sum()) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] += g * g


def _sigmoid(x: float | np.ndarray) -> float | np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _features(texts: pa.Array) -> pa.Array:
    found = [slots.astype(np.int32) for slots in _all_slots(texts)]
    at = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([np.empty(0, dtype=np.int32), *found])))


def train(seen: list[np.ndarray], labels: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Slots and weights that are not 0 after PASSES over the rows, each in an order of its own."""
    model = Ftrl(len(seen))
    for p in range(PASSES):
        for i in np.random.default_rng(p).permutation(len(seen)):
            model.learn(seen[i], labels[i])
    at = np.flatnonzero(model.z)
    w = model.weights(at)
    return at[w != 0], w[w != 0]


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, labels, left = [], [], MAX_FIT_FEATURES
    for batch in batches:
        for label, slots in zip(batch.column("label").to_pylist(), batch.column("slots"), strict=True):
            left -= len(slots)
            if left >= 0:
                seen.append(np.asarray(slots.values).astype(np.int64))
                labels.append(int(label))
        if left < 0:
            break
    slots, weights = train(seen, labels)
    yield pa.RecordBatch.from_arrays([pa.array(slots, type=pa.int64()), pa.array(weights, type=pa.float64())], names=["slot", "weight"])


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_FIT_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Slots and weights from texts (doc_id, text) and labels (doc_id, label)."""
    wanted = labels.where("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = (
        wanted.join(docs.select("doc_id"), "doc_id", "left_semi")
        .select("doc_id", "label", F.xxhash64("doc_id").alias("h"))
        .orderBy("h", "doc_id")
        .limit(max_rows)
    )
    rows = (
        docs.select("doc_id", "text")
        .join(F.broadcast(chosen), "doc_id")  # of max_rows rows at most
        .select("h", "doc_id", "label", _features(F.col("text").cast("binary")).alias("slots"))
        .groupBy("h", "doc_id", "label")
        .agg(F.min("slots").alias("slots"))
    )
    model = rows.repartition(1).sortWithinPartitions("h", "doc_id").mapInArrow(_learn, "slot long, weight double").orderBy("slot").collect()
    return np.array([r["slot"] for r in model], dtype=np.int64), np.array([r["weight"] for r in model])


def toxicity_score(spark: SparkSession, model: tuple[np.ndarray, np.ndarray], text: Column) -> Column:
    """Chance that the text is toxic under the model."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf(T.DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        slots, weights = shared.value
        if not len(slots):
            return pa.array(np.zeros(len(texts)))
        dense = np.zeros(SLOTS + 1, dtype=np.float64)
        dense[slots] = weights
        sums = np.array([dense[at].sum() for at in _all_slots(texts)])
        return pa.array(_sigmoid(sums + dense[SLOTS]), type=pa.float64())

    return score(text.cast("binary"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op10_toxicity_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").alias("label"))
    model = fit(docs, labels)
    scored = docs.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), toxicity_score(spark, model, F.col("text")).alias("score")
    )
    return scored.withColumn("predicted", (F.col("score") >= CUTOFF).cast("int"))
