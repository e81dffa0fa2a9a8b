"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the presence of words, pairs of neighbours and pairs with one word between, hashed to 2**20
coordinates; words are runs of letters and digits (any byte beyond ASCII counts as a letter), A-Z lower-cased.
Each coordinate has its own learning rate, and the L1 term keeps most weights at zero, so the model is a short
list of (coordinate, weight) pairs, 12 MB at the very most, broadcast to score every whole text.

The model is fitted in one task, on the labelled rows with the smallest hash of doc_id: at most TRAIN_ROWS rows
and, where texts are long, at most TRAIN_FEATURES features (whole texts; the row that would pass the bound and all
after it are left out). Features are made where the texts are read; only they, not texts, go to that task.
Defined cases: null text counts as empty; labels that are null, or whose doc_id isn't among the documents, are
left out; a doc_id with several labels or texts gives a row for each pair, within the bounds; rows that tie in the
hash are learnt in the order of doc_id, label and features; without a labelled row every score is 0.0; an empty
table gives none; other columns of docs, of whatever names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import mixed, ship, table, word_hashes

DIMENSION_BITS = 20
#: Bound of the labelled rows that are fitted.
TRAIN_ROWS = 20_000
#: Bound of their features, 4 bytes each: 160 MB.
TRAIN_FEATURES = 40_000_000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 4.0, 0.1
FOLDS = 5

#: ASCII that is no letter or digit becomes a space.
_LETTERS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_PAIR, _SKIP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def features(text: str | None) -> np.ndarray:
    """Sorted distinct coordinates."""
    h = word_hashes((text or "").encode().lower().translate(_LETTERS))
    all_of = np.concatenate([mixed(h), mixed(h[:-1] * _PAIR + h[1:]), mixed(h[:-2] * _SKIP + h[2:])])
    return np.unique(all_of >> np.uint64(64 - DIMENSION_BITS)).astype(np.int32)


class Ftrl:
    """Per-coordinate FTRL-proximal for the logistic loss; the last coordinate is the intercept."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    def learn(self, at: np.ndarray, y: int) -> None:
        at = np.append(at, len(self.z) - 1)
        w = self.weights(at)
        g = probability(w.sum()) - y
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] += g * g


def probability(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -35, 35))))


def trained(rows: list[tuple[np.ndarray, int]]) -> Ftrl:
    """rows: (coordinates, label), in the order of learning."""
    model = Ftrl(1 << DIMENSION_BITS)
    for _ in range(EPOCHS):
        for at, y in rows:
            model.learn(at, y)
    return model


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [features(t).tobytes() for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("h"), b.column("_id"), b.column("y"), pa.array(found, pa.binary())], names=["h", "_id", "y", "at"])


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in the order of learning."""
    rows, n = [], 0
    for b in batches:
        for at, y in zip(b.column("at").to_pylist(), b.column("y").to_pylist()):
            n += len(at) // 4
            if n <= TRAIN_FEATURES and len(rows) < TRAIN_ROWS:
                rows.append((np.frombuffer(at, np.int32), y))
    if rows:
        model = trained(rows)
        w = model.weights(np.arange(len(model.z)))
        at = np.union1d(np.flatnonzero(w), [len(w) - 1])
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(w[at])], names=["at", "weight"])


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(FOLDS))


def fitted(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> pd.DataFrame:
    """(at, weight) of the coordinates that are not zero; learnt only outside fold 0."""
    ship(docs.sparkSession)
    usable = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0))
    some = usable.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("y"), F.xxhash64("doc_id").alias("h")).orderBy("h", "_id", "y").limit(TRAIN_ROWS)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(some), F.col("doc_id") == F.col("_id")).select("h", F.col("_id").cast("string"), "y", "text")
    rows = rows.mapInArrow(_features, "h long, _id string, y int, at binary")
    return rows.repartition(1).sortWithinPartitions("h", "_id", "y", "at").mapInArrow(_fit, "at long, weight double").toPandas()


def scored(docs: DataFrame, model: pd.DataFrame) -> DataFrame:
    """(doc_id, score) for each row of docs (doc_id, text)."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((model["at"].to_numpy(np.int64), model["weight"].to_numpy(np.float64)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, weight = sent.value
        dense = np.zeros((1 << DIMENSION_BITS) + 1)
        dense[at] = weight
        for batch in batches:
            found = [probability(dense[features(t)].sum() + dense[-1]) if len(at) else 0.0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(score, "doc_id long, score double")


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that score below 0.5."""
    model = fitted(docs, labels)
    sent = docs.sparkSession.sparkContext.broadcast((model["at"].to_numpy(np.int64), model["weight"].to_numpy(np.float64)))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, weight = sent.value
        dense = np.zeros((1 << DIMENSION_BITS) + 1)
        dense[at] = weight
        for batch in batches:
            keep = [not len(at) or probability(dense[features(t)].sum() + dense[-1]) < 0.5 for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = scored(docs, fitted(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out")
    return out.select("doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
