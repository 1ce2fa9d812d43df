"""Quality classifier: logistic regression on hashed word n-grams, trained with FTRL-proximal updates."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgraph.llm.common import crc_fold, slices

BITS = 18  # 2^18 weights, one megabyte: what every scoring task gets
TRAIN_DOCS = 4000  # labelled documents the model is fitted on, at most; chosen by a hash of the id
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.1
SCALE = 8.0  # a text's features sum to this, whatever its length
KEEP = 0.3
CHUNK_BYTES = 8 << 20
SEED = 7

#: A word is a run of letters, of digits, or of other characters that are no white space.
WORD = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
REPEATED = (1 << BITS) - 1  # the feature of all pairs of equal words


class _Hashes(dict):
    """Hashes of words, kept up to a bounded number of them."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        return value


def features(text: str | None, hashes: _Hashes) -> np.ndarray:
    """Hashed features of the words and of the pairs of words of a text, with repeats."""
    one = np.array([hashes[w] for w in WORD.findall(text or "")], np.uint64)
    pairs = (one[:-1] * np.uint64(0x9E3779B1) + one[1:] * np.uint64(0x85EBCA77)) >> np.uint64(20)
    space = np.uint64(REPEATED)
    two = np.where(one[:-1] == one[1:], space, pairs % space)
    return np.concatenate([one * np.uint64(0x9E3779B1) % space, two]).astype(np.int64)


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, own: np.ndarray) -> float:
        total = self.bias + (SCALE * float(self.weights[own].mean()) if len(own) else 0.0)
        return float(1 / (1 + np.exp(-np.clip(total, -35, 35))))


def train(examples: list[tuple[np.ndarray, int]], epochs: int = EPOCHS) -> Model:
    """Follow the regularised leader: a weight is what minimises all gradients so far, with L1 and L2 penalties.

    Only weights of features that occur are touched; those under the L1 bound are exactly zero. The last weight is the bias.
    """
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    rng = np.random.default_rng(SEED)
    sparse = []
    for own, label in examples:
        at, count = np.unique(own, return_counts=True)
        sparse.append((np.append(at, size), np.append(SCALE * count / max(1, len(own)), 1.0), label))

    def weight(at):
        small = np.abs(z[at]) <= L1
        small[at == size] = False
        return np.where(small, 0.0, -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(epochs):
        for k in rng.permutation(len(sparse)):
            at, value, label = sparse[k]
            w = weight(at)
            p = 1 / (1 + np.exp(-np.clip(w @ value, -35, 35)))
            g = (p - label) * value
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - step * w
            n[at] += g * g
    w = weight(np.arange(size + 1))
    return Model(w[:-1].astype("f4"), float(w[-1]))


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> Model:
    """A model of at most ``most`` documents (doc_id, text) that ``labels`` (doc_id, label) marks 0 or 1.

    The chosen labels are a bounded table, so they go to the documents and no text is shuffled. One task fits the model
    on the features of these documents; only its weights come to the driver.
    """
    usable = labels.filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("label").alias("label"))
    total = usable.count()
    lucky = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1_000_003)) < F.lit(1_000_003 * min(1.0, most / max(1, total)))
    chosen = usable.filter(lucky).limit(most + most // 4)

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in slices(batches, "text", CHUNK_BYTES):
            own = [features(t, hashes).astype("<i4").tobytes() for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), batch.column("label"), pa.array(own, pa.binary())], names=["doc_id", "label", "own"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(
            (d, x, own) for b in batches for d, x, own in zip(*(b.column(c).to_pylist() for c in ("doc_id", "label", "own")), strict=True)
        )
        model = train([(np.frombuffer(own, "<i4"), x) for _, x, own in rows])
        at = np.flatnonzero(model.weights)
        yield pa.record_batch(
            [pa.array([at.astype("<i4").tobytes()]), pa.array([model.weights[at].tobytes()]), pa.array([model.bias])],
            names=["at", "w", "bias"],
        )

    rows = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")
    made = rows.mapInArrow(featurise, "doc_id long, label int, own binary").repartition(1).mapInArrow(
        learn, "at binary, w binary, bias double"
    )
    weights, bias = np.zeros(1 << BITS, "f4"), 0.0
    for at, w, b in made.collect():
        weights[np.frombuffer(at, "<i4")] = np.frombuffer(w, "f4")
        bias = b
    return Model(weights, bias)


def scorer(model: Model):
    """A column function from a text to its score, a sparse dot product."""

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hashes = _Hashes()
        for batch in texts:
            yield pd.Series([model.score(features(t, hashes)) for t in batch], dtype="float64")

    return score


def classify(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    folds: int = 5, keep: float = KEEP,
) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; rows whose id falls into fold 0 teach nothing.

    A null or empty text has no features and gets the score of the bias. Labels other than 0 and 1, and labels of unknown
    documents, are left out; of several for one document the largest counts. Without labels every score is a half. Very
    long texts are scored whole, repeated rows alike. An empty table gives an empty result. Other columns are ignored.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    model = fitted(docs, labels, label_col, folds)
    rows = docs.select("doc_id", (crc_fold("doc_id", folds) == 0).alias("held_out"), scorer(model)("text").alias("score"))
    return rows.select("doc_id", "held_out", "score", (F.col("score") >= keep).cast("int").alias("predicted"))


def fitted(docs: DataFrame, labels: DataFrame, label_col: str = "quality", folds: int = 5) -> Model:
    taught = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    return fit(docs.select("doc_id", "text"), taught.filter(crc_fold("doc_id", folds) != 0))


def keep_good(docs: DataFrame, labels: DataFrame, keep: float = KEEP) -> DataFrame:
    """The documents, with all their columns, that score ``keep`` or more."""
    model = fitted(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels)
    return docs.filter(scorer(model)(F.col("text")) >= keep)
