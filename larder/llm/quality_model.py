"""Quality classifier: logistic regression on hashed word uni- and bigrams,
trained with follow-the-regularised-leader (FTRL-proximal) updates.

Training reads at most ``max_rows`` labelled rows (the smallest by hash of the
id; whole texts) in one task, one update per document.  The weights, ``2 **
bits`` floats, are broadcast; scoring is a sparse dot product per document in
numpy, with no shuffle.

Nulls and oddities: null and empty texts are scored by the bias alone.  Labels
other than 0 and 1, and labels of unknown documents, are not used.  A document
with several labels counts once for each.  Repeated rows are scored one by
one; a null id is carried along and counts as the empty text in the hold-out
rule.  Without labelled rows every score is 0.5.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.common import mix, prepare, remainder, sums, table, word_hashes

BITS = 18
MAX_ROWS = 6000
PAIR = np.uint64(0x9E3779B97F4A7C15)


def features(hashes: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the uni- and bigrams of each text, and the offsets of the texts."""
    shift = np.uint64(64 - bits)
    n = len(hashes)
    keys = np.empty(2 * n, dtype=np.int64)
    keys[0::2] = (hashes >> shift).astype(np.int64)
    pairs = np.zeros(n, dtype=np.uint64)
    pairs[1:] = mix(hashes[:-1] * PAIR + hashes[1:])
    keys[1::2] = (pairs >> shift).astype(np.int64)
    begins = offsets[:-1][offsets[1:] > offsets[:-1]]
    keep = np.ones(2 * n, dtype=bool)
    keep[2 * begins + 1] = False  # the first word of a text ends no bigram
    first = np.concatenate(([0], np.cumsum(keep)))
    return keys[keep], first[2 * offsets]


def vector(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets with their square-root counts at unit length."""
    index, counts = np.unique(keys, return_counts=True)
    value = np.sqrt(counts)
    return index, value / max(1.0, np.sqrt((value * value).sum()))


class Ftrl:
    """FTRL-proximal state (z, n) per weight; index -1 is the bias."""

    def __init__(self, bits: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.05, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros((1 << bits) + 1)
        self.n = np.zeros((1 << bits) + 1)

    def weights(self, index) -> np.ndarray:
        z, n = self.z[index], self.n[index]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def update(self, index: np.ndarray, value: np.ndarray, label: int) -> None:
        index, value = np.append(index, -1), np.append(value, 1.0)
        w = self.weights(index)
        p = 1 / (1 + np.exp(-np.clip(w @ value, -35, 35)))
        g = (p - label) * value
        n = self.n[index]
        self.z[index] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[index] = n + g * g


def train(rows: DataFrame, bits: int = BITS, max_rows: int = MAX_ROWS, epochs: int = 2) -> np.ndarray:
    """Weights (bias last) from rows (id, text, label): the first ``max_rows`` by hash of the id."""
    def run(frames):
        model, held = Ftrl(bits), []
        for f in frames:
            texts, labels = list(f["text"]), list(f["label"])
            for first, last, hashes, offsets in word_hashes(texts):
                keys, at = features(hashes, offsets, bits)
                for i in range(first, last):
                    held.append((*vector(keys[at[i - first]:at[i - first + 1]]), labels[i]))
        for _ in range(epochs):
            for x in held:
                model.update(*x)
        w = model.weights(np.arange(len(model.z)))
        yield pd.DataFrame({"w": [w.astype("<f4").tobytes()]})

    sample = rows.where("label IN (0, 1)").orderBy(F.xxhash64("id", "text"), "id", "text", "label").limit(max_rows)
    got = sample.select("text", F.col("label").cast("int").alias("label")).coalesce(1).mapInPandas(run, "w binary").collect()
    return np.frombuffer(bytes(got[0][0]), "<f4") if got else np.zeros((1 << bits) + 1, dtype="<f4")


def score(docs: DataFrame, weights: np.ndarray, ident: str = "doc_id", text: str = "text", bits: int = BITS) -> DataFrame:
    """(id, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # (2 ** bits + 1) floats

    def run(frames):
        w = shared.value
        for f in frames:
            out = np.zeros(len(f))
            for first, last, hashes, offsets in word_hashes(list(f["text"])):
                keys, at = features(hashes, offsets, bits)
                # distinct (text, bucket) pairs with their counts
                owner = np.repeat(np.arange(last - first, dtype=np.int64), np.diff(at))
                pairs, counts = np.unique((owner << bits) | keys, return_counts=True)
                value, whose = np.sqrt(counts), pairs >> bits
                begins = np.searchsorted(whose, np.arange(last - first + 1))
                dot = sums(value * w[pairs & ((1 << bits) - 1)], begins)
                out[first:last] = dot / np.maximum(1.0, np.sqrt(sums(value * value, begins)))
            yield pd.DataFrame({"id": f["id"].tolist(), "score": 1 / (1 + np.exp(-np.clip(out + w[-1], -35, 35)))})

    # The id travels as text: pandas would turn a column with nulls into floats.
    kind = docs.schema[ident].dataType.simpleString()
    return docs.select(F.col(ident).cast("string").alias("id"), F.col(text).alias("text")).mapInPandas(run, "id string, score double").withColumn(
        "id", F.col("id").cast(kind))


def learn_rows(docs: DataFrame, labels: DataFrame, label: str, held: Column) -> DataFrame:
    """(id, text, label) of the labelled rows outside the hold-out."""
    marks = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held).select(
        F.col("doc_id").alias("id"), F.col(label).alias("label"))
    return docs.select(F.col("doc_id").alias("id"), "text").join(marks, "id")


def bounded(labels: DataFrame, max_rows: int) -> DataFrame:
    """At most ``max_rows`` labelled ids, the smallest by hash."""
    return labels.orderBy(F.xxhash64("doc_id"), "doc_id", *[c for c in labels.columns if c != "doc_id"]).limit(max_rows)


def op5_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where("quality IN (0, 1)").select("doc_id", "quality")
    held = remainder(F.col("doc_id"), 3) == 1
    # The sampled ids are at most MAX_ROWS, so their broadcast is bounded and the texts stay where they are.
    chosen = F.broadcast(bounded(labels.where(~held & F.col("doc_id").isNotNull()), MAX_ROWS))
    weights = train(learn_rows(docs, chosen, "quality", held))
    return score(docs, weights).select(
        F.col("id").alias("doc_id"), (remainder(F.col("id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
