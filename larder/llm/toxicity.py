"""Toxicity from class-conditional Kneser-Ney models.

Two interpolated Kneser-Ney bigram models, one of toxic and one of ordinary
labelled documents, are compared: a text's evidence is the mean over its words
of ln P(word | toxic) - ln P(word | ordinary).  Each model discounts its bigram
counts, backs off to the bigram counts of both classes together, then to its
own continuation counts, and these to the continuation counts of both classes,
so that an expression rare in either class counts for little.  Differences within ``DEAD_ZONE`` nats of an
unknown word's are as likely a matter of subject or language and count as
zero.  A logistic fit on the logarithm of the evidence, over labelled documents
that the counts have not seen, turns it into a score.

Counting runs in Spark over at most ``MAX_ROWS`` labelled documents (the
smallest by hash), the fit over as many others.  All words of these and all
bigrams that the discount leaves anything of are kept: that bound limits both
tables, so they may be broadcast; scoring has no shuffle.

Nulls and oddities: null and wordless texts have evidence zero.  Repeated rows
are scored one by one; equal training texts count once.  A null id is carried
along and counts as the empty text in the hold-out rule.  Where a class has no
labelled documents every score is 0.5 (and so every prediction 1).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.common import FOLD, Lookup, mix, prepare, remainder, sums, table, word_hashes

MAX_ROWS = 20_000
DISCOUNT = 2
DEAD_ZONE = 1.5
ROWS = 512  # texts taken from Arrow at a time
UNIT = 1e-3  # evidence from which its logarithm counts
PAIR = np.uint64(0x9E3779B97F4A7C15)
PUNCTUATION = str.maketrans({c: " " for c in ".,;:!?\"'()[]{}"})


def expressions(texts: list) -> list[str]:
    """A-Z folded, punctuation as white space."""
    return [(t or "").translate(FOLD).translate(PUNCTUATION) for t in texts]


def bigram_keys(hashes: np.ndarray) -> np.ndarray:
    """Key of each word with the one before it; the first has none before."""
    out = hashes.copy()
    out[1:] = mix(hashes[:-1] * PAIR + hashes[1:])
    return out


def count(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From (text, label): words (w, k0, k1, ks, n, n0, n1, t0, t1, ts) and bigrams (v, w, n0, n1).

    k: different predecessors of w in each class and in both; n: occurrences of w
    after a word; n0, n1: words after w; t0, t1, ts: what the discount
    takes from these and from both together."""
    def run(frames):
        for f in frames:
            for label in (0, 1):
                for _, _, hashes, offsets in word_hashes(expressions(f["text"][f["label"] == label].tolist())):
                    inner = np.ones(len(hashes), dtype=bool)
                    inner[offsets[:-1][offsets[1:] > offsets[:-1]]] = False
                    at = np.flatnonzero(inner)
                    pairs, n = np.unique(np.stack([hashes[at - 1], hashes[at]], axis=1), axis=0, return_counts=True)
                    yield pd.DataFrame({"v": pairs[:, 0].view(np.int64), "w": pairs[:, 1].view(np.int64),
                                        "n0": n * (label == 0), "n1": n * (label == 1)})

    got = rows.select("text", "label").distinct().mapInPandas(run, "v bigint, w bigint, n0 bigint, n1 bigint")
    bigrams = got.groupBy("v", "w").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).checkpoint()
    seen = [F.count(F.when(F.col(c) > 0, 1)) for c in ("n0", "n1")]
    taken = [F.sum(F.least(c, F.lit(DISCOUNT))) for c in (F.col("n0"), F.col("n1"), F.col("n0") + F.col("n1"))]
    after = bigrams.groupBy(F.col("v").alias("w")).agg(
        F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), taken[0].alias("t0"), taken[1].alias("t1"), taken[2].alias("ts"))
    before = bigrams.groupBy("w").agg(seen[0].alias("k0"), seen[1].alias("k1"), F.count("*").alias("ks"), (F.sum("n0") + F.sum("n1")).alias("n"))
    return before.join(after, "w", "full").na.fill(0), bigrams


def fit_line(z: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Logistic fit of y on z by damped Newton steps: (slope, offset)."""
    if not len(z) or y.min() == y.max():
        return 1.0, 0.0
    scale = max(float(z.std()), 1e-9)
    x = np.stack([z / scale, np.ones_like(z)], axis=1)
    beta = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -35, 35)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-2, 1e-3])
        beta += np.clip(np.linalg.solve(h, x.T @ (y - p) - np.array([1e-2, 1e-3]) * beta), -2, 2)
    return max(float(beta[0] / scale), 1e-6), float(beta[1])


def narrow(table, names: tuple) -> np.ndarray:
    """Columns of counts side by side and a row of zeros at the end, in 32 bits if they fit."""
    columns = [np.asarray(table[c]) for c in names]
    kind = np.int32 if all(c.max(initial=0) < 1 << 31 for c in columns) else np.int64
    out = np.zeros((len(columns[0]) + 1, len(columns)), dtype=kind)
    for i, c in enumerate(columns):
        out[:-1, i] = c
    return out


class KneserNey:
    """Both models as counts: words with their continuations and what follows them,
    bigrams with their occurrences.  Estimates are made from them as they are
    needed; the row at -1 belongs to any other word or bigram."""

    WORD = ("k0", "k1", "ks", "n0", "n1", "t0", "t1", "ts")

    def __init__(self, words, bigrams, types: np.ndarray, taken: np.ndarray, kinds: int):
        # types: different bigrams of class 0, class 1 and both; taken: what the
        # discount takes from the words' continuation counts of either class
        unsigned = [np.asarray(t[c]).astype(np.int64, copy=False).view(np.uint64) for t, c in ((words, "w"), (bigrams, "v"), (bigrams, "w"))]
        by = np.argsort(unsigned[0].view(np.int64), kind="stable")
        self.words, self.word_counts = unsigned[0][by], narrow(words, self.WORD)
        self.word_counts[:-1] = self.word_counts[:-1][by]
        self.bigrams, first = np.unique(mix(unsigned[1] * PAIR + unsigned[2]), return_index=True)
        counts = narrow(bigrams, ("n0", "n1"))
        self.bigram_counts = counts[np.append(first, len(counts) - 1)]
        self.base, self.own, self.taken = types[2] + 0.5 * (kinds + 1), np.maximum(types[:2], 1), taken
        p = self.base_estimates(np.array([-1]))[0]
        self.neutral = float(np.log(p[1] / p[0]))  # of a word that neither class knows
        self.index = None

    def base_estimates(self, w: np.ndarray) -> np.ndarray:
        """Of each word in either class, whatever stands before it."""
        c = self.word_counts[w].astype(float)
        return (np.maximum(c[:, :2] - DISCOUNT, 0) + self.taken * ((c[:, 2:3] + 0.5) / self.base)) / self.own

    def histories(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each word as a history, in class 0, class 1 and both: its occurrences, and
        the share of their probability that goes to the next estimate."""
        c = self.word_counts[v].astype(float)
        n = np.column_stack([c[:, 3:5], c[:, 3] + c[:, 4]])
        return np.maximum(n, 1), np.where(n > 0, c[:, 5:] / np.maximum(n, 1), 1.0)

    def discounted(self, pair: np.ndarray) -> np.ndarray:
        """Counts of each bigram in class 0, class 1 and both, less the discount."""
        c = self.bigram_counts[pair].astype(float)
        return np.maximum(np.column_stack([c, c.sum(axis=1)]) - DISCOUNT, 0)

    def evidence(self, texts: list) -> np.ndarray:
        """Mean log-likelihood ratio per word of each text."""
        if self.index is None:
            self.index = Lookup(self.words), Lookup(self.bigrams)
        out = np.zeros(len(texts))
        for first, last, hashes, offsets in word_hashes(expressions(texts)):
            if not len(hashes):
                continue
            begins = offsets[:-1][offsets[1:] > offsets[:-1]]
            w = self.index[0](hashes)
            v = np.concatenate(([-1], w[:-1]))
            pair = self.index[1](bigram_keys(hashes))
            v[begins], pair[begins] = -1, -1
            after, left = self.histories(v)
            seen = self.discounted(pair) / after
            p = seen[:, :2] + left[:, :2] * (seen[:, 2:] + left[:, 2:] * self.base_estimates(w))
            ratio = np.log(p[:, 1]) - np.log(p[:, 0]) - self.neutral
            ratio = np.sign(ratio) * np.maximum(np.abs(ratio) - DEAD_ZONE, 0)
            out[first:last] = sums(ratio, offsets) / np.maximum(1, np.diff(offsets))
        return out


def train(rows: DataFrame, fit_rows: DataFrame) -> tuple[KneserNey | None, float, float]:
    """Count on ``rows`` (text, label), fit the line on ``fit_rows``; both are bounded samples."""
    words, bigrams = count(rows)
    words = words.checkpoint()
    total = words.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("k0", "k1", "ks", "n")],
                      *[F.coalesce(F.sum(F.least(F.col(c), F.lit(DISCOUNT))), F.lit(0)) for c in ("k0", "k1")], F.count("*")).first()
    if not total[0] or not total[1]:
        return None, 1.0, 0.0
    # Other bigrams are discounted to zero in either class and in both together.  Arrow
    # brings the columns as they are: no rows or frames of them in the driver.
    kept = bigrams.where(F.col("n0") + F.col("n1") > DISCOUNT).select("v", "w", "n0", "n1")
    model = KneserNey(words.select("w", *KneserNey.WORD).toArrow(), kept.toArrow(), np.array(total[:3], float), np.array(total[4:6], float), total[6])
    pa.default_memory_pool().release_unused()
    seen = evidence(fit_rows.select("label", "text"), model, "label").toPandas()
    z = seen["z"].to_numpy()
    return model, *fit_line(np.sign(z) * np.log1p(np.abs(z) / UNIT), seen["id"].to_numpy(float))


def evidence(docs: DataFrame, model: KneserNey, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, z) of every row: the mean log-likelihood ratio per word."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shared.value.evidence(part.column(1).to_pylist()))], names=["id", "z"])

    kind = docs.schema[ident].dataType.simpleString()
    return docs.select(F.col(ident).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, z double")


def score(docs: DataFrame, rows: DataFrame, fit_rows: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, z, score) of every row."""
    model, slope, offset = train(rows, fit_rows)
    if model is None:
        return docs.select(F.col(ident).alias("id"), F.lit(0.0).alias("z"), F.lit(0.5).alias("score"))
    x = F.signum("z") * F.log1p(F.abs("z") / UNIT)
    return evidence(docs, model, ident, text).withColumn("score", 1 / (1 + F.exp(-(x * slope + offset))))


def bounded(labels: DataFrame, max_rows: int) -> DataFrame:
    """At most ``max_rows`` labelled ids, the smallest by hash."""
    return labels.orderBy(F.xxhash64("id"), "id", "label").limit(max_rows)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = remainder(F.col("id"), 5)
    labels = (
        table(spark, sf_dir, "labels").where("toxic IN (0, 1) AND doc_id IS NOT NULL")
        .select(F.col("doc_id").alias("id"), F.col("toxic").alias("label"), remainder(F.col("doc_id"), 5).alias("fold")).where("fold != 0")
    )
    texts = docs.select(F.col("doc_id").alias("id"), "text")
    # Both samples are bounded lists of ids: their broadcast leaves the texts where they are.
    rows = texts.join(F.broadcast(bounded(labels.where("fold != 4"), MAX_ROWS)), "id")
    scored = score(docs, rows, texts.join(F.broadcast(bounded(labels.where("fold = 4"), MAX_ROWS)), "id"))
    return scored.select(F.col("id").alias("doc_id"), (held == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "z")
