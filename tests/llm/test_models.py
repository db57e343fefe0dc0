"""Trained operators: held-out accuracy, exact formulas against plain loops, odd rows."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.llm import ctw, quality_model, toxicity
from larder.llm.common import Lookup, prepare, word_hashes

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double"


@pytest.fixture(scope="module", autouse=True)
def ready(spark):
    prepare(spark)


def prose(rnd, n, more=()):
    words = ["".join(rnd.choice(("ka", "lo", "mi", "ten", "ru", "sa", "ve", "do")) for _ in range(rnd.randint(1, 3))) for _ in range(n)]
    for w in more:
        words.insert(rnd.randrange(len(words) + 1), w)
    return " ".join(words)


def docs_of(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "en", "s", 0, 0.0) for i, t in zip(ids or range(len(texts)), texts)], DOCS)


def test_word_hashes_split_as_the_pattern_does():
    import re

    rnd = random.Random(2)
    texts = ["a b", None, "", "  \n", "x y z", prose(rnd, 50), "é é"] + [prose(rnd, 400_000)]
    seen: dict = {}
    for first, last, hashes, offsets in word_hashes(texts):
        for i in range(first, last):
            words = re.findall(r"[^\x20\x09-\x0D]+", texts[i] or "")
            part = hashes[offsets[i - first]:offsets[i - first + 1]]
            assert len(words) == len(part), i
            for w, h in zip(words, part.tolist()):
                assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_lookup_finds_present_and_missing_keys():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 62, 5000).astype(np.uint64))
    table = Lookup(keys[::2])
    assert (table(keys[::2]) == np.arange(len(keys[::2]))).all() and (table(keys[1::2]) == -1).all()
    assert (Lookup(keys[:0])(keys[:3]) == -1).all()


# -- quality -------------------------------------------------------------------------

def test_quality_model_on_held_out_documents(spark):
    rnd = random.Random(3)
    good = [prose(rnd, 80) for _ in range(200)]
    bad = [" ".join(w + rnd.choice(("%%%", "&&&", "!!")) for w in prose(rnd, 80).split()) for _ in range(200)]
    rows = spark.createDataFrame([(i, t, int(i < 150)) for i, t in enumerate(good[:150] + bad[:150])], "id long, text string, label int")
    weights = quality_model.train(rows, bits=14)
    assert weights.tobytes() == quality_model.train(rows.repartition(3), bits=14).tobytes()
    texts = good[150:] + bad[150:] + [None, "", prose(rnd, 30_000), good[0], good[0]]
    got = {}
    for r in quality_model.score(docs_of(spark, texts, [None, *range(1, len(texts))]), weights, bits=14).collect():
        got.setdefault(r["id"] or 0, r["score"])
    assert sum((got[i] >= 0.5) == (i < 50) for i in range(100)) >= 98
    assert got[100] == got[101] == pytest.approx(1 / (1 + math.exp(-float(weights[-1])))) and got[103] == got[104]
    assert quality_model.score(docs_of(spark, ["x"]), np.zeros((1 << 14) + 1, "<f4"), bits=14).first()["score"] == 0.5
    assert len(quality_model.train(rows.limit(0), bits=14)) == (1 << 14) + 1


# -- CTW -------------------------------------------------------------------------------

def brute_ctw(train, texts, depth):
    """CTW from its definition: block probabilities by recursion over explicit contexts."""
    counts: dict = {}

    def walk(t):
        data = b"\xfe" * depth + t + b"\xff"
        for i in range(depth, len(data)):
            node = 1
            for j in range(7, -1, -1):
                yield data[i - depth:i], node, data[i] >> j & 1
                node = 2 * node + (data[i] >> j & 1)

    children: dict = {}
    for t in train:
        for ctx, node, bit in walk(t):
            for d in range(depth + 1):
                key = ctx[depth - d:], node
                counts.setdefault(key, [0, 0])[bit] += 1
                if d < depth:
                    children.setdefault(key, set()).add((ctx[depth - d - 1:], node))

    def kt(a, b):
        return math.lgamma(a + .5) + math.lgamma(b + .5) - math.lgamma(a + b + 1) - math.log(math.pi)

    block: dict = {}

    def weighted(key):
        if key not in counts:
            return 0.0
        if key not in block:
            own = kt(*counts[key])
            if len(key[0]) < depth:
                own = np.logaddexp(own, sum(weighted(c) for c in children[key])) - math.log(2)
            block[key] = own
        return block[key]

    def predict(ctx, node, bit, d=0):
        key = ctx[depth - d:], node
        n = counts.get(key, [0, 0])
        p = (n[bit] + .5) / (sum(n) + 1)
        if d == depth:
            return p
        stay = math.exp(kt(*n) - math.log(2) - weighted(key)) if key in counts else 0.5
        return stay * p + (1 - stay) * predict(ctx, node, bit, d + 1)

    return [sum(math.log10(predict(*x)) for x in walk(t)) for t in texts]


def test_ctw_equals_its_definition(spark):
    rnd = random.Random(5)
    texts = [prose(rnd, 12) for _ in range(14)] + ["", None, "É ñ ABC abc", "\n"]
    texts.append(texts[0])
    docs = docs_of(spark, texts, [None, *range(1, len(texts))])
    held = F.coalesce(F.col("doc_id") % 3 == 1, F.lit(False))
    got = ctw.score(docs, held, depth=3, block_bytes=200).collect()
    plain = [ctw.folded(t) for t in texts]
    train = [t for i, t in enumerate(plain) if i % 3 != 1]
    want = brute_ctw(train, plain, 3)
    assert len(got) == len(texts)
    assert sorted(r["score"] for r in got) == pytest.approx(sorted(want), rel=1e-7)
    words = [w for t in train for w in [*t.split(), None]]
    n, v = len(words), len(set(words))
    base = [sum(math.log10((words.count(w) + .5) / (n + .5 * (v + 1))) for w in [*t.split(), None]) for t in plain]
    assert sorted(r["base_score"] for r in got) == pytest.approx(sorted(base), rel=1e-9)
    by = {r["id"]: r for r in got}
    assert by[1]["held_out"] and not by[2]["held_out"] and by[14]["n_tokens"] == 1 and {r["train_tokens"] for r in got} == {n}
    assert by[1]["n_known"] == sum(w in words for w in [*plain[1].split(), None])


def test_ctw_default_depth_is_five_bytes(spark):
    rnd = random.Random(6)
    texts = [prose(rnd, 30) for _ in range(6)]
    got = ctw.score(docs_of(spark, texts), F.col("doc_id") % 3 == 1, block_bytes=400).collect()
    plain = [ctw.folded(t) for t in texts]
    want = brute_ctw([t for i, t in enumerate(plain) if i % 3 != 1], plain, 5)
    assert [r["score"] for r in sorted(got, key=lambda r: r["id"])] == pytest.approx(want, rel=1e-7)


def test_ctw_probabilities_sum_to_one(spark):
    """Over all next bytes of a seen and of an unseen context."""
    rows = [("ab" * 20,), ("abc",)]
    docs = spark.createDataFrame([(i, t) for i, (t,) in enumerate(rows)], "doc_id long, text string")
    keys = [(c << 8 | b, 0) for c in (0x6162, 0x7a7a) for b in range(256)]
    seen = [(int(k), 1) for t in ("ab" * 20, "abc") for _, _, ks, _ in ctw.grams([t.encode()], 2) for k in ks]
    counts = spark.createDataFrame(keys + seen, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    got = {r["gram"]: r["lp"] for r in ctw.code_lengths(counts, 2).collect()}
    for c in (0x6162, 0x7a7a):
        assert sum(math.exp(got[c << 8 | b]) for b in range(256)) == pytest.approx(1)
    assert docs.count() == 2


def test_ctw_without_training_texts_and_empty(spark):
    docs = docs_of(spark, ["ab", ""])
    got = ctw.score(docs, F.lit(True), depth=2).collect()
    assert sorted(r["score"] for r in got) == pytest.approx([-24 * math.log10(2), -8 * math.log10(2)])
    assert ctw.score(docs.limit(0), F.lit(False), depth=2).count() == 0
    long = docs_of(spark, [prose(random.Random(1), 500_000)])
    assert ctw.score(long, F.lit(False), depth=2).first()["score"] < 0


# -- toxicity ----------------------------------------------------------------------------

def test_toxicity_on_unseen_documents(spark):
    rnd = random.Random(7)
    bad = ("idiot", "moron", "scum", "trash")
    texts = [prose(rnd, 120, [rnd.choice(bad) for _ in range(4)]) for _ in range(150)] + [prose(rnd, 120) for _ in range(450)]
    rows = spark.createDataFrame([(i, t, int(i < 150)) for i, t in enumerate(texts)], "id long, text string, label int")
    new = [prose(rnd, 120, [rnd.choice(bad) for _ in range(3)]) for _ in range(40)] + [prose(rnd, 120) for _ in range(80)]
    new += [None, "", new[0], "  ", prose(rnd, 20_000)]
    docs = docs_of(spark, new, [None, *range(1, len(new))])
    got = {(r["id"] or 0): r for r in toxicity.score(docs, rows.where("id % 4 != 0"), rows.where("id % 4 = 0")).collect()}
    assert len(got) == len(new)
    assert sum((got[i]["score"] >= 0.5) == (i < 40) for i in range(120)) >= 110
    assert got[120]["z"] == got[121]["z"] == got[123]["z"] == 0 and got[122]["score"] == got[0]["score"]
    none = toxicity.score(docs, rows.where("label = 0"), rows.where("id % 4 = 0"))
    assert {r["score"] for r in none.collect()} == {0.5}
    assert toxicity.score(docs.limit(0), rows, rows).count() == 0


def test_toxicity_keeps_rare_entries_of_large_tables(spark):
    """More than 3 * 2 ** 20 training bigrams: words and bigrams of three occurrences stay."""
    rare = "rareone raretwo x"
    rows = (spark.range(400).select(F.concat(F.lit(rare), F.when(F.col("id") < 3, " z").otherwise(" y"), F.repeat(F.concat(F.lit(" k"), F.col("id") % 7), 9000)).alias("text"),
                                    (F.col("id") % 2).cast("int").alias("label"), "id")
            .withColumn("text", F.when(F.col("id") < 3, F.col("text")).otherwise(F.substring_index("text", rare, -1))))
    rows = rows.withColumn("text", F.concat("text", F.lit(" u"), "id"))
    model, _, _ = toxicity.train(rows.select("text", "label"), rows.where("id < 10").select("text", "label"))
    hashes = next(word_hashes([rare + " z u7 absent"]))[2]
    assert (Lookup(model.words)(hashes) >= 0).tolist() == [True] * 5 + [False]
    assert (Lookup(model.bigrams)(toxicity.bigram_keys(hashes))[1:4] >= 0).all()


def test_kneser_ney_conditionals_sum_to_one(spark):
    rnd = random.Random(9)
    rows = spark.createDataFrame([(prose(rnd, 40), i % 2) for i in range(30)], "text string, label int")
    words, bigrams = toxicity.count(rows)
    w, b = words.toPandas().sort_values("w"), bigrams.toPandas().sort_values(["v", "w"])
    model = toxicity.KneserNey(w, b, np.array([(w.k0).sum(), (w.k1).sum(), (w.ks).sum()], float),
                               np.array([np.minimum(w[k], toxicity.DISCOUNT).sum() for k in ("k0", "k1")], float), len(w))
    # every word and one place for all unknown ones
    unigram = model.base_estimates(np.append(np.arange(len(model.words)), -1))
    assert unigram.sum(axis=0) == pytest.approx([1, 1])
    index = toxicity.Lookup(model.bigrams)
    for v in range(0, len(model.words), 17):
        keys = toxicity.mix(model.words[v] * toxicity.PAIR + model.words)
        pair = index(keys)
        after, left = (x[0] for x in model.histories(np.array([v])))
        seen = model.discounted(pair) / after
        p = seen[:, :2] + left[:2] * (seen[:, 2:] + left[2:] * unigram[:-1])
        assert p.sum(axis=0) + left[:2] * left[2] * unigram[-1] == pytest.approx([1, 1])
